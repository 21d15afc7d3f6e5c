"""Inputs that must not drive a model."""

from __future__ import annotations

from collections.abc import Sequence

# Inputs the regulator does not allow in a default-probability model.
PD_FORBIDDEN_FEATURES = ("state_code", "gender", "religion")


def guard_forbidden(
    continuous: Sequence[str], categorical: Sequence[str], forbidden: Sequence[str] | None
) -> None:
    """Raise when a forbidden feature is listed; an empty list opts out."""
    present = sorted(set(forbidden or ()) & {*continuous, *categorical})
    if present:
        raise ValueError(
            f"Forbidden: {', '.join(present)}; assembly leaves such features out unless told otherwise"
        )
