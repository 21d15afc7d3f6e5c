"""Scalar statistics evaluated once per metric on the driver."""

from __future__ import annotations

import math


def chi2_upper_tail(x: float, dof: int) -> float:
    """P(X >= x) for a chi-square variable with an integer number of degrees.

    Even dof: the finite Poisson sum. Odd dof: erfc plus the half-integer terms.
    """
    if dof < 1:
        raise ValueError(f"dof must be >= 1; got {dof}")
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    half = x / 2.0
    log_half = math.log(half)
    if dof % 2 == 0:
        terms = (i * log_half - half - math.lgamma(i + 1) for i in range(dof // 2))
        return min(1.0, math.fsum(math.exp(t) for t in terms))
    tail = math.erfc(math.sqrt(half))
    terms = (
        (i + 0.5) * log_half - half - math.lgamma(i + 1.5) for i in range((dof - 1) // 2)
    )
    return min(1.0, tail + math.fsum(math.exp(t) for t in terms))


def interpolate(low: float, high: float, weight: float) -> float:
    """Linear interpolation between two order statistics."""
    if low == high or weight == 0.0:
        return low
    return low + (high - low) * weight
