"""Preprocessing of the feature matrix for tree and neural models.

Fitting takes one exact-quantile pass and one level count for all columns;
applying a fitted step is a single projection.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.util import MLReader, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.functions.nulls import number
from loanloom.operators.governance import PD_FORBIDDEN_FEATURES, guard_forbidden
from loanloom.operators.levels import level_counts, level_text
from loanloom.operators.quantiles import exact_quantiles
from loanloom.operators.woe import WOEEncoder

MODEL_TYPES = ("scorecard", "tree", "neural")
# Codes and one-hot columns are literals of the plan, so the levels must be listable.
MAX_LISTED_LEVELS = 10_000


def _clean(name: str) -> Column:
    return F.nanvl(number(name), F.lit(None).cast("double"))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` persisted for the several passes of a fit, so that its plan runs once."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


class StoredState:
    """Writing and reading of models whose state is a few plain values.

    The state is one JSON text, written and read by Spark, so any file system will do.
    """

    def state(self) -> dict:
        raise NotImplementedError

    @classmethod
    def from_state(cls, state: dict):
        return cls(**state)

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def load(cls, path: str):
        return cls.read().load(path)


class _StateWriter(MLWriter):
    def __init__(self, model: StoredState) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        text = json.dumps(self.model.state())
        self.sparkSession.createDataFrame([(text,)], "state string").coalesce(1).write.parquet(f"{path}/state")


class _StateReader(MLReader):
    def __init__(self, kind: type[StoredState]) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        return self.kind.from_state(json.loads(self.sparkSession.read.parquet(f"{path}/state").first()["state"]))


# ------------------------------------------------------------------ IQR clipping


class IQRClipper(Estimator):
    """Learns [Q1 - k IQR, Q3 + k IQR] per column and clips to it later."""

    def __init__(self, columns: Sequence[str], k: float = 1.5) -> None:
        super().__init__()
        self.columns = list(columns)
        self.k = k

    def _fit(self, df: DataFrame) -> IQRClipperModel:
        with kept(df.select(*[_clean(c).alias(c) for c in self.columns])) as cleaned:
            quartiles = exact_quantiles(cleaned, self.columns, [0.25, 0.75])
        return IQRClipperModel(iqr_bounds(quartiles, self.k))


def iqr_bounds(
    quartiles: dict[str, list[float] | None], k: float
) -> dict[str, tuple[float, float]]:
    bounds = {}
    for c, q in quartiles.items():
        if q is not None:
            spread = k * (q[1] - q[0])
            bounds[c] = (q[0] - spread, q[1] + spread)
    return bounds


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


class IQRClipperModel(StoredState, Model):
    def __init__(self, bounds: dict[str, tuple[float, float]]) -> None:
        super().__init__()
        self.bounds = {c: tuple(b) for c, b in bounds.items()}

    def state(self) -> dict:
        return {"bounds": self.bounds}

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip(_clean(c), *b) for c, b in self.bounds.items()})


# ------------------------------------------------------------- levels and modes


@dataclass(frozen=True)
class Levels:
    """Sorted levels of a categorical column and its most frequent one."""

    ordered: list[str]
    mode: str


def _plain_levels(levels: dict[str, Levels]) -> dict[str, dict]:
    return {c: asdict(v) for c, v in levels.items()}


def learn_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, Levels]:
    """Levels per column; columns without any value are left out.

    Numeric columns sort by number. The most frequent level wins the
    imputation, the smallest one on a tie.
    """
    if not columns:
        return {}
    counts = level_counts(df, columns, {}).where("level IS NOT NULL").persist()
    try:
        sizes = counts.groupBy("feature").count().where(F.col("count") > MAX_LISTED_LEVELS)
        too_many = sorted(r["feature"] for r in sizes.collect())
        if too_many:
            raise ValueError(
                f"Too many levels to list for {too_many}; encode such columns by weight of evidence."
            )
        per: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
        for r in counts.collect():  # at most MAX_LISTED_LEVELS rows per column
            per[r["feature"]].append((r["level"], r["n"]))
    finally:
        counts.unpersist()
    out = {}
    for c, found in per.items():
        if not found:
            continue
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        order = (lambda kv: float(kv[0])) if numeric else (lambda kv: kv[0])
        found.sort(key=order)
        out[c] = Levels([k for k, _ in found], max(found, key=lambda kv: kv[1])[0])
    return out


def _imputed_level(df: DataFrame, name: str, levels: Levels) -> Column:
    return F.coalesce(level_text(df, name), F.lit(levels.mode))


# ------------------------------------------------------------------------- tree


class TreePreprocessor(Estimator):
    """Median for continuous columns; most frequent level, then its sorted position."""

    def __init__(self, continuous: Sequence[str], categorical: Sequence[str]) -> None:
        super().__init__()
        self.continuous, self.categorical = list(continuous), list(categorical)

    def _fit(self, df: DataFrame) -> TreePreprocessorModel:
        with kept(df.select(*self.continuous, *self.categorical)) as needed:
            cleaned = needed.select(*[_clean(c).alias(c) for c in self.continuous])
            medians = exact_quantiles(cleaned, self.continuous, [0.5])
            levels = learn_levels(needed, self.categorical)
        return TreePreprocessorModel({c: q[0] for c, q in medians.items() if q is not None}, levels)


class TreePreprocessorModel(StoredState, Model):
    """Replaces the features by doubles without nulls; other columns pass through.

    A level not seen during fit becomes -1.
    """

    def __init__(self, medians: dict[str, float], levels: dict[str, Levels]) -> None:
        super().__init__()
        self.medians, self.levels = medians, levels

    def state(self) -> dict:
        return {"medians": self.medians, "levels": _plain_levels(self.levels)}

    @classmethod
    def from_state(cls, state: dict) -> TreePreprocessorModel:
        return cls(state["medians"], {c: Levels(**v) for c, v in state["levels"].items()})

    @property
    def output_names(self) -> list[str]:
        return [*self.medians, *self.levels]

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {c: F.coalesce(_clean(c), F.lit(m)) for c, m in self.medians.items()}
        for c, lv in self.levels.items():
            codes = F.create_map(
                *[F.lit(x) for i, k in enumerate(lv.ordered) for x in (k, float(i))]
            )
            out[c] = F.coalesce(codes[_imputed_level(df, c, lv)], F.lit(-1.0))
        return df.withColumns(out)


# ----------------------------------------------------------------------- neural


class NeuralPreprocessor(Estimator):
    """Median, IQR clip and population z-score; one 0/1 column per level."""

    def __init__(
        self, continuous: Sequence[str], categorical: Sequence[str], iqr_k: float = 1.5
    ) -> None:
        super().__init__()
        self.continuous, self.categorical, self.iqr_k = list(continuous), list(categorical), iqr_k

    def _fit(self, df: DataFrame) -> NeuralPreprocessorModel:
        with kept(df.select(*self.continuous, *self.categorical)) as needed:
            return self._fit_kept(needed)

    def _fit_kept(self, df: DataFrame) -> NeuralPreprocessorModel:
        cleaned = df.select(*[_clean(c).alias(c) for c in self.continuous])
        rows = cleaned.count()
        medians = {
            c: q[0]
            for c, q in exact_quantiles(cleaned, self.continuous, [0.5], rows=rows).items()
            if q is not None
        }
        kept = list(medians)
        # quartiles are taken after imputation, so the median mass counts
        imputed = cleaned.select(*[F.coalesce(c, F.lit(medians[c])).alias(c) for c in kept])
        bounds = iqr_bounds(exact_quantiles(imputed, kept, [0.25, 0.75], rows=rows), self.iqr_k)
        scales: dict[str, tuple[float, float]] = {}
        if kept:
            clipped = imputed.select(*[clip(F.col(c), *bounds[c]).alias(c) for c in kept])
            row = clipped.agg(
                *[F.avg(c).alias(f"m_{c}") for c in kept],
                *[F.stddev_pop(c).alias(f"s_{c}") for c in kept],
            ).first()
            for c in kept:
                mean, std = row[f"m_{c}"], row[f"s_{c}"]
                # rounding noise on a constant column must not be scaled up
                constant = std <= 1e-12 * max(1.0, abs(mean))
                scales[c] = (mean, 1.0 if constant else std)
        return NeuralPreprocessorModel(medians, bounds, scales, learn_levels(df, self.categorical))


class NeuralPreprocessorModel(StoredState, Model):
    """Scaled columns keep their name; level columns are ``<feature>_<level>``."""

    def __init__(self, medians, bounds, scales, levels: dict[str, Levels]) -> None:
        super().__init__()
        self.medians, self.bounds, self.scales, self.levels = medians, bounds, scales, levels

    def state(self) -> dict:
        return {"medians": self.medians, "bounds": self.bounds, "scales": self.scales, "levels": _plain_levels(self.levels)}

    @classmethod
    def from_state(cls, state: dict) -> NeuralPreprocessorModel:
        return cls(state["medians"], state["bounds"], state["scales"], {c: Levels(**v) for c, v in state["levels"].items()})

    @property
    def output_names(self) -> list[str]:
        return [*self.scales, *(f"{c}_{k}" for c, lv in self.levels.items() for k in lv.ordered)]

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (mean, std) in self.scales.items():
            value = clip(F.coalesce(_clean(c), F.lit(self.medians[c])), *self.bounds[c])
            out[c] = (value - F.lit(mean)) / F.lit(std)
        for c, lv in self.levels.items():
            level = _imputed_level(df, c, lv)
            for k in lv.ordered:
                out[f"{c}_{k}"] = (level == F.lit(k)).cast("double")
        return df.withColumns(out)


# ------------------------------------------------------------------ entry point


def build_pd_feature_pipeline(
    model_type: str,
    continuous: Sequence[str],
    categorical: Sequence[str],
    *,
    target: str = "default_flag_12m",
    forbidden_features: Sequence[str] | None = PD_FORBIDDEN_FEATURES,
    n_bins: int = 10,
    iqr_k: float = 1.5,
) -> Estimator:
    """The preprocessing estimator of a model family.

    Forbidden features in the lists raise; pass ``forbidden_features=()`` to
    allow them, as for loss-given-default models.
    """
    if model_type not in MODEL_TYPES:
        raise ValueError(f"model_type must be one of {MODEL_TYPES}; got {model_type!r}")
    guard_forbidden(continuous, categorical, forbidden_features)
    if model_type == "scorecard":
        return WOEEncoder(
            target,
            features=[*continuous, *categorical],
            continuous=continuous,
            categorical=categorical,
            n_bins=n_bins,
            forbidden=forbidden_features,
        )
    if model_type == "tree":
        return TreePreprocessor(continuous, categorical)
    return NeuralPreprocessor(continuous, categorical, iqr_k)
