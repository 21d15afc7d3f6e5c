"""Stability and drift measures between a baseline and a current population."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.nulls import number
from loanloom.operators.metrics import discrimination_by, score_curve, slice_cuts
from loanloom.operators.preprocess import kept
from loanloom.operators.quantiles import SINGLE_PASS_ROWS, bin_counts, exact_quantiles

# Thresholds of the monitoring policy.
PSI_ALERT, PSI_RETRAIN = 0.25, 0.40
KS_SHIFT_ALERT = 0.20
GINI_DROP_ALERT_PP = 5.0
CALIBRATION_TOLERANCE = 0.20
SHARE_FLOOR = 1e-4


@dataclass(frozen=True)
class Populations:
    """Baseline and current rows of one DataFrame, told apart by a condition."""

    df: DataFrame
    is_baseline: Column


def share_table(
    populations: Populations, features: Sequence[str], *, n_bins: int = 10,
    single_pass_rows: int = SINGLE_PASS_ROWS,
) -> DataFrame:
    """Rows per feature and baseline-quantile bin in both populations, with shares.

    The populations are computed once and kept for the quantiles of the baseline and one count
    over both for all features. Bin 0 .. n; nulls form the bin -1.
    """
    none = F.lit(None).cast("double")
    cleaned = populations.df.select(
        populations.is_baseline.alias("_base"), *[F.nanvl(number(c), none).alias(c) for c in features]
    )
    grid = [i / n_bins for i in range(n_bins + 1)]
    with kept(cleaned) as rows:
        edges = exact_quantiles(
            rows.where("_base"), list(features), grid, single_pass_rows=single_pass_rows
        )
        cuts = {c: sorted(set(q))[1:-1] if q else [] for c, q in edges.items()}
        counts = bin_counts(rows, cuts, [F.col("_base"), ~F.col("_base")])
    table = populations.df.sparkSession.createDataFrame(
        [(c, -1 if b is None else b, *n[1:]) for c in features for b, n in counts[c].items()],
        "feature string, bin int, n_baseline bigint, n_current bigint",
    )
    totals = table.groupBy("feature").agg(
        F.sum("n_baseline").alias("_nb"), F.sum("n_current").alias("_nc")
    )
    return table.join(totals, "feature").select(
        "feature",
        "bin",
        "n_baseline",
        "n_current",
        (F.col("n_baseline") / F.nullif("_nb", F.lit(0))).alias("baseline_share"),
        (F.col("n_current") / F.nullif("_nc", F.lit(0))).alias("current_share"),
    )


def stability_index(shares: DataFrame) -> DataFrame:
    """PSI (of a score) or CSI (of a feature) per feature, with its status."""
    e = F.greatest("baseline_share", F.lit(SHARE_FLOOR))
    a = F.greatest("current_share", F.lit(SHARE_FLOOR))
    psi = shares.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    status = (
        F.when(F.col("psi") >= PSI_RETRAIN, "retrain")
        .when(F.col("psi") >= PSI_ALERT, "alert")
        .otherwise("stable")
    )
    return psi.withColumn("status", status)


def jensen_shannon(shares: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (natural log) per feature on the same bins."""
    e, a = F.col("baseline_share"), F.col("current_share")
    m = (e + a) / 2.0

    def part(p: Column) -> Column:
        return F.when(p > 0, p * F.log(p / m)).otherwise(F.lit(0.0))

    return shares.groupBy("feature").agg(F.sum((part(e) + part(a)) / 2.0).alias("js_divergence"))


def two_sample_ks(populations: Populations, score: str, *, rows_per_slice: int = 1_000_000) -> DataFrame:
    """Largest gap between the two score distributions; same plan as the model KS."""
    ys = populations.df.select(
        populations.is_baseline.cast("double").alias("y"), F.col(score).cast("double").alias("s")
    ).where("s IS NOT NULL AND NOT isnan(s)")
    curve = score_curve(ys, slice_cuts(ys, ys.count(), rows_per_slice))
    gap = F.abs(F.col("cum_bad") / F.col("nb") - F.col("cum_good") / F.col("ng"))
    return curve.agg(F.max(gap).alias("ks")).withColumn(
        "alert", F.coalesce(F.col("ks") >= KS_SHIFT_ALERT, F.lit(False))
    )


def cohort_performance(
    df: DataFrame,
    *,
    target: str,
    probability: str,
    cohort: Column,
    baseline_gini: float,
    rows_per_slice: int = 1_000_000,
) -> DataFrame:
    """Gini, KS and Brier per cohort; a Gini drop above the limit is flagged."""
    keyed = df.select(
        cohort.alias("cohort"),
        F.col(target).cast("double").alias("y"),
        F.col(probability).cast("double").alias("p"),
    ).persist(StorageLevel.MEMORY_AND_DISK)  # read by the curves and the error; scoring happens once
    ranked = discrimination_by(keyed, "y", "p", ["cohort"], rows_per_slice=rows_per_slice)
    error = F.col("p") - F.col("y")
    brier = keyed.groupBy("cohort").agg(F.avg(error * error).alias("brier"))
    drop = (F.lit(baseline_gini) - F.col("gini")) * 100.0
    return ranked.join(brier, "cohort").select(
        "cohort",
        "n",
        "n_default",
        "gini",
        "ks",
        "brier",
        F.coalesce(drop > GINI_DROP_ALERT_PP, F.lit(False)).alias("degraded"),
    )


def calibration_by_grade(
    df: DataFrame, *, target: str, probability: str, grade: Column, tolerance: float = CALIBRATION_TOLERANCE
) -> DataFrame:
    """Observed over predicted default rate per score grade, within a tolerance or not."""
    y, p = F.col(target).cast("double"), F.col(probability).cast("double")
    rates = df.groupBy(grade.alias("grade")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("actual"), F.avg(p).alias("predicted")
    )
    found = F.when(F.col("predicted") > 0, F.col("actual") / F.col("predicted"))
    return rates.withColumn("ratio", found).withColumn(
        "within", F.coalesce(F.abs(F.col("ratio") - 1.0) <= tolerance, F.lit(False))
    )


def _pair_sums(features: Sequence[str], shifts: dict[str, float]):
    """Per batch and pair of features: rows that have both, their sums, squares and products."""

    def run(batches):
        width = len(features)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x -= np.array([shifts[c] for c in features])
            there = np.isfinite(x)
            x = np.where(there, x, 0.0)
            m = there.astype(float)
            parts = [m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x]
            i, j = np.divmod(np.arange(width * width), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i), pa.array(j), *[pa.array(p.ravel()) for p in parts]], names=["i", "j", "n", "sx", "sxx", "sxy"]
            )

    return run


def pair_sums(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, ...]:
    """Rows, sums, squares and products per pair of features, over the rows that have both.

    Values count from the mean of their feature. One pass of partial sums per batch, added
    up per pair of features.
    """
    features = list(features)
    values = df.select(*[number(c).alias(c) for c in features])
    middle = values.agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in features]).first()
    shifts = {c: middle[c] if middle[c] is not None else 0.0 for c in features}
    sums = values.mapInArrow(
        _pair_sums(features, shifts), "i long, j long, n double, sx double, sxx double, sxy double"
    )
    names = ("n", "sx", "sxx", "sxy")
    total = {c: np.zeros((len(features), len(features))) for c in names}
    for r in sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect():  # one row per pair
        for c in names:
            total[c][r["i"], r["j"]] = r[c]
    return tuple(total[c] for c in names)


def pair_correlations(n: np.ndarray, sx: np.ndarray, sxx: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Pearson correlation of every pair of features over the rows that have both.

    NaN where fewer than two rows have both or one of them is constant there.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = sxx - sx * sx / n
        flat = spread <= 1e-12 * sxx
        found = (sxy - sx * sx.T / n) / np.sqrt(spread * spread.T)
    found[flat | flat.T | (n < 2)] = np.nan
    return np.clip(found, -1.0, 1.0)


def inflation_factors(sxx: np.ndarray, sxy: np.ndarray, *, tolerance: float = 1e-9) -> np.ndarray:
    """Variance inflation per feature; infinite for features that others determine.

    A missing value counts as the mean of its feature, so every row takes part and the
    matrix is a true correlation matrix. Features that take part in a null direction of it
    are collinear; the others are read off the inverse on the rest. Never below 1; a
    constant feature has 1.
    """
    size = np.sqrt(np.diag(sxx))
    with np.errstate(divide="ignore", invalid="ignore"):
        matrix = np.where((size[:, None] > 0) & (size > 0), sxy / (size[:, None] * size), 0.0)
    np.fill_diagonal(matrix, 1.0)
    values, vectors = np.linalg.eigh(matrix)
    null = values <= tolerance * max(1.0, values[-1])
    collinear = (np.abs(vectors[:, null]) > 1e-6).any(axis=1)
    inverse = (vectors[:, ~null] ** 2 / values[~null]).sum(axis=1)
    return np.where(collinear, np.inf, np.maximum(inverse, 1.0))


def correlation_and_vif(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Pearson correlations of all feature pairs, and the inflation factor per feature.

    A pair is correlated over the rows that have both features, so a missing
    value drops nothing else; for the factors it counts as the mean of its feature. One cell
    per pair of features, whatever the number of rows.
    """
    features = list(features)
    spark = df.sparkSession
    n, sx, sxx, sxy = pair_sums(df, features)
    matrix = pair_correlations(n, sx, sxx, sxy)
    plain = lambda v: None if np.isnan(v) else float(v)
    pairs = [(a, b, plain(matrix[i, j])) for i, a in enumerate(features) for j, b in enumerate(features)]
    vif = [(c, float(v)) for c, v in zip(features, inflation_factors(sxx, sxy), strict=True)]
    return (
        spark.createDataFrame(pairs, "feature string, other string, correlation double"),
        spark.createDataFrame(vif, "feature string, vif double"),
    )
