"""Calibration of default probabilities, loss severity, and reason codes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO_LOSS = 0.05
_EPS = 1e-6
_SCORE = "_score"


def clamped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(_EPS)), F.lit(1.0 - _EPS))


def logit(p: Column) -> Column:
    q = clamped(p)
    return F.log(q / (F.lit(1.0) - q))


class PlattCalibrator:
    """Logistic regression of the target on the log-odds of the raw probability."""

    def fit(self, df: DataFrame, target: str, probability: str) -> PlattCalibrator:
        train = _vector(df.withColumn("_logit", logit(F.col(probability))), ["_logit"]).select(
            "_x", F.col(target).cast("double").alias("label")
        )
        fitted = LogisticRegression(featuresCol="_x", labelCol="label", tol=1e-9, maxIter=200).fit(train)
        self.slope_, self.intercept_ = float(fitted.coefficients[0]), float(fitted.intercept)
        return self

    def apply(self, probability: Column) -> Column:
        odds = F.lit(self.intercept_) + F.lit(self.slope_) * logit(probability)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


class IsotonicCalibrator:
    """Monotone step function from raw to observed default rate, exact at every size.

    Equal probabilities are counted first. The regression then pools neighbours range by
    range and merges the pooled blocks; what it gathers in the end are the steps of the
    fitted function, one or two numbers each.
    """

    def fit(self, df: DataFrame, target: str, probability: str) -> IsotonicCalibrator:
        scores = df.groupBy(F.col(probability).cast("double").alias(_SCORE)).agg(
            F.avg(F.col(target).cast("double")).alias("label"),
            F.count(F.lit(1)).cast("double").alias("weight"),
        )
        self.model_ = IsotonicRegression(
            featuresCol=_SCORE, labelCol="label", weightCol="weight"
        ).fit(scores)
        return self

    def transform(self, df: DataFrame, probability: str, into: str) -> DataFrame:
        held = df.select(F.struct(*df.columns).alias("_row"), F.col(probability).cast("double").alias(_SCORE))
        scored = self.model_.transform(held)
        kept = [F.col("_row")[c].alias(c) for c in df.columns if c != into]
        return scored.select(*kept, F.col("prediction").alias(into))


class LongRunCalibrator:
    """Shift of the log-odds that brings the mean probability to a long-run rate.

    Equal log-odds are counted once and kept; every step of a guarded Newton
    iteration is one aggregate over them, so nothing is rounded to a grid.
    """

    def __init__(self, long_run_rate: float) -> None:
        if not 0.0 < long_run_rate < 1.0:
            raise ValueError(f"long_run_rate must lie in (0, 1); got {long_run_rate}")
        self.long_run_rate = long_run_rate

    def fit(self, df: DataFrame, probability: str) -> LongRunCalibrator:
        z = logit(F.col(probability).cast("double")).alias("z")
        counted = df.groupBy(z).agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            span = 2.0 * math.log((1.0 - _EPS) / _EPS)
            low, high, shift = -span, span, 0.0
            for _ in range(100):
                share = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("z") + F.lit(shift))))
                row = counted.agg(
                    F.sum("n").alias("n"),
                    F.sum(F.col("n") * share).alias("mean"),
                    F.sum(F.col("n") * share * (1.0 - share)).alias("slope"),
                ).first()
                gap = row["mean"] / row["n"] - self.long_run_rate
                low, high = (low, shift) if gap > 0 else (shift, high)
                step = shift - gap / (row["slope"] / row["n"]) if row["slope"] > 0 else low
                following = step if low < step < high else (low + high) / 2.0
                if abs(following - shift) <= 1e-13 * max(1.0, abs(shift)):
                    break
                shift = following
        finally:
            counted.unpersist()
        self.shift_ = shift
        return self

    def apply(self, probability: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(logit(probability) + F.lit(self.shift_))))


def _vector(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df)


class TwoStageLGD:
    """Loss given default: probability of a material loss times its severity.

    Stage one is a logistic regression for loss >= ZERO_LOSS, stage two a
    fractional logit (binomial family on a rate) over the rows with a loss.
    Features are numeric and complete, e.g. the output of tree preprocessing.
    """

    def __init__(self, features: Sequence[str], *, zero_loss: float = ZERO_LOSS) -> None:
        self.features, self.zero_loss = list(features), zero_loss
        self.stage_one_ = None

    def fit(self, df: DataFrame, loss: str) -> TwoStageLGD:
        train = _vector(df, self.features).select("_x", F.col(loss).cast("double").alias("loss"))
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            material = (F.col("loss") >= self.zero_loss).cast("double")
            self.stage_one_ = LogisticRegression(
                featuresCol="_x", labelCol="label", regParam=1e-4
            ).fit(train.select("_x", material.alias("label")))
            severe = train.where(F.col("loss") >= self.zero_loss).select(
                "_x", clamped(F.col("loss")).alias("label")
            )
            self.stage_two_ = GeneralizedLinearRegression(
                featuresCol="_x", labelCol="label", family="binomial", link="logit", regParam=1e-4
            ).fit(severe)
        finally:
            train.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p_loss``, ``severity`` and their product ``lgd``."""
        if self.stage_one_ is None:
            raise RuntimeError("TwoStageLGD is not fitted; call fit() first.")
        staged = self.stage_one_.transform(_vector(df, self.features))
        staged = staged.withColumn("p_loss", vector_to_array("probability")[1]).drop(
            "probability", "rawPrediction", "prediction"
        )
        scored = self.stage_two_.transform(staged).withColumnRenamed("prediction", "severity")
        return scored.withColumn("lgd", F.col("p_loss") * F.col("severity")).drop("_x")


def reason_codes(scorecard, df: DataFrame, *, top: int = 3) -> DataFrame:
    """The features that push a row's points down most, worst first.

    Contribution = coefficient x (weight - mean weight in training), exact for a linear
    model. The means belong to the scorecard, so a loan gets the same reasons alone and in
    any batch.
    """
    scorecard._check_fitted()
    names = scorecard.preprocess_.output_names
    coefs = scorecard.classifier_.coefficients.toArray().tolist()
    means = dict(zip(names, scorecard.train_means_, strict=True))
    encoded = scorecard.preprocess_.transform(df)
    # the model predicts default, so a positive log-odds share costs points
    impacts = F.array(
        *[
            F.struct(
                (F.lit(-b) * (F.col(c) - F.lit(means[c]))).alias("impact"),
                F.lit(c.removesuffix("_woe")).alias("feature"),
            )
            for c, b in zip(names, coefs, strict=True)
        ]
    )
    worst = F.slice(
        F.array_sort(F.filter(impacts, lambda x: x["impact"] < 0)), 1, top
    )
    kept = [c for c in encoded.columns if c not in set(names)]
    return encoded.select(*kept, F.transform(worst, lambda x: x["feature"]).alias("reasons"))
