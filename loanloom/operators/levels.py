"""Counting the levels of many categorical columns in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_WHOLE = 1e15


def is_categorical_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.BooleanType, T.CharType, T.VarcharType))


def level_text(df: DataFrame, column: str) -> Column:
    """Canonical text of a level: 1, 1.0 and a 1 widened by a join are all ``1``."""
    dtype, c = df.schema[column].dataType, F.col(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        whole = (d == F.floor(d)) & (F.abs(d) < _WHOLE)
        return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    return c.cast("string")


def level_counts(df: DataFrame, columns: Sequence[str], weights: dict[str, Column]) -> DataFrame:
    """(feature, level, n, *weights summed) for all columns; map-side combined.

    The rows are widened column by column inside the map task; only one row per
    distinct level and task is shuffled.
    """
    names = {f"_w_{k}": v for k, v in weights.items()}
    texts = df.select(
        *[c.alias(k) for k, c in names.items()],
        *[level_text(df, c).alias(c) for c in columns],
    )
    long = texts.unpivot(list(names), list(columns), "feature", "level")
    return long.groupBy("feature", "level").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k[3:]) for k in names]
    )


__all__ = ["is_categorical_type", "level_counts", "level_text"]
