"""Null rules shared by every feature expression.

Missing values are NULL everywhere. Doubles are cleaned of NaN once, at the
source, because Spark orders NaN above every number and so would set flags
that must stay 0 for a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATING = (T.DoubleType, T.FloatType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (one projection)."""
    return df.select(
        *[
            F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, _FLOATING)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def number(col: str | Column) -> Column:
    """Numeric value as double; text that is not a number becomes NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("double")


def flag(cond: Column) -> Column:
    """0/1 integer from a condition; an undecidable condition counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def floor_at(col: Column, low: float) -> Column:
    """Lower clip that keeps NULL (``greatest`` alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(float(low))))


def cap_at(col: Column, high: float) -> Column:
    """Upper clip that keeps NULL."""
    return F.when(col.isNotNull(), F.least(col, F.lit(float(high))))


def log1p0(col: Column) -> Column:
    """ln(1 + x) with negative amounts treated as zero."""
    return F.log1p(floor_at(col, 0.0))


def ratio(num: Column, den: Column) -> Column:
    """num / den where den is positive, else NULL."""
    return F.when(den > 0, num / den)


def finite(col: Column) -> Column:
    """NULL for an infinite value."""
    inf = F.lit(float("inf"))
    return F.when((col != inf) & (col != -inf), col)
