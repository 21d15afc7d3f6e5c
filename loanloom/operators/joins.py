"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key counts as hot when it alone holds this share of the rows, so there can
# be at most 1 / HOT_SHARE hot keys: the list handed to the plan is bounded.
HOT_SHARE = 1 / 256
HOT_MIN_ROWS = 1_000_000
SALTS = 64
# Largest as-of interval table (rows after the split into days) that is broadcast.
ASOF_BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class FamilyCount:
    """Rows per key of one right table, overall and for the keys of the left table."""

    most: int
    most_matched: int


@dataclass(frozen=True)
class KeyCensus:
    """What one key-only pass tells about a left table and its right families."""

    rows: int
    families: dict[str, FamilyCount]
    hot_keys: list
    ids_repeat: bool = False


def hot_threshold(rows: int) -> float:
    """Rows a key must exceed to count as hot."""
    return max(HOT_MIN_ROWS, rows * HOT_SHARE)


def key_census(
    left: DataFrame, families: dict[str, DataFrame], key: str, *, unique_id: str | None = None
) -> KeyCensus:
    """Count each key per table in one shuffle that carries keys only.

    Gives the checks a family join needs (unique right keys, any match at all)
    and the hot left keys that have to be salted. A null left key is counted
    like any other; null right keys match nothing and are left out. With
    ``unique_id`` the same pass tells whether that left column repeats a value.
    """
    dtype = left.schema[key].dataType

    def ones(table: DataFrame, name: str, column: str = key) -> DataFrame:
        return table.select(
            F.lit(name == "_ids").alias("is_id"),
            F.col(column).cast(dtype).alias("key"),
            *[F.lit(int(other == name)).cast("long").alias(other) for other in names],
        )

    names = ["_left", *families, *(["_ids"] if unique_id else [])]
    stacked = [ones(left, "_left")] + [
        ones(t.where(F.col(key).isNotNull()), name) for name, t in families.items()
    ]
    if unique_id:
        stacked.append(ones(left, "_ids", unique_id))
    counts = reduce(DataFrame.unionByName, stacked).groupBy("is_id", "key").agg(
        *[F.sum(name).alias(name) for name in names]
    )
    zero = F.lit(0)
    top = counts.agg(
        F.coalesce(F.sum("_left"), zero).alias("rows"),
        F.coalesce(F.max("_left"), zero).alias("most"),
        F.coalesce(F.max("_ids") if unique_id else zero, zero).alias("ids"),
        *[F.coalesce(F.max(f), zero).alias(f"all_{f}") for f in families],
        *[
            F.coalesce(F.max(F.when(F.col("_left") > 0, F.col(f))), zero).alias(f"met_{f}")
            for f in families
        ],
    ).first()
    threshold = hot_threshold(top["rows"])
    hot: list = []
    if top["most"] > threshold:
        hot = [r["key"] for r in counts.where(F.col("_left") > threshold).select("key").collect()]
    return KeyCensus(
        rows=top["rows"],
        families={f: FamilyCount(top[f"all_{f}"], top[f"met_{f}"]) for f in families},
        hot_keys=hot,
        ids_repeat=top["ids"] > 1,
    )


def hot_keys_of(df: DataFrame, key: str) -> list:
    """Keys that hold a large share of ``df`` (at most 1 / HOT_SHARE of them)."""
    return key_census(df, {}, key).hot_keys


def _is_hot(key: str, hot_keys: list) -> Column:
    listed = F.coalesce(F.col(key).isin([k for k in hot_keys if k is not None]), F.lit(False))
    return (listed | F.col(key).isNull()) if None in hot_keys else listed


def salted_left_join(
    left: DataFrame, right: DataFrame, key: str, hot_keys: list, *, spread_by: str | list[str]
) -> DataFrame:
    """Left join on ``key`` that spreads the rows of hot keys over SALTS tasks.

    The left rows of a hot key get a salt from ``spread_by``; the right rows of
    the same keys are repeated once per salt. Right keys are unique, so at most
    len(hot_keys) * SALTS right rows are added.
    """
    if not hot_keys:
        return left.join(right, key, "left")
    is_hot = _is_hot(key, hot_keys)
    columns = [spread_by] if isinstance(spread_by, str) else spread_by
    salt = F.when(is_hot, F.pmod(F.xxhash64(*columns), F.lit(SALTS))).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted_left = left.withColumn("_salt", salt.cast("int"))
    salted_right = right.withColumn("_salt", F.explode(copies))
    return salted_left.join(salted_right, [key, "_salt"], "left").drop("_salt")


DUPLICATE_FAMILY = (
    "Family feature frame has duplicate borrower_id rows; expected one row per borrower."
)


def left_join_by_borrower(base: DataFrame, family: DataFrame, *, spread_by: str = "loan_id") -> DataFrame:
    """Attach one family to the loans by borrower; repeated borrowers raise."""
    right = family.drop("observation_date")
    census = key_census(base, {"family": right}, "borrower_id")
    if census.families["family"].most > 1:
        raise ValueError(DUPLICATE_FAMILY)
    return salted_left_join(base, right, "borrower_id", census.hot_keys, spread_by=spread_by)


# --------------------------------------------------------------------------- as-of


def _checked(on: str) -> Column:
    missing = F.raise_error(F.lit(f"{on} is null; an as-of join needs a date on every row"))
    return F.when(F.col(on).isNull(), missing.cast("timestamp")).otherwise(
        F.col(on).cast("timestamp")
    )


@dataclass(frozen=True)
class DateRange:
    """Size and first and last day of a dated table."""

    rows: int
    first: date | None
    last: date | None


def date_range(right: DataFrame, column: str) -> DateRange:
    """Measure the right side of an as-of join; repeated or null dates raise."""
    seen = right.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(column).alias("distinct"),
        F.to_date(F.min(column)).alias("first"),
        F.to_date(F.max(column)).alias("last"),
    ).first()
    if seen["distinct"] != seen["n"]:
        raise ValueError(f"{column} must be unique and non-null on the right of an as-of join.")
    return DateRange(seen["n"], seen["first"], seen["last"])


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    on: str = "observation_date",
    right_on: str = "date",
    *,
    spread_by: str = "loan_id",
    broadcast_rows: int = ASOF_BROADCAST_ROWS,
    dates: DateRange | None = None,
) -> DataFrame:
    """Each left row with the latest right row dated at or before it.

    Right dates must be unique. The size of the right side is measured before
    a strategy is chosen: see :func:`_asof_by_day` and :func:`_asof_by_scan`.
    """
    dates = date_range(right, right_on) if dates is None else dates
    if dates.rows == 0:
        empty = right.drop(right_on)
        return left.select(
            "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields]
        )
    # every right row opens one interval, which touches one day more than its length
    split_rows = (dates.last - dates.first).days + dates.rows
    if split_rows <= broadcast_rows:
        return _asof_by_day(left, right, on, right_on, dates.last)
    return _asof_by_scan(left, right, on, right_on, spread_by)


def _asof_by_day(
    left: DataFrame, right: DataFrame, on: str, right_on: str, last_day: date
) -> DataFrame:
    """Hash join on the calendar day against validity intervals cut into days.

    A range condition alone would become a nested loop over all right rows; the
    day turns it into an equi-join with about one candidate per left row. Days
    after the last reading all fall on its day, so the open interval is finite.
    """
    opened = F.col(right_on).cast("timestamp")
    intervals = right.withColumn("_lo", opened).withColumn(
        "_hi", F.lead("_lo").over(Window.orderBy("_lo"))
    )
    days = intervals.withColumn(
        "_day",
        F.explode(
            F.sequence(
                F.to_date("_lo"), F.coalesce(F.to_date("_hi"), F.to_date("_lo"))
            )
        ),
    ).drop(right_on)
    keyed = left.withColumn(
        "_lday", F.least(F.to_date(_checked(on)), F.lit(last_day).cast("date"))
    )
    at = F.col(on).cast("timestamp")
    joined = keyed.join(
        F.broadcast(days),
        (F.col("_lday") == F.col("_day"))
        & (at >= F.col("_lo"))
        & (F.col("_hi").isNull() | (at < F.col("_hi"))),
        "left",
    )
    return joined.drop("_lday", "_day", "_lo", "_hi")


def _asof_by_scan(left: DataFrame, right: DataFrame, on: str, right_on: str, spread_by: str) -> DataFrame:
    """Sorted scan for a right side too large to broadcast.

    Only the distinct left timestamps are matched (they combine on the map
    side, so a popular date costs nothing), in windows of one day each; what
    carries over from earlier days comes from the last reading of every day.
    The result is joined back by timestamp with hot timestamps salted.
    """
    values = [c for c in right.columns if c != right_on]
    readings = right.select(
        F.col(right_on).cast("timestamp").alias("_at"), F.struct(*values).alias("_v")
    )
    asked = left.select(_checked(on).alias("_at")).distinct()
    points = asked.withColumn("_v", F.lit(None).cast(readings.schema["_v"].dataType)).withColumn(
        "_asked", F.lit(True)
    ).unionByName(readings.withColumn("_asked", F.lit(False)))
    points = points.withColumn("_day", F.to_date("_at"))

    day_last = points.groupBy("_day").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_v"))
    # one row per calendar day: small whatever the number of readings
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = day_last.select("_day", F.last("_v", ignorenulls=True).over(before).alias("_carried"))

    in_day = Window.partitionBy("_day").orderBy("_at", "_asked").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    matched = (
        points.withColumn("_seen", F.last("_v", ignorenulls=True).over(in_day))
        .where("_asked")
        .join(carried, "_day", "left")
        .select("_at", F.coalesce("_seen", "_carried").alias("_m"))
    )
    keyed = left.withColumn("_micros", F.unix_micros(F.col(on).cast("timestamp")))
    matched = matched.select(F.unix_micros("_at").alias("_micros"), "_m")
    hot = hot_keys_of(keyed, "_micros")
    joined = salted_left_join(keyed, matched, "_micros", hot, spread_by=spread_by)
    return joined.select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in values])
