"""Exact quantiles of many columns that never gather a column in one task.

``percentile`` keeps every distinct value of a column in the memory of one
task, which is fine up to SINGLE_PASS_ROWS rows. Beyond that two passes give
the same exact answer: evenly spaced order statistics of every few rows, put
together per column, enclose each wanted rank in a bracket that always holds,
then one grouped count finds the order statistics inside the brackets. (One
sketch over all columns had to be merged by a single task, which took longer
with every partition.) Rows outside a bracket only add to a counter, so what is
shuffled is a small fraction of the column, and repeated values combine on the map side. The count
is one pass over Arrow batches for all columns: as one Spark expression it
outgrew what the JVM compiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.stats import interpolate

SINGLE_PASS_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000
# Rows of a task that one summary of order statistics stands for.
SUMMARY_ROWS = 250_000
# Values of one column inside brackets that a task holds before it counts them.
TASK_VALUES = 200_000


def case_bin(value: Column, cuts: Sequence[float], *, closed: str = "left") -> Column:
    """Number of cuts <= value (``left``) or < value (``right``); NULL stays NULL."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    bins: Column | None = None
    for i, cut in enumerate(cuts):
        below = value < F.lit(float(cut)) if closed == "left" else value <= F.lit(float(cut))
        bins = F.when(below, i) if bins is None else bins.when(below, i)
    return bins.when(value.isNotNull(), len(cuts))


def bucket_codes(
    df: DataFrame, cuts: dict[str, Sequence[float]], into: dict[str, str]
) -> DataFrame:
    """Add an integer bin per column: the number of cuts <= value.

    NULL gets the code after the last bin. The bins are found by the binary
    search of the ML bucketizer, which keeps a wide projection small enough to
    be compiled to machine code.
    """
    split = [c for c in cuts if cuts[c]]
    if split:
        df = Bucketizer(
            splitsArray=[[-math.inf, *map(float, cuts[c]), math.inf] for c in split],
            inputCols=split,
            outputCols=[into[c] for c in split],
            handleInvalid="keep",
        ).transform(df)
    codes = {
        into[c]: F.coalesce(F.col(into[c]).cast("int"), F.lit(len(cuts[c]) + 1)) for c in split
    }
    codes |= {into[c]: F.col(c).isNull().cast("int") for c in cuts if not cuts[c]}
    return df.withColumns(codes) if codes else df


def bin_counts(
    df: DataFrame, cuts: dict[str, Sequence[float]], flags: Sequence[Column]
) -> dict[str, dict[int | None, tuple[int, ...]]]:
    """Per column and bin the number of rows and of those with each 0/1 flag; NULL has the bin None.

    Bins are those of :func:`bucket_codes`. All columns are counted in one pass over Arrow
    batches and each task hands on one short row per column and bin, where exploding the codes
    would send every column of every row through a hash aggregate.
    """
    names = list(cuts)
    if not names:
        return {}
    edges = [_total_order(np.array(cuts[c], np.float64)) for c in names]
    bits = len(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(e) + 2) << bits, np.int64) for e in edges]
        for batch in batches:
            mark = np.zeros(batch.num_rows, np.int64)
            for k in range(bits):
                mark |= batch.column(k).to_numpy().astype(np.int64) << k
            for c, e in enumerate(edges):
                v = _total_order(batch.column(bits + c).to_numpy(zero_copy_only=False))
                b = np.searchsorted(e, v, "right")
                b[np.isnan(v)] = len(e) + 1
                totals[c] += np.bincount(b << bits | mark, minlength=len(totals[c]))
        for c, total in enumerate(totals):
            code = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(code), c), pa.int32()),
                    pa.array(code >> bits, pa.int32()),
                    pa.array(code & ((1 << bits) - 1), pa.int32()),
                    pa.array(total[code], pa.int64()),
                ],
                names=["c", "b", "mark", "n"],
            )

    wide = df.select(
        *[F.coalesce(f.cast("int"), F.lit(0)).alias(f"_flag_{k}") for k, f in enumerate(flags)],
        *[F.col(c).cast("double").alias(c) for c in names],
    )
    counted = wide.mapInArrow(run, "c int, b int, mark int, n bigint").groupBy("c", "b", "mark").agg(F.sum("n").alias("n"))
    out: dict[str, dict[int | None, tuple[int, ...]]] = {c: {} for c in names}
    for r in counted.collect():  # a few rows per column and bin
        here, b = out[names[r["c"]]], None if r["b"] > len(cuts[names[r["c"]]]) else r["b"]
        old = here.get(b, (0,) * (bits + 1))
        hit = (True, *(bool(r["mark"] >> k & 1) for k in range(bits)))
        here[b] = tuple(x + r["n"] * h for x, h in zip(old, hit, strict=True))
    return out


def _total_order(v: np.ndarray) -> np.ndarray:
    """-0.0 below 0.0, as the search of the bucketizer has it."""
    return np.where((v == 0.0) & np.signbit(v), -5e-324, v)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    *,
    rows: int | None = None,
    single_pass_rows: int = SINGLE_PASS_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column; None for a column without values."""
    if not columns:
        return {}
    rows = df.count() if rows is None else rows
    if rows <= single_pass_rows:
        probs = [float(p) for p in probabilities]
        got = df.agg(
            *[F.percentile(F.col(c).cast("double"), probs).alias(c) for c in columns]
        ).first()
        return {c: (None if got[c] is None else list(got[c])) for c in columns}
    return _bracketed(df, columns, probabilities, accuracy)


def _bracketed(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int
) -> dict[str, list[float] | None]:
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    points = max(2, accuracy // 2)
    probs = [float(p) for p in probabilities]
    bounds = (
        doubles.mapInArrow(_summaries(points), "c int, n bigint, v array<double>")
        .groupBy("c")
        .applyInArrow(_bounds(probs, points), "c int, n bigint, low array<double>, high array<double>")
    )
    wanted, edges = {}, {}
    for r in bounds.collect():  # one row per column
        c = columns[r["c"]]
        wanted[c] = [(r["n"] - 1) * p for p in probs]
        edges[c] = _merge(list(zip(r["low"], r["high"], strict=True)))
    found = _order_statistics(doubles, edges, wanted) if wanted else {}
    return {
        c: [
            interpolate(found[c][math.floor(h)], found[c][math.ceil(h)], h - math.floor(h))
            for h in wanted[c]
        ]
        if c in wanted
        else None
        for c in columns
    }


def _ranks(n: int, points: int) -> np.ndarray:
    """The 0-based ranks of ``n`` sorted values that a summary keeps, first and last included."""
    return np.unique(np.linspace(0, n - 1, min(n, points)).round().astype(np.int64))


def _summaries(points: int):
    """Evenly spaced order statistics of every column, one short row per SUMMARY_ROWS rows of a task."""

    def summed(kept: list[list[np.ndarray]]) -> pa.RecordBatch | None:
        rows = []
        for c, parts in enumerate(kept):
            v = np.sort(np.concatenate(parts)) if parts else np.zeros(0)
            if len(v):
                rows.append((c, len(v), v[_ranks(len(v), points)]))
        if not rows:
            return None
        c, n, v = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(n, pa.int64()), pa.array(v, pa.list_(pa.float64()))],
            names=["c", "n", "v"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            kept = kept or [[] for _ in batch.columns]
            for parts, column in zip(kept, batch.columns, strict=True):
                parts.append(column.drop_null().to_numpy(zero_copy_only=False) + 0.0)  # one zero
            held += batch.num_rows
            if held >= SUMMARY_ROWS:
                if (found := summed(kept)) is not None:
                    yield found
                kept, held = [], 0
        if (found := summed(kept)) is not None:
            yield found

    return run


def _bounds(probabilities: Sequence[float], points: int):
    """Values that enclose the two order statistics around every wanted position of a column.

    A summary knows the rows up to a value but for less than one of its steps, so the bounds
    always hold; between them lie about ``2 / points`` of the rows.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        steps = [np.diff(_ranks(n, points), prepend=-1) for n in sizes]
        values, place = np.unique(
            np.concatenate([v.values.to_numpy() for v in table.column("v")]), return_inverse=True
        )
        least = np.cumsum(np.bincount(place, np.concatenate(steps)).astype(np.int64))
        most = least + sum(int(s.max()) - 1 for s in steps)
        n = sum(sizes)
        lows, highs = [], []
        for p in probabilities:
            position = (n - 1) * p
            below = int(np.searchsorted(most, math.floor(position), "right")) - 1
            lows.append(float(values[max(below, 0)]))
            highs.append(float(values[int(np.searchsorted(least, math.ceil(position) + 1, "left"))]))
        return pa.table(
            {
                "c": table.column("c").slice(0, 1).cast(pa.int32()),
                "n": pa.array([n], pa.int64()),
                "low": pa.array([lows], pa.list_(pa.float64())),
                "high": pa.array([highs], pa.list_(pa.float64())),
            }
        )

    return run


def _merge(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    merged: list[tuple[float, float]] = []
    for low, high in sorted(intervals):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _order_statistics(
    df: DataFrame,
    edges: dict[str, list[tuple[float, float]]],
    wanted: dict[str, list[float]],
) -> dict[str, dict[int, float]]:
    """Values at the wanted 0-based ranks that lie inside the brackets."""
    names = list(edges)
    counted = (
        df.select(*names)
        .mapInArrow(_bracket_counter([edges[c] for c in names]), "c int, s int, v double, n bigint")
        .groupBy("c", "s", "v")
        .agg(F.sum("n").alias("n"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    found: dict[str, dict[int, float]] = {c: {} for c in edges}
    try:
        sizes: dict[str, dict[int, int]] = {c: {} for c in edges}
        for r in counted.groupBy("c", "s").agg(F.sum("n").alias("n")).collect():
            sizes[names[r["c"]]][r["s"]] = r["n"]
        targets = []
        for c, positions in wanted.items():
            start = 0
            for s in sorted(sizes[c]):
                if s % 2 == 1:
                    for rank in {f(h) for h in positions for f in (math.floor, math.ceil)}:
                        if start <= rank < start + sizes[c][s]:
                            targets.append((names.index(c), s, rank, rank - start))
                start += sizes[c][s]
        if not targets:
            return found
        ranks = Window.partitionBy("c", "s").orderBy("v")
        # rank of the last row with this value, counted from the start of its bracket
        running = counted.where(F.col("s") % 2 == 1).withColumn(
            "upto", F.sum("n").over(ranks.rowsBetween(Window.unboundedPreceding, 0))
        )
        asked = df.sparkSession.createDataFrame(targets, "c int, s int, rank bigint, offset bigint")
        reached = (F.col("upto") > F.col("offset")) & (F.col("upto") - F.col("n") <= F.col("offset"))
        for r in running.join(F.broadcast(asked), ["c", "s"]).where(reached).select("c", "rank", "v").collect():
            found[names[r["c"]]][r["rank"]] = r["v"]
        return found
    finally:
        counted.unpersist()


def _bracket_counter(brackets: list[list[tuple[float, float]]]):
    """Counts per column, segment and, inside a bracket, value; one small table per task.

    Segments alternate: below bracket 0, bracket 0, between 0 and 1, bracket 1, ...
    """
    lows = [np.array([low for low, _ in b], np.float64) for b in brackets]
    highs = [np.array([high for _, high in b], np.float64) for b in brackets]

    def table(c: int, s: np.ndarray, v: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        values = pa.nulls(len(n), pa.float64()) if v is None else pa.array(v, pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), c), pa.int32()), pa.array(s, pa.int32()), values, pa.array(n, pa.int64())],
            names=["c", "s", "v", "n"],
        )

    def inside(kept: list[np.ndarray], c: int) -> pa.RecordBatch:
        v, n = np.unique(np.concatenate(kept), return_counts=True)
        return table(c, np.searchsorted(lows[c], v, "right") * 2 - 1, v, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(2 * len(b) + 1, np.int64) for b in brackets]
        kept: list[list[np.ndarray]] = [[] for _ in brackets]
        held = [0] * len(brackets)
        for batch in batches:
            for c in range(len(brackets)):
                v = batch.column(c).drop_null().to_numpy(zero_copy_only=False) + 0.0  # one zero
                s = np.searchsorted(lows[c], v, "right") + np.searchsorted(highs[c], v, "left")
                totals[c] += np.bincount(s, minlength=len(totals[c]))
                v = v[s % 2 == 1]
                kept[c].append(v)
                held[c] += len(v)
                if held[c] > TASK_VALUES:
                    yield inside(kept[c], c)
                    kept[c], held[c] = [], 0
        for c, total in enumerate(totals):
            if held[c]:
                yield inside(kept[c], c)
            outside = np.arange(0, len(total), 2)
            outside = outside[total[outside] > 0]
            if len(outside):
                yield table(c, outside, None, total[outside])

    return run


def grouped_quantile(df: DataFrame, by: Sequence[str], value: str, p: float, *, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """``by`` and the exact, linearly interpolated ``quantile`` of ``value`` in each group.

    Equal values of a group are counted before the shuffle. A sketch brackets the wanted
    rank; values below the bracket are only counted, the few inside are put in order. A
    bracket that misses is widened. Null values are left out.
    """
    keys = [F.col(c) for c in by]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    group = F.struct(*by).alias("g")
    counted = counted.select(group, "v", "n")
    margin = 4.0 / accuracy
    while True:
        around = [max(0.0, p - margin), min(1.0, p + margin)]
        sketch = df.where(F.col(value).isNotNull()).groupBy(group).agg(
            F.count(F.lit(1)).alias("total"), F.percentile_approx(F.col(value).cast("double"), around, accuracy).alias("q"))
        sketch = sketch.select("g", "total", F.when(F.lit(around[0] > 0.0), F.col("q")[0]).alias("low"), F.when(F.lit(around[1] < 1.0), F.col("q")[1]).alias("high"))
        inside = (F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))
        under = F.coalesce(F.col("v") < F.col("low"), F.lit(False))
        placed = counted.join(sketch, "g")
        below = placed.groupBy("g").agg(F.coalesce(F.sum(F.when(under, F.col("n"))), F.lit(0)).alias("below"), F.max("total").alias("total"))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranked = placed.where(inside).select("g", "v", upto.alias("upto")).join(below, "g")
        rank = (F.col("total") - 1) * F.lit(float(p))
        reached = lambda k: F.min(F.when((F.col("upto") + F.col("below") > k), F.col("v")))
        found = ranked.groupBy("g").agg(
            reached(F.floor(rank)).alias("a"), reached(F.ceil(rank)).alias("b"), F.max(F.col("below")).alias("below"), F.max(rank).alias("rank"))
        right = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("below") <= F.floor("rank"))
        result = below.select("g").join(found, "g", "left").persist()
        if margin >= 1.0 or result.where(~F.coalesce(right, F.lit(False))).isEmpty():
            break
        result.unpersist()
        margin = min(1.0, margin * 8)
    at = F.col("rank") - F.floor("rank")
    return result.select("g.*", (F.col("a") + at * (F.col("b") - F.col("a"))).alias("quantile"))
