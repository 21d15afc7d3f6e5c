"""What keeps the fits of a large book in many small tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loanloom.operators.partitions import PART_ROWS, spread_book
from loanloom.operators import quantiles
from loanloom.operators.quantiles import _bracket_counter, _bounds, _summaries, exact_quantiles


def test_a_large_book_is_dealt_by_its_rows(spark):
    one = spark.range(1000).coalesce(1)
    assert spread_book(one, 10 * PART_ROWS).rdd.getNumPartitions() == 10
    assert spread_book(one, 1000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_bracket_counts_are_one_small_table():
    v = pa.array([1.0, 2.0, -0.0, 0.0, None, float("inf"), 5.0, 9.0, 5.0])
    batches = _bracket_counter([[(0.0, 1.0), (5.0, 5.0)]])(iter([pa.RecordBatch.from_arrays([v], names=["x"])]))
    got = sorted(tuple(r.values()) for b in batches for r in b.to_pylist() if r["v"] is not None)
    assert got == [(0, 1, 0.0, 2), (0, 1, 1.0, 1), (0, 3, 5.0, 2)]
    batches = _bracket_counter([[(0.0, 1.0), (5.0, 5.0)]])(iter([pa.RecordBatch.from_arrays([v], names=["x"])]))
    assert sorted(tuple(r.values()) for b in batches for r in b.to_pylist() if r["v"] is None) == [(0, 2, None, 1), (0, 4, None, 2)]


def test_bracketed_quantiles_of_many_columns_are_exact(spark):
    rng = np.random.default_rng(1)
    n, names = 3000, [f"c{i}" for i in range(38)]
    x = np.round(rng.standard_normal((n, 38)) * rng.integers(1, 2000, 38), 2)
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{c} double" for c in names)).select(
        *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in names])
    grid = [i / 10 for i in range(11)]
    got = exact_quantiles(df, names, grid, single_pass_rows=0, accuracy=100)
    for i, c in enumerate(names):
        assert np.allclose(got[c], np.quantile(x[~np.isnan(x[:, i]), i], grid), rtol=0, atol=1e-9)


def test_summaries_of_many_tasks_enclose_every_rank(monkeypatch):
    monkeypatch.setattr(quantiles, "SUMMARY_ROWS", 50)
    rng = np.random.default_rng(2)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for x in (rng.standard_normal(3001), np.repeat([1.0, 2.0], 500), np.array([3.0]), np.concatenate((np.zeros(900), rng.random(90), [np.inf]))):
        parts = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 20]), pa.nulls(len(x[i : i + 20]), pa.float64())], names=["x", "none"]) for i in range(0, len(x), 20)]
        rows = pa.Table.from_batches(list(_summaries(10)(iter(parts))))
        assert set(rows["c"].to_pylist()) == {0} and max(map(len, rows["v"].to_pylist())) <= 10
        got = _bounds(probabilities, 10)(rows).to_pylist()[0]
        y = np.sort(x)
        for p, low, high in zip(probabilities, got["low"], got["high"], strict=True):
            at = (len(y) - 1) * p
            assert got["n"] == len(y) and low <= y[int(np.floor(at))] and y[int(np.ceil(at))] <= high
            assert ((y > low) & (y < high)).sum() <= 0.5 * len(y)


def test_bracketed_quantiles_leave_out_columns_without_values(spark):
    names = [f"c{i}" for i in range(4)]
    df = spark.range(4000).repartition(7).select(*[((F.col("id") * (7 + i)) % 1009).cast("double").alias(c) for i, c in enumerate(names)], F.lit(None).cast("double").alias("none"))
    x = np.arange(4000)
    got = exact_quantiles(df, [*names, "none"], [0.0, 0.3, 1.0], single_pass_rows=0)
    assert got["none"] is None
    for i, c in enumerate(names):
        assert np.allclose(got[c], np.quantile((x * (7 + i)) % 1009, [0.0, 0.3, 1.0]), rtol=0, atol=1e-9)
