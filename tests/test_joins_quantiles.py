from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import joins
from loanloom.operators.quantiles import bin_counts, bucket_codes, case_bin, exact_quantiles
from loanloom.plans.monitoring import Populations, share_table


@pytest.fixture
def readings(spark):
    rows = [
        (dt.datetime(2022, 1, 31), 1.0),
        (dt.datetime(2022, 2, 28, 12, 0), 2.0),
        (dt.datetime(2022, 2, 28, 18, 0), 3.0),
        (dt.datetime(2022, 6, 30), None),
    ]
    return spark.createDataFrame(rows, "date timestamp, v double").orderBy(F.desc("date"))


@pytest.fixture
def asked(spark):
    stamps = [
        dt.datetime(2021, 12, 31),
        dt.datetime(2022, 1, 31),
        dt.datetime(2022, 2, 28, 11, 59),
        dt.datetime(2022, 2, 28, 12, 0),
        dt.datetime(2022, 2, 28, 17, 0),
        dt.datetime(2022, 3, 1),
        dt.datetime(2022, 6, 30),
        dt.datetime(2030, 1, 1),
        dt.datetime(2022, 3, 1),
    ]
    return spark.createDataFrame(
        [(f"L{i}", t) for i, t in enumerate(stamps)], "loan_id string, observation_date timestamp"
    )


@pytest.mark.parametrize("limit", [joins.ASOF_BROADCAST_ROWS, 0])
def test_asof_strategies(asked, readings, limit):
    out = joins.asof_backward(asked, readings, broadcast_rows=limit)
    assert out.columns == ["loan_id", "observation_date", "v"]
    got = [r["v"] for r in out.orderBy("loan_id").collect()]
    assert got == [None, 1.0, 1.0, 2.0, 2.0, 3.0, None, None, 3.0]


def test_asof_errors(spark, asked, readings):
    with pytest.raises(ValueError, match="unique"):
        joins.asof_backward(asked, readings.unionAll(readings))
    undated = asked.withColumn("observation_date", F.expr("if(loan_id = 'L3', null, observation_date)"))
    for limit in (joins.ASOF_BROADCAST_ROWS, 0):
        with pytest.raises(Exception, match="is null"):
            joins.asof_backward(undated, readings, broadcast_rows=limit).collect()
    empty = joins.asof_backward(asked, readings.limit(0))
    assert empty.count() == 9 and empty.where("v IS NOT NULL").isEmpty()


def test_hot_keys_are_found_and_salted(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_MIN_ROWS", 50)
    left = spark.range(300).select(
        F.concat(F.lit("L"), F.col("id").cast("string")).alias("loan_id"),
        F.when(F.col("id") < 100, "hot").when(F.col("id") < 200, None).otherwise(F.col("id").cast("string")).alias("borrower_id"),
    )
    right = spark.createDataFrame(
        [("hot", 1), ("250", 2), ("none", 3), (None, 4)], "borrower_id string, v int"
    )
    census = joins.key_census(left, {"f": right}, "borrower_id", unique_id="loan_id")
    assert set(census.hot_keys) == {"hot", None} and census.rows == 300
    assert (census.families["f"].most, census.families["f"].most_matched) == (1, 1)
    assert not census.ids_repeat
    joined = joins.salted_left_join(left, right, "borrower_id", census.hot_keys, spread_by="loan_id")
    assert "_salt" in joined._jdf.queryExecution().toString()
    plain = left.join(right, "borrower_id", "left")
    key = lambda r: (r["loan_id"], r["borrower_id"], r["v"])
    assert sorted(map(key, joined.collect()), key=str) == sorted(map(key, plain.collect()), key=str)


def test_family_join(spark, loan_frame, account_frame):
    out = joins.left_join_by_borrower(loan_frame, account_frame)
    assert out.count() == 4 and out.columns.count("observation_date") == 1
    with pytest.raises(ValueError, match="duplicate borrower_id"):
        joins.left_join_by_borrower(loan_frame, account_frame.union(account_frame))


# ----------------------------------------------------------------------- quantiles


@pytest.fixture(scope="module")
def columns(spark):
    rng = np.random.default_rng(3)
    n = 4_000
    data = {
        "normal": rng.normal(size=n),
        "ties": rng.integers(0, 4, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.lognormal(size=n)),
        "constant": np.full(n, 5.0),
        "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.uniform(-1, 1, n)),
    }
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) for r in zip(*data.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data))
    return data, df.withColumn("empty", F.lit(None).cast("double"))


@pytest.mark.parametrize(("limit", "accuracy"), [(10**6, 10_000), (10, 10_000), (10, 50)])
def test_exact_quantiles_match_numpy(columns, limit, accuracy):
    data, df = columns
    grid = [i / 10 for i in range(11)] + [0.25, 0.333]
    got = exact_quantiles(df, df.columns, grid, single_pass_rows=limit, accuracy=accuracy)
    assert got["empty"] is None
    for c, x in data.items():
        expected = np.quantile(x[~np.isnan(x)], grid)
        np.testing.assert_allclose(got[c], expected, rtol=1e-12, atol=1e-12)


def test_quantiles_do_not_depend_on_partitions(columns):
    _, df = columns
    one = exact_quantiles(df.coalesce(1), ["normal", "hot"], [0.1, 0.9], single_pass_rows=10, accuracy=100)
    many = exact_quantiles(df.repartition(7), ["normal", "hot"], [0.1, 0.9], single_pass_rows=10, accuracy=100)
    assert one == many


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 9.0, None)], "x double")
    left = [r[0] for r in df.select(case_bin(F.col("x"), [0.0, 1.0])).collect()]
    right = [r[0] for r in df.select(case_bin(F.col("x"), [0.0, 1.0], closed="right")).collect()]
    assert left == [0, 1, 1, 2, 2, None] and right == [0, 0, 1, 1, 2, None]
    coded = bucket_codes(df, {"x": [0.0, 1.0]}, {"x": "b"}).select("b").collect()
    assert [r["b"] for r in coded] == [0, 1, 1, 2, 2, 3]
    single = bucket_codes(df, {"x": []}, {"x": "b"}).select("b").collect()
    assert [r["b"] for r in single] == [0, 0, 0, 0, 0, 1]


def test_bin_counts_are_those_of_the_bucket_codes(spark):
    values = [None, -1.0, -0.0, 0.0, 0.5, 1.0, 2.0, float("inf"), float("-inf"), 0.0]
    rows = [(x, None if i == 3 else float(i % 2), None if i % 3 else x) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(3)
    cuts = {"x": [0.0, 1.0], "z": []}
    got = bin_counts(df, cuts, [F.col("y"), F.col("y") == 0.0])
    coded = bucket_codes(df, cuts, {"x": "bx", "z": "bz"}).collect()
    for c, code in (("x", "bx"), ("z", "bz")):
        want = {}
        for r in coded:
            b = None if r[code] > len(cuts[c]) else r[code]
            n = want.get(b, (0, 0, 0))
            want[b] = (n[0] + 1, n[1] + (r["y"] == 1.0), n[2] + (r["y"] == 0.0))
        assert got[c] == want
    assert bin_counts(df.where("false"), cuts, []) == {"x": {}, "z": {}}


def test_share_table_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(400, numPartitions=4).selectExpr("id % 2 = 0 as base", "if(id % 10 = 0, null, double(id)) as x")
    df = rows.mapInArrow(counted, rows.schema)
    table = share_table(Populations(df, F.col("base")), ["x"], n_bins=4, single_pass_rows=100).collect()
    assert seen.value == 400  # quantiles and both counts read the kept rows
    assert sum(r["n_baseline"] for r in table) == 200 == sum(r["n_current"] for r in table)
    assert {r["bin"]: r["n_baseline"] for r in table}[-1] == 40
