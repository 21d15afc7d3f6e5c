"""Correlation, inflation, reasons, calibration, grouped quantiles and one parse per report."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanloom.operators import smote as smote_module
from loanloom.operators.preprocess import IQRClipper, NeuralPreprocessor, TreePreprocessor
from loanloom.operators.quantiles import grouped_quantile
from loanloom.operators.smote import smote
from loanloom.plans import calibration as cal
from loanloom.plans import monitoring, portfolio
from loanloom.plans.models import PDBoostedTrees, PDRandomForest, PDScorecard
from loanloom.sources.bureau import StoredReportBureauLoader


def test_pairs_use_the_rows_that_have_both(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)) + 1e6
    x[:, 1] = 0.6 * x[:, 0] + 0.4 * x[:, 1]
    x[rng.random((400, 4)) < 0.3] = np.nan
    x[:200, 2], x[200:, 3] = np.nan, np.nan  # these two never meet
    pdf = pd.DataFrame(x, columns=list("abcd"))
    df = spark.createDataFrame(pdf)
    pairs, _ = monitoring.correlation_and_vif(df, list("abcd"))
    got = {(r["feature"], r["other"]): r["correlation"] for r in pairs.collect()}
    want = pdf.corr()
    for (a, b), value in got.items():
        assert value == pytest.approx(want.loc[a, b]) if not math.isnan(want.loc[a, b]) else value is None


def test_inflation_is_infinite_for_collinear_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    pdf = pd.DataFrame({"a": x[:, 0], "b": 1 - x[:, 0], "c": x[:, 1], "d": 0.8 * x[:, 1] + 0.6 * x[:, 2], "e": 7.0})
    _, vif = monitoring.correlation_and_vif(spark.createDataFrame(pdf), list("abcde"))
    got = {r["feature"]: r["vif"] for r in vif.collect()}
    r2 = pdf[["c", "d"]].corr().iloc[0, 1] ** 2
    assert got["a"] == got["b"] == math.inf and got["e"] == pytest.approx(1.0)
    assert got["c"] == pytest.approx(1 / (1 - r2), rel=0.05) and min(got.values()) >= 1.0


def test_reasons_of_a_loan_do_not_depend_on_the_batch(credit):
    model = PDScorecard(["cibil_score", "revolving_utilisation", "dpd_90_count_24m"], ["borrower_segment"], target="y").fit(credit)
    worst = credit.orderBy("cibil_score", "loan_id").limit(1).persist()
    alone = cal.reason_codes(model, worst).first()
    batch = cal.reason_codes(model, credit).where(F.col("loan_id") == alone["loan_id"]).first()
    assert alone["reasons"] == batch["reasons"] and "cibil_score" in alone["reasons"]


def test_isotonic_is_exact_for_close_scores_and_keeps_columns(spark):
    rng = np.random.default_rng(2)
    raw = np.sort(rng.random(600)) * 1e-5
    y = (rng.random(600) < raw / raw.max()).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"raw": raw, "y": y, "p": -1.0}))
    got = cal.IsotonicCalibrator().fit(df, "y", "raw").transform(df, "raw", "fitted").orderBy("raw").toPandas()
    levels, sizes = [], []
    for v in y:  # pool adjacent violators
        levels.append(v)
        sizes.append(1)
        while len(levels) > 1 and levels[-2] >= levels[-1]:
            b, m = levels.pop(), sizes.pop()
            levels[-1] = (levels[-1] * sizes[-1] + b * m) / (sizes[-1] + m)
            sizes[-1] += m
    assert np.allclose(got["fitted"], np.repeat(levels, sizes)) and (got["p"] == -1.0).all() and "_score" not in got


@pytest.mark.parametrize("rate", [0.001, 0.1, 0.7])
def test_long_run_shift_is_exact(spark, rate):
    raw = np.concatenate((np.linspace(1e-5, 0.4, 500), np.full(300, 1e-5)))
    df = spark.createDataFrame(pd.DataFrame({"raw": raw}))
    shift = cal.LongRunCalibrator(rate).fit(df, "raw")
    assert df.agg(F.avg(shift.apply(F.col("raw")))).first()[0] == pytest.approx(rate, abs=1e-10)


def test_grouped_quantile_equals_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 3000), "v": np.round(rng.normal(size=3000), 2)})
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    for p, accuracy in ((0.9, 10_000), (0.5, 20), (0.0, 50), (1.0, 50)):
        got = {r["g"]: r["quantile"] for r in grouped_quantile(df, ["g"], "v", p, accuracy=accuracy).collect()}
        for g, part in pdf.dropna(subset=["v"]).groupby("g", dropna=False):
            assert got[None if g is None or g != g else g] == pytest.approx(np.quantile(part["v"], p))


def test_every_observation_gets_its_flag(spark):
    rows = [("L1", "B", "2020-01-01", False), ("L2", "B", "2020-01-01", False), ("L3", "B", "2020-06-01", True), ("L4", "B", "2022-01-01", False)]
    df = spark.createDataFrame(rows, "loan_id string, borrower_id string, observation_date string, npa_flag boolean")
    got = {r["loan_id"]: r["default_next_12m"] for r in portfolio.default_within_a_year(df).collect()}
    assert got == {"L1": 1, "L2": 1, "L3": 0, "L4": 0}


def test_observations_with_null_borrower_or_date_are_kept(spark):
    rows = [("L1", "B", "2020-01-01", False), ("L2", None, "2020-01-01", True), ("L3", None, "2020-02-01", True),
            ("L4", "B", None, True), ("L5", "B", "2020-03-01", True), ("L6", "B", "2020-03-01", False)]
    df = spark.createDataFrame(rows, "loan_id string, borrower_id string, observation_date string, npa_flag boolean")
    got = sorted((r["loan_id"], r["default_next_12m"]) for r in portfolio.default_within_a_year(df).collect())
    assert got == [("L1", 1), ("L2", 0), ("L3", 0), ("L4", 0), ("L5", 0), ("L6", 0)]


def test_stored_reports_are_parsed_once(spark):
    stored = spark.createDataFrame([("B0", '{"status": "SUCCESS", "data": {}}'), ("B1", '{"responseKey": "error_empty_consent"}')], "borrower_id string, raw string")
    known = spark.createDataFrame([("B0", "9", "n", 1), ("B1", "9", "m", 2)], "borrower_id string, mobile string, name string, seq int")
    loader = StoredReportBureauLoader(stored, known, tiebreak="seq", observation_date="2023-01-01")
    rows = loader.load()
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r["borrower_id"] for r in rows.collect()] == ["B0"]
    assert [tuple(r) for r in loader.rejects().collect()] == [("B1", "consent_missing")]


def test_oversampling_keeps_parity_with_repeated_points(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": [f"r{i}" for i in range(300)], "a": rng.normal(size=300).round(1), "b": rng.integers(0, 2, 300).astype(float), "y": 0})
    pdf.loc[:59, "y"] = 1
    pdf.loc[:19, ["a", "b"]] = 0.5
    got = smote(spark.createDataFrame(pdf), ["a", "b"], "y", key="id")
    counts = {(r["y"], r["synthetic"]): r["count"] for r in got.groupBy("y", "synthetic").count().collect()}
    assert counts == {(0, False): 240, (1, False): 60, (1, True): 180}


def test_preprocessing_comes_back_from_disk(credit, tmp_path):
    features = (["cibil_score", "revolving_utilisation"], ["borrower_segment"])
    for i, model in enumerate((
        TreePreprocessor(*features).fit(credit), NeuralPreprocessor(*features).fit(credit), IQRClipper(features[0]).fit(credit))):
        model.save(str(tmp_path / str(i)))
        again = type(model).load(str(tmp_path / str(i)))
        rows = lambda m: sorted(map(str, m.transform(credit).collect()))
        assert rows(again) == rows(model)


def test_models_come_back_from_disk(credit, tmp_path):
    features = (["cibil_score", "revolving_utilisation", "dpd_90_count_24m"], ["borrower_segment"])
    for model in (
        PDScorecard(*features, target="y"), PDRandomForest(*features, target="y", n_estimators=3, max_depth=4, use_smote=False),
        PDBoostedTrees(*features, target="y", params={"n_estimators": 3})):
        model.fit(credit).save(str(tmp_path / type(model).__name__))
        again = type(model).load(str(tmp_path / type(model).__name__))
        scores = lambda m: sorted((r["loan_id"], r["pd"]) for r in m.predict_proba(credit).collect())
        assert scores(again) == scores(model)
    with pytest.raises(ValueError, match="PDBoostedTrees"):
        PDScorecard.load(str(tmp_path / "PDBoostedTrees"))


def test_points_ask_only_the_blocks_in_reach(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(12, 3)) * 50, 25, axis=0) + rng.normal(size=(300, 3)) * 0.1
    x[:, 2] = np.round(x[:, 2])  # equal values in a column that is cut
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    vectors = df.select("id", F.array("a", "b", "c").alias("x"))
    dist = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(dist, np.inf)
    for points in (20_000, 30):  # cuts from all points, and from a few: large leaves become several blocks
        monkeypatch.setattr(smote_module, "_CUT_POINTS", points)
        placed, low, high = smote_module._placed(vectors, 300, 12, 3, 25)
        blocks = [r["n"] for r in placed.groupBy("block").agg(F.count("*").alias("n")).collect()]
        assert sum(blocks) == 300 and len(low) >= len(blocks) >= 12 and max(blocks) <= 60
        asked = smote_module._near_in_own_block(placed, low, high, 3, 4).select(F.size("others").alias("n")).collect()
        if points == 20_000:  # before, each point was sent to every block
            assert sum(r["n"] for r in asked) < 300 * 3
        got = {r["id"]: r["ids"] for r in smote_module.neighbours(df, ["a", "b", "c"], 4, block_points=25).collect()}
        for i in range(300):
            np.testing.assert_allclose(dist[i, got[i]], np.sort(dist[i])[:4], rtol=1e-6, atol=1e-9)
