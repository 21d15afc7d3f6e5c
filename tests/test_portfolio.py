from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.plans import monitoring as mon
from loanloom.plans import portfolio as pf


def test_default_rates(loan_frame):
    out = {r["product_type"]: (r["default_rate"], r["n_loans"]) for r in pf.default_rate_by_product(loan_frame).collect()}
    assert out["ALL"] == (50.0, 4) and out["credit_card"] == (100.0, 1) and out["lap"] == (0.0, 1)


def test_exposure_and_expected_loss(loan_frame):
    df = loan_frame.withColumns({"ead": pf.exposure_at_default({"retail_salaried": 0.5}), "pd": F.lit(0.1), "lgd": F.lit(0.5)})
    ead = {r["loan_id"]: r["ead"] for r in df.collect()}
    assert ead["L0"] == 2_000_000.0  # term loan: outstanding
    assert ead["L1"] == 50_000.0  # over the limit: nothing undrawn
    card = loan_frame.where("loan_id = 'L1'").withColumn("sanctioned_limit", F.lit(90_000.0))
    assert card.select(pf.exposure_at_default({"retail_salaried": 0.5}).alias("e")).first()["e"] == 70_000.0
    out = {(r["borrower_segment"], r["product_type"]): r for r in pf.expected_loss_rollup(df).collect()}
    assert out["ALL", "ALL"]["n_loans"] == 4
    parts = [r["expected_loss"] for k, r in out.items() if "ALL" not in k]
    assert out["ALL", "ALL"]["expected_loss"] == pytest.approx(sum(parts))
    assert out["retail_salaried", "ALL"]["expected_loss"] == pytest.approx(0.05 * 2_050_000)
    stressed = {(r["borrower_segment"], r["scenario"]): r["expected_loss"] for r in pf.stressed_expected_loss(df).collect()}
    assert stressed["retail_salaried", "moderate"] == pytest.approx(1.5 * stressed["retail_salaried", "baseline"])
    assert stressed["retail_salaried", "severe"] == pytest.approx(2_050_000 * 0.3 * 0.675)


def test_conversion_factors_and_downturn(spark):
    rows = [("msme", 50.0, 100.0, 75.0), ("msme", 50.0, 100.0, 150.0), ("msme", 100.0, 100.0, 120.0), ("retail", 0.0, 10.0, -5.0)]
    df = spark.createDataFrame(rows, "borrower_segment string, drawn double, limit double, drawn_at_default double")
    out = {r["borrower_segment"]: r for r in pf.credit_conversion_factors(df).collect()}
    assert out["msme"]["mean_ccf"] == 0.75 and out["msme"]["n"] == 2 and out["retail"]["mean_ccf"] == 0.0
    seen = spark.createDataFrame(
        [("2020-03-01", 0.5, 0.2), ("2021-03-31", 0.9, 0.4), ("2021-04-01", 1.0, 1.0), ("2019-01-01", 0.3, 0.1)], "d string, ccf double, lgd double"
    ).withColumn("d", F.col("d").cast("timestamp"))
    down = {r["window"]: r for r in pf.downturn_parameters(seen, date="d", ccf="ccf", lgd="lgd").collect()}
    assert down["COVID Stress"]["downturn_ccf"] == 0.9 and down["COVID Stress"]["downturn_lgd"] == pytest.approx(0.3)
    assert down["NBFC Liquidity Crisis"]["n"] == 1


def dated(spark, rows):
    return spark.createDataFrame(
        [(f"L{i}", b, dt.datetime.fromisoformat(d), s, n) for i, (b, d, s, n) in enumerate(rows)],
        "loan_id string, borrower_id string, observation_date timestamp, sma_flag int, npa_flag boolean",
    )


def test_stage_transitions_and_forward_default(spark):
    df = dated(
        spark,
        [
            ("B0", "2022-01-10", 0, False),
            ("B0", "2022-02-10", 1, False),
            ("B0", "2022-05-10", 2, True),
            ("B0", "2023-01-10", 0, False),  # two quarters missing: no transition
            ("B1", "2022-11-01", 0, False),
            ("B1", "2023-03-31", 0, None),
        ],
    ).withColumn("stage", pf.stage())
    out = {(r["from_stage"], r["to_stage"]): (r["n"], r["rate"]) for r in pf.stage_transitions(df).collect()}
    assert out == {("SMA-1", "NPA"): (1, 1.0), ("SMA-0", "SMA-0"): (1, 1.0)}
    flags = {(r["borrower_id"], r["day"].isoformat()): r["default_next_12m"] for r in pf.default_within_a_year(df).collect()}
    assert flags["B0", "2022-01-10"] == 1 and flags["B0", "2022-05-10"] == 0 and flags["B1", "2022-11-01"] == 0


def test_vintages(spark):
    rows = [("2020-01-05", 1, True), ("2020-01-20", 3, False), ("2020-01-30", 3, True), ("2020-02-01", 2, False)]
    df = spark.createDataFrame(rows, "disbursement_date string, months_on_book int, default_flag_12m boolean")
    out = {(r["vintage"], r["age"]): (r["cum_default"], r["cum_default_rate"]) for r in pf.vintage_curves(df).collect()}
    assert out["2020-01", 1] == (1, pytest.approx(1 / 3)) and out["2020-01", 3] == (2, pytest.approx(2 / 3))
    assert out["2020-02", 2] == (0, 0.0)


def test_disparate_impact(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("y", 0)], "g string, ok int")
    out = {r["g"]: r for r in pf.disparate_impact(df, group="g", favourable=F.col("ok") == 1).collect()}
    assert out["x"]["impact_ratio"] == 1.0 and out["y"]["impact_ratio"] == 0.5
    assert out["x"]["passes"] and not out["y"]["passes"]


@pytest.fixture(scope="module")
def shifted(spark):
    rng = np.random.default_rng(8)
    base, now = rng.normal(size=1_000), rng.normal(0.8, 1.0, 1_000)
    rows = [(True, float(x), float(abs(x))) for x in base] + [(False, float(x), None) for x in now]
    return base, now, spark.createDataFrame(rows, "old boolean, x double, z double")


def test_stability_and_divergence(shifted):
    base, now, df = shifted
    shares = mon.share_table(mon.Populations(df, F.col("old")), ["x", "z"])
    edges = np.unique(np.quantile(base, np.linspace(0, 1, 11)))[1:-1]
    e = np.bincount(np.digitize(base, edges), minlength=10) / 1000
    a = np.bincount(np.digitize(now, edges), minlength=10) / 1000
    psi = {r["feature"]: (r["psi"], r["status"]) for r in mon.stability_index(shares).collect()}
    expected = np.sum((np.maximum(a, 1e-4) - np.maximum(e, 1e-4)) * np.log(np.maximum(a, 1e-4) / np.maximum(e, 1e-4)))
    assert psi["x"] == (pytest.approx(expected), "retrain")
    assert psi["z"][0] > 5 and shares.where("feature = 'z' AND bin = -1").first()["current_share"] == 1.0
    js = {r["feature"]: r["js_divergence"] for r in mon.jensen_shannon(shares).collect()}
    m = (a + e) / 2
    part = lambda p: np.sum(np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / m), 0))
    assert js["x"] == pytest.approx((part(a) + part(e)) / 2)
    for size in (10**6, 200):
        row = mon.two_sample_ks(mon.Populations(df, F.col("old")), "x", rows_per_slice=size).first()
        grid = np.sort(np.r_[base, now])
        gap = np.abs(np.searchsorted(np.sort(base), grid, "right") - np.searchsorted(np.sort(now), grid, "right")) / 1000
        assert row["ks"] == pytest.approx(gap.max()) and row["alert"]


def test_cohorts_grades_and_correlation(spark, credit):
    df = credit.withColumn("p", 1 - (F.col("cibil_score") - 300) / 600)
    year = F.date_format("observation_date", "yyyy")
    out = mon.cohort_performance(df, target="y", probability="p", cohort=year, baseline_gini=0.99).collect()
    assert sum(r["n"] for r in out) == 2_000 and all(r["degraded"] for r in out)
    grade = F.when(F.col("p") < 0.5, "A").otherwise("B")
    rates = {r["grade"]: r for r in mon.calibration_by_grade(df, target="y", probability="p", grade=grade).collect()}
    assert rates["A"]["ratio"] == pytest.approx(rates["A"]["actual"] / rates["A"]["predicted"])
    doubled = credit.withColumn("twin", F.col("cibil_score") * 2 + F.col("dpd_90_count_24m"))
    pairs, vif = mon.correlation_and_vif(doubled, ["cibil_score", "twin", "revolving_utilisation"])
    c = {(r["feature"], r["other"]): r["correlation"] for r in pairs.collect()}
    assert c["cibil_score", "cibil_score"] == pytest.approx(1.0) and c["cibil_score", "twin"] > 0.99
    v = {r["feature"]: r["vif"] for r in vif.collect()}
    assert v["twin"] > 100 > 2 > v["revolving_utilisation"]
