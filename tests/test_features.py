from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from loanloom.operators import features as ft


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_loan_derivations_and_null_rules(loan_frame):
    out = by(ft.build_loan_features(loan_frame), "loan_id")
    assert out["L0"]["drawn_to_sanctioned"] == pytest.approx(0.8)
    assert out["L0"]["available_headroom"] == pytest.approx(0.2)
    assert out["L0"]["seasoning_ratio"] == pytest.approx(54 / 240)
    assert out["L1"]["drawn_to_sanctioned"] == pytest.approx(1.25)  # over the limit is kept
    assert (out["L0"]["is_secured"], out["L1"]["is_secured"], out["L2"]["is_secured"]) == (1, 0, 1)
    assert out["L2"]["log_outstanding_principal"] == 0.0  # negative amounts count as zero
    assert out["L2"]["drawn_to_sanctioned"] is None and out["L2"]["seasoning_ratio"] is None
    assert out["L3"]["log_sanctioned_limit"] is None and out["L1"]["ltv_at_origination"] is None


def test_loan_features_hide_outcomes(loan_frame):
    out = ft.build_loan_features(loan_frame)
    assert not set(ft.LEAKAGE_COLUMNS) & set(out.columns)
    assert out.columns == [*ft.LOAN_KEYS, *ft.LOAN_CONTINUOUS, *ft.LOAN_CATEGORICAL]


def test_bureau_bands_and_flags(bureau_frame):
    out = by(ft.build_bureau_features(bureau_frame), "borrower_id")
    assert [out[b]["cibil_band"] for b in ("B0", "B1", "B2", "B3")] == ["very_good", "poor", None, "ntc"]
    assert out["B3"]["is_new_to_credit"] == 1 and out["B3"]["is_thin_file"] == 1
    assert out["B2"]["is_thin_file"] == 1 and out["B2"]["any_delinquency_24m"] == 0
    assert out["B1"]["any_delinquency_24m"] == 1 and out["B0"]["any_delinquency_24m"] == 0


@pytest.mark.parametrize(
    ("score", "band"),
    [(299, None), (300, "poor"), (649, "poor"), (650, "fair"), (700, "good"), (750, "very_good"), (800, "excellent"), (900, "excellent"), (901, None)],
)
def test_band_edges(bureau_frame, score, band):
    df = bureau_frame.limit(1).withColumn("cibil_score", F.lit(score))
    assert ft.build_bureau_features(df).first()["cibil_band"] == band


def test_account_flags(account_frame):
    out = by(ft.build_account_features(account_frame), "borrower_id")
    assert out["B0"]["salary_regularity_12m"] == 1.0 and out["B0"]["has_nach_bounce"] == 0
    assert out["B1"]["overspending_flag"] == 1 and out["B1"]["log_avg_monthly_balance_3m"] == 0.0
    assert out["B3"]["no_salary_credit"] == 1
    assert out["B3"]["has_nach_bounce"] == 0 and out["B3"]["overspending_flag"] == 0
    assert out["B3"]["log_avg_monthly_balance_3m"] is None


def test_gst_flags(gst_frame):
    row = ft.build_gst_features(gst_frame).first()
    assert (row["itc_anomaly_flag"], row["revenue_declining_flag"], row["filing_on_time_flag"]) == (1, 1, 0)
    assert row["log_gstr1_revenue_monthly"] == pytest.approx(math.log1p(100_000.0))


def test_business_ratios(spark):
    df = spark.createDataFrame(
        [
            ("B2", "d", 1.2e6, 1e6, 8e5, 4e5, 2e6, 1e6, 5e6, 2.5e6, "big4"),
            ("B9", "d", 5e5, 0.0, -2e5, 1e5, 1e6, -1.0, 3e6, -5e5, "local"),
        ],
        "borrower_id string, observation_date string, cash_flow_available double, debt_service double, "
        "ebit double, interest_expense double, current_assets double, current_liabilities double, "
        "total_debt double, total_equity double, auditor_category string",
    )
    out = by(ft.build_business_features(df), "borrower_id")
    assert out["B2"]["dscr"] == pytest.approx(1.2) and out["B2"]["icr"] == pytest.approx(2.0)
    assert out["B2"]["current_ratio"] == pytest.approx(2.0) and out["B2"]["dscr_below_1"] == 0
    assert out["B9"]["dscr"] is None and out["B9"]["dscr_below_1"] == 0
    assert out["B9"]["current_ratio"] is None and out["B9"]["negative_net_worth"] == 1


def test_macro_changes(macro_frame):
    rows = ft.build_macro_features(macro_frame).collect()
    assert [r["repo_rate_change_3m"] for r in rows[:3]] == [None] * 3
    assert rows[3]["repo_rate_change_3m"] == pytest.approx(3 * 2.5 / 35)
    assert rows[11]["repo_rate_change_12m"] is None and rows[12]["repo_rate_change_12m"] is not None
    assert all(r["real_repo_rate"] == pytest.approx(r["rbi_repo_rate_pct"] - 5.0) for r in rows)


def test_text_that_is_no_number_becomes_null(account_frame):
    df = account_frame.withColumn("cash_withdrawal_ratio", F.lit("n/a"))
    assert ft.build_account_features(df).first()["cash_withdrawal_ratio"] is None
