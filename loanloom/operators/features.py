"""Per-family feature builders.

Each family is a dict ``column name -> expression`` over its raw table, so the
same expressions serve a stand-alone projection and the assembled matrix. All
of them are built-in expressions: one projection per family, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.nulls import finite, flag, log1p0, number, ratio

LOAN_KEYS = ["loan_id", "borrower_id", "observation_date"]
FAMILY_KEYS = ["borrower_id", "observation_date"]

# Feature lists and their order, as consumers of the matrix expect them.
LOAN_CONTINUOUS = [
    "ltv_at_origination",
    "log_outstanding_principal",
    "log_sanctioned_limit",
    "drawn_to_sanctioned",
    "available_headroom",
    "loan_tenor_months",
    "months_on_book",
    "seasoning_ratio",
]
LOAN_CATEGORICAL = [
    "product_type",
    "borrower_segment",
    "collateral_type",
    "is_secured",
    "state_code",
]
BUREAU_CONTINUOUS = [
    "cibil_score",
    "dpd_30_count_24m",
    "dpd_60_count_24m",
    "dpd_90_count_24m",
    "months_since_last_delinquency",
    "revolving_utilisation",
    "open_trade_count",
    "oldest_trade_months",
    "enquiry_count_6m",
]
BUREAU_CATEGORICAL = ["cibil_band", "is_new_to_credit", "is_thin_file", "any_delinquency_24m"]
ACCOUNT_CONTINUOUS = [
    "log_avg_monthly_balance_3m",
    "salary_credit_months_12m",
    "salary_regularity_12m",
    "nach_bounce_count_12m",
    "cash_withdrawal_ratio",
    "debit_credit_ratio_3m",
]
ACCOUNT_CATEGORICAL = ["has_nach_bounce", "no_salary_credit", "overspending_flag"]
GST_CONTINUOUS = [
    "log_gstr1_revenue_monthly",
    "itc_to_output_ratio",
    "revenue_trend_slope_3m",
    "revenue_trend_slope_12m",
]
GST_CATEGORICAL = ["filing_on_time_flag", "itc_anomaly_flag", "revenue_declining_flag"]
BUSINESS_CONTINUOUS = ["dscr", "icr", "current_ratio", "debt_to_equity"]
BUSINESS_CATEGORICAL = ["auditor_quality", "dscr_below_1", "negative_net_worth"]
MACRO_DATE = "date"
MACRO_CONTINUOUS = [
    "rbi_repo_rate_pct",
    "repo_rate_change_3m",
    "repo_rate_change_12m",
    "gdp_growth_yoy_pct",
    "wpi_inflation_pct",
    "cpi_inflation_pct",
    "iip_growth_pct",
    "msme_npa_index",
    "real_repo_rate",
]
# Outcome columns that may never become features.
LEAKAGE_COLUMNS = ["sma_flag", "npa_flag", "restructured_flag", "default_flag_12m"]
# Score bands, lower bound inclusive, upper bound exclusive.
CIBIL_BANDS = [
    (300, 650, "poor"),
    (650, 700, "fair"),
    (700, 750, "good"),
    (750, 800, "very_good"),
    (800, 901, "excellent"),
]
ITC_ANOMALY_THRESHOLD = 0.90
THIN_FILE_TRADES = 2


def loan_expressions() -> dict[str, Column]:
    outstanding, sanctioned = number("outstanding_principal"), number("sanctioned_limit")
    tenor, on_book = number("loan_tenor_months"), number("months_on_book")
    drawn = ratio(outstanding, sanctioned)
    return {
        "ltv_at_origination": number("ltv_at_origination"),
        "log_outstanding_principal": log1p0(outstanding),
        "log_sanctioned_limit": log1p0(sanctioned),
        "drawn_to_sanctioned": drawn,
        "available_headroom": F.lit(1.0) - drawn,
        "loan_tenor_months": tenor,
        "months_on_book": on_book,
        "seasoning_ratio": ratio(on_book, tenor),
        "product_type": F.col("product_type"),
        "borrower_segment": F.col("borrower_segment"),
        "collateral_type": F.col("collateral_type"),
        # an unknown collateral type counts as secured
        "is_secured": (~F.col("collateral_type").eqNullSafe("none")).cast("int"),
        "state_code": F.col("state_code"),
    }


def bureau_expressions() -> dict[str, Column]:
    score = number("cibil_score")
    band = F.when(score.isNull(), "ntc")
    for low, high, label in CIBIL_BANDS:
        band = band.when((score >= low) & (score < high), label)
    delinquencies = sum(
        (F.coalesce(number(f"dpd_{d}_count_24m"), F.lit(0.0)) for d in (30, 60, 90)),
        F.lit(0.0),
    )
    out = {name: number(name) for name in BUREAU_CONTINUOUS}
    out["cibil_band"] = band
    out["is_new_to_credit"] = score.isNull().cast("int")
    out["is_thin_file"] = flag(
        F.coalesce(number("open_trade_count"), F.lit(0.0)) < THIN_FILE_TRADES
    )
    out["any_delinquency_24m"] = flag(delinquencies > 0)
    return out


def account_expressions() -> dict[str, Column]:
    salary, bounces = number("salary_credit_months_12m"), number("nach_bounce_count_12m")
    debit_credit = number("debit_credit_ratio_3m")
    return {
        "log_avg_monthly_balance_3m": log1p0(number("avg_monthly_balance_3m")),
        "salary_credit_months_12m": salary,
        "salary_regularity_12m": salary / 12.0,
        "nach_bounce_count_12m": bounces,
        "cash_withdrawal_ratio": number("cash_withdrawal_ratio"),
        "debit_credit_ratio_3m": debit_credit,
        "has_nach_bounce": flag(bounces > 0),
        "no_salary_credit": flag(F.coalesce(salary, F.lit(0.0)) == 0),
        "overspending_flag": flag(debit_credit > 1.0),
    }


def gst_expressions() -> dict[str, Column]:
    itc, slope_year = number("itc_to_output_ratio"), number("revenue_trend_slope_12m")
    return {
        "log_gstr1_revenue_monthly": log1p0(number("gstr1_revenue_monthly")),
        "itc_to_output_ratio": itc,
        "revenue_trend_slope_3m": number("revenue_trend_slope_3m"),
        "revenue_trend_slope_12m": slope_year,
        "filing_on_time_flag": flag(F.col("filing_on_time_flag").cast("boolean")),
        "itc_anomaly_flag": flag(itc > ITC_ANOMALY_THRESHOLD),
        "revenue_declining_flag": flag(slope_year < 0),
    }


def business_expressions() -> dict[str, Column]:
    def safe(num: str, den: str) -> Column:
        return finite(ratio(number(num), number(den)))

    dscr = safe("cash_flow_available", "debt_service")
    return {
        "dscr": dscr,
        "icr": safe("ebit", "interest_expense"),
        "current_ratio": safe("current_assets", "current_liabilities"),
        "debt_to_equity": safe("total_debt", "total_equity"),
        "auditor_quality": F.col("auditor_category"),
        "dscr_below_1": flag(dscr < 1.0),
        "negative_net_worth": flag(number("total_equity") < 0),
    }


def _project(df: DataFrame, keys: list[str], exprs: dict[str, Column]) -> DataFrame:
    key_cols = [
        F.col(k) if k == "observation_date" else F.col(k).cast("string").alias(k) for k in keys
    ]
    return df.select(*key_cols, *[c.alias(name) for name, c in exprs.items()])


def build_loan_features(df: DataFrame) -> DataFrame:
    """Loan keys, continuous and categorical loan features; no outcome column survives."""
    return _project(df, LOAN_KEYS, loan_expressions())


def build_bureau_features(df: DataFrame) -> DataFrame:
    return _project(df, FAMILY_KEYS, bureau_expressions())


def build_account_features(df: DataFrame) -> DataFrame:
    return _project(df, FAMILY_KEYS, account_expressions())


def build_gst_features(df: DataFrame) -> DataFrame:
    return _project(df, FAMILY_KEYS, gst_expressions())


def build_business_features(df: DataFrame) -> DataFrame:
    return _project(df, FAMILY_KEYS, business_expressions())


def build_macro_features(df: DataFrame) -> DataFrame:
    """Macro levels plus rate changes over 3 and 12 rows and the real policy rate.

    The series has one row per reading date, so the ordered window runs over a
    few hundred rows whatever the size of the loan book.
    """
    by_date = Window.orderBy(MACRO_DATE)
    repo = number("rbi_repo_rate_pct")
    dated = df.withColumn(MACRO_DATE, F.col(MACRO_DATE).cast("timestamp"))
    derived = {
        "repo_rate_change_3m": repo - F.lag(repo, 3).over(by_date),
        "repo_rate_change_12m": repo - F.lag(repo, 12).over(by_date),
        "real_repo_rate": repo - number("cpi_inflation_pct"),
    }
    return dated.select(
        MACRO_DATE,
        *[derived[c].alias(c) if c in derived else F.col(c) for c in MACRO_CONTINUOUS],
    ).orderBy(MACRO_DATE)
