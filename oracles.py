"""DuckDB SQL that states what every query must return, on the stored tables.

Used for verification only. Each statement builds the loan-book views from the
star-schema tables with its own SQL and computes the result independently of
the Spark plans.
"""

from __future__ import annotations

CONTINUOUS = {
    "loan": [
        "ltv_at_origination", "log_outstanding_principal", "log_sanctioned_limit",
        "drawn_to_sanctioned", "available_headroom", "loan_tenor_months",
        "months_on_book", "seasoning_ratio",
    ],
    "bureau": [
        "cibil_score", "dpd_30_count_24m", "dpd_60_count_24m", "dpd_90_count_24m",
        "months_since_last_delinquency", "revolving_utilisation", "open_trade_count",
        "oldest_trade_months", "enquiry_count_6m",
    ],
    "account": [
        "log_avg_monthly_balance_3m", "salary_credit_months_12m", "salary_regularity_12m",
        "nach_bounce_count_12m", "cash_withdrawal_ratio", "debit_credit_ratio_3m",
    ],
    "gst": [
        "log_gstr1_revenue_monthly", "itc_to_output_ratio", "revenue_trend_slope_3m",
        "revenue_trend_slope_12m",
    ],
    "macro": [
        "rbi_repo_rate_pct", "repo_rate_change_3m", "repo_rate_change_12m",
        "gdp_growth_yoy_pct", "wpi_inflation_pct", "cpi_inflation_pct", "iip_growth_pct",
        "msme_npa_index", "real_repo_rate",
    ],
}
TEXT = {"loan": ["product_type", "borrower_segment", "collateral_type"], "bureau": ["cibil_band"]}
FLAGS = {
    "loan": ["is_secured"],
    "bureau": ["is_new_to_credit", "is_thin_file", "any_delinquency_24m"],
    "account": ["has_nach_bounce", "no_salary_credit", "overspending_flag"],
    "gst": ["filing_on_time_flag", "itc_anomaly_flag", "revenue_declining_flag"],
}
FAMILIES = ["loan", "bureau", "account", "gst", "macro"]
ALL_CONTINUOUS = [c for f in FAMILIES for c in CONTINUOUS[f]]
ALL_CATEGORICAL = [
    c for f in FAMILIES for c in [*TEXT.get(f, []), *FLAGS.get(f, [])]
]


def key(prefix: str, column: str) -> str:
    text = f"{column}::VARCHAR"
    return f"concat('{prefix}', lpad({text}, greatest(8, length({text}))::INT, '0'))"


def risk(column: str) -> str:
    return f"(({column} * 7919) % 600)"


VIEWS = {
    "loans": f"""
SELECT {key('L', 'o_orderkey')} AS loan_id, {key('B', 'o_custkey')} AS borrower_id,
  o_orderdate AS observation_date,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'home_loan' WHEN 'AUTOMOBILE' THEN 'auto'
    WHEN 'HOUSEHOLD' THEN 'credit_card' WHEN 'FURNITURE' THEN 'lap' ELSE 'term_loan_sme' END AS product_type,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'retail_self_employed' WHEN 'MACHINERY' THEN 'msme'
    ELSE 'retail_salaried' END AS borrower_segment,
  o_totalprice AS outstanding_principal,
  CASE WHEN o_orderkey % 101 = 7 THEN NULL WHEN o_orderkey % 97 = 5 THEN 0e0
    ELSE o_totalprice * (1e0 + (o_orderkey % 7)::DOUBLE / 10e0) END AS sanctioned_limit,
  CASE WHEN o_orderkey % 89 = 3 THEN 0 ELSE 12 * (1 + o_orderkey % 20) END AS loan_tenor_months,
  o_orderkey % 120 AS months_on_book,
  CASE WHEN o_orderkey % 103 = 11 THEN NULL WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'immovable_property'
    WHEN c_mktsegment = 'AUTOMOBILE' THEN 'movable_assets' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'none'
    ELSE 'mixed' END AS collateral_type,
  (40 + o_orderkey % 80)::DOUBLE / 100e0 AS ltv_at_origination, n_name AS state_code,
  CASE WHEN o_orderkey % 50 = 1 THEN 2 WHEN o_orderkey % 25 = 2 THEN 1 ELSE 0 END AS sma_flag,
  o_orderkey % 50 = 1 AS npa_flag, o_orderkey % 67 = 4 AS restructured_flag,
  o_orderdate::DATE - (30 * (o_orderkey % 120))::INT AS disbursement_date,
  ((o_orderkey * 31 + 17) % 100 < CASE WHEN {risk('o_custkey')} < 150 THEN 30
    WHEN {risk('o_custkey')} < 300 THEN 15 ELSE 4 END)::INT AS y,
  CASE WHEN {risk('o_custkey')} < 150 THEN 0.30::DOUBLE WHEN {risk('o_custkey')} < 300 THEN 0.15::DOUBLE
    ELSE 0.04::DOUBLE END * ((80 + o_orderkey % 41)::DOUBLE / 100e0) AS p,
  (20 + o_orderkey % 60)::DOUBLE / 100e0 AS lgd
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "bureau": f"""
SELECT {key('B', 'c_custkey')} AS borrower_id,
  CASE WHEN c_custkey % 13 = 6 THEN NULL ELSE 300 + {risk('c_custkey')} END AS cibil_score,
  'ERS4.0' AS score_type,
  CASE WHEN {risk('c_custkey')} < 300 THEN c_custkey % 5 ELSE 0 END AS dpd_30_count_24m,
  CASE WHEN {risk('c_custkey')} < 300 THEN least(c_custkey % 5, 2) ELSE 0 END AS dpd_60_count_24m,
  CASE WHEN {risk('c_custkey')} < 150 THEN least(c_custkey % 5, 1) ELSE 0 END AS dpd_90_count_24m,
  CASE WHEN {risk('c_custkey')} < 300 AND c_custkey % 5 > 0 THEN c_custkey % 24 END AS months_since_last_delinquency,
  CASE WHEN c_custkey % 17 = 4 THEN NULL ELSE (c_custkey % 121)::DOUBLE / 100e0 END AS revolving_utilisation,
  c_custkey % 7 AS open_trade_count,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 6 + c_custkey % 180 END AS oldest_trade_months,
  c_custkey % 6 AS enquiry_count_6m
FROM customer WHERE c_custkey % 20 <> 9""",
    "gst": f"""
SELECT {key('B', 'c_custkey')} AS borrower_id, (50000 + (c_custkey * 977) % 900000)::DOUBLE AS revenue,
  c_custkey % 8 <> 3 AS filed, (55 + c_custkey % 50)::DOUBLE / 100e0 AS itc,
  ((c_custkey * 13) % 41 - 20)::DOUBLE / 100e0 AS slope3, ((c_custkey * 17) % 37 - 18)::DOUBLE / 100e0 AS slope12
FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "account": f"""
SELECT {key('B', 'c_custkey')} AS borrower_id, c_acctbal * 10e0 AS balance,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE c_custkey % 13 END AS salary,
  CASE WHEN c_custkey % 19 = 2 THEN NULL ELSE c_custkey % 4 END AS bounces,
  (c_custkey % 90)::DOUBLE / 100e0 AS cash, (50 + c_custkey % 71)::DOUBLE / 100e0 AS dcr
FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "macro": """
SELECT d::TIMESTAMP AS date, (40 + (i * 7) % 25)::DOUBLE / 10e0 AS repo, ((i * 11) % 60 - 10)::DOUBLE / 10e0 AS gdp,
  (20 + (i * 3) % 30)::DOUBLE / 10e0 AS wpi, (30 + (i * 5) % 40)::DOUBLE / 10e0 AS cpi,
  ((i * 13) % 80 - 20)::DOUBLE / 10e0 AS iip, (80 + (i * 17) % 200)::DOUBLE / 100e0 AS msme
FROM (SELECT d, year(d) * 12 + month(d) AS i
      FROM (SELECT DISTINCT last_day(o_orderdate) AS d FROM orders) WHERE month(d) <> 6)""",
    "identities": f"""
SELECT {key('B', 'c_custkey')} AS borrower_id,
  concat('9', lpad(c_custkey::VARCHAR, greatest(9, length(c_custkey::VARCHAR))::INT, '0')) AS mobile,
  CASE WHEN v = 1 THEN c_name || ' II' ELSE c_name END AS name, c_custkey * 2 + v AS seq
FROM customer, (VALUES (0), (1)) AS t(v) WHERE c_custkey % 20 <> 9 AND (v = 0 OR c_custkey % 10 = 0)""",
    "loan_f": """
SELECT loan_id, borrower_id, observation_date, y, p, lgd, ltv_at_origination,
  ln(1e0 + CASE WHEN outstanding_principal < 0 THEN 0 ELSE outstanding_principal END) AS log_outstanding_principal,
  ln(1e0 + CASE WHEN sanctioned_limit < 0 THEN 0 ELSE sanctioned_limit END) AS log_sanctioned_limit,
  CASE WHEN sanctioned_limit > 0 THEN outstanding_principal / sanctioned_limit END AS drawn_to_sanctioned,
  1e0 - CASE WHEN sanctioned_limit > 0 THEN outstanding_principal / sanctioned_limit END AS available_headroom,
  loan_tenor_months::DOUBLE AS loan_tenor_months, months_on_book::DOUBLE AS months_on_book,
  CASE WHEN loan_tenor_months > 0 THEN months_on_book::DOUBLE / loan_tenor_months::DOUBLE END AS seasoning_ratio,
  product_type, borrower_segment, collateral_type,
  (collateral_type IS DISTINCT FROM 'none')::INT AS is_secured, state_code
FROM loans""",
    "bureau_f": """
SELECT borrower_id, cibil_score::DOUBLE AS cibil_score, dpd_30_count_24m::DOUBLE AS dpd_30_count_24m,
  dpd_60_count_24m::DOUBLE AS dpd_60_count_24m, dpd_90_count_24m::DOUBLE AS dpd_90_count_24m,
  months_since_last_delinquency::DOUBLE AS months_since_last_delinquency, revolving_utilisation,
  open_trade_count::DOUBLE AS open_trade_count, oldest_trade_months::DOUBLE AS oldest_trade_months,
  enquiry_count_6m::DOUBLE AS enquiry_count_6m,
  CASE WHEN cibil_score IS NULL THEN 'ntc' WHEN cibil_score < 300 OR cibil_score >= 901 THEN NULL
    WHEN cibil_score < 650 THEN 'poor' WHEN cibil_score < 700 THEN 'fair' WHEN cibil_score < 750 THEN 'good'
    WHEN cibil_score < 800 THEN 'very_good' ELSE 'excellent' END AS cibil_band,
  (cibil_score IS NULL)::INT AS is_new_to_credit, (coalesce(open_trade_count, 0) < 2)::INT AS is_thin_file,
  (coalesce(dpd_30_count_24m, 0) + coalesce(dpd_60_count_24m, 0) + coalesce(dpd_90_count_24m, 0) > 0)::INT AS any_delinquency_24m
FROM bureau""",
    "account_f": """
SELECT borrower_id, ln(1e0 + CASE WHEN balance < 0 THEN 0 ELSE balance END) AS log_avg_monthly_balance_3m,
  salary::DOUBLE AS salary_credit_months_12m, salary::DOUBLE / 12e0 AS salary_regularity_12m,
  bounces::DOUBLE AS nach_bounce_count_12m, cash AS cash_withdrawal_ratio, dcr AS debit_credit_ratio_3m,
  (coalesce(bounces, 0) > 0)::INT AS has_nach_bounce, (coalesce(salary, 0) = 0)::INT AS no_salary_credit,
  coalesce(dcr > 1e0, false)::INT AS overspending_flag
FROM account""",
    "gst_f": """
SELECT borrower_id, ln(1e0 + CASE WHEN revenue < 0 THEN 0 ELSE revenue END) AS log_gstr1_revenue_monthly,
  itc AS itc_to_output_ratio, slope3 AS revenue_trend_slope_3m, slope12 AS revenue_trend_slope_12m,
  filed::INT AS filing_on_time_flag, (itc > 0.90::DOUBLE)::INT AS itc_anomaly_flag,
  (slope12 < 0)::INT AS revenue_declining_flag
FROM gst""",
    "macro_f": """
SELECT date, repo AS rbi_repo_rate_pct, repo - lag(repo, 3) OVER (ORDER BY date) AS repo_rate_change_3m,
  repo - lag(repo, 12) OVER (ORDER BY date) AS repo_rate_change_12m, gdp AS gdp_growth_yoy_pct,
  wpi AS wpi_inflation_pct, cpi AS cpi_inflation_pct, iip AS iip_growth_pct, msme AS msme_npa_index,
  repo - cpi AS real_repo_rate
FROM macro""",
}


def _columns(family: str) -> list[str]:
    return [*CONTINUOUS.get(family, []), *TEXT.get(family, []), *FLAGS.get(family, [])]


def _matrix(bureau: bool) -> str:
    families = ["account", "gst"] if not bureau else ["bureau", "account", "gst"]
    columns = ["l.loan_id", "l.borrower_id", "l.observation_date", "l.y"]
    columns += [f"l.{c}" for c in _columns("loan")]
    columns += [f"{f}_f.{c}" for f in families for c in _columns(f)]
    columns += [f"m.{c}" for c in _columns("macro")]
    joins = " ".join(f"LEFT JOIN {f}_f ON {f}_f.borrower_id = l.borrower_id" for f in families)
    return (
        f"SELECT {', '.join(columns)} FROM loan_f l {joins} "
        "ASOF LEFT JOIN macro_f m ON l.observation_date >= m.date"
    )


VIEWS["matrix"] = _matrix(True)
VIEWS["matrix_no_bureau"] = _matrix(False)

_NEEDS = {
    "loan_f": ["loans"],
    "bureau_f": ["bureau"],
    "account_f": ["account"],
    "gst_f": ["gst"],
    "macro_f": ["macro"],
    "matrix": ["loan_f", "bureau_f", "account_f", "gst_f", "macro_f"],
    "matrix_no_bureau": ["loan_f", "account_f", "gst_f", "macro_f"],
}


def statement(body: str, *views: str, **ctes: str) -> str:
    """``body`` with the views it uses, and further named subqueries, in front."""
    order: list[str] = []

    def need(view: str) -> None:
        for v in _NEEDS.get(view, []):
            need(v)
        if view not in order:
            order.append(view)

    for v in views:
        need(v)
    parts = [f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in order]
    parts += [f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def d(column: str, name: str | None = None, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor(({column})::DOUBLE * {scale} + 0.5::DOUBLE) / {scale} AS {name or column}"


def i(column: str, name: str | None = None) -> str:
    return f"({column})::BIGINT AS {name or column}"


def day(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d') AS {name or column}"


def picked(family: str) -> str:
    out = [d(c) for c in CONTINUOUS.get(family, [])]
    return ", ".join(out + TEXT.get(family, []) + [i(c) for c in FLAGS.get(family, [])])


def matrix_columns(bureau: bool = True) -> str:
    use = [f for f in FAMILIES if bureau or f != "bureau"]
    return ", ".join(
        ["loan_id", "borrower_id", day("observation_date"), i("y", "default_flag_12m")]
        + [picked(f) for f in use]
    )


# --------------------------------------------------------------- encoders

_GRID = "[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]"
_LONG = " UNION ALL ".join(
    f"SELECT loan_id, '{c}' AS feature, {c}::DOUBLE AS x, y FROM matrix" for c in ALL_CONTINUOUS
)
_LONG_TEXT = " UNION ALL ".join(
    f"SELECT loan_id, '{c}' AS feature, {c}::VARCHAR AS x, y FROM matrix" for c in ALL_CATEGORICAL
)


def _woe(e: str, g: str, n: str) -> tuple[str, str]:
    bad = f"(({e} + 0.5::DOUBLE) / (te + 0.5::DOUBLE * {n}))"
    good = f"(({g} + 0.5::DOUBLE) / (tg + 0.5::DOUBLE * {n}))"
    w = f"greatest(-3e0, least(3e0, ln({good} / {bad})))"
    return w, f"({good} - {bad}) * {w}"


_W, _IV = _woe("e", "g", "n")
WOE_CTES = {
    "tot": "SELECT sum(y)::DOUBLE AS te, sum(1 - y)::DOUBLE AS tg, count(*) AS rows FROM matrix",
    "long": _LONG,
    "edges": f"SELECT feature, list_sort(list_distinct(quantile_cont(x, {_GRID}))) AS e FROM long GROUP BY feature",
    "cuts": "SELECT feature, CASE WHEN len(e) > 2 THEN e[2:len(e) - 1] ELSE []::DOUBLE[] END AS c FROM edges",
    "coded": """SELECT loan_id, feature, y, len(c) + 1 AS nb,
      CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(c, lambda k: k <= x)) END AS bin
      FROM long JOIN cuts USING (feature)""",
    "cells": """SELECT feature, bin, CASE WHEN bin = -1 THEN 1 ELSE max(nb) END AS n,
      sum(y)::DOUBLE AS e, sum(1 - y)::DOUBLE AS g FROM coded GROUP BY feature, bin""",
    "cont": f"SELECT feature, bin, e, g, {_W} AS woe, {_IV} AS iv FROM cells, tot",
    "longt": _LONG_TEXT,
    "lv": "SELECT feature, x, count(*) AS k, sum(y)::DOUBLE AS e, sum(1 - y)::DOUBLE AS g FROM longt GROUP BY feature, x",
    "roles": """SELECT feature, CASE WHEN x IS NULL THEN '__MISSING__' WHEN k >= 0.02::DOUBLE * rows THEN x
      ELSE '__OTHER__' END AS level, e, g FROM lv, tot
      UNION ALL SELECT DISTINCT feature, '__OTHER__', 0e0, 0e0 FROM lv""",
    "grp": "SELECT feature, level, sum(e) AS e, sum(g) AS g FROM roles GROUP BY feature, level",
    "grpn": """SELECT *, CASE WHEN level = '__MISSING__' THEN 1 ELSE
      count(*) FILTER (level <> '__MISSING__') OVER (PARTITION BY feature) END AS n FROM grp""",
    "cat": f"SELECT feature, level, e, g, {_W} AS woe, {_IV} AS iv FROM grpn, tot",
}


def _woe_statement(body: str) -> str:
    return statement(body, "matrix", **WOE_CTES)


_WOE_LONG = """
SELECT loan_id, feature, woe FROM coded JOIN cont USING (feature, bin)
UNION ALL
SELECT loan_id, l.feature, c.woe FROM longt l JOIN cat c ON c.feature = l.feature AND c.level =
  CASE WHEN l.x IS NULL THEN '__MISSING__'
       WHEN EXISTS (SELECT 1 FROM cat k WHERE k.feature = l.feature AND k.level = l.x) THEN l.x ELSE '__OTHER__' END"""

_MED = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in ALL_CONTINUOUS)
_MODES = """SELECT feature, arg_min(x, (-k, x)) AS mode FROM lv WHERE x IS NOT NULL GROUP BY feature"""
_LEVELS = """SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS code
  FROM lv WHERE x IS NOT NULL"""


def _tree() -> str:
    cont = ", ".join(d(f"coalesce({c}, m_{c})", c) for c in ALL_CONTINUOUS)
    cats = ", ".join(
        f"(SELECT code FROM codes WHERE feature = '{c}' AND x = coalesce(matrix.{c}::VARCHAR, "
        f"(SELECT mode FROM modes WHERE feature = '{c}')))::DOUBLE AS {c}"
        for c in ALL_CATEGORICAL
    )
    return statement(
        f"SELECT loan_id, {cont}, {cats} FROM matrix, med",
        "matrix",
        med=f"SELECT {_MED} FROM matrix",
        longt=_LONG_TEXT,
        lv=WOE_CTES["lv"],
        modes=_MODES,
        codes=_LEVELS,
    )


def _clip(c: str) -> str:
    return f"least(greatest({c}, q1_{c} - 1.5::DOUBLE * (q3_{c} - q1_{c})), q3_{c} + 1.5::DOUBLE * (q3_{c} - q1_{c}))"


# Levels of the one-hot columns that the driver tables produce.
ONE_HOT = {
    "product_type": ["auto", "credit_card", "home_loan", "lap", "term_loan_sme"],
    "borrower_segment": ["msme", "retail_salaried", "retail_self_employed"],
    "collateral_type": ["immovable_property", "mixed", "movable_assets", "none"],
    "cibil_band": ["excellent", "fair", "good", "ntc", "poor", "very_good"],
}


def _neural() -> str:
    quart = ", ".join(
        f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in ALL_CONTINUOUS
    )
    imp = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in ALL_CONTINUOUS)
    clipped = ", ".join(f"{_clip(c)} AS {c}" for c in ALL_CONTINUOUS)
    stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in ALL_CONTINUOUS)
    cont = ", ".join(
        d(f"({c} - a_{c}) / CASE WHEN s_{c} < 1e-12 THEN 1e0 ELSE s_{c} END", c) for c in ALL_CONTINUOUS
    )
    hot = []
    for c in ALL_CATEGORICAL:
        for level in ONE_HOT.get(c, ["0", "1"]):
            hot.append(
                f"(coalesce(t_{c}, (SELECT mode FROM modes WHERE feature = '{c}')) = '{level}')::INT::DOUBLE AS {c}_{level}"
            )
    texts = ", ".join(f"{c}::VARCHAR AS t_{c}" for c in ALL_CATEGORICAL)
    return statement(
        f"SELECT loan_id, {cont}, {', '.join(hot)} FROM clipped, stats",
        "matrix",
        med=f"SELECT {_MED} FROM matrix",
        imputed=f"SELECT loan_id, {imp}, {texts} FROM matrix, med",
        quart=f"SELECT {quart} FROM imputed",
        clipped=f"SELECT loan_id, {clipped}, {', '.join('t_' + c for c in ALL_CATEGORICAL)} FROM imputed, quart",
        stats=f"SELECT {stats} FROM clipped",
        longt=_LONG_TEXT,
        lv=WOE_CTES["lv"],
        modes=_MODES,
    )


# --------------------------------------------------------------- bureau reports

_HISTORY = f"""
SELECT o_custkey AS cust, o_orderkey AS k, m,
  CASE WHEN {risk('o_custkey')} >= 300 THEN 'STD'
    WHEN (o_orderkey * 31 + m * 17) % 40 = 0 THEN '090' WHEN (o_orderkey * 31 + m * 17) % 40 = 1 THEN '030'
    WHEN (o_orderkey * 31 + m * 17) % 40 = 2 THEN 'SMA' WHEN (o_orderkey * 31 + m * 17) % 40 = 3 THEN '060'
    WHEN (o_orderkey * 31 + m * 17) % 40 = 4 THEN 'SUB' ELSE 'STD' END AS code
FROM orders, range(24) t(m)"""
_DPD = f"""
SELECT cust, count(*) FILTER (code IN ('090','030','SMA','060','SUB')) AS dpd_30_count_24m,
  count(*) FILTER (code IN ('090','060','SUB')) AS dpd_60_count_24m,
  count(*) FILTER (code IN ('090','SUB')) AS dpd_90_count_24m,
  min(m) FILTER (code IN ('090','030','SMA','060','SUB')) AS months_since_last_delinquency
FROM ({_HISTORY}) GROUP BY cust"""
_ACCOUNTS = """
SELECT o_custkey AS cust,
  sum(CASE WHEN o_orderkey % 6 IN (0, 1, 5) THEN coalesce(CASE WHEN o_orderkey % 101 <> 7 THEN o_totalprice END, 0) ELSE 0 END) AS lim,
  sum(CASE WHEN o_orderkey % 6 IN (0, 1, 5) THEN o_totalprice * (o_orderkey % 25)::DOUBLE / 10e0 ELSE 0 END) AS bal,
  count(*) FILTER (o_orderkey % 3 <> 2) AS open_trade_count,
  min(o_orderdate::DATE) FILTER (o_orderkey % 61 <> 8) AS opened,
  count(*) FILTER (o_orderkey % 400 - 10 BETWEEN 0 AND 182) AS enquiry_count_6m
FROM orders GROUP BY o_custkey"""
_SCORE = """CASE WHEN cust % 29 = 1 OR cust % 13 = 6 THEN NULL ELSE 300 + (cust * 7919) % 600 END"""
_UTIL = "CASE WHEN lim > 0 THEN least(bal / lim, 2e0) END"
_AGE = "greatest(0, (DATE '2001-08-01' - opened) // 30)"

SCORED_COLUMNS = "loan_id, y, p"

_METRIC_CTES = {
    "s": "SELECT p, sum(y)::DOUBLE AS b, sum(1 - y)::DOUBLE AS g FROM loans GROUP BY p",
    "c": """SELECT *, sum(b) OVER w AS cb, sum(g) OVER w AS cg, sum(b) OVER () AS nb, sum(g) OVER () AS ng
      FROM s WINDOW w AS (ORDER BY p ROWS UNBOUNDED PRECEDING)""",
    "ranked": "SELECT sum(b * (cg - g / 2e0)) / max(nb * ng) AS auc, max(abs(cb / nb - cg / ng)) AS ks FROM c",
    "hle": f"SELECT list_sort(list_distinct(quantile_cont(p, {_GRID}))) AS e FROM loans",
    "hlb": """SELECT len(list_filter(e[2:len(e) - 1], lambda k: k < p)) AS bin, count(*)::DOUBLE AS n,
      sum(y)::DOUBLE AS o, sum(p) AS x, max(len(e) - 1) AS groups FROM loans, hle GROUP BY bin""",
    "hl": """SELECT sum((o - x) ** 2 / x + ((n - o) - (n - x)) ** 2 / (n - x)) AS stat, max(groups) AS groups FROM hlb""",
    "hlp": """SELECT stat, groups, exp(-stat / 2) * list_sum([(stat / 2) ** i / factorial(i::INT) FOR i IN range((groups - 2) // 2)]) AS pv FROM hl""",
    "agg": "SELECT avg((p - y) ** 2) AS brier, count(*) AS n, sum(y) AS n_default FROM loans",
}


def _metric(body: str) -> str:
    return statement(body, "loans", **_METRIC_CTES)


_EAD = """CASE WHEN product_type = 'credit_card' THEN outstanding_principal + 0.75::DOUBLE *
  greatest(coalesce(sanctioned_limit, outstanding_principal) - outstanding_principal, 0e0)
  ELSE outstanding_principal END"""

_PSI_FEATURES = ["p", "lgd", "ltv_at_origination", "months_on_book"]
_PSI_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, observation_date < TIMESTAMP '2000-01-01' AS base FROM loans"
    for c in _PSI_FEATURES
)
_PSI_CTES = {
    "long": _PSI_LONG,
    "edges": f"SELECT feature, list_sort(list_distinct(quantile_cont(x, {_GRID}))) AS e FROM long WHERE base GROUP BY feature",
    "coded": """SELECT feature, base, len(list_filter(e[2:len(e) - 1], lambda k: k <= x)) AS bin
      FROM long JOIN edges USING (feature)""",
    "cells": """SELECT feature, bin, count(*) FILTER (base) AS n_baseline, count(*) FILTER (NOT base) AS n_current
      FROM coded GROUP BY feature, bin""",
    "shares": """SELECT feature, bin, n_baseline, n_current,
      n_baseline::DOUBLE / sum(n_baseline) OVER (PARTITION BY feature) AS b,
      n_current::DOUBLE / sum(n_current) OVER (PARTITION BY feature) AS a FROM cells""",
}

_FEATURE_PSI_CTES = {
    "long": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, m.observation_date < TIMESTAMP '2000-01-01' AS base FROM matrix m JOIN (SELECT loan_id, p FROM loans) USING (loan_id)"
        for c in ["p", *ALL_CONTINUOUS]
    ),
    "edges": f"SELECT feature, list_sort(list_distinct(quantile_cont(x, {_GRID}))) AS e FROM long WHERE base AND x IS NOT NULL GROUP BY feature",
    "coded": """SELECT feature, base, CASE WHEN x IS NULL THEN -1 WHEN e IS NULL THEN 0
      ELSE len(list_filter(e[2:len(e) - 1], lambda k: k <= x)) END AS bin FROM long LEFT JOIN edges USING (feature)""",
    "cells": _PSI_CTES["cells"],
    "shares": """SELECT feature, bin, n_baseline, n_current,
      n_baseline::DOUBLE / nullif(sum(n_baseline) OVER (PARTITION BY feature), 0) AS b,
      n_current::DOUBLE / nullif(sum(n_current) OVER (PARTITION BY feature), 0) AS a FROM cells""",
}


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["loan_features"] = statement(
        f"SELECT loan_id, borrower_id, {day('observation_date')}, {picked('loan')}, state_code FROM loan_f", "loan_f"
    )
    for f in ("bureau", "account", "gst"):
        sql[f"{f}_features"] = statement(
            f"SELECT borrower_id, '2001-08-01' AS observation_date, {picked(f)} FROM {f}_f", f"{f}_f"
        )
    sql["business_features"] = f"""
WITH f AS (SELECT {key('B', 's_suppkey')} AS borrower_id, s_acctbal * 12e0 AS cf,
  CASE WHEN s_suppkey % 11 = 3 THEN 0e0 ELSE (20000 + (s_suppkey * 37) % 60000)::DOUBLE END AS ds,
  s_acctbal * 8e0 AS ebit, (10000 + (s_suppkey * 53) % 40000)::DOUBLE AS ie,
  ((s_suppkey * 71) % 50000)::DOUBLE AS ca, ((s_suppkey * 29) % 30000)::DOUBLE AS cl,
  ((s_suppkey % 9) * 1000)::DOUBLE AS debt, ((s_suppkey % 10 - 3) * 1000)::DOUBLE AS eq,
  CASE s_suppkey % 3 WHEN 0 THEN 'big4' WHEN 1 THEN 'national' ELSE 'local' END AS aud FROM supplier)
SELECT borrower_id, '2001-08-01' AS observation_date, {d('CASE WHEN ds > 0 THEN cf / ds END', 'dscr')},
  {d('CASE WHEN ie > 0 THEN ebit / ie END', 'icr')}, {d('CASE WHEN cl > 0 THEN ca / cl END', 'current_ratio')},
  {d('CASE WHEN eq > 0 THEN debt / eq END', 'debt_to_equity')}, aud AS auditor_quality,
  {i('coalesce(CASE WHEN ds > 0 THEN cf / ds END < 1e0, false)::INT', 'dscr_below_1')},
  {i('(eq < 0)::INT', 'negative_net_worth')} FROM f"""
    sql["macro_features"] = statement(f"SELECT {day('date')}, {picked('macro')} FROM macro_f", "macro_f")
    sql["asof_macro"] = statement(
        f"SELECT loan_id, {day('observation_date')}, {picked('macro')} FROM loans ASOF LEFT JOIN macro_f "
        "ON observation_date >= date",
        "loans", "macro_f",
    )
    sql["asof_macro_scan"] = sql["asof_macro"]
    sql["family_left_join"] = statement(
        f"SELECT loan_id, l.borrower_id, {picked('account')} FROM loan_f l LEFT JOIN account_f a ON l.borrower_id = a.borrower_id",
        "loan_f", "account_f",
    )
    sql["bureau_semi_join"] = statement(
        """SELECT borrower_id, '2001-08-01' AS observation_date, cibil_score::BIGINT AS cibil_score, score_type,
        dpd_30_count_24m::BIGINT AS dpd_30_count_24m, dpd_60_count_24m::BIGINT AS dpd_60_count_24m,
        dpd_90_count_24m::BIGINT AS dpd_90_count_24m, months_since_last_delinquency::BIGINT AS months_since_last_delinquency,
        floor(revolving_utilisation * 1e6 + 0.5::DOUBLE) / 1e6 AS revolving_utilisation, open_trade_count::BIGINT AS open_trade_count,
        oldest_trade_months::BIGINT AS oldest_trade_months, enquiry_count_6m::BIGINT AS enquiry_count_6m
        FROM bureau WHERE borrower_id IN (SELECT borrower_id FROM loans)""",
        "bureau", "loans",
    )
    sql["missing_identities"] = statement(
        "SELECT DISTINCT borrower_id FROM loans WHERE borrower_id NOT IN (SELECT borrower_id FROM identities)",
        "loans", "identities",
    )
    sql["identities_keep_first"] = statement(
        "SELECT borrower_id, mobile, name, seq::BIGINT AS seq FROM (SELECT *, row_number() OVER "
        "(PARTITION BY borrower_id ORDER BY seq) AS rn FROM identities) WHERE rn = 1",
        "identities",
    )
    who = f"{key('B', 'cust')} AS borrower_id"
    sql["bureau_report_dpd"] = (
        f"SELECT {who}, {i('dpd_30_count_24m')}, {i('dpd_60_count_24m')}, {i('dpd_90_count_24m')}, "
        f"{i('months_since_last_delinquency')} FROM ({_DPD})"
    )
    sql["bureau_report_utilisation"] = f"SELECT {who}, {d(_UTIL, 'revolving_utilisation')} FROM ({_ACCOUNTS})"
    sql["bureau_report_trades"] = (
        f"SELECT {who}, {i('open_trade_count')}, {i(_AGE, 'oldest_trade_months')} FROM ({_ACCOUNTS})"
    )
    sql["bureau_report_enquiries"] = f"SELECT {who}, {i('enquiry_count_6m')} FROM ({_ACCOUNTS})"
    sql["bureau_report_score"] = (
        f"SELECT {who}, {i(_SCORE, 'cibil_score')}, CASE WHEN cust % 29 <> 1 THEN 'ERS4.0' END AS score_type "
        f"FROM ({_ACCOUNTS})"
    )
    known = "cust % 20 <> 9 AND cust % 31 NOT IN (2, 3, 4, 5)"
    sql["bureau_report_rows"] = (
        f"SELECT {who}, '2001-08-01' AS observation_date, {i(_SCORE, 'cibil_score')}, "
        "CASE WHEN cust % 29 <> 1 THEN 'ERS4.0' END AS score_type, "
        f"{i('dpd_30_count_24m')}, {i('dpd_60_count_24m')}, {i('dpd_90_count_24m')}, "
        f"{i('months_since_last_delinquency')}, {d(_UTIL, 'revolving_utilisation')}, {i('open_trade_count')}, "
        f"{i(_AGE, 'oldest_trade_months')}, {i('enquiry_count_6m')} "
        f"FROM ({_ACCOUNTS}) JOIN ({_DPD}) USING (cust) WHERE {known}"
    )
    sql["report_classes"] = """
SELECT CASE cust % 31 WHEN 2 THEN 'not_found' WHEN 3 THEN 'consent_missing' WHEN 4 THEN 'credits_exhausted'
  WHEN 5 THEN 'error' ELSE 'ok' END AS response_class, count(*)::BIGINT AS n
FROM (SELECT DISTINCT o_custkey AS cust FROM orders) GROUP BY 1"""
    sql["pd_matrix"] = statement(f"SELECT {matrix_columns()} FROM matrix", "matrix")
    sql["pd_matrix_no_bureau"] = statement(
        f"SELECT {matrix_columns(False)} FROM matrix_no_bureau", "matrix_no_bureau"
    )
    sql["default_rate_by_product"] = statement(
        f"SELECT coalesce(product_type, 'ALL') AS product_type, {d('avg(y) * 100e0', 'default_rate')}, "
        f"{i('count(*)', 'n_loans')} FROM loans GROUP BY ROLLUP (product_type)",
        "loans",
    )
    sql["oot_fold_counts"] = statement(
        """SELECT CASE WHEN observation_date <= TIMESTAMP '1999-12-31' THEN 'train'
        WHEN observation_date <= TIMESTAMP '2000-12-31' THEN 'validation' ELSE 'test' END AS fold,
        count(*)::BIGINT AS n FROM loans WHERE observation_date <= TIMESTAMP '2001-08-31' GROUP BY 1""",
        "loans",
    )
    sql["woe_bins_continuous"] = _woe_statement(
        f"SELECT feature, {i('bin')}, {i('e', 'events')}, {i('g', 'non_events')}, {d('woe')}, {d('iv')} FROM cont"
    )
    sql["woe_bins_categorical"] = _woe_statement(
        f"SELECT feature, level, {i('e', 'events')}, {i('g', 'non_events')}, {d('woe')}, {d('iv')} FROM cat"
    )
    woe_names = [*ALL_CONTINUOUS, *ALL_CATEGORICAL]
    pivot = ", ".join(
        d(f"max(CASE WHEN feature = '{c}' THEN woe END)", f"{c}_woe") for c in woe_names
    )
    sql["woe_transform"] = _woe_statement(f"SELECT loan_id, {pivot} FROM ({_WOE_LONG}) GROUP BY loan_id")
    sql["iv_summary"] = _woe_statement(
        """SELECT feature, floor(iv * 1e6 + 0.5::DOUBLE) / 1e6 AS iv, CASE WHEN iv < 0.02 THEN 'useless' WHEN iv < 0.10 THEN 'weak'
        WHEN iv < 0.30 THEN 'medium' ELSE 'strong' END AS strength, iv >= 0.30 AS leakage_warning, kind FROM (
        SELECT feature, sum(iv) AS iv, 'continuous' AS kind FROM cont GROUP BY feature UNION ALL
        SELECT feature, sum(iv) AS iv, 'categorical' AS kind FROM cat GROUP BY feature)"""
    )
    quart = ", ".join(
        f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in ALL_CONTINUOUS
    )
    clipped = ", ".join(
        d(f"CASE WHEN {c} IS NOT NULL THEN {_clip(c)} END", c) for c in ALL_CONTINUOUS
    )
    sql["iqr_clip"] = statement(
        f"SELECT loan_id, {clipped} FROM matrix, quart", "matrix", quart=f"SELECT {quart} FROM matrix"
    )
    sql["tree_preprocess"] = _tree()
    sql["neural_preprocess"] = _neural()
    sql["scorecard_points"] = statement(
        "SELECT loan_id, " + d(
            "600e0 - (20e0 / ln(2e0)) * ln(50e0) + (20e0 / ln(2e0)) * ln((1e0 - p) / p)", "points"
        ) + " FROM loans",
        "loans",
    )
    sql["auc_gini"] = _metric(f"SELECT {d('auc', digits=9)}, {d('2e0 * auc - 1e0', 'gini', 9)} FROM ranked")
    sql["ks"] = _metric(f"SELECT {d('ks', digits=9)} FROM ranked")
    sql["brier"] = _metric(f"SELECT {d('brier', digits=9)} FROM agg")
    sql["hosmer_lemeshow"] = _metric(
        f"SELECT {d('stat', 'statistic')}, {d('pv', 'p_value')}, {i('groups - 2', 'dof')}, {i('groups', 'n_groups')} FROM hlp"
    )
    sql["pd_metrics"] = _metric(
        f"SELECT {d('2e0 * auc - 1e0', 'gini')}, {d('ks')}, {d('auc')}, {d('brier')}, {d('stat', 'hl_statistic')}, "
        f"{d('pv', 'hl_pvalue')}, {i('n')}, {i('n_default')} FROM ranked, agg, hlp"
    )
    # ------------------------------------------------------------ portfolio
    sql["expected_loss_rollup"] = statement(
        f"""SELECT coalesce(borrower_segment, 'ALL') AS borrower_segment, coalesce(product_type, 'ALL') AS product_type,
        {i('count(*)', 'n_loans')}, {d('sum(ead)', 'ead', 1)}, {d('sum(p * lgd * ead)', 'expected_loss', 1)},
        {d('sum(p * lgd * ead) / sum(ead)', 'loss_rate')} FROM (SELECT *, {_EAD} AS ead FROM loans)
        GROUP BY ROLLUP (borrower_segment, product_type)""",
        "loans",
    )
    sql["stressed_expected_loss"] = statement(
        f"""SELECT borrower_segment, scenario, {d('sum(least(p * mult, 1e0) * least(lgd + (1e0 - lgd) * haircut, 1e0) * ead)', 'expected_loss', 1)}
        FROM (SELECT *, {_EAD} AS ead FROM loans),
        (VALUES ('baseline', 1e0, 0e0), ('moderate', 1.5::DOUBLE, 0e0), ('severe', 3e0, 0.35::DOUBLE)) s(scenario, mult, haircut)
        GROUP BY borrower_segment, scenario""",
        "loans",
    )
    sql["sma_transitions"] = statement(
        """SELECT f AS from_stage, t AS to_stage, n::BIGINT AS n, floor(n::DOUBLE / sum(n) OVER (PARTITION BY f) * 1e6 + 0.5::DOUBLE) / 1e6 AS rate
        FROM (SELECT ['SMA-0','SMA-1','SMA-2','NPA'][a.r + 1] AS f, ['SMA-0','SMA-1','SMA-2','NPA'][b.r + 1] AS t, count(*) AS n
              FROM w a JOIN w b ON a.borrower_id = b.borrower_id AND b.q = a.q + 1 GROUP BY ALL)""",
        "loans",
        w="""SELECT borrower_id, year(observation_date) * 4 + quarter(observation_date) - 1 AS q,
          max(CASE WHEN npa_flag THEN 3 ELSE sma_flag END) AS r FROM loans GROUP BY ALL""",
    )
    sql["credit_conversion_factors"] = statement(
        f"""SELECT borrower_segment, {d('avg(ccf)', 'mean_ccf')}, {d('quantile_cont(ccf, 0.9)', 'p90_ccf')}, {i('count(*)', 'n')}
        FROM (SELECT borrower_segment, least(greatest(((drawn + (lim - drawn) * lgd) - drawn) / (lim - drawn), 0e0), 1e0) AS ccf
              FROM (SELECT borrower_segment, outstanding_principal AS drawn, sanctioned_limit AS lim, lgd FROM loans) WHERE lim - drawn > 0)
        GROUP BY borrower_segment""",
        "loans",
    )
    sql["default_within_a_year"] = statement(
        f"""SELECT a.loan_id, a.borrower_id, {day('a.d', 'day')}, {i('''(EXISTS (SELECT 1 FROM x b WHERE b.borrower_id = a.borrower_id
        AND b.hit AND b.d > a.d AND b.d <= a.d + INTERVAL 12 MONTH))::INT''', 'default_next_12m')} FROM (SELECT loan_id, borrower_id, observation_date::DATE AS d FROM loans) a""",
        "loans",
        x="SELECT borrower_id, observation_date::DATE AS d, bool_or(npa_flag) AS hit FROM loans GROUP BY ALL",
    )
    sql["vintage_curves"] = statement(
        f"""SELECT vintage, {i('age')}, {i('n_loans')}, {i('n_default')},
        {i('sum(n_default) OVER (PARTITION BY vintage ORDER BY age)', 'cum_default')},
        {d('sum(n_default) OVER (PARTITION BY vintage ORDER BY age)::DOUBLE / sum(n_loans) OVER (PARTITION BY vintage)', 'cum_default_rate')}
        FROM (SELECT strftime(disbursement_date, '%Y-%m') AS vintage, months_on_book AS age, count(*) AS n_loans,
              sum(y) AS n_default FROM loans GROUP BY ALL)""",
        "loans",
    )
    sql["disparate_impact"] = statement(
        f"""SELECT state_code, {i('n')}, {d('rate', 'favourable_rate')}, {d('rate / max(rate) OVER ()', 'impact_ratio')},
        rate / max(rate) OVER () >= 0.80::DOUBLE AS passes
        FROM (SELECT state_code, count(*) AS n, avg((p < 0.10::DOUBLE)::INT) AS rate FROM loans GROUP BY state_code)""",
        "loans",
    )
    sql["psi"] = statement(
        f"""SELECT feature, {d('psi')}, CASE WHEN psi >= 0.40 THEN 'retrain' WHEN psi >= 0.25 THEN 'alert' ELSE 'stable' END AS status
        FROM (SELECT feature, sum((greatest(a, 1e-4) - greatest(b, 1e-4)) * ln(greatest(a, 1e-4) / greatest(b, 1e-4))) AS psi
              FROM shares GROUP BY feature)""",
        "loans", **_PSI_CTES,
    )
    sql["jensen_shannon"] = statement(
        f"""SELECT feature, {d('''sum((CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2e0)) ELSE 0 END
        + CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2e0)) ELSE 0 END) / 2e0)''', 'js_divergence')} FROM shares GROUP BY feature""",
        "loans", **_PSI_CTES,
    )
    sql["feature_psi"] = statement(
        f"""SELECT feature, {d('psi')}, CASE WHEN psi >= 0.40 THEN 'retrain' WHEN psi >= 0.25 THEN 'alert' ELSE 'stable' END AS status
        FROM (SELECT feature, sum((greatest(a, 1e-4) - greatest(b, 1e-4)) * ln(greatest(a, 1e-4) / greatest(b, 1e-4))) AS psi
              FROM shares GROUP BY feature)""",
        "matrix", "loans", **_FEATURE_PSI_CTES,
    )
    sql["feature_jensen_shannon"] = statement(
        f"""SELECT feature, {d("""sum((CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2e0)) ELSE 0 END
        + CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2e0)) ELSE 0 END) / 2e0)""", 'js_divergence')} FROM shares GROUP BY feature""",
        "matrix", "loans", **_FEATURE_PSI_CTES,
    )
    sql["drift_ks"] = statement(
        f"SELECT {d('ks', digits=9)}, ks >= 0.20 AS alert FROM (SELECT max(abs(cb / nb - cg / ng)) AS ks FROM c)",
        "loans",
        s="""SELECT p, count(*) FILTER (observation_date < TIMESTAMP '2000-01-01')::DOUBLE AS b,
          count(*) FILTER (observation_date >= TIMESTAMP '2000-01-01')::DOUBLE AS g FROM loans GROUP BY p""",
        c=_METRIC_CTES["c"],
    )
    sql["cohort_performance"] = statement(
        f"""SELECT cohort, {i('n')}, {i('n_default')}, {d('2e0 * auc - 1e0', 'gini')}, {d('ks')}, {d('brier')},
        coalesce((0.55::DOUBLE - (2e0 * auc - 1e0)) * 100e0 > 5e0, false) AS degraded FROM
        (SELECT cohort, sum(b * (cg - g / 2e0)) / nullif(max(nb * ng), 0) AS auc,
          max(abs(cb / nullif(nb, 0) - cg / nullif(ng, 0))) AS ks FROM c GROUP BY cohort)
        JOIN (SELECT strftime(observation_date, '%Y-%m') AS cohort, count(*) AS n, sum(y) AS n_default,
              avg((p - y) ** 2) AS brier FROM loans GROUP BY 1) USING (cohort)""",
        "loans",
        s="""SELECT strftime(observation_date, '%Y-%m') AS cohort, p, sum(y)::DOUBLE AS b, sum(1 - y)::DOUBLE AS g
          FROM loans GROUP BY ALL""",
        c="""SELECT *, sum(b) OVER w AS cb, sum(g) OVER w AS cg, sum(b) OVER (PARTITION BY cohort) AS nb,
          sum(g) OVER (PARTITION BY cohort) AS ng FROM s
          WINDOW w AS (PARTITION BY cohort ORDER BY p ROWS UNBOUNDED PRECEDING)""",
    )
    sql["calibration_by_grade"] = statement(
        f"""SELECT grade, {i('n')}, {d('actual')}, {d('predicted')}, {d('actual / predicted', 'ratio')},
        abs(actual / predicted - 1e0) <= 0.20::DOUBLE AS within FROM (
        SELECT CASE WHEN p < 0.05::DOUBLE THEN 'A' WHEN p < 0.16::DOUBLE THEN 'B' ELSE 'C' END AS grade,
        count(*) AS n, avg(y::DOUBLE) AS actual, avg(p) AS predicted FROM loans GROUP BY 1)""",
        "loans",
    )
    sql["exposure_at_default"] = statement(
        f"SELECT loan_id, {d(_EAD, 'ead')} FROM loans", "loans"
    )
    sql["downturn_parameters"] = statement(
        f"""SELECT w AS "window", {d('max(ccf)', 'downturn_ccf')}, {d('avg(lgd)', 'downturn_lgd')}, {i('count(*)', 'n')}
        FROM (SELECT *, months_on_book::DOUBLE / 120e0 AS ccf FROM loans) JOIN
        (VALUES ('slump', DATE '1997-07-01', DATE '1998-12-31'), ('shock', DATE '1998-08-01', DATE '1998-10-31')) t(w, a, b)
        ON observation_date::DATE BETWEEN a AND b GROUP BY w""",
        "loans",
    )
    sql["smote_train"] = statement(
        """SELECT 0::BIGINT AS default_flag_12m, false AS synthetic, g::BIGINT AS n FROM t UNION ALL
        SELECT 1, false, e FROM t UNION ALL SELECT 1, true, g - e FROM t""",
        "loans",
        t="SELECT sum(y) AS e, sum(1 - y) AS g FROM loans WHERE observation_date <= TIMESTAMP '1999-12-31'",
    )
    sql["feature_correlation"] = statement(
        f"SELECT x.feature AS feature, x.other AS other, {d('CASE WHEN isfinite(x.c) THEN x.c END', 'correlation')} FROM pairs",
        "matrix",
        pairs="SELECT unnest(["
        + ", ".join(f"{{'feature': '{a}', 'other': '{b}', 'c': corr({a}, {b})}}" for a in ALL_CONTINUOUS for b in ALL_CONTINUOUS)
        + "]) AS x FROM matrix",
    )
    return sql

