"""The loan-book tables as views over the star-schema tables of a directory.

Every view is a projection or key join of the stored tables, with integer
arithmetic on keys only, so that the same rows can be produced by any SQL
engine. Sizes follow the tables: one loan per order, one borrower per customer.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.sources.bureau import semi_by_borrower
from loanloom.sources.reports import REPORT_SCHEMA
from loanloom.sources.tables import BUREAU_COLUMNS

OBSERVED = "2001-08-01"
CUTOFFS = ("1999-12-31", "2000-12-31", "2001-08-31")
# Orders whose keys share a block go to one report part, so a part holds at most
# this many accounts however many orders a single customer has.
REPORT_PART_KEYS = 65_536
HISTORY_MONTHS = 30
_RISK_LEVELS = 600


@lru_cache(maxsize=64)
def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A stored table; footers are read once per session."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def _borrower(key: str | Column) -> Column:
    return _padded("B", F.col(key) if isinstance(key, str) else key)


def _padded(prefix: str, key: Column) -> Column:
    """Key as text of at least eight digits; longer keys keep all of them."""
    text = key.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(8)), F.lit("0")))


def _risk(key: str) -> Column:
    return (F.col(key) * 7919) % _RISK_LEVELS


def _d(c: Column) -> Column:
    return c.cast("double")


def _pick(c: Column, choices: dict[str, str], otherwise: str) -> Column:
    out = None
    for value, result in choices.items():
        out = F.when(c == value, result) if out is None else out.when(c == value, result)
    return out.otherwise(otherwise)


def _observed() -> Column:
    return F.lit(OBSERVED).cast("timestamp")


def loan_portfolio(spark: SparkSession, directory: str) -> DataFrame:
    customer = table(spark, directory, "customer").join(
        table(spark, directory, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    joined = table(spark, directory, "orders").join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    key, price, seg = F.col("o_orderkey"), F.col("o_totalprice"), F.col("c_mktsegment")
    product = _pick(
        seg,
        {
            "BUILDING": "home_loan",
            "AUTOMOBILE": "auto",
            "HOUSEHOLD": "credit_card",
            "FURNITURE": "lap",
        },
        "term_loan_sme",
    )
    collateral = _pick(
        seg,
        {
            "BUILDING": "immovable_property",
            "FURNITURE": "immovable_property",
            "AUTOMOBILE": "movable_assets",
            "HOUSEHOLD": "none",
        },
        "mixed",
    )
    on_book = (key % 120).cast("int")
    sma = F.when(key % 50 == 1, 2).when(key % 25 == 2, 1).otherwise(0)
    risk = _risk("c_custkey")
    cutoff = F.when(risk < 150, 30).when(risk < 300, 15).otherwise(4)
    return joined.select(
        _padded("L", key).alias("loan_id"),
        _borrower("o_custkey").alias("borrower_id"),
        F.col("o_orderdate").cast("timestamp").alias("observation_date"),
        product.alias("product_type"),
        _pick(seg, {"FURNITURE": "retail_self_employed", "MACHINERY": "msme"}, "retail_salaried").alias(
            "borrower_segment"
        ),
        price.alias("outstanding_principal"),
        F.when(key % 101 == 7, None)
        .when(key % 97 == 5, F.lit(0.0))
        .otherwise(price * (F.lit(1.0) + _d(key % 7) / 10.0))
        .alias("sanctioned_limit"),
        F.when(key % 89 == 3, 0).otherwise(12 * (1 + key % 20)).cast("int").alias("loan_tenor_months"),
        on_book.alias("months_on_book"),
        F.when(key % 103 == 11, None).otherwise(collateral).alias("collateral_type"),
        (_d(40 + key % 80) / 100.0).alias("ltv_at_origination"),
        F.col("n_name").alias("state_code"),
        sma.alias("sma_flag"),
        (sma == 2).alias("npa_flag"),
        (key % 67 == 4).alias("restructured_flag"),
        F.date_sub(F.to_date("o_orderdate"), 30 * on_book).cast("timestamp").alias("disbursement_date"),
        ((key * 31 + 17) % 100 < cutoff).alias("default_flag_12m"),
    )


def bureau(spark: SparkSession, directory: str) -> DataFrame:
    key, risk = F.col("c_custkey"), _risk("c_custkey")
    late = risk < 300
    rows = table(spark, directory, "customer").where(key % 20 != 9)
    return rows.select(
        _borrower("c_custkey").alias("borrower_id"),
        _observed().alias("observation_date"),
        F.when(key % 13 != 6, 300 + risk).cast("int").alias("cibil_score"),
        F.lit("ERS4.0").alias("score_type"),
        F.when(late, key % 5).otherwise(0).cast("int").alias("dpd_30_count_24m"),
        F.when(late, F.least(key % 5, F.lit(2))).otherwise(0).cast("int").alias("dpd_60_count_24m"),
        F.when(risk < 150, F.least(key % 5, F.lit(1))).otherwise(0).cast("int").alias("dpd_90_count_24m"),
        F.when(late & (key % 5 > 0), key % 24).cast("int").alias("months_since_last_delinquency"),
        F.when(key % 17 != 4, _d(key % 121) / 100.0).alias("revolving_utilisation"),
        (key % 7).cast("int").alias("open_trade_count"),
        F.when(key % 7 != 0, 6 + key % 180).cast("int").alias("oldest_trade_months"),
        (key % 6).cast("int").alias("enquiry_count_6m"),
    ).select(*BUREAU_COLUMNS)


def gst_data(spark: SparkSession, directory: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, directory, "customer").where("c_mktsegment = 'MACHINERY'").select(
        _borrower("c_custkey").alias("borrower_id"),
        _observed().alias("observation_date"),
        _d(50000 + (key * 977) % 900000).alias("gstr1_revenue_monthly"),
        (key % 8 != 3).alias("filing_on_time_flag"),
        (_d(55 + key % 50) / 100.0).alias("itc_to_output_ratio"),
        (_d((key * 13) % 41 - 20) / 100.0).alias("revenue_trend_slope_3m"),
        (_d((key * 17) % 37 - 18) / 100.0).alias("revenue_trend_slope_12m"),
    )


def account_transactions(spark: SparkSession, directory: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, directory, "customer").where("c_mktsegment <> 'MACHINERY'").select(
        _borrower("c_custkey").alias("borrower_id"),
        _observed().alias("observation_date"),
        (F.col("c_acctbal") * 10.0).alias("avg_monthly_balance_3m"),
        F.when(F.col("c_mktsegment") == "FURNITURE", 0)
        .otherwise(key % 13)
        .cast("int")
        .alias("salary_credit_months_12m"),
        F.when(key % 19 != 2, key % 4).cast("int").alias("nach_bounce_count_12m"),
        (_d(key % 90) / 100.0).alias("cash_withdrawal_ratio"),
        (_d(50 + key % 71) / 100.0).alias("debit_credit_ratio_3m"),
    )


def macroeconomic(spark: SparkSession, directory: str) -> DataFrame:
    """Month ends that occur in the orders; June is missing, so readings have gaps."""
    months = (
        table(spark, directory, "orders")
        .select(F.last_day("o_orderdate").alias("day"))
        .where("month(day) <> 6")
        .distinct()
    )
    i = F.year("day") * 12 + F.month("day")

    def level(low: int, step: int, span: int, scale: float) -> Column:
        return _d(F.lit(low) + (i * step) % span) / scale

    return months.select(
        F.col("day").cast("timestamp").alias("date"),
        level(40, 7, 25, 10.0).alias("rbi_repo_rate_pct"),
        level(-10, 11, 60, 10.0).alias("gdp_growth_yoy_pct"),
        level(20, 3, 30, 10.0).alias("wpi_inflation_pct"),
        level(30, 5, 40, 10.0).alias("cpi_inflation_pct"),
        level(-20, 13, 80, 10.0).alias("iip_growth_pct"),
        level(80, 17, 200, 100.0).alias("msme_npa_index"),
    )


def financials(spark: SparkSession, directory: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, directory, "supplier").select(
        _borrower("s_suppkey").alias("borrower_id"),
        _observed().alias("observation_date"),
        (F.col("s_acctbal") * 12.0).alias("cash_flow_available"),
        F.when(key % 11 == 3, F.lit(0.0))
        .otherwise(_d(20000 + (key * 37) % 60000))
        .alias("debt_service"),
        (F.col("s_acctbal") * 8.0).alias("ebit"),
        _d(10000 + (key * 53) % 40000).alias("interest_expense"),
        _d((key * 71) % 50000).alias("current_assets"),
        _d((key * 29) % 30000).alias("current_liabilities"),
        _d((key % 9) * 1000).alias("total_debt"),
        _d((key % 10 - 3) * 1000).alias("total_equity"),
        F.when(key % 3 == 0, "big4").when(key % 3 == 1, "national").otherwise("local").alias(
            "auditor_category"
        ),
    )


def identities(spark: SparkSession, directory: str) -> DataFrame:
    """One identity per customer, a second one for some, none for others."""
    key = F.col("c_custkey")
    known = table(spark, directory, "customer").where(key % 20 != 9)
    versions = F.when(key % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return known.select("c_custkey", "c_name", F.explode(versions).alias("version")).select(
        _borrower("c_custkey").alias("borrower_id"),
        F.concat(F.lit("9"), F.lpad(key.cast("string"), F.greatest(F.length(key.cast("string")), F.lit(9)), F.lit("0"))).alias("mobile"),
        F.when(F.col("version") == 1, F.concat("c_name", F.lit(" II")))
        .otherwise(F.col("c_name"))
        .alias("name"),
        (key * 2 + F.col("version")).alias("seq"),
    )


def bureau_reports(spark: SparkSession, directory: str) -> DataFrame:
    """Nested reports: (borrower_id, part, report), one account per order."""
    orders = table(spark, directory, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    # only the narrow order fields are shuffled; the nested account is made from them afterwards
    per_part = orders.groupBy(
        F.col("o_custkey").alias("cust"),
        F.floor(key / REPORT_PART_KEYS).cast("bigint").alias("part"),
    ).agg(
        F.collect_list(
            F.struct(key.alias("k"), price.alias("price"), F.to_date("o_orderdate").alias("d"))
        ).alias("orders")
    )
    kinds = F.array(*[F.lit(k) for k in ("CC", "OD", "HL", "PL", "TL", "AL")])
    codes = F.array(*[F.lit(c) for c in ("090", " 030 ", "sma", "060", "SUB")])
    months = F.sequence(F.lit(0), F.lit(HISTORY_MONTHS - 1))
    clean = F.array_repeat(F.lit("STD"), HISTORY_MONTHS)

    def history(k: Column) -> Column:
        late = F.transform(
            months, lambda m: F.coalesce(F.get(codes, ((k * 31 + m * 17) % 40).cast("int")), F.lit("STD"))
        )
        return F.when(_risk("cust") >= 300, clean).otherwise(late)

    def account(o: Column) -> Column:
        k = o["k"]
        return F.struct(
            F.get(kinds, (k % 6).cast("int")).alias("accountType"),
            F.when(k % 61 == 8, "bad").otherwise(F.date_format(o["d"], "yyyy-MM-dd")).alias("dateOpened"),
            F.when(k % 3 == 1, "").when(k % 3 == 2, "2001-01-01").alias("dateClosed"),
            F.when(k % 101 != 7, o["price"]).alias("sanctionedAmount"),
            (o["price"] * _d(k % 25) / 10.0).alias("currentBalance"),
            history(k).alias("paymentHistory"),
        )

    def enquiry(o: Column) -> Column:
        day = F.date_sub(F.lit(OBSERVED).cast("date"), ((o["k"] % 400) - 10).cast("int"))
        return F.struct(
            F.date_format(day, "yyyy-MM-dd").alias("enquiryDate"),
            F.lit("loan").alias("enquiryPurpose"),
            F.lit("HARD").alias("enquiryType"),
        )

    cust = F.col("cust")
    score_value = (
        F.when(cust % 13 == 6, "-1").otherwise((300 + _risk("cust")).cast("string"))
    )
    scores = F.when(cust % 29 != 1, F.array(F.struct(score_value.alias("value"), F.lit("ERS4.0").alias("name"))))
    response_key = (
        F.when(cust % 31 == 2, "error_credits_score_not_found")
        .when(cust % 31 == 3, "error_empty_consent")
        .when(cust % 31 == 4, "error_module_credits_exhausted")
        .when(cust % 31 == 5, "error_other")
        .otherwise("success_credit_report")
    )
    report = F.struct(
        F.concat(F.lit("TXN"), cust.cast("string")).alias("decentroTxnId"),
        F.when(cust % 31 == 5, "FAILURE").otherwise("SUCCESS").alias("status"),
        F.lit("S00000").alias("responseCode"),
        response_key.alias("responseKey"),
        F.concat(F.lit("REF"), cust.cast("string")).alias("reference_id"),
        F.struct(
            scores.alias("scoreDetails"),
            F.transform("orders", account).alias("accountDetails"),
            F.transform("orders", enquiry).alias("enquiryDetails"),
        ).alias("data"),
    )
    return per_part.select(
        _borrower("cust").alias("borrower_id"), "part", report.cast(REPORT_SCHEMA).alias("report")
    )


def scored_loans(spark: SparkSession, directory: str) -> DataFrame:
    """Loans with an arithmetic default probability, loss rate and target ``y``.

    The probability follows the default rule of the loans with a spread of
    twenty percent, so it ranks well and is close to calibrated.
    """
    loan = F.substring("loan_id", 2, 20).cast("bigint")
    risk = (F.substring("borrower_id", 2, 20).cast("bigint") * 7919) % _RISK_LEVELS
    level = F.when(risk < 150, F.lit(0.30)).when(risk < 300, F.lit(0.15)).otherwise(F.lit(0.04))
    return loan_portfolio(spark, directory).withColumns(
        {
            "y": F.col("default_flag_12m").cast("int"),
            "p": level * (_d(80 + loan % 41) / 100.0),
            "lgd": _d(20 + loan % 60) / 100.0,
        }
    )


class DriverSource:
    """The views as a tabular source."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    def loans(self) -> DataFrame:
        return loan_portfolio(self.spark, self.directory)

    def gst(self) -> DataFrame:
        return gst_data(self.spark, self.directory)

    def transactions(self) -> DataFrame:
        return account_transactions(self.spark, self.directory)

    def macro(self) -> DataFrame:
        return macroeconomic(self.spark, self.directory)


class DriverBureauLoader:
    """The flat bureau view behind the loader contract."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    def load(self, ids: DataFrame | None = None) -> DataFrame:
        rows = bureau(self.spark, self.directory)
        if ids is None:
            return rows
        return semi_by_borrower(rows, ids)

