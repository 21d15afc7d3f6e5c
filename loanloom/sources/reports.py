"""Reduction of nested bureau reports to one feature row per borrower.

Every report row is reduced where it lies with array functions, so no trade
line is exploded or shuffled. A very large report may be stored in several
parts; each part is reduced first and only the small partial rows are grouped
(``merge_parts``), with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
_FIELD = T.StructField

SCORE_TYPE = T.StructType([_FIELD("value", _S), _FIELD("name", _S)])
ACCOUNT_TYPE = T.StructType(
    [
        _FIELD("accountType", _S),
        _FIELD("dateOpened", _S),
        _FIELD("dateClosed", _S),
        _FIELD("sanctionedAmount", T.DoubleType()),
        _FIELD("currentBalance", T.DoubleType()),
        _FIELD("paymentHistory", T.ArrayType(_S)),
    ]
)
ENQUIRY_TYPE = T.StructType(
    [_FIELD("enquiryDate", _S), _FIELD("enquiryPurpose", _S), _FIELD("enquiryType", _S)]
)
REPORT_SCHEMA = T.StructType(
    [
        _FIELD("decentroTxnId", _S),
        _FIELD("status", _S),
        _FIELD("responseCode", _S),
        _FIELD("responseKey", _S),
        _FIELD("reference_id", _S),
        _FIELD(
            "data",
            T.StructType(
                [
                    _FIELD("scoreDetails", T.ArrayType(SCORE_TYPE)),
                    _FIELD("accountDetails", T.ArrayType(ACCOUNT_TYPE)),
                    _FIELD("enquiryDetails", T.ArrayType(ENQUIRY_TYPE)),
                ]
            ),
        ),
    ]
)

# Payment-history codes per days-past-due bucket.
DPD_90_CODES = ["090", "120", "150", "180", "SUB", "DBT", "LSS"]
DPD_60_CODES = ["060", *DPD_90_CODES]
DPD_30_CODES = ["030", "SMA", *DPD_60_CODES]
# Account types with a revolving limit.
REVOLVING_ACCOUNT_TYPES = ["CC", "OD", "CV", "AL", "RV"]
LOOKBACK_MONTHS = 24
ENQUIRY_WINDOW_DAYS = 182
DAYS_PER_MONTH = 30
UTILISATION_CAP = 2.0
# Response key -> response class.
RESPONSE_CLASSES = {
    "error_credits_score_not_found": "not_found",
    "error_empty_consent": "consent_missing",
    "error_module_credits_exhausted": "credits_exhausted",
}
_BLANKS = " \t\n\r\x0b\x0c"


def parse_reports(df: DataFrame, raw: str = "raw", into: str = "report") -> DataFrame:
    """Parse stored JSON text into the nested report column.

    The parsed value is handed on by a generator of one element: conditions on its
    fields are not moved below one, so no filter parses the text again.
    """
    kept = [c for c in df.columns if c not in (raw, into)]
    return df.select(*kept, F.explode(F.array(F.from_json(F.col(raw), REPORT_SCHEMA))).alias(into))


def response_class(report: str = "report") -> Column:
    """not_found, consent_missing, credits_exhausted, error or ok (first match wins)."""
    key = F.coalesce(F.col(f"{report}.responseKey"), F.lit(""))
    status = F.coalesce(F.col(f"{report}.status"), F.lit(""))
    out = None
    for value, label in RESPONSE_CLASSES.items():
        out = F.when(key == value, label) if out is None else out.when(key == value, label)
    failed = ~status.isin("SUCCESS", "success") & key.startswith("error_")
    return out.when(failed, "error").otherwise("ok")


def split_responses(df: DataFrame, report: str = "report") -> tuple[DataFrame, DataFrame]:
    """(usable reports, rejected reports with their response class)."""
    tagged = df.withColumn("response_class", response_class(report))
    good = tagged.where(F.col("response_class") == "ok").drop("response_class")
    return good, tagged.where(F.col("response_class") != "ok")


def _items(path: str, dtype: T.DataType) -> Column:
    """Array at ``path``; a missing array counts as empty."""
    return F.coalesce(F.col(path), F.array().cast(T.ArrayType(dtype)))


def _day(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-M-d")


def _code(text: Column) -> Column:
    return F.upper(F.btrim(text, F.lit(_BLANKS)))


def _total(amounts: Column) -> Column:
    return F.aggregate(amounts, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def reduce_parts(
    df: DataFrame, report: str = "report", observed: str = "observation_date"
) -> DataFrame:
    """Add the per-report partial features and drop the nested report.

    Columns that are sums, minima or counts can be merged over the parts of
    one report; ratios are only formed in :func:`finish`.
    """
    data = f"{report}.data"
    day = F.to_date(F.col(observed))
    staged = (
        df.withColumn("_accounts", _items(f"{data}.accountDetails", ACCOUNT_TYPE))
        .withColumn("_enquiries", _items(f"{data}.enquiryDetails", ENQUIRY_TYPE))
        .withColumn("_score", F.get(F.col(f"{data}.scoreDetails"), F.lit(0)))
    )
    histories = F.transform(
        "_accounts",
        lambda a: F.transform(
            F.slice(F.coalesce(a["paymentHistory"], F.array().cast("array<string>")), 1, LOOKBACK_MONTHS),
            lambda c, i: F.struct(i.alias("month"), _code(c).alias("code")),
        ),
    )
    # one pass over all cells keeps only the delinquent ones; the rest reuse it
    staged = staged.withColumn(
        "_late",
        F.filter(F.flatten(histories), lambda cell: cell["code"].isin(DPD_30_CODES)),
    ).withColumn(
        "_revolving",
        F.filter("_accounts", lambda a: a["accountType"].isin(REVOLVING_ACCOUNT_TYPES)),
    )

    def late_in(codes: list[str]) -> Column:
        return F.size(F.filter("_late", lambda cell: cell["code"].isin(codes)))

    value = F.col("_score.value").try_cast("int")
    features = {
        "cibil_score": F.when(value >= 0, value),
        "score_type": F.col("_score.name"),
        "dpd_30_count_24m": F.size("_late"),
        "dpd_60_count_24m": late_in(DPD_60_CODES),
        "dpd_90_count_24m": late_in(DPD_90_CODES),
        "months_since_last_delinquency": F.array_min(
            F.transform("_late", lambda cell: cell["month"])
        ),
        "revolving_balance": _total(F.transform("_revolving", lambda a: a["currentBalance"])),
        "revolving_limit": _total(F.transform("_revolving", lambda a: a["sanctionedAmount"])),
        "open_trade_count": F.size(
            F.filter("_accounts", lambda a: F.coalesce(a["dateClosed"], F.lit("")) == "")
        ),
        "oldest_opened": F.array_min(F.transform("_accounts", lambda a: _day(a["dateOpened"]))),
        "enquiry_count_6m": F.size(
            F.filter(
                F.transform("_enquiries", lambda e: _day(e["enquiryDate"])),
                lambda d: d.between(F.date_sub(day, ENQUIRY_WINDOW_DAYS), day),
            )
        ),
    }
    kept = [c for c in df.columns if c != report]
    return staged.select(*kept, *[c.alias(name) for name, c in features.items()])


def merge_parts(partials: DataFrame, part: str = "part") -> DataFrame:
    """Combine the partial rows of reports stored in parts (one row per borrower)."""
    counts = [
        "dpd_30_count_24m",
        "dpd_60_count_24m",
        "dpd_90_count_24m",
        "open_trade_count",
        "enquiry_count_6m",
    ]
    first = F.struct(part, "cibil_score", "score_type")
    merged = partials.groupBy("borrower_id", "observation_date").agg(
        F.min(first).alias("_first"),
        *[F.sum(c).cast("int").alias(c) for c in counts],
        F.sum("revolving_balance").alias("revolving_balance"),
        F.sum("revolving_limit").alias("revolving_limit"),
        F.min("months_since_last_delinquency").alias("months_since_last_delinquency"),
        F.min("oldest_opened").alias("oldest_opened"),
    )
    return merged.withColumns(
        {"cibil_score": F.col("_first.cibil_score"), "score_type": F.col("_first.score_type")}
    ).drop("_first")


def finish(partials: DataFrame) -> DataFrame:
    """Form the ratio and age features and project the bureau row contract."""
    age_days = F.date_diff(F.to_date("observation_date"), F.col("oldest_opened"))
    age = F.floor(age_days / DAYS_PER_MONTH).cast("int")
    used = F.when(
        F.col("revolving_limit") > 0,
        F.least(F.col("revolving_balance") / F.col("revolving_limit"), F.lit(UTILISATION_CAP)),
    )
    return partials.select(
        "borrower_id",
        "observation_date",
        "cibil_score",
        "score_type",
        "dpd_30_count_24m",
        "dpd_60_count_24m",
        "dpd_90_count_24m",
        "months_since_last_delinquency",
        used.alias("revolving_utilisation"),
        "open_trade_count",
        F.when(age.isNotNull(), F.greatest(age, F.lit(0))).alias("oldest_trade_months"),
        "enquiry_count_6m",
    )


def bureau_rows(reports: DataFrame, report: str = "report", part: str | None = None) -> DataFrame:
    """Bureau feature rows of reports that carry borrower_id and observation_date.

    Without ``part`` each row is a whole report and the result is one narrow
    projection. With ``part`` the rows are pieces of reports and get merged.
    """
    partials = reduce_parts(reports, report)
    return finish(merge_parts(partials, part) if part else partials)
