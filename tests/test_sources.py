from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loanloom.plans.assemble import assemble_pd_feature_matrix
from loanloom.sources import reports as rp
from loanloom.sources.bureau import (
    ParquetBureauLoader,
    StoredReportBureauLoader,
    build_bureau_loader,
    keep_first_identity,
    missing_identities,
)
from loanloom.sources.tables import (
    BUREAU_COLUMNS,
    ParquetTabularSource,
    TabularSource,
    build_tabular_source,
    write_table,
)


@pytest.fixture
def book(tmp_path, loan_frame, gst_frame, account_frame, macro_frame, bureau_frame):
    for name, df in {
        "loan_portfolio": loan_frame,
        "gst_data": gst_frame,
        "account_transactions": account_frame,
        "macroeconomic": macro_frame,
        "bureau": bureau_frame,
    }.items():
        write_table(df, str(tmp_path), name)
    return str(tmp_path)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "borrower_id string")


def test_parquet_source(spark, book):
    source = build_tabular_source(spark, {"data": {"synthetic_dir": book}})
    assert isinstance(source, TabularSource)
    assert (source.loans().count(), source.gst().count(), source.macro().count()) == (4, 1, 36)


def test_missing_tables(spark, tmp_path):
    source = ParquetTabularSource(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        source.loans()
    with pytest.raises(FileNotFoundError):
        source.macro()
    assert source.gst().isEmpty() and source.transactions().isEmpty()


def test_nan_becomes_null_at_the_source(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    write_table(df, str(tmp_path), "macroeconomic")
    rows = ParquetTabularSource(spark, str(tmp_path)).macro().collect()
    assert sorted((r["x"] for r in rows), key=str) == [1.0, None]


def test_bureau_loader_keeps_wanted_rows(spark, book):
    loader = ParquetBureauLoader(spark, f"{book}/bureau.parquet")
    out = loader.load(ids(spark, "B0", "B2", "B2", "UNKNOWN"))
    assert out.columns == BUREAU_COLUMNS
    assert sorted(r["borrower_id"] for r in out.collect()) == ["B0", "B2"]


def test_bureau_loader_errors(spark, book, tmp_path):
    with pytest.raises(FileNotFoundError):
        ParquetBureauLoader(spark, f"{book}/none.parquet").load()
    write_table(spark.range(1), book, "odd")
    with pytest.raises(ValueError, match="missing columns"):
        ParquetBureauLoader(spark, f"{book}/odd.parquet").load()


def test_loader_choice(spark, book):
    config = {"bureau_connector": {"parquet_path": f"{book}/bureau.parquet"}}
    assert isinstance(build_bureau_loader(spark, config), ParquetBureauLoader)
    with pytest.raises(ValueError, match="parquet_path"):
        build_bureau_loader(spark, {"bureau_connector": {"parquet_path": f"{book}/none"}})
    with pytest.raises(ValueError, match="identities"):
        build_bureau_loader(spark, {})


def test_identities(spark):
    df = spark.createDataFrame(
        [("B0", "9", "second", 2), ("B0", "9", "first", 1), ("B1", "8", "only", 5)],
        "borrower_id string, mobile string, name string, seq int",
    )
    out = {r["borrower_id"]: r["name"] for r in keep_first_identity(df, "seq").collect()}
    assert out == {"B0": "first", "B1": "only"}
    missing = missing_identities(ids(spark, "B0", "B7", "B7"), df).collect()
    assert [r["borrower_id"] for r in missing] == ["B7"]
    with pytest.raises(ValueError, match="PII"):
        keep_first_identity(df.drop("mobile"), "seq")
    with pytest.raises(ValueError, match="borrower_id"):
        keep_first_identity(df.drop("borrower_id"), "seq")


# ------------------------------------------------------------------------- reports

CLEAN = ["STD"] * 30
OBSERVED = "2024-01-31"


def report(score="760", accounts=(), enquiries=(), key="success_credit_report", status="SUCCESS", name="ERS4.0"):
    return {
        "decentroTxnId": "T",
        "status": status,
        "responseCode": "S0",
        "responseKey": key,
        "reference_id": "R",
        "data": {
            "scoreDetails": [] if score is None else [{"value": score, "name": name}],
            "accountDetails": list(accounts),
            "enquiryDetails": [{"enquiryDate": d} for d in enquiries],
        },
    }


def account(kind="CC", opened="2020-01-15", closed=None, limit=100.0, balance=20.0, history=CLEAN):
    return {
        "accountType": kind,
        "dateOpened": opened,
        "dateClosed": closed,
        "sanctionedAmount": limit,
        "currentBalance": balance,
        "paymentHistory": history,
    }


def rows_of(spark, *payloads, part=None):
    data = [
        (f"B{i}" if part is None else "B0", i, json.dumps(p)) for i, p in enumerate(payloads)
    ]
    df = rp.parse_reports(spark.createDataFrame(data, "borrower_id string, part int, raw string"))
    df = df.withColumn("observation_date", F.lit(OBSERVED).cast("timestamp"))
    out = rp.bureau_rows(df if part else df.drop("part"), part=part)
    return [r.asDict() for r in out.orderBy("borrower_id").collect()]


def test_good_report(spark):
    accounts = [
        account("CC", "2018-02-01", None, 200_000.0, 42_000.0),
        account("HL", "2015-01-31T10:00", "", 5e6, 1e6),
        account("PL", "bad", "2022-01-01", 1e5, 0.0),
    ]
    row = rows_of(spark, report(accounts=accounts, enquiries=["2024-01-31", "2023-08-02", "2023-08-01", "2024-02-01", "x"]))[0]
    assert row["cibil_score"] == 760 and row["score_type"] == "ERS4.0"
    assert (row["dpd_30_count_24m"], row["months_since_last_delinquency"]) == (0, None)
    assert row["revolving_utilisation"] == pytest.approx(42 / 200)
    assert row["open_trade_count"] == 2
    assert row["oldest_trade_months"] == 3287 // 30
    assert row["enquiry_count_6m"] == 2  # both window ends count, future dates do not


def test_delinquency_codes(spark):
    history = ["STD", " 090", "sma", "060 ", "030", "sub"] + ["STD"] * 18 + ["LSS"] * 6
    row = rows_of(spark, report(accounts=[account(history=history), account(history=[])]))[0]
    assert (row["dpd_30_count_24m"], row["dpd_60_count_24m"], row["dpd_90_count_24m"]) == (5, 3, 2)
    assert row["months_since_last_delinquency"] == 1


def test_utilisation_rules(spark):
    over = report(accounts=[account("OD", limit=10.0, balance=90.0)])
    none = report(accounts=[account("HL"), account("CC", limit=None, balance=5.0)])
    out = rows_of(spark, over, none)
    assert out[0]["revolving_utilisation"] == 2.0 and out[1]["revolving_utilisation"] is None


@pytest.mark.parametrize(("value", "expected"), [("-1", None), ("abc", None), ("0", 0), (" 710 ", 710)])
def test_score_parsing(spark, value, expected):
    assert rows_of(spark, report(score=value))[0]["cibil_score"] == expected


def test_new_to_credit_report(spark):
    row = rows_of(spark, {"responseKey": "success", "status": "SUCCESS", "data": {}})[0]
    assert row["cibil_score"] is None and row["score_type"] is None
    assert (row["dpd_30_count_24m"], row["open_trade_count"], row["enquiry_count_6m"]) == (0, 0, 0)
    assert row["revolving_utilisation"] is None and row["oldest_trade_months"] is None


def test_opening_after_the_observation_counts_as_zero_months(spark):
    assert rows_of(spark, report(accounts=[account(opened="2024-06-01")]))[0]["oldest_trade_months"] == 0


def test_report_in_parts_equals_whole_report(spark):
    a = [account(history=["090", "STD"]), account("HL", "2010-05-05")]
    b = [account("OD", balance=70.0, history=["STD", "030", "060"])]
    whole = rows_of(spark, report(accounts=a + b, enquiries=["2024-01-01", "2023-12-01"]))[0]
    parts = rows_of(spark, report(accounts=a, enquiries=["2024-01-01"]), report(accounts=b, enquiries=["2023-12-01"]), part="part")[0]
    assert whole == parts


def test_response_classes_and_loader(spark):
    payloads = [
        report(),
        report(key="error_credits_score_not_found"),
        report(key="error_empty_consent"),
        report(key="error_module_credits_exhausted"),
        report(key="error_other", status="FAILURE"),
        report(key="error_other", status="success"),
        report(),
    ]
    stored = spark.createDataFrame(
        [(f"B{i}", json.dumps(p)) for i, p in enumerate(payloads)], "borrower_id string, raw string"
    )
    people = spark.createDataFrame(
        [(f"B{i}", "9", "n", 0) for i in range(6)], "borrower_id string, mobile string, name string, seq int"
    )
    loader = StoredReportBureauLoader(stored, people, tiebreak="seq", observation_date=OBSERVED)
    out = loader.load()
    assert out.columns == BUREAU_COLUMNS
    assert sorted(r["borrower_id"] for r in out.collect()) == ["B0", "B5"]  # B6 has no identity
    assert [r["borrower_id"] for r in loader.load(ids(spark, "B0", "B6")).collect()] == ["B0"]
    rejects = {r["borrower_id"]: r["response_class"] for r in loader.rejects().collect()}
    assert rejects == {"B1": "not_found", "B2": "consent_missing", "B3": "credits_exhausted", "B4": "error"}


# ------------------------------------------------------------------------ assembly


def test_assembled_matrix(spark, book):
    matrix = assemble_pd_feature_matrix(
        ParquetTabularSource(spark, book), ParquetBureauLoader(spark, f"{book}/bureau.parquet")
    )
    assert len(matrix.continuous) == 36 and len(matrix.categorical) == 14
    assert "state_code" not in matrix.df.columns
    out = {r["loan_id"]: r.asDict() for r in matrix.df.collect()}
    assert [out[f"L{i}"]["default_flag_12m"] for i in range(4)] == [0, 1, 1, 0]
    assert out["L2"]["has_nach_bounce"] is None  # no account row for B2
    assert out["L0"]["itc_anomaly_flag"] is None and out["L2"]["itc_anomaly_flag"] == 1
    assert out["L3"]["rbi_repo_rate_pct"] is None  # observed before the first reading
    assert out["L0"]["rbi_repo_rate_pct"] == pytest.approx(4.0 + 16 * 2.5 / 35)  # reading of 2022-05-31
    assert matrix.X.columns == matrix.feature_names and matrix.meta.count() == 4


def test_assembly_without_bureau_and_with_forbidden(spark, book):
    source = ParquetTabularSource(spark, book)
    plain = assemble_pd_feature_matrix(source, None, drop_forbidden=False)
    assert "cibil_score" not in plain.df.columns and "state_code" in plain.categorical


def test_assembly_skips_an_empty_family(spark, book, gst_frame):
    write_table(gst_frame.limit(0), book, "gst_data")
    matrix = assemble_pd_feature_matrix(ParquetTabularSource(spark, book), None)
    assert "itc_to_output_ratio" not in matrix.feature_names


def test_assembly_errors(spark, book, loan_frame, account_frame):
    source = ParquetTabularSource(spark, book)
    with pytest.raises(ValueError, match="target"):
        assemble_pd_feature_matrix(source, None, target_column="nope")
    write_table(account_frame.union(account_frame), book, "account_transactions")
    with pytest.raises(ValueError, match="duplicate borrower_id"):
        assemble_pd_feature_matrix(ParquetTabularSource(spark, book), None)
    write_table(account_frame, book, "account_transactions")
    write_table(loan_frame.union(loan_frame), book, "loan_portfolio")
    with pytest.raises(ValueError, match="duplicate loan_id"):
        assemble_pd_feature_matrix(ParquetTabularSource(spark, book), None)
    write_table(loan_frame.withColumn("default_flag_12m", F.lit(None).cast("boolean")), book, "loan_portfolio")
    with pytest.raises(Exception, match="is null for a loan"):
        assemble_pd_feature_matrix(ParquetTabularSource(spark, book), None).df.collect()
