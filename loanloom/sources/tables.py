"""Parquet tables of the loan book and the sink that writes them."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loanloom.functions.nulls import nan_to_null

DEFAULT_TABLE_DIR = "data/synthetic"


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


_S, _D, _I, _B, _TS = (
    T.StringType(),
    T.DoubleType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
)

GST_SCHEMA = _schema(
    borrower_id=_S,
    observation_date=_TS,
    gstr1_revenue_monthly=_D,
    filing_on_time_flag=_B,
    itc_to_output_ratio=_D,
    revenue_trend_slope_3m=_D,
    revenue_trend_slope_12m=_D,
)
ACCOUNT_SCHEMA = _schema(
    borrower_id=_S,
    observation_date=_TS,
    avg_monthly_balance_3m=_D,
    salary_credit_months_12m=_I,
    nach_bounce_count_12m=_I,
    cash_withdrawal_ratio=_D,
    debit_credit_ratio_3m=_D,
)
BUREAU_SCHEMA = _schema(
    borrower_id=_S,
    observation_date=_TS,
    cibil_score=_I,
    score_type=_S,
    dpd_30_count_24m=_I,
    dpd_60_count_24m=_I,
    dpd_90_count_24m=_I,
    months_since_last_delinquency=_I,
    revolving_utilisation=_D,
    open_trade_count=_I,
    oldest_trade_months=_I,
    enquiry_count_6m=_I,
)
BUREAU_COLUMNS = BUREAU_SCHEMA.fieldNames()


@runtime_checkable
class TabularSource(Protocol):
    """Anything that can hand out the non-bureau tables."""

    def loans(self) -> DataFrame: ...

    def gst(self) -> DataFrame: ...

    def transactions(self) -> DataFrame: ...

    def macro(self) -> DataFrame: ...


def read_parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` or None when nothing is there.

    Spark resolves the path, so any file system the cluster knows works.
    """
    try:
        return nan_to_null(spark.read.parquet(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class ParquetTabularSource:
    """Tables stored as ``<directory>/<table>.parquet``.

    Loans and macro must exist; the borrower-segment tables may be absent and
    then read as empty frames with their contract schema.
    """

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = str(directory).rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.directory}/{table}.parquet"

    def _required(self, table: str) -> DataFrame:
        df = read_parquet_or_none(self.spark, self._path(table))
        if df is None:
            raise FileNotFoundError(f"Required table {self._path(table)} not found.")
        return df

    def _optional(self, table: str, schema: T.StructType) -> DataFrame:
        df = read_parquet_or_none(self.spark, self._path(table))
        return self.spark.createDataFrame([], schema) if df is None else df

    def loans(self) -> DataFrame:
        return self._required("loan_portfolio")

    def macro(self) -> DataFrame:
        return self._required("macroeconomic")

    def gst(self) -> DataFrame:
        return self._optional("gst_data", GST_SCHEMA)

    def transactions(self) -> DataFrame:
        return self._optional("account_transactions", ACCOUNT_SCHEMA)


def build_tabular_source(spark: SparkSession, config: dict) -> ParquetTabularSource:
    directory = config.get("data", {}).get("synthetic_dir", DEFAULT_TABLE_DIR)
    return ParquetTabularSource(spark, directory)


def write_table(df: DataFrame, directory: str, table: str) -> None:
    """Write ``df`` as snappy parquet under the name the source reads back."""
    path = f"{str(directory).rstrip('/')}/{table}.parquet"
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
