"""The driver contract on the smallest data set, compared with DuckDB."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as contract

DIRECTORY = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables absent")

FAST = [
    "loan_features",
    "bureau_features",
    "asof_macro",
    "asof_macro_scan",
    "family_left_join",
    "identities_keep_first",
    "bureau_report_rows",
    "pd_matrix",
    "default_rate_by_product",
    "iv_summary",
    "hosmer_lemeshow",
    "expected_loss_rollup",
    "sma_transitions",
    "psi",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DIRECTORY}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(clean(r[i]) for i in order)) for r in rows)


def test_registry_is_consistent():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 1_500


@pytest.mark.parametrize("name", FAST)
def test_query_equals_statement(spark, con, name):
    df = contract.queries()[name](spark, DIRECTORY)
    con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.columns, df.collect()) == plain(columns, con.fetchall())
