"""The registered queries on the smallest tables, against DuckDB or brute force."""

from __future__ import annotations

import glob
import os
import zlib
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from test_text_ops import slow_fingerprint, slow_groups

DIRECTORY = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DIRECTORY}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return Counter(repr(tuple(clean(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op4_chat_format", "op6_mtree_top_k", "op7_warc", "op9_mixing", "op10_cross_polytope"])
def test_query_equals_statement(spark, con, name):
    df = contract.queries()[name](spark, DIRECTORY)
    con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.columns, df.collect()) == plain(columns, con.fetchall())


def test_every_operator_has_a_query():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in contract.queries()


def test_language_query(spark, con):
    known = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = contract.queries()["op1_language_id"](spark, DIRECTORY).collect()
    assert len(got) == len(known)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held_out = [r["lang_pred"] == known[r["doc_id"]] for r in got if r["held_out"] and known[r["doc_id"]] is not None]
    assert sum(held_out) >= 0.9 * len(held_out)


def test_page_query_keeps_every_page(spark, con):
    got = contract.queries()["op2_html_text"](spark, DIRECTORY).collect()
    assert sorted(r["page_id"] for r in got) == [r[0] for r in con.execute("SELECT page_id FROM pages ORDER BY 1").fetchall()]
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"] for r in got)


def test_fingerprint_query_equals_brute_force(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    prints = [slow_fingerprint(t, 3) for _, t in rows]
    groups = slow_groups(prints, 2)  # the smallest position is the smallest id
    want = Counter((i, f"{p:016x}", rows[g][0]) for (i, _), p, g in zip(rows, prints, groups, strict=True))
    assert Counter(tuple(r) for r in contract.queries()["op5_simhash"](spark, DIRECTORY).collect()) == want


def test_pipeline_follows_its_stages(spark, con):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DIRECTORY)
        assert after.columns == docs.columns, name
        assert after.count() > 0
    got = contract.queries()["pipeline"](spark, DIRECTORY).collect()
    assert got and all(r["round_trip"] for r in got)
    known = {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()}
    assert {r["doc_id"] for r in got} <= known
