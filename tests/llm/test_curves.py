"""Shifted Hilbert curves: the curve itself, recall against brute force, and awkward rows."""

from __future__ import annotations

import itertools
import os

import numpy as np
import pytest

from loanloom.llm.curves import hilbert_keys, nearest_inner_products


@pytest.mark.parametrize("p,bits", [(2, 3), (3, 2), (4, 2)])
def test_consecutive_keys_are_neighbouring_cells(p, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=p)))
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute(rows, every=20, k=20):
    ok = [(i, v, np.array(e, float)) for i, (v, e) in enumerate(rows)
          if e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and np.any(np.array(e, float) != 0)]
    sizes = [len(e) for _, _, e in ok]
    ok = [x for x in ok if len(x[2]) == max(set(sizes), key=lambda d: (sizes.count(d), -d))]
    out = {}
    for i, v, e in ok:
        if v is None or v % every:
            continue
        scored = sorted(((-float(e @ f), w is None, w or 0, j) for j, w, f in ok if j != i))[:k]
        out[i] = [(v, r, None if nul else w, -s) for r, (s, nul, w, j) in enumerate(scored, 1)]
    return sorted((x for xs in out.values() for x in xs), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in nearest_inner_products(df, **kw).collect()), key=repr)


def test_small_table_equals_brute_force_with_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(120)]
    rows += [(200, None), (220, [0.0] * 8), (240, [float("nan")] + [1.0] * 7), (260, [None] + [1.0] * 7),
             (280, [1.0] * 3), (40, rows[40][1]), (None, rows[7][1]), (300, rows[20][1])]
    got, want = run(spark, rows), brute(rows)
    assert [(q, r, v) for q, r, v, _ in got] == [(q, r, v) for q, r, v, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want], rtol=0, atol=1e-6)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, None), (20, [0.0, 0.0])]) == []
    df = spark.createDataFrame([(0, [1.0, 0.0], "x", 1), (1, [0.5, 0.5], "y", 2)], "vec_id long, embedding array<double>, e string, rk int")
    assert [(r.query_id, r.vec_id) for r in nearest_inner_products(df).collect()] == [(0, 1)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables absent")
def test_recall_of_the_query_against_brute_force(spark):
    import __spark_entry__ as contract
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pandas()
    v, ids = np.stack(t.embedding.values).astype(np.float64), t.vec_id.to_numpy()
    got = {}
    for r in contract.queries()["op13_curve_search"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asks = np.flatnonzero(ids % 20 == 0)
    scores = v[asks] @ v.T
    scores[np.arange(len(asks)), asks] = -np.inf
    recall = np.mean([len(set(ids[np.lexsort((ids, -scores[a]))[:20]]) & got.get(ids[i], set())) / 20 for a, i in enumerate(asks)])
    assert recall >= 0.9


def recall(spark, x, **options):
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = {}
    for r in nearest_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asks = np.arange(0, len(x), 20)
    scores = x[asks] @ x.T
    scores[np.arange(len(asks)), asks] = -np.inf
    return np.mean([len(set(np.argsort(-s, kind="stable")[:20]) & got[a]) / 20 for a, s in zip(asks, scores)])


def test_vectors_without_structure_are_found_by_wider_windows(spark):
    x = np.random.default_rng(5).standard_normal((3000, 48))
    assert recall(spark, x, curves=4, window=32) >= 0.9


def test_a_very_common_vector_hides_no_neighbour(spark):
    x = np.random.default_rng(6).standard_normal((1500, 16))
    x[200:1200] = x[200] * 2
    assert recall(spark, x, curves=4, window=32) >= 0.9
