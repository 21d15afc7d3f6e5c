"""Ranked lexical search by bag classes against a plain scoring of every document."""

from __future__ import annotations

import math
import re
from collections import Counter

from loanloom.llm.lexical import rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def slow(docs, items, k=10):
    bags = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    big_n = sum(1 for _, _, n in bags if n)
    big_l = sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, (d, b, n) in enumerate(bags):
            if not n:
                continue
            m = 10 + (90 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                    for t in set(words(text)) if b[t])
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0, i, d))
        for r, (s, _, _, _, d) in enumerate(sorted(scored)[:k], 1):
            out.append((item, r, d, -s))
    return sorted(out, key=repr)


def run(spark, docs, items, k=10):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rank_documents(a, b, k).collect()), key=repr)


def test_equals_plain_scoring_with_copies_ties_and_nulls(spark):
    docs = [(1, "The cat sat on the mat"), (2, "the CAT sat on the mat"), (3, "a dog, a Cat; a bird"), (4, None),
            (5, ""), (None, "cat cat cat dog"), (6, "cat cat cat dog"), (6, "cat cat cat dog"), (7, "élan vital Élan"),
            (8, "x " * 5000 + "cat"), (9, "dog bird"), (10, "dog bird")]
    items = [(100, "cat dog"), (101, "Élan"), (102, "nothing here"), (None, "bird"), (103, None), (104, "the")]
    assert run(spark, docs, items) == slow(docs, items)
    assert run(spark, docs, items, k=2) == slow(docs, items, k=2)


def test_empty_inputs(spark):
    assert run(spark, [], [(1, "cat")]) == []
    assert run(spark, [(1, "cat")], []) == []
    assert run(spark, [(1, None), (2, "...")], [(1, "cat")]) == []


def test_extra_columns_with_clashing_names(spark):
    a = spark.createDataFrame([(1, "cat dog", 5, "x"), (2, "dog", 6, "y")], "doc_id long, text string, rk long, tokens string")
    b = spark.createDataFrame([(1, "dog", 1, "t")], "item_id long, text string, term long, w string")
    got = sorted((r.doc_id, r.rank) for r in rank_documents(a, b).collect())
    assert got == [(1, 2), (2, 1)]


def test_vocabulary_too_large_to_broadcast_gives_the_same(spark, monkeypatch):
    import loanloom.llm.lexical as lexical

    docs = [(1, "The cat sat on the mat"), (2, "the CAT sat"), (3, None), (4, "cat cat dog Élan"), (4, "cat cat dog Élan")]
    items = [(100, "cat dog"), (101, "élan the")]
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    assert run(spark, docs, items) == slow(docs, items)
