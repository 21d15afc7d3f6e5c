"""The burst trie of rebuilt conversations against a plain trie of every prefix."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pytest

from loanloom.llm import burst

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    order = {c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, ts in convs.items()}
    seqs = {}
    for c in order:
        h = zlib.crc32(str(c).encode()) % 4
        base = order.get(c - int(math.fmod(c, 20)), [])
        seqs[c] = base[:h] + order[c][h:]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        sub = [q for q in nodes if q[:len(p)] == p]
        children = [q for q in sub if len(q) == len(p) + 1]
        leaves = sum(1 for q in sub if not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in nodes))
        saved = sum((len(nodes[q]) - 1) * len(WORD.findall(q[-1][1])) for q in sub if q)
        ends = sorted(c for c in members if len(seqs[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(children), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = burst.prefix_trie(burst.rebuilt(df), **kw).collect()
    return sorted((tuple(r) for r in got), key=repr)


ROWS = [(0, 0, "user", "hi there"), (0, 1, "assistant", "hello  you"), (0, 2, "user", "bye"),
        (1, 0, "user", "hi there"), (1, 1, "assistant", "other"), (2, 0, "user", "x"), (3, None, "user", None),
        (3, 1, None, "late"), (5, 0, "user", "hi there"), (5, 1, "assistant", "hello  you"), (5, 1, "assistant", "hello  you"),
        (20, 0, "user", "a b c"), (21, 0, "user", "a b c"), (21, 1, "assistant", "d"), (22, 3, "user", "z"),
        (-1, 0, "user", "neg"), (-1, 1, "assistant", "neg two"), (None, 0, "user", "lost"), (47, 0, "user", "absent base"),
        (40, 0, "user", "long " * 3000)] + [(60 + i, t, "user", f"same {t}") for i in range(12) for t in range(3)]


@pytest.mark.parametrize("bounds", [{}, {"max_convs": 2, "max_turns": 4}, {"max_convs": 1, "max_turns": 1}])
def test_equals_a_plain_trie_whether_burst_or_swept(spark, bounds):
    assert run(spark, ROWS, **bounds) == slow(ROWS)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, 0, "user", "a", 9, "x")], "conv_id long, turn long, role string, text string, seq long, d string")
    got = burst.prefix_trie(burst.rebuilt(df)).collect()
    assert sorted((r.depth, r.n_convs, r.conv_id) for r in got) == [(0, 1, 1)]  # h = crc32("1") % 4 = 3 and conversation 0 is absent: no turns
