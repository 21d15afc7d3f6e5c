"""Mixing, SimHash, suffix arrays and language ID against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loanloom.llm import langid, mixing, simhash, suffix
from loanloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept string, mix int, row string, fp int, raw int"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with further columns whose names the operators use, too."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), "s", "k", 1, "r", 2, 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


def unchanged(before, after):
    """Every row of ``after`` is one of ``before``, with all columns."""
    rows = Counter(before.collect())
    got = Counter(after.collect())
    return after.columns == before.columns and all(rows[r] >= 1 for r in got)


# --------------------------------------------------------------------- components


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(5, 5), (7, None)]
    pairs += [(int(a), int(b)) for a, b in rng.integers(200, 400, (150, 2))]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_components_without_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --------------------------------------------------------------------- mixing


def filled(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = {s for s in names if sizes[s] == 0}
    while True:
        level = (share * sum(sizes.values()) - sum(cap * sizes[s] for s in capped)) / (sum(weight[s] for s in names if s not in capped) or 1)
        over = {s for s in names if cap * sizes[s] <= weight[s] * level} | capped
        if over == capped:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in names}
        capped = over


def test_targets_and_copies(spark):
    rng = np.random.default_rng(1)
    sources = ["b", "a", "Z", None, "é", ""]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "x", sources[min(int(rng.integers(0, 12)), 5)]) for i in range(400)]
    rows += [(None, None, None, "b"), (7, "w w", None, "a"), (7, "w w", None, "a"), (900, " x\t\n y", None, "empty"), (901, "", None, "none")]
    docs = documents(spark, rows)
    got = mixing.mixed_documents(docs, column="mix").collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = filled(sizes, (3, 1, 2), 1.5, 2.0)
    taken = Counter()
    for r in got:
        m = r["mix"]
        assert m["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert m["source_size"] == sizes[r["source"]]
        assert m["target"] == pytest.approx(want[r["source"]])
        assert np.floor(m["rate"]) <= m["copies"] <= np.floor(m["rate"]) + 1 and m["copies"] <= 2
        taken[r["source"]] += m["size"] * m["copies"]
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.15 * sum(sizes.values())
    copies = mixing.emit_copies(docs)
    assert copies.count() == sum(r["mix"]["copies"] for r in got) and unchanged(docs, copies)
    assert sorted(map(str, mixing.mixed_documents(docs).collect())) == sorted(map(str, mixing.mixed_documents(docs).collect()))


def test_mixing_many_sources_joins_the_same(spark, monkeypatch):
    docs = documents(spark, [(i, "a b c", None, f"s{i % 7}") for i in range(50)])
    before = sorted(r["mix"]["copies"] for r in mixing.mixed_documents(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(r["mix"]["copies"] for r in mixing.mixed_documents(docs).collect()) == before


def test_mixing_nothing(spark):
    assert mixing.emit_copies(documents(spark, [])).count() == 0
    assert mixing.mixed_documents(documents(spark, [(1, None), (2, " ")])).count() == 2


# --------------------------------------------------------------------- SimHash


def slow_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) > n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_groups(values, bits):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def odd_texts():
    rng = np.random.default_rng(5)
    words = ["The", "a", "of", "été", "ÀB", "x", "word", "Long"]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    near = [t.replace("word", "ward", 1) for t in base[:6]]
    return [*base, *near, *base[:3], None, "", " \t\n", "one", "One", "two words", "a b c", "a b", "w " * 30_000]


def test_fingerprints_equal_brute_force():
    texts = odd_texts()
    got = simhash.fingerprints([(t or "").encode() for t in texts], 3)
    assert [int(x) % (1 << 64) for x in got] == [slow_fingerprint(t, 3) for t in texts]


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_close_pairs_connect_like_all_pairs(spark, bits):
    rng = np.random.default_rng(bits)
    centres = rng.integers(-(1 << 63), 1 << 63, 6)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(25):
            x = int(c) % (1 << 64)
            for b in rng.integers(0, 64, int(rng.integers(0, 6))):
                x ^= 1 << int(b)
            values.add(x - (1 << 64) if x >= 1 << 63 else x)
    values = sorted(values)
    links = simhash.fingerprint_roots(spark.createDataFrame([(v,) for v in values], "fp long"), bits)
    got = {r["fp"]: r["root"] for r in links.collect()}
    want = slow_groups([v % (1 << 64) for v in values], bits)
    groups = defaultdict(set)
    for v, w in zip(values, want, strict=True):
        groups[w].add(v)
    assert got == {v: min(groups[w]) for v, w in zip(values, want, strict=True)}


def test_groups_and_what_stays(spark):
    texts = odd_texts()
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone and nameless"), (3, texts[-3])]
    docs = documents(spark, rows)
    prints = [slow_fingerprint(r[1], 3) for r in rows]
    groups = slow_groups(prints, 2)
    least = {}
    for g, r in zip(groups, rows, strict=True):
        least[g] = min((x for x in (least.get(g), r[0]) if x is not None), default=None)
    want = Counter((r[0], p - (1 << 64) if p >= 1 << 63 else p, least[g]) for r, p, g in zip(rows, prints, groups, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicate_groups(docs).collect()) == want
    kept = simhash.drop_near_duplicates(docs)
    assert unchanged(docs, kept)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())


def test_simhash_without_rows(spark):
    assert simhash.near_duplicate_groups(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        simhash.close_pairs(spark.range(1).toDF("fp"), 3)


# --------------------------------------------------------------------- suffix arrays


def slow_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, left))
    return out


def repetitive_texts(length):
    rng = np.random.default_rng(length)
    base = [bytes(rng.choice(list(b"abc d"), 700)).decode() for _ in range(6)]
    texts = [base[0], base[0], base[1][:350] + base[2][:300], base[2][:320] + "ü" * 40 + base[1][:340], base[3]]
    for i in range(12):  # near copies of one text, each changed in its own place
        texts.append(base[4][: 50 * i] + f"<{i}>" + base[4][50 * i :])
    return [*texts, "xy" * 400, "z" * 900, "é" * 300, "short", "", None, base[5][: length - 1], base[5][:length]]


@pytest.mark.parametrize("length", [40, 200])
def test_removed_bytes_equal_brute_force(spark, length):
    texts = repetitive_texts(length)
    docs = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in suffix.without_repeats(docs, length, as_text=False).collect()}
    for i, (size, removed, spans, left) in enumerate(slow_removed([(t or "").encode() for t in texts], length)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (size, removed, spans)
        assert got[i]["kept"] == hashlib.sha256(left).hexdigest() and got[i]["lang"] is None and got[i]["fp"] == 2


def test_small_sorted_batches_give_the_same(spark, monkeypatch):
    data = np.frombuffer(b"".join((t or "").encode() for t in repetitive_texts(64)), dtype=np.uint8)
    ends = np.cumsum([len((t or "").encode()) for t in repetitive_texts(64)])
    starts = np.concatenate(([0], ends[:-1]))
    _, first, stop, anchor, _ = suffix.anchored_strings(data, starts, ends, 64)
    whole = set(suffix.repeated_starts(data, starts, ends, 64).tolist())
    found = set()
    for a in np.unique(anchor):  # one suffix array per anchor
        rows = np.flatnonzero(anchor == a)
        part = np.concatenate([data[first[r] : stop[r]] for r in rows])
        e = np.cumsum(stop[rows] - first[rows])
        s = np.concatenate(([0], e[:-1]))
        for p in suffix.repeated_starts(part, s, e, 64):
            k = np.searchsorted(e, p, side="right")
            found.add(int(first[rows[k]] + p - s[k]))
    assert found == whole


def test_dropping_repeats_keeps_the_columns(spark):
    docs = documents(spark, [(1, "ab" * 150), (1, "ab" * 150), (None, None), (2, "fine"), (2, "fine")])
    got = suffix.drop_repeats(docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"], r["kept"]) for r in got.where("text is not null").collect()) == [
        (1, "", 0, "k"), (1, "", 0, "k"), (2, "fine", 4, "k"), (2, "fine", 4, "k")]
    assert got.where("text is null and n_chars is null and doc_id is null").count() == 1
    assert suffix.drop_repeats(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix.repeated_spans(docs, 10)


# --------------------------------------------------------------------- language ID


@pytest.fixture(scope="module")
def told_apart(spark):
    rng = np.random.default_rng(0)
    words = {"aa": ["ban", "dob", "gub", "lad"], "bb": ["été", "çoi", "eux", "lè"], "cc": ["zsz", "gyö", "tty", "ű"]}
    rows = []
    for i in range(240):
        lang = "aabbcc"[2 * (i % 3) :][:2]
        rows.append((i, " ".join(rng.choice(words[lang], int(rng.integers(5, 120)))), lang, "s"))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 + 3 §", "cc"), (1003, "ban dob " * 20_000), (None, "lad gub ban"), (4, rows[4][1], rows[4][2])]
    docs = documents(spark, rows)
    return docs, langid.fit(docs)


def test_languages_of_held_out_texts(told_apart):
    docs, net = told_apart
    got = langid.with_language(docs, net).collect()
    assert len(got) == docs.count()
    right = [r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 1000]
    assert np.mean(right) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "aa", "aa"]
    assert all(0.0 <= r["score"] <= 1.0 for r in got) and by_id[1000]["score"] == 0.0


def test_prediction_sees_only_the_text(spark, told_apart):
    docs, net = told_apart
    renamed = docs.selectExpr("-doc_id as doc_id", "text", "'zz' as lang", "'zz' as source", "n_chars")
    score = lambda df: sorted((r["text"] or "", r["lang_pred"], r["score"]) for r in langid.with_language(df, net).collect())
    assert score(docs) == score(renamed)


def test_rejected_documents_go(spark, told_apart):
    docs, net = told_apart
    kept = langid.keep_known(docs, net, 0.4)
    assert unchanged(docs, kept) and kept.count() == docs.count() - 3
    assert langid.keep_known(documents(spark, []), net).count() == 0


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "text"), (2, None)])
    assert langid.fit(docs) is None
    assert {r["lang_pred"] for r in langid.with_language(docs, None).collect()} == {"und"}
    assert langid.keep_known(docs, None).count() == 1


def test_windows_cover_every_byte():
    texts = [b"", b"a", b"b" * 256, b"c" * 257, b"d" * 1000]
    windows, owner, weight = langid.cut_windows(texts)
    assert [int((owner == i).sum()) for i in range(5)] == [1, 1, 1, 2, 4]
    assert all((windows[owner == i] == ord("abcd"[i - 1])).sum() >= len(texts[i]) for i in range(1, 5)) and weight.min() >= 1


def test_sample_is_bounded(told_apart):
    docs, _ = told_apart
    sample = langid.training_sample(langid.learnable(docs).select("doc_id", "text", "lang"), per_language=10, windows=2)
    assert len(sample) <= 10 * 3 * 2 and sample["piece"].str.len().max() <= langid.WINDOW
