"""Removal of repeated byte strings with suffix arrays built by bucket-pointer refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.common import fresh, ranges_of, row_id, small_batches, text_bytes, written

#: Bytes hashed together to choose the anchor of a string; the shortest string is longer.
GRAM = 32
#: Bytes of text that numpy works on at once, and of strings sorted at once.
CHUNK, SORTED = 1 << 20, 1 << 20

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    v = data.astype(np.uint64)
    for width in (1, 2, 4):
        v = v[:-width] | (v[width:] << np.uint64(8 * width))
    return v


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    v = _words(data) * _MIX[0]
    v ^= v >> np.uint64(29)
    width = 8
    while width < GRAM:
        v = v[:-width] * _MIX[1] + v[width:]
        v ^= v >> np.uint64(31)
        width *= 2
    v *= _MIX[3]
    return v ^ (v >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values."""
    n = len(values) - width + 1
    f, fill = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    blocks = np.full(-(-len(values) // width) * width, fill, dtype=np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[width - 1 : width - 1 + n])


def anchored_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cut texts into strings so that equal substrings of ``length`` bytes get equal keys.

    The anchor of a substring is the least gram hash in it. Neighbouring substrings with one
    anchor form one string. Returns owner, first byte and end of each string, its anchor, and
    whether it may hold a substring twice itself (never a false no).
    """
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    if not len(data) or (ends - starts).max(initial=0) < length:
        return none
    width = length - GRAM + 1
    grams = _gram_hashes(data)
    anchors = _sliding(grams, width, True)
    long = np.flatnonzero(ends - starts >= length)
    first, stop = starts[long], ends[long] - length + 1  # substring starts of each text
    cuts = np.concatenate((np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, first, stop))
    cuts = np.unique(cuts[cuts <= stop[-1]])
    begin, end = cuts[:-1], cuts[1:]
    owner = np.searchsorted(first, begin, side="right") - 1
    inside = (owner >= 0) & (begin < stop[np.maximum(owner, 0)])
    begin, end, owner = begin[inside], end[inside], owner[inside]
    valid = np.zeros(len(anchors) + 1, dtype=np.int8)
    np.add.at(valid, first, 1)
    np.add.at(valid, np.minimum(stop, len(anchors)), -1)
    masked = np.where(np.cumsum(valid[:-1]) > 0, anchors, np.uint64(0))
    padded = np.concatenate((np.zeros(width - 1, np.uint64), masked, np.zeros(width - 1, np.uint64)))
    at = np.flatnonzero(grams == _sliding(padded, width, False)[: len(grams)])
    twice = np.concatenate(([0], np.cumsum(grams[at][1:] == grams[at][:-1]))) if len(at) else np.zeros(1, np.int64)
    lo, hi = np.searchsorted(at, begin), np.searchsorted(at, end - 1 + width)
    again = (hi - lo >= 2) & (twice[np.maximum(hi - 1, 0)] > twice[np.minimum(lo, len(twice) - 1)])
    return long[owner], begin, end - 1 + length, anchors[begin], again


def repeated_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Positions whose ``length`` bytes start anywhere else in the strings too, by bucket-pointer refinement.

    The first buckets hold the positions with equal 8 bytes. A bucket is refined by sorting
    its positions on the bucket pointers found ``depth`` bytes further on, which doubles the
    depth; each round sorts on the pointers that the round before has updated. Positions
    alone in their bucket are settled and are sorted no more.
    """
    size = ends - starts
    base = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(size) else np.zeros(0, np.int64)
    left = np.zeros(len(data) + 1, dtype=np.int64)  # bytes from here to the end of the string
    if len(size):
        where = np.arange(size.sum()) + base
        left[where] = np.repeat(ends, size) - where
    active = np.flatnonzero(left[:-1] >= 8) if len(data) >= 8 else np.zeros(0, np.int64)
    if not len(active):
        return active
    bucket = np.full(len(data), -1, dtype=np.int64)  # the bucket pointers; -1: shorter than the depth
    active, groups = _settle(_words(data)[active], active)
    bucket[active] = groups
    depth = 8
    while depth < length and len(active):
        ahead = min(depth, length - depth)
        whole = left[active] >= depth + ahead
        here = active[whole]
        ahead_bucket = bucket[here + ahead]  # -1 when what starts there is found nowhere else
        here, ahead_bucket = here[ahead_bucket >= 0], ahead_bucket[ahead_bucket >= 0]
        key = (bucket[here].astype(np.uint64) << np.uint64(32)) | ahead_bucket.astype(np.uint64)
        bucket[active] = -1
        active, groups = _settle(key, here)
        bucket[active] = groups
        depth += ahead
    return active


def _settle(keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions that share their key with another, and the number of their bucket."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
    shared = ~(new & np.concatenate((new[1:], [True]))) if len(ranked) else new
    at = positions[order[shared]]
    groups = np.cumsum(new)[shared]
    back = np.argsort(at)
    return at[back], groups[back]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value starts (one more at the end)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


_ANCHORS = "row long, first int, stop int, anchor long, digest long, again boolean"
_SPANS = "row long, first int, stop int"


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(0))
            data, at = _flat(batch.column(1))
            for a, b in ranges_of(np.diff(at), CHUNK):
                part = data[at[a] : at[b]]
                owner, first, stop, anchor, again = anchored_strings(part, at[a:b] - at[a], at[a + 1 : b + 1] - at[a], length)
                if len(owner):
                    view, digest = memoryview(part), xxhash.xxh3_64_intdigest
                    digests = np.array([digest(view[i:j]) for i, j in zip(first.tolist(), stop.tolist(), strict=True)], dtype=np.uint64)
                    base = at[a:b][owner] - at[a]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[a:b][owner]), pa.array((first - base).astype(np.int32)), pa.array((stop - base).astype(np.int32)),
                         pa.array(anchor.view(np.int64)), pa.array(digests.view(np.int64)), pa.array(again)],
                        names=["row", "first", "stop", "anchor", "digest", "again"])

    return run


def _cut_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed strings of each text."""
    for batch in batches:
        for row, text, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([p["anchor"] for p in parts], pa.int64()), pa.array([row] * len(parts), pa.int64()),
                 pa.array([p["first"] for p in parts], pa.int32()), pa.array([text[p["first"] : p["stop"]] for p in parts], pa.binary())],
                names=["anchor", "row", "first", "string"])


def _sort_strings(length: int):
    """Spans of repeated substrings in strings that come sorted by anchor; whole anchors are taken together."""

    def spans(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(h[3] for h in held), dtype=np.uint8)
        ends = np.cumsum([len(h[3]) for h in held])
        starts = np.concatenate(([0], ends[:-1]))
        at = repeated_starts(data, starts, ends, length)
        owner = np.searchsorted(ends, at, side="right")
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]))) if len(at) else np.zeros(0, bool)
        opens = np.flatnonzero(new)
        closes = np.concatenate((opens[1:], [len(at)])) - 1 if len(opens) else opens
        who = owner[opens]
        base = np.array([h[2] for h in held], dtype=np.int64)[who] - starts[who]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array([h[1] for h in held], dtype=np.int64)[who]), pa.array((at[opens] + base).astype(np.int32)),
             pa.array((at[closes] + length + base).astype(np.int32))], names=["row", "first", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for item in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= SORTED and item[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(item)
                size += len(item[3])
        if held:
            yield spans(held)

    return run


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """``row, first, stop`` of strings of ``length`` bytes or more that occur elsewhere too.

    ``texts`` has ``row`` (a key) and ``data`` (bytes). The spans of a row may overlap;
    their union is every byte covered by a ``length``-byte string that starts at another
    place as well, in this row or another. Strings never cross rows.

    All rows are cut into anchored strings; only keys are shuffled. Anchors met once are
    out. Where all strings of an anchor are equal, each is repeated whole, and so is a string
    that a second place has too: copies never travel. What is left, one of each different
    string around an anchor, is fetched and sorted into suffix arrays, anchors dealt to tasks.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    small_batches(texts.sparkSession)
    strings = written(texts.mapInArrow(_find_anchors(length), _ANCHORS), "anchors")
    met = strings.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.max("again").alias("self"))
    met = met.where("n > 1 or self").select("anchor", (F.col("self") | (F.col("low") != F.col("high"))).alias("mixed"))
    shared = written(strings.join(met, "anchor"), "shared")
    alike = shared.where("not mixed").select("row", "first", "stop")
    kinds = shared.where("mixed").groupBy("anchor", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "first", "stop")).alias("sample"))
    kinds = written(kinds, "kinds")
    copied = (shared.where("mixed").join(kinds.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
              .select("row", "first", "stop"))
    wanted = (kinds.select("sample.row", F.struct("anchor", "sample.first", "sample.stop").alias("part"))
              .groupBy("row").agg(F.collect_list("part").alias("parts")))
    cut = texts.join(wanted, "row").select("row", "data", "parts")
    cut = cut.mapInArrow(_cut_strings, "anchor long, row long, first int, string binary")
    found = (cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_strings(length), _SPANS))
    return alike.unionByName(copied).unionByName(found)


def _strip(keep: int, as_text: bool):
    """Per row what is left without its spans, as a digest or as text, after ``keep`` further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for data, spans in zip(batch.column(keep).to_pylist(), batch.column(keep + 1).to_pylist(), strict=True):
                cut = merged([(s["first"], s["stop"]) for s in spans or ()])
                edges = [0, *(x for span in cut for x in span), len(data)]
                left = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                sizes.append(len(data))
                removed.append(len(data) - len(left))
                counts.append(len(cut))
                kept.append(left.decode("utf-8", "replace") if as_text else hashlib.sha256(left).hexdigest())
            found = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *found], names=[*batch.schema.names[:keep], *_FOUND])

    return run


_FOUND = ["n_bytes", "n_removed", "n_spans", "kept"]


def without_repeats(docs: DataFrame, length: int = 200, as_text: bool = True) -> DataFrame:
    """``docs`` without ``text``, with a struct-free ``n_bytes, n_removed, n_spans, kept`` per row.

    ``kept`` is the remaining text (a character cut in two becomes U+FFFD) or, with ``as_text`` off, the
    SHA-256 of the remaining bytes. Null texts are empty, shorter ones than ``length`` stay
    whole, repeated rows count as repeats of each other. A column of ``docs`` with one of
    the four names is replaced.
    """
    small_batches(docs.sparkSession)
    row, raw, cuts = (fresh(n, docs.columns) for n in ("row", "data", "spans"))
    rest = [c for c in docs.columns if c != "text" and c not in _FOUND]
    keyed = docs.withColumn(row, row_id())
    spans = repeated_spans(keyed.select(F.col(row).alias("row"), text_bytes().alias("data")), length)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("first", "stop")).alias(cuts)).withColumnRenamed("row", row)
    joined = keyed.join(spans, row, "left").select(*rest, text_bytes().alias(raw), cuts)
    schema = T.StructType([*[docs.schema[c] for c in rest],
                           *[T.StructField(n, T.LongType()) for n in _FOUND[:3]], T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_strip(len(rest), as_text), schema)


def drop_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the text that ``without_repeats`` leaves; ``n_chars``, if there, is counted anew.

    A null text stays null. Columns keep their order and any further ones their values.
    """
    mark, none = fresh("row", docs.columns), fresh("none", docs.columns)
    others = [c for c in docs.columns if c != "text"]
    held = docs.select(F.struct(F.col("text").isNull().alias(none), *others).alias(mark), "text")
    left = without_repeats(held, length, as_text=True)
    text = F.when(~F.col(mark)[none], F.col("kept"))
    new = {"text": text}
    if "n_chars" in others:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return left.select(*[new[c].alias(c) if c in new else F.col(mark)[c].alias(c) for c in docs.columns])
