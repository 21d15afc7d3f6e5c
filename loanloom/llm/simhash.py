"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loanloom.llm.common import fresh, ranges_of, row_id, small_batches, text_bytes
from loanloom.llm.components import connected_components
from loanloom.operators.lineage import cut_lineage

SEED = 42
#: Bytes of text whose hashes are held at once.
CHUNK = 1 << 20
#: Value of each bit of a byte, lowest first: rows are byte values.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of every run of ``shingle`` words, of all words if there are fewer, of none if none."""
    words = text.lower().split()  # on bytes: A-Z, and exactly the six ASCII spaces
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """One 64-bit fingerprint per text, as signed integers; zero without words."""
    hashes = [shingle_hashes(t, shingle) for t in texts]
    counts = np.array([len(h) for h in hashes])
    flat = np.array([x for h in hashes for x in h], dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(texts), 8), dtype=np.uint8)
    owner, at = np.repeat(np.arange(len(texts)), counts), np.concatenate(([0], np.cumsum(counts)))
    step = 512  # texts whose byte histograms are held at once
    for a in range(0, len(texts), step):
        b = min(a + step, len(texts))
        rows = slice(at[a], at[b])
        for lane in range(8):
            seen = np.bincount((owner[rows] - a) * 256 + flat[rows, lane], minlength=(b - a) * 256).reshape(-1, 256)
            out[a:b, lane] = np.packbits(seen @ _BITS * 2 > counts[a:b, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.int64)[:, 0]


def with_fingerprint(docs: DataFrame, column: str, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` without its text, with a fingerprint column (long)."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    raw = fresh("raw", docs.columns)
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(column, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            parts = [fingerprints(texts[a:b], shingle) for a, b in ranges_of([len(t) for t in texts], CHUNK)]
            values = pa.array(np.concatenate([*parts, np.zeros(0, dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], values], names=[*rest, column])

    return docs.select(*rest, text_bytes(text).alias(raw)).mapInArrow(run, schema)


def _segments(count: int) -> list[list[int]]:
    """The bits of each of ``count`` segments of a 64-bit value."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [list(range(a, b)) for a, b in pairwise(cuts)]


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64 if bit == 63 else 0)


def close_pairs(values: DataFrame, max_bits: int = 2, segments: int = 4) -> DataFrame:
    """Links ``a, b`` that join all distinct ``fp`` values up to ``max_bits`` (0 to 2) bits apart.

    Each segment has an index table. Its key is the whole fingerprint with the segment
    replaced by a member of the small Hamming ball around it (radius 1), so a table match
    already agrees outside the segment. Two values at most two bits apart share such a key:
    either one of them, or the value half-way. A key has at most 65 distinct fingerprints
    next to it, however large a group of copies is, so no match list grows with the data;
    each is linked to the smallest one of its list and the complete distance is verified.
    For one bit the key has the bit cleared, so only the two values around it meet.
    The links are enough for components; they are not all pairs.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2: the balls are of radius 1")
    fp = F.col("fp")
    if max_bits == 0:
        return values.select(fp.alias("a"), fp.alias("b")).where("a <> b")
    keys: list[Column] = [F.struct(F.lit(-1).alias("slot"), fp.alias("key"))]
    for bits in _segments(segments):
        for bit in bits:
            mask = F.lit(_signed(bit))
            if max_bits == 2:
                keys.append(F.struct(F.lit(-1).alias("slot"), fp.bitwiseXOR(mask).alias("key")))
            else:
                keys.append(F.struct(F.lit(bit).alias("slot"), fp.bitwiseAND(F.bitwise_not(mask)).alias("key")))
    probes = values.select(fp, F.explode(F.array(*keys)).alias("k")).select("fp", "k.slot", "k.key")
    matched = probes.withColumn("least", F.min("fp").over(W.partitionBy("key", "slot"))).where("fp <> least")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= max_bits
    return matched.where(near).select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def fingerprint_roots(values: DataFrame, max_bits: int = 2) -> DataFrame:
    """``fp, root``: the smallest fingerprint that the links reach from each distinct ``fp``."""
    roots = connected_components(close_pairs(values, max_bits)).withColumnRenamed("node", "fp")
    return values.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; the component id is the
    smallest document id reachable, the row's own included. A null or blank text has
    fingerprint zero and links like any other. Rows may repeat. A null id takes part, gets a
    row, and is never a component id unless its whole group has none. No rows, no result.
    """
    marked = cut_lineage(with_fingerprint(docs.select("doc_id", "text"), "fp", shingle))
    values = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = cut_lineage(values.join(fingerprint_roots(values.select("fp"), max_bits), "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(groups, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each group stays whole: that of the smallest id, of several the first row.

    A null id stays only if its group has no other. All columns of ``docs`` are kept.
    """
    row = fresh("row", docs.columns)
    docs = docs.withColumn(row, row_id())
    marked = with_fingerprint(docs.select("doc_id", "text", F.col(row).alias("row")), "fp", shingle)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    values = cut_lineage(marked.groupBy("fp").agg(best))
    rooted = values.join(fingerprint_roots(values.select("fp"), max_bits), "fp")
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return docs.join(kept, row, "left_semi").drop(row)
