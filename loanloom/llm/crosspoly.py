"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import fresh, row_id, small_batches
from loanloom.llm.components import connected_components
from loanloom.operators.lineage import cut_lineage

#: Tables, hashes per table, further buckets probed per table.
TABLES, HASHES, PROBES = 10, 3, 3
#: Members of a bucket that are compared in one task at once; larger buckets are cut into such blocks.
BLOCK = 1024


@lru_cache(maxsize=8)
def _signs(width: int, count: int, seed: int) -> np.ndarray:
    """Three diagonals of random signs for each of ``count`` rotations."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(count, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix, by butterflies; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def bucket_keys(vectors: np.ndarray, labels: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Keys (vector, table, probe): the own bucket first, then the next best ones.

    A rotation maps a vector to the nearest corner of the cross-polytope, its largest
    coordinate with sign. The next buckets move one hash to its second corner, the hash with the
    smallest gap between the two first.
    """
    n, dim = vectors.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :dim] = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    signs = _signs(width, tables * hashes, seed)
    keys = np.empty((n, tables, probes + 1), dtype=np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, gap = (np.empty((n, hashes), dtype=d) for d in (np.int64, np.int64, float))
        for k in range(hashes):
            y = x
            for diagonal in signs[t * hashes + k]:
                y = hadamard(y * diagonal)
            size = np.abs(y)
            top = np.argmax(size, axis=1)
            most = size[rows, top]
            size[rows, top] = -1.0
            after = np.argmax(size, axis=1)
            best[:, k] = 2 * top + (y[rows, top] < 0)
            second[:, k] = 2 * after + (y[rows, after] < 0)
            gap[:, k] = most - size[rows, after]
        order = np.argsort(gap, axis=1, kind="stable")
        keys[:, t, 0] = _key(labels, t, best)
        for p in range(probes):
            moved = best.copy()
            moved[rows, order[:, p]] = second[rows, order[:, p]]
            keys[:, t, p + 1] = _key(labels, t, moved)
    return keys.view(np.int64)


def _key(labels: np.ndarray, table: int, corners: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit key of label, table and corners."""
    h = labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(table + 1)
    for k in range(corners.shape[1]):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + corners[:, k].astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty nor zero and has only finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0.0)
    return F.coalesce(~odd & some, F.lit(False))


def _hash_classes(tables: int, hashes: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            width = np.diff(np.asarray(lists.offsets))
            flat, at = np.asarray(lists.flatten(), dtype=float), np.concatenate(([0], np.cumsum(width)))
            labels = np.asarray(batch.column(1)).astype(np.int64)
            keys = np.empty((len(width), tables * (probes + 1)), dtype=np.int64)
            for dim in np.unique(width):
                rows = np.flatnonzero(width == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                keys[rows] = bucket_keys(x, labels[rows], tables, hashes, probes, seed).reshape(len(rows), -1)
            edges = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.ravel()))],
                                             names=["cls", "keys"])

    return run


def _first_meeting(keys: np.ndarray, a: np.ndarray, b: np.ndarray, here: np.ndarray, per_table: int) -> np.ndarray:
    """Whether the bucket ``here`` is the first that the pairs share: the earliest table, there the least key."""
    first = np.full(len(a), np.iinfo(np.int64).max)
    open_ = np.ones(len(a), dtype=bool)
    for t in range(0, keys.shape[1], per_table):
        here_least = np.full(len(a), np.iinfo(np.int64).max)
        for p in range(per_table):
            for q in range(per_table):
                left = keys[a, t + p]
                here_least = np.where(left == keys[b, t + q], np.minimum(here_least, left), here_least)
        met = here_least < np.iinfo(np.int64).max
        first = np.where(open_ & met, here_least, first)
        open_ &= ~met
        if not open_.any():
            break
    return first == here


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` points reaches over the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if np.array_equal(before, root):
            return root


def _compare(threshold: float, per_table: int):
    """Per class of a bucket block: the vectors it links to here first, and a root it hangs on."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        key, left, right, side = (np.asarray(part.column(c).combine_chunks()) for c in ("key", "low", "high", "side"))
        cls, weight, labels = (np.asarray(part.column(c).combine_chunks()) for c in ("cls", "n", "label"))
        lists, keys = part.column("vector").combine_chunks(), part.column("keys").combine_chunks()
        width = np.diff(np.asarray(lists.offsets))
        flat, at = np.asarray(lists.flatten(), dtype=float), np.concatenate(([0], np.cumsum(width)))
        keys = np.asarray(keys.flatten()).reshape(len(cls), -1)
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]), [True])))
        found_a, found_b = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for dim in np.unique(width[a:b]):
                rows = a + np.flatnonzero(width[a:b] == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if left[a] == right[a]:
                    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                else:
                    one, two = np.flatnonzero(side[rows] == left[a]), np.flatnonzero(side[rows] == right[a])
                    i, j = np.nonzero(x[one] @ x[two].T >= threshold)
                    i, j = one[i], two[j]
                same = labels[rows[i]] == labels[rows[j]]
                found_a.append(rows[i][same])
                found_b.append(rows[j][same])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        new = _first_meeting(keys, a, b, key[a], per_table)
        links = np.bincount(a[new], weight[b[new]], len(cls)) + np.bincount(b[new], weight[a[new]], len(cls))
        root = _roots(len(cls), a, b)
        told = np.flatnonzero((links > 0) | (root != np.arange(len(cls))))
        return pa.RecordBatch.from_arrays(
            [pa.array(cls[told]), pa.array(links[told].astype(np.int64)), pa.array(cls[root[told]])], names=["cls", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            key, low, high = (np.asarray(batch.column(k)) for k in range(3))
            new = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            start = 0
            for cut in [*([0] if last is not None and last != (key[0], low[0], high[0]) else []), *new.tolist()]:
                if size + cut - start >= 4 * BLOCK:
                    held.append(batch.slice(start, cut - start))
                    yield block(held)
                    held, size, start = [], 0, cut
            held.append(batch.slice(start))
            size += batch.num_rows - start
            last = (key[-1], low[-1], high[-1])
        if size:
            yield block(held)

    return run


def linked_vectors(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, hashes: int = HASHES,
                   probes: int = PROBES, seed: int = 10) -> DataFrame:
    """``vectors`` with ``n_links, component_id, kept`` per row.

    ``vectors`` has ``vec_id, embedding, label``. Rows of one label link when the cosine of
    their vectors is at least ``threshold``; pairs are found in shared buckets and verified,
    so no link is false and a few may be missed. Equal vectors are one class with a weight:
    copies are never paired. Buckets larger than a block are cut, and every two blocks meet in
    a task of their own. Links are counted where a pair meets first and never leave the task.
    Rows whose label is null, or whose vector is null, empty, zero or has null or non-finite
    components, link with nothing. Vectors of different lengths do not link. A null ``vec_id``
    counts as a link but names no component unless the component has no other; ``kept`` is
    then false. Columns of ``vectors`` with one of the three names are replaced.
    """
    if not 0 < probes + 1 <= hashes + 1:
        raise ValueError("probes must be between 0 and hashes")
    small_batches(vectors.sparkSession)
    rows = vectors.drop("n_links", "component_id", "kept")
    fits = usable(F.col("embedding")) & F.col("label").isNotNull()
    classes = (rows.where(fits).withColumn("_row", row_id()).groupBy("label", "embedding")
               .agg(F.min("_row").alias("cls"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
    classes = cut_lineage(classes)
    hashed = cut_lineage(classes.select("cls", F.col("label").cast("long"), "embedding")
                         .mapInArrow(_hash_classes(tables, hashes, probes, seed), "cls long, keys array<long>"))
    slots = hashed.select("cls", F.explode(F.array_distinct("keys")).alias("key"))
    crowded = slots.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    spread = slots.join(crowded, "key").select("key", "cls", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    side = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    spread = spread.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "cls")
    full = classes.join(hashed, "cls").select("cls", "n", F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"), "keys")
    met = spread.join(full, "cls").select("key", "low", "high", "side", "cls", "n", "label", "vector", "keys")
    met = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = cut_lineage(met.mapInArrow(_compare(threshold, probes + 1), "cls long, links long, root long"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    joined = (classes.join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
              .select("label", "embedding", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root")))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    mark = fresh("class", rows.columns)
    known = joined.join(smallest, "root").select(
        F.struct("label", "embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id").alias(mark))
    out = rows.join(known, (F.col("label") == F.col(mark)["label"]) & (F.col("embedding") == F.col(mark)["embedding"]), "left")
    component = F.when(F.col(mark).isNull(), F.col("vec_id")).otherwise(F.col(mark)["component_id"])
    return out.select(*rows.columns, F.coalesce(F.col(mark)["n_links"], F.lit(0)).alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
