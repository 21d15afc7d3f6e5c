"""Approximate largest inner products by shifted Hilbert curves.

Largest inner product becomes nearest neighbour after the usual lift: a candidate ``x``
becomes ``[x / M, sqrt(1 - |x / M|^2)]`` with ``M`` the largest norm, a query ``q`` becomes
``[q / |q|, 0]``; both then lie on the unit sphere, and Euclidean nearness there orders the
candidates by ``q . x``. Each curve projects the lifted vectors onto a few random directions,
shifts them by a random vector, quantises them and orders them along a Hilbert curve. Spark
range-partitions every curve by its key, numbers the rows in key order, and cuts the order into
windows of ``window`` rows; a query meets the candidates of its own window and of the
neighbouring windows of every curve. Those candidates are reranked by the exact inner product in
double precision, and the best ``k`` of all curves are kept.

How many neighbouring windows are met is measured, not fixed: up to ``PROBES`` queries are
compared with every row, their true ``k`` nearest are looked up on the curves, and the fewest
windows are taken that hold ``RECALL`` of them. Clustered vectors need one window on either side; vectors
without any structure may need all windows, which is the comparison with every row. Of equal vectors only the
``k + 1`` first by vec_id are candidates, since no other can be among the ``k`` best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loanloom.llm.common import fresh, row_id, written

#: Curves, rows per window, projected dimensions, bits per dimension (dims * bits < 63), seed.
CURVES, WINDOW, DIMS, BITS, SEED = 16, 256, 4, 15, 13
#: Rows of the keyed table per range partition.
PART_ROWS = 200_000
#: Queries whose true neighbours are known, the share of these to be met, rows of a widened window, scores at once.
PROBES, RECALL, WIDE_WINDOW, TILE_SCORES = 128, 0.96, 4096, 2_000_000

_ROWS = "t int, key long, rk long, vec_id long, q boolean, vec binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points ``cells`` (n x p, each below 2**bits), by Skilling's transform."""
    x = cells.astype(np.int64).copy()
    n, p = x.shape
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess work: inverse of the Gray-code rotations, per bit from the top
        low = q - 1
        for i in range(p):
            up = (x[:, i] & q) != 0
            x[up, 0] ^= low
            swap = (x[~up, 0] ^ x[~up, i]) & low
            x[~up, 0] ^= swap
            x[~up, i] ^= swap
        q >>= 1
    for i in range(1, p):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.int64)
    q = top
    while q > 1:
        flip[(x[:, p - 1] & q) != 0] ^= q - 1
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(p):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


def curve_setup(dim: int, curves: int = CURVES, dims: int = DIMS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Projections (curves x (dim+1) x dims) and shifts (curves x dims) of every curve, from the seed."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((curves, dim + 1, dims)), rng.uniform(0.0, 1.0, (curves, dims))


def lifted(vectors: np.ndarray, largest: float, query: bool) -> np.ndarray:
    """Vectors on the unit sphere of one more dimension: queries by their own norm, candidates by ``largest``."""
    norms = np.linalg.norm(vectors, axis=1)
    if query:
        return np.hstack([vectors / norms[:, None], np.zeros((len(vectors), 1))])
    scaled = vectors / largest
    return np.hstack([scaled, np.sqrt(np.clip(1.0 - (norms / largest) ** 2, 0.0, None))[:, None]])


def keys_of(points: np.ndarray, projection: np.ndarray, shift: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve keys of unit vectors: each projection is bounded by its direction's norm, so no data pass is needed."""
    bound = np.linalg.norm(projection, axis=0)
    unit = (points @ projection / bound + 1.0 + shift) / 3.0
    return hilbert_keys(np.clip((unit * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)


def nearest_inner_products(vectors: DataFrame, every: int = 20, k: int = 20, curves: int = CURVES,
                           window: int = WINDOW, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """The ``k`` best candidates of every query by inner product: ``query_id, rank, vec_id, score``.

    ``vectors`` has ``vec_id, embedding``; other columns are ignored. Queries are the rows whose
    vec_id is divisible by ``every``; candidates are all rows but the query's own row, so a
    repeated vec_id is a candidate of its twin, and a null vec_id can be a candidate (never a
    query). Vectors that are null, empty, zero, hold a null or non-finite component, or whose
    length differs from the most common length take no part. Scores are the inner products of
    the original components in double precision; equal scores go to the smaller vec_id (null
    last). A query with fewer than ``k`` candidates found gets them all; empty input, no rows.
    """
    rk, e = fresh("rk", vectors.columns), fresh("e", vectors.columns)
    finite = "forall({e}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) != double('infinity'))".format(e=e)
    base = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias(e))
            .withColumn(rk, row_id())
            .where(F.col(e).isNotNull() & (F.size(e) > 0) & F.expr(finite)
                   & (F.expr(f"aggregate({e}, 0D, (a, x) -> a + x * x)") > 0)))
    sizes = base.groupBy(F.size(e).alias("d")).agg(F.count("*").alias("n"), F.max(F.expr(f"sqrt(aggregate({e}, 0D, (a, x) -> a + x * x))")).alias("m"))
    common = sizes.orderBy(F.desc("n"), "d").first()
    spark = vectors.sparkSession
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, largest = int(common["d"]), float(common["m"])
    projections, shifts = curve_setup(dim, curves, dims, seed)

    full = base.where(F.size(e) == dim).select("vec_id", rk, e)
    asking = full.where(F.col("vec_id") % every == 0)
    # of equal vectors a query keeps k at most, and its own row is not among them
    first = W.partitionBy(e).orderBy(F.col("vec_id").asc_nulls_last(), rk)
    at = fresh("at", vectors.columns)
    offering = full.withColumn(at, F.row_number().over(first)).where(F.col(at) <= k + 1).drop(at)

    def keyed(query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if b.empty:
                    continue
                x = np.stack(b[e].to_numpy()).astype(np.float64)
                packed, ids = [v.tobytes() for v in x], b["vec_id"].astype("Int64").array
                points = lifted(x, largest, query)
                for t in range(curves):
                    yield pd.DataFrame({"t": t, "key": keys_of(points, projections[t], shifts[t]), "rk": b[rk].to_numpy(),
                                        "vec_id": ids, "q": query, "vec": packed})
        return run

    rows = offering.mapInPandas(keyed(False), _ROWS).unionByName(asking.mapInPandas(keyed(True), _ROWS))
    count = int(common["n"]) * curves * (1 + 1.0 / every)
    parts = max(1, int(np.ceil(count / PART_ROWS)))
    ranged = rows.repartitionByRange(parts, "t", "key", "rk", "q").sortWithinPartitions("t", "key", "rk", "q")
    placed = written(ranged.withColumn("pid", F.spark_partition_id()).mapInPandas(_numbered, _ROWS + ", pid int, local long"),
                     "curve-rows")
    counts = placed.groupBy("pid", "t").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("t").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("pid", "t", before.alias("offset"))
    place = ((F.col("offset") + F.col("local")) / window).cast("long")
    placed = placed.join(F.broadcast(offsets), ["pid", "t"]).withColumn("block", place)
    used, reach = _reach(placed, _probed(offering, asking, rk, e, k), curves)
    # far windows are met as few wide ones, so that a query travels a few times only
    wide = min(reach, max(1, WIDE_WINDOW // window))
    steps = -(-reach // wide)
    block = F.floor(F.col("block") / wide).cast("long")
    # a query also visits the neighbouring windows; candidates stay in their own
    spread = F.when(F.col("q"), F.sequence(F.lit(-steps), F.lit(steps))).otherwise(F.array(F.lit(0)))
    blocks = (placed.where(F.col("t") < used).withColumn("step", F.explode(spread))
              .select("t", (block + F.col("step")).alias("block"), "rk", "vec_id", "q", "vec"))
    found = blocks.groupBy("t", "block").applyInPandas(_best(k), "qrk long, query_id long, crk long, vec_id long, score double")
    found = found.dropDuplicates(["qrk", "crk"])
    order = W.partitionBy("qrk").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "crk")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted partition with their place among the rows of their curve in it."""
    seen: dict[int, int] = {}
    for b in batches:
        local = np.empty(len(b), np.int64)
        ts = b["t"].to_numpy()
        for t in np.unique(ts):
            at = np.flatnonzero(ts == t)
            start = seen.get(int(t), 0)
            local[at] = start + np.arange(len(at))
            seen[int(t)] = start + len(at)
        yield b.assign(local=local)


def _probed(offering: DataFrame, asking: DataFrame, rk: str, e: str, k: int) -> DataFrame:
    """``qrk, crk``: the true ``k`` nearest rows of up to ``PROBES`` queries, by comparison with every row."""
    probes = asking.orderBy(F.xxhash64(rk), rk).limit(PROBES).collect()
    asks = np.array([r[e] for r in probes], np.float64)
    keys = np.array([r[rk] for r in probes], np.int64)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            ids, own = b["vec_id"].astype("float64").fillna(np.inf).to_numpy(), b[rk].to_numpy()
            scores = asks @ np.stack(b[e].to_numpy()).astype(np.float64).T
            scores[keys[:, None] == own[None, :]] = -np.inf
            tops = [_top(s, ids, own, k) for s in scores]
            picked = np.concatenate(tops)
            yield pd.DataFrame({"qrk": np.repeat(keys, [len(t) for t in tops]), "crk": own[picked],
                                "vec_id": b["vec_id"].astype("Int64").array[picked],
                                "score": np.concatenate([s[t] for s, t in zip(scores, tops)])})

    if not probes:
        return offering.sparkSession.createDataFrame([], "qrk long, crk long")
    order = W.partitionBy("qrk").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "crk")
    found = offering.mapInPandas(nearest, "qrk long, crk long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qrk", "crk")


def _reach(placed: DataFrame, true: DataFrame, curves: int) -> tuple[int, int]:
    """Curves and windows on either side that hold ``RECALL`` of the known neighbours at the least work."""
    pairs = [(r["qrk"], r["crk"]) for r in true.collect()]  # PROBES * k at most
    if not pairs:
        return curves, 1
    spark = placed.sparkSession
    wanted = spark.createDataFrame([(q, True) for q in {q for q, _ in pairs}] + [(c, False) for c in {c for _, c in pairs}], "rk long, q boolean")
    at = {(r["t"], r["q"], r["rk"]): r["block"]
          for r in placed.join(F.broadcast(wanted), ["rk", "q"]).select("t", "q", "rk", "block").collect()}
    windows = placed.agg(F.max("block")).first()[0] + 1
    need = np.array([[abs(at[t, True, q] - at[t, False, c]) for t in range(curves)] for q, c in pairs])
    need = np.minimum.accumulate(need, axis=1)  # by the number of curves used
    enough = int(np.ceil(RECALL * len(pairs))) - 1
    reach = np.maximum(1, np.sort(need, axis=0)[enough])
    if reach[-1] == 1:
        return curves, 1
    work = np.arange(1, curves + 1) * np.minimum(2 * reach + 1, windows)
    if work.min() >= windows:  # one curve that is met as a whole costs no more and misses nothing
        return 1, int(windows)
    best = int(work.argmin())
    return best + 1, int(reach[best])


def _top(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest finite scores, equal ones by id, then key."""
    near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else np.arange(len(scores))
    near = near[np.isfinite(scores[near])]
    return near[np.lexsort((keys[near], ids[near], -scores[near]))[:k]]


def _best(k: int):
    def best(rows: pd.DataFrame) -> pd.DataFrame:
        asks, offers = rows[rows["q"]], rows[~rows["q"]]
        if asks.empty or offers.empty:
            return pd.DataFrame({"qrk": [], "query_id": [], "crk": [], "vec_id": [], "score": []})
        a = np.stack([np.frombuffer(v, np.float64) for v in asks["vec"]])
        c = np.stack([np.frombuffer(v, np.float64) for v in offers["vec"]])
        own, offered = asks["rk"].to_numpy(), offers["rk"].to_numpy()
        ids = offers["vec_id"].astype("float64").fillna(np.inf).to_numpy()
        tile, out = max(1, TILE_SCORES // len(c)), []
        for start in range(0, len(a), tile):
            scores = a[start : start + tile] @ c.T
            scores[own[start : start + tile, None] == offered[None, :]] = -np.inf
            for i, s in enumerate(scores, start):
                top = _top(s, ids, offered, k)
                out.append((np.full(len(top), i), top, s[top]))
        i, top, score = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"qrk": own[i], "query_id": asks["vec_id"].astype("Int64").array[i], "crk": offered[top],
                             "vec_id": offers["vec_id"].astype("Int64").array[top], "score": score})
    return best
