"""Exact top-k inner products with an M-tree searched best first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loanloom.llm.common import small_batches
from loanloom.operators.lineage import cut_lineage

#: Root entries of the tree at most (a bounded sample of the vectors), vectors of a subtree at most,
#: entries of a page, queries searched together, queries sent to a subtree as one block.
ROOTS, SUBTREE, PAGE, QUERIES, QUERY_BLOCK = 32, 4096, 256, 512, 16384


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has no null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def lists(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


class Tree:
    """The pages of one subtree below a root entry.

    A page has a routing vector, a covering radius and the distance to its parent, the root
    entry; its entries keep their distance to the routing vector. The metric is the Euclidean
    distance after one more coordinate has made all candidates equally long: then the
    nearest candidates of a query are those with the largest inner product.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, root: np.ndarray, reach: float, keys: np.ndarray | None = None):
        self.reach = reach  # squared length that every candidate gets
        self.keys = ids if keys is None else keys  # one per row; ids may repeat
        self.order = np.lexsort((self.keys, ids))
        self.place = np.empty(len(ids), np.int64)
        self.place[self.order] = np.arange(len(ids))  # place in the order of (id, key): equal scores go by it
        lifted = _lift(vectors, reach)
        self.from_root = np.linalg.norm(lifted - root, axis=1)
        order = np.argsort(self.from_root, kind="stable")
        pages = [p for p in _split(lifted, order) if len(p)]
        self.ids, self.vectors, self.pages = ids, vectors, pages
        self.routers = np.stack([lifted[p].mean(axis=0) for p in pages])
        self.to_router = [np.linalg.norm(lifted[p] - r, axis=1) for p, r in zip(pages, self.routers, strict=True)]
        self.radius = np.array([d.max() for d in self.to_router])
        self.to_parent = np.linalg.norm(self.routers - root, axis=1)
        self.root, self.root_radius = root, self.from_root.max()
        self.compared = 0

    def search(self, own: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query row, candidate position and score of up to ``k`` best of each query; ``own`` are the keys of the queries,
        whose own rows are left out; ``floor`` is a score each query has ``k`` times already.

        Pages are visited in the order of their least possible distance. A page is passed
        over for a query by its distance to the parent first, without a distance of its own,
        then by its router; an entry by its stored distance to the router. Equal scores are never passed over.
        """
        n, lifted = len(queries), _lift(queries, None)
        norms = np.einsum("ij,ij->i", queries.astype(float), queries.astype(float))
        far = self.reach + norms
        limit = _limit(far, floor)  # squared distance beyond which nothing can matter
        to_root = np.linalg.norm(lifted - self.root, axis=1)
        from_parent = np.abs(to_root[:, None] - self.to_parent) - self.radius  # known without any new distance
        score = np.full((n, k), _NONE)
        ident = np.full((n, k), np.iinfo(np.int64).max)
        bound = np.maximum(from_parent, 0.0)
        heap = [(float(bound[:, p].min()), p, False) for p in range(len(self.pages))]
        heapq.heapify(heap)
        exact = np.zeros((n, len(self.pages)))
        while heap:
            _, p, measured = heapq.heappop(heap)
            live = np.flatnonzero(_below(bound[:, p], limit))
            if not len(live):
                continue
            if not measured:  # now the distance to the router itself
                exact[live, p] = np.linalg.norm(lifted[live] - self.routers[p], axis=1)
                bound[live, p] = np.maximum(bound[live, p], exact[live, p] - self.radius[p])
                heapq.heappush(heap, (float(bound[live, p].min()), p, True))
                continue
            entries = self.pages[p]
            gap = np.abs(exact[live, p][:, None] - self.to_router[p][None, :])
            near = _below(gap, limit[live][:, None])
            wanted = np.flatnonzero(near.any(axis=0))
            if not len(wanted):
                continue
            found = inner_products(queries[live], self.vectors[entries[wanted]])
            self.compared += found.size
            who = np.broadcast_to(self.place[entries[wanted]], found.shape)
            found = np.where(self.keys[entries[wanted]][None, :] == own[live][:, None], _NONE, found)
            some = found.max(axis=1) >= score[live, k - 1]
            live, found, who = live[some], found[some], who[some]
            both, names = np.concatenate((score[live], found), axis=1), np.concatenate((ident[live], who), axis=1)
            order = np.lexsort((names, -both), axis=1)[:, :k]
            score[live], ident[live] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
            limit[live] = _limit(far[live], np.maximum(floor[live], score[live, k - 1]))
        rows, slots = np.nonzero((score > _NONE) & (score >= floor[:, None]))
        return rows, self.order[ident[rows, slots]], score[rows, slots]


#: Below every score.
_NONE = np.iinfo(np.int64).min + 1


def _limit(far: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Squared distance at a score, with room for rounding; infinite without a score."""
    return np.where(floor > _NONE, far - 2.0 * floor.astype(float) + 1e-9 * (far + 2.0 * np.abs(floor.astype(float))) + 1e-6, np.inf)


def _below(distance: np.ndarray, limit: np.ndarray) -> np.ndarray:
    return np.square(np.maximum(distance * (1 - 1e-9), 0.0)) <= limit


def _lift(vectors: np.ndarray, reach: float | None) -> np.ndarray:
    """One more coordinate: what is missing to the length ``reach``; zero for queries."""
    x = vectors.astype(float)
    missing = np.zeros(len(x)) if reach is None else np.maximum(reach - np.einsum("ij,ij->i", x, x), 0.0)
    return np.concatenate((x, np.sqrt(missing)[:, None]), axis=1)


def _split(lifted: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows cut in two around two far entries, again and again, until they fit a page."""
    out, todo = [], [rows]
    while todo:
        part = todo.pop()
        if len(part) <= PAGE:
            out.append(part)
            continue
        x = lifted[part]
        one = x[np.argmax(np.linalg.norm(x - x[0], axis=1))]
        two = x[np.argmax(np.linalg.norm(x - one, axis=1))]
        lean = np.linalg.norm(x - one, axis=1) - np.linalg.norm(x - two, axis=1)
        order = np.argsort(lean, kind="stable")
        cut = min(max(int((lean < 0).sum()), len(part) // 4), len(part) - len(part) // 4)
        todo += [part[order[:cut]], part[order[cut:]]]
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by doubles where every sum is below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def whole_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """``vec_id, row, dim, vector`` with components floor(scale * x), of usable vectors only.

    Null ids take no part. Rows that repeat an id all count, each with its own ``row`` key
    (unique; stable once the result is materialised).
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("vector"))
    return rows.select("vec_id", F.monotonically_increasing_id().alias("row"), F.size("vector").alias("dim"), "vector")


def _assign(roots: dict[int, np.ndarray], reach: dict[int, float]):
    """The nearest root entry of each vector, and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(batch.schema.get_field_index("dim")))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _lift(lists(part.column(part.schema.get_field_index("vector"))) if dim else np.zeros((part.num_rows, 0), np.int64), reach[int(dim)])
                centres = roots[int(dim)]
                square = np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ centres.T + np.einsum("ij,ij->i", centres, centres)
                home = square.argmin(axis=1)
                away = np.linalg.norm(x - centres[home], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array(away)],
                                                 names=[*part.schema.names, "root", "away"])

    return run


def _route(roots: dict[int, np.ndarray], reach: dict[int, float], radius: dict[tuple[int, int], float], first: bool):
    """The root entries a query has to visit: the nearest one, or all others its floor does not rule out."""

    cells = {d: np.array(sorted(r for e, r in radius if e == d)) for d in roots}
    wide = {d: np.array([radius[d, r] for r in cells[d]]) for d in roots}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            names = ("vec_id", "row", "dim", "vector", "floor", "home")
            for vec_id, row, dim, vector, floor, home in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                x = np.append(np.array(vector, dtype=float), 0.0)
                far = np.linalg.norm(roots[dim][cells[dim]] - x, axis=1)
                if first:
                    visit = cells[dim][[far.argmin()]]
                else:
                    limit = _limit(np.array([reach[dim] + x @ x]), np.array([floor]))
                    visit = cells[dim][_below(far - wide[dim], limit) & (cells[dim] != home)]
                out += [(vec_id, row, dim, vector, floor, home if not first else r, r) for r in visit.tolist()]
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=[*names, "root"])

    return run


def _search(roots: dict[int, np.ndarray], reach: dict[int, float], k: int):
    """Cogroup: the candidates of a subtree, and the queries that come to it."""

    def run(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "query_row", "vec_id", "row", "score"]
        if not candidates.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names=names)
        dim, root = key[0].as_py(), key[1].as_py()
        matrix = lambda t: lists(t.column("vector").combine_chunks()) if dim else np.zeros((t.num_rows, 0), np.int64)
        tree = Tree(np.asarray(candidates.column("vec_id")), matrix(candidates), roots[dim][root], reach[dim], np.asarray(candidates.column("row")))
        ids, keys = np.asarray(queries.column("vec_id")), np.asarray(queries.column("row"))
        vectors, floors = matrix(queries), np.asarray(queries.column("floor"))
        out = []
        for a in range(0, len(ids), QUERIES):
            part = slice(a, a + QUERIES)
            rows, found, score = tree.search(keys[part], vectors[part], floors[part], k)
            out.append(pa.table([pa.array(ids[part][rows]), pa.array(keys[part][rows]), pa.array(tree.ids[found]),
                                 pa.array(tree.keys[found]), pa.array(score)], names=names))
        return pa.concat_tables(out)

    return run


def top_inner_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, roots: int = ROOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every query vector.

    Queries are the vectors whose id is divisible by ``every``, candidates all others of the
    same length, the query's own row left out; ties go to the smaller id. Rows that repeat an
    id are separate rows: each is a candidate of the others, and a repeated query id gives one
    list of up to ``k`` per row, all under that id. The root entries of
    the tree are a sample of at most ``roots`` vectors per length, chosen by a hash; every vector
    goes to the nearest one, and a root entry with many vectors is cut into subtrees of bounded
    size. A query searches the subtrees of its nearest root entry first; the k-th score there
    bounds which others it visits. Results are exact. Unusable vectors and null ids take no part; an empty
    vector has inner product 0 with every other empty one. No vectors, no rows.
    """
    small_batches(vectors.sparkSession)
    rows = cut_lineage(whole_vectors(vectors, scale))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    reach = {r["dim"]: r["reach"] for r in rows.groupBy("dim").agg(F.max(norm).alias("reach")).collect()}
    centres: dict[int, np.ndarray] = {}
    for dim, most in reach.items():
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id", "row").select("vector").limit(roots).collect()
        centres[dim] = _lift(np.array([r["vector"] for r in sample], dtype=np.int64).reshape(len(sample), dim), most)
    schema = T.StructType([*rows.schema.fields, T.StructField("root", T.IntegerType()), T.StructField("away", T.DoubleType())])
    placed = cut_lineage(rows.mapInArrow(_assign(centres, reach), schema))
    cells = placed.groupBy("dim", "root").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    known = {(r["dim"], r["root"]): (r["n"], r["radius"]) for r in cells.collect()}  # at most ``roots`` rows per length
    radius = {key: r for key, (_, r) in known.items()}
    counted = {f"{d}/{r}": -(-n // SUBTREE) for (d, r), (n, _) in known.items()}
    parts = F.create_map(*[F.lit(x) for item in counted.items() for x in item])[F.concat_ws("/", "dim", "root")] if counted else F.lit(1)
    queries = placed.where(F.col("vec_id") % every == 0)
    blocks = -(-queries.count() // QUERY_BLOCK)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("block")
    stored = placed.select("dim", "root", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), every_block, "vec_id", "row", "vector")
    queries = queries.select("vec_id", "row", "dim", "vector", F.lit(_NONE).alias("floor"), F.lit(-1).alias("home"))
    routed = "vec_id long, row long, dim int, vector array<long>, floor long, home int, root int"
    cell = ["dim", "root", "part", "block"]

    def searched(visits: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("row", F.lit(6)), F.lit(max(blocks, 1))).cast("int")
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))).withColumn("block", block)
        grouped = stored.groupBy(*cell).cogroup(visits.groupBy(*cell))
        return grouped.applyInArrow(_search(centres, reach, k), "query_id long, query_row long, vec_id long, row long, score long")

    homes = cut_lineage(queries.mapInArrow(_route(centres, reach, radius, True), routed))
    at_home = cut_lineage(searched(homes))
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = at_home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    floors = best.select(F.col("query_row").alias("row"), F.col("score").alias("kth"))
    again = homes.drop("root", "floor").join(floors, "row", "left").select(
        "vec_id", "row", "dim", "vector", F.coalesce("kth", F.lit(_NONE)).alias("floor"), "home")
    found = at_home.unionByName(searched(again.mapInArrow(_route(centres, reach, radius, False), routed)))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
