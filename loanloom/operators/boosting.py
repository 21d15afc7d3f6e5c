"""Second-order histogram boosting of binary classifiers on Spark DataFrames.

Features are cut into quantile bins once (null and NaN in a bin of their own); the binned
rows are written once and every later pass reads small integer arrays. A tree grows level by
level: one aggregation per level sums the gradients and hessians of the sampled training rows by
(node, feature, bin), partially on the map side, so only ``nodes x features x bins`` rows reach
the driver. The driver picks, for each node, the split of largest gain with L1 and L2 penalties
on the leaf weights, ``gamma`` as the least gain and ``min_child_weight`` as the least hessian
of a child; missing values go to the side that gains more. Rows then move to their child by an
expression over literal arrays, inside whole-stage code generation. Columns are drawn per tree,
rows per tree by a hash of their id. With a validation fold, training stops after
``early_stopping_rounds`` rounds without a better validation AUC, and the model keeps the trees up
to the best round.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loanloom.operators.lineage import cut_lineage
from loanloom.operators.metrics import auc_roc

#: Distinct validation scores up to which the AUC of a round is counted on the driver.
DRIVER_AUC_SCORES = 200_000
#: Rounds between reliable checkpoints of the margins.
CHECKPOINT_EVERY = 10


@dataclass
class BoostingParams:
    n_estimators: int = 400
    max_depth: int = 5
    learning_rate: float = 0.05
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    max_bins: int = 64
    early_stopping_rounds: int = 50
    seed: int = 42


def _soft(g: np.ndarray, alpha: float) -> np.ndarray:
    """Gradient sums after the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _score(g: np.ndarray, h: np.ndarray, p: BoostingParams) -> np.ndarray:
    return _soft(g, p.reg_alpha) ** 2 / (h + p.reg_lambda)


def leaf_weight(g: float, h: float, p: BoostingParams) -> float:
    """Leaf value before shrinkage: ``-T(G) / (H + lambda)``."""
    return float(-_soft(np.array([g]), p.reg_alpha)[0] / (h + p.reg_lambda))


def best_split(hist: np.ndarray, p: BoostingParams) -> tuple[float, int, int, bool] | None:
    """Best split of one node from its histogram ``features x bins x 2`` (sums of g and h; bin 0 is missing).

    Returns ``(gain, feature, last bin going left, missing goes left)`` or None when no split
    has a gain above ``gamma`` with both children at ``min_child_weight`` or more. Ties go to the
    smaller feature, then the smaller bin, then missing to the left.
    """
    g_all, h_all = hist[0, :, 0].sum(), hist[0, :, 1].sum()
    parent = _score(np.array([g_all]), np.array([h_all]), p)[0]
    best = None
    for f in range(hist.shape[0]):
        miss_g, miss_h = hist[f, 0, 0], hist[f, 0, 1]
        cg, ch = np.cumsum(hist[f, 1:-1, 0]), np.cumsum(hist[f, 1:-1, 1])  # left = bins 1..b
        for left_missing in (True, False):
            lg, lh = cg + (miss_g if left_missing else 0.0), ch + (miss_h if left_missing else 0.0)
            rg, rh = g_all - lg, h_all - lh
            gain = _score(lg, lh, p) + _score(rg, rh, p) - parent
            ok = (lh >= p.min_child_weight) & (rh >= p.min_child_weight) & (gain > p.gamma)
            if not ok.any():
                continue
            b = int(np.argmax(np.where(ok, gain, -np.inf)))
            if best is None or gain[b] > best[0] + 1e-12 * max(1.0, abs(best[0])):
                best = (float(gain[b]), f, b + 1, left_missing)
    return best


@dataclass
class BoostedTreesModel:
    """Trees as flat arrays in heap order: node ``n`` has children ``2n+1`` and ``2n+2``."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[dict] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)
    best_round: int = -1
    history: list[float] = field(default_factory=list)

    @property
    def featureImportances(self):  # noqa: N802 - the name Spark ML models use
        total = sum(self.gains)
        from pyspark.ml.linalg import Vectors

        return Vectors.dense([g / total if total > 0 else 0.0 for g in self.gains])

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """Summed leaf values of all kept trees for binned rows (n x features)."""
        out = np.zeros(len(bins))
        rows = np.arange(len(bins))
        for tree in self.trees:
            node = np.zeros(len(bins), np.int64)
            feature, cut, left_missing, value = (np.asarray(tree[k]) for k in ("feature", "cut", "left_missing", "value"))
            for _ in range(tree["depth"]):
                f = feature[node]
                split = f >= 0
                b = bins[rows, np.maximum(f, 0)]
                left = np.where(b == 0, left_missing[node], b <= cut[node])
                node = np.where(split, np.where(left, 2 * node + 1, 2 * node + 2), node)
            out += value[node]
        return out

    def transform(self, df: DataFrame, output: str = "pd") -> DataFrame:
        """``df`` with the probability of class 1 appended; the features are binned as in training."""
        binned = df.withColumn("_bins", _bins_of(self.features, self.cuts))
        schema = StructType([*binned.schema.fields, StructField(output, DoubleType())])  # not .add: it changes the cached schema

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                bins = np.stack(b["_bins"].to_numpy()) if len(b) else np.zeros((0, len(self.features)), np.int64)
                yield b.assign(**{output: 1.0 / (1.0 + np.exp(-self.margins(bins.astype(np.int64))))})
        return binned.mapInPandas(score, schema).drop("_bins")

    def to_json(self) -> str:
        return json.dumps(vars(self))

    @classmethod
    def from_json(cls, text: str) -> BoostedTreesModel:
        return cls(**json.loads(text))

    def write(self):
        model = self

        class _Writer:
            def save(self, path: str) -> None:
                SparkSession.active().createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.parquet(path)
        return _Writer()

    @classmethod
    def load(cls, path: str) -> BoostedTreesModel:
        return cls.from_json(SparkSession.active().read.parquet(path).first()["model"])


def _bins_of(features: Sequence[str], cuts: Sequence[Sequence[float]]) -> Column:
    """Bin of every feature: 0 for null or NaN, else 1 + the number of cut points below the value."""
    def one(name: str, points: Sequence[float]) -> Column:
        x = F.col(name).cast("double")
        below = F.aggregate(F.array(*[F.lit(float(c)) for c in points]) if points else F.array().cast("array<double>"),
                            F.lit(0), lambda acc, c: acc + F.when(x > c, 1).otherwise(0))
        return F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(below + 1)
    return F.array(*[one(n, c) for n, c in zip(features, cuts)])


def quantile_cuts(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """At most ``max_bins - 1`` distinct cut points per feature, from one approximate-percentile pass."""
    levels = [i / max_bins for i in range(1, max_bins)]
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), levels, 10_000)
                   .alias(f"c{i}") for i, f in enumerate(features)]).first()
    return [sorted({float(v) for v in (row[f"c{i}"] or [])}) for i in range(len(features))]


@dataclass
class BinnedRows:
    """Rows cut into bins once, written, and shared by every fit: ``rid, bins, y, w, held, margin``."""

    features: list[str]
    cuts: list[list[float]]
    rows: DataFrame
    validating: bool


def binned_rows(rows: DataFrame, features: Sequence[str], *, max_bins: int = 64, label: str = "label",
                weight: str = "weight", held_out: str | None = None) -> BinnedRows:
    """Bins of ``rows`` from cut points of the training rows; rows with a null label are left out, a null weight is 1."""
    held = F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)
    base = rows.where(F.col(label).isNotNull()).select(
        *features, F.col(label).cast("double").alias("y"), F.coalesce(F.col(weight).cast("double"), F.lit(1.0)).alias("w"),
        held.alias("held"))
    cuts = quantile_cuts(base.where(~F.col("held")), features, max_bins)
    binned = base.select(F.xxhash64(*features, "y", "w", "held", F.monotonically_increasing_id()).alias("rid"),
                         _bins_of(features, cuts).alias("bins"), "y", "w", "held", F.lit(0.0).alias("margin"))
    state = cut_lineage(binned)
    return BinnedRows(list(features), cuts, state, held_out is not None and not state.where("held").isEmpty())


def fit_boosted_trees(rows: DataFrame, features: Sequence[str], params: BoostingParams, *, label: str = "label",
                      weight: str = "weight", held_out: str | None = None) -> BoostedTreesModel:
    """Fit on ``rows`` (features, a 0/1 ``label``, a ``weight``); rows where ``held_out`` is true only validate.

    Without a validation fold all ``n_estimators`` rounds are kept. Rows with a null label are
    left out; a null weight counts as 1. Deterministic for a seed: the column and row draws do
    not depend on the partitioning.
    """
    return boost(binned_rows(rows, features, max_bins=params.max_bins, label=label, weight=weight, held_out=held_out), params)


def boost(data: BinnedRows, p: BoostingParams) -> BoostedTreesModel:
    """The rounds of boosting over binned rows; stops early on the validation AUC when there is a validation fold."""
    model = BoostedTreesModel(data.features, data.cuts)
    state = data.rows
    draws = random.Random(p.seed)
    width = max(1, int(round(p.colsample_bytree * len(data.features))))
    best_auc, since = -math.inf, 0
    cached = state
    for t in range(p.n_estimators):
        chosen = sorted(draws.sample(range(len(data.features)), width))
        tree, state_next, kept = _grow(cached, p, t, chosen)
        model.trees.append(tree)
        state_next = state_next.persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % CHECKPOINT_EVERY == 0:
            state_next = cut_lineage(state_next)
        else:
            state_next.count()
        for level in kept:
            level.unpersist()
        if data.validating:
            auc = _auc(state_next.where("held"))
            model.history.append(auc)
            if auc > best_auc:
                best_auc, since, model.best_round = auc, 0, t
            else:
                since += 1
        if cached is not state:
            cached.unpersist()
        cached = state_next
        if data.validating and since >= p.early_stopping_rounds:
            break
    if cached is not state:
        cached.unpersist()
    if data.validating:
        model.trees = model.trees[: model.best_round + 1]
    else:
        model.best_round = len(model.trees) - 1
    gains = [0.0] * len(data.features)
    for tree in model.trees:
        for f, g in zip(tree["feature"], tree["gain"]):
            if f >= 0:
                gains[f] += g
    model.gains = gains
    return model


def _grow(state: DataFrame, p: BoostingParams, t: int, chosen: list[int]):
    """One tree: level by level histograms of the sampled training rows, then the new margins of all rows."""
    size = 2 ** (p.max_depth + 1) - 1
    feature, cut, gain_of = [-1] * size, [0] * size, [0.0] * size
    left_missing, value = [False] * size, [0.0] * size
    prob = 1.0 / (1.0 + F.exp(-F.col("margin")))
    g, h = F.col("w") * (prob - F.col("y")), F.col("w") * prob * (1.0 - prob)
    draw = (F.xxhash64("rid", F.lit(t), F.lit(p.seed)).bitwiseAND(F.lit(0xFFFFFFFF)) / float(1 << 32))
    rows = state.withColumn("node", F.lit(0)).withColumn("g", g).withColumn("h", h).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [rows]
    training = (~F.col("held")) & (draw < p.subsample) if p.subsample < 1.0 else ~F.col("held")
    open_nodes = [0]
    sums: dict[int, tuple[float, float]] = {0: (0.0, 0.0)}
    depth = 0
    for level in range(p.max_depth):
        hist = _histogram(rows.where(training & F.col("node").isin(open_nodes)), chosen, p.max_bins)
        splits = []
        for node in open_nodes:
            node_hist = hist.get(node)
            if node_hist is None:  # no sampled row reached it: a leaf of weight 0
                sums[node] = (0.0, 0.0)
                continue
            sums[node] = (float(node_hist[0, :, 0].sum()), float(node_hist[0, :, 1].sum()))
            found = best_split(node_hist, p)
            if found is None:
                continue
            gain, f, b, miss_left = found
            feature[node], cut[node], left_missing[node], gain_of[node] = chosen[f], b, miss_left, gain
            splits.append(node)
        for node in open_nodes:
            if node not in splits:
                value[node] = p.learning_rate * leaf_weight(*sums[node], p)
        if not splits:
            open_nodes = []
            break
        depth = level + 1
        # kept per level, so that the next step reads a column instead of nesting all earlier steps
        rows = rows.withColumn("node", _step(feature, cut, left_missing)).persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(rows)
        open_nodes = [c for n in splits for c in (2 * n + 1, 2 * n + 2)]
        if depth == p.max_depth:  # children at the deepest level: their sums come from the parents' histograms
            for n in splits:
                f = chosen.index(feature[n])
                column = hist[n][f]
                left = column[1:cut[n] + 1].sum(axis=0) + (column[0] if left_missing[n] else 0.0)
                total = column.sum(axis=0)
                for child, (cg, ch) in ((2 * n + 1, left), (2 * n + 2, total - left)):
                    value[child] = p.learning_rate * leaf_weight(float(cg), float(ch), p)
    tree = {"depth": depth, "feature": feature, "cut": cut, "left_missing": left_missing, "value": value, "gain": gain_of}
    leaf = F.element_at(F.array(*[F.lit(v) for v in value]), F.col("node") + 1)
    margins = rows.select("rid", "bins", "y", "w", "held", (F.col("margin") + leaf).alias("margin"))
    return tree, margins, kept


def _step(feature: list[int], cut: list[int], left_missing: list[bool]) -> Column:
    """Child of every row whose node was split at this level; others stay."""
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("node") + 1)
    f = at(feature)
    b = F.element_at("bins", F.greatest(f, F.lit(0)) + 1)
    left = F.when(b == 0, at(left_missing)).otherwise(b <= at(cut))
    child = F.when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
    return F.when(f >= 0, child).otherwise(F.col("node"))


def _histogram(rows: DataFrame, chosen: list[int], max_bins: int) -> dict[int, np.ndarray]:
    """``node -> features x bins x (g, h)`` of the chosen features, summed map-side first."""
    picked = rows.select("node", "g", "h", F.posexplode(F.array(*[F.element_at("bins", f + 1) for f in chosen])).alias("k", "bin"))
    sums = picked.groupBy("node", "k", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["node"], np.zeros((len(chosen), max_bins + 1, 2)))[r["k"], r["bin"]] = (r["g"], r["h"])
    return out


def _auc(held: DataFrame) -> float:
    """AUC of the validation margins: counted per distinct score on the driver when they are few, else by the distributed count."""
    counts = held.groupBy("margin").agg(F.sum("y").alias("pos"), F.sum(1.0 - F.col("y")).alias("neg"))
    found = counts.limit(DRIVER_AUC_SCORES + 1).collect()
    if len(found) > DRIVER_AUC_SCORES:
        return auc_roc(held, "y", "margin")
    c = np.array([(r["margin"], r["pos"], r["neg"]) for r in found], dtype=float).reshape(-1, 3)
    c = c[np.argsort(c[:, 0])]
    pos, neg = c[:, 1].sum(), c[:, 2].sum()
    if pos == 0 or neg == 0:
        return 0.5
    below = np.cumsum(c[:, 2]) - c[:, 2]
    return float(((below + 0.5 * c[:, 2]) * c[:, 1]).sum() / (pos * neg))
