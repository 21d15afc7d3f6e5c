"""Histogram boosting against an exhaustive search over the rows themselves."""

from __future__ import annotations

import numpy as np
import pytest

from loanloom.operators.boosting import BoostedTreesModel, BoostingParams, fit_boosted_trees


def brute_root(bins, y, w, p):
    """Best root split by trying every feature, threshold and side of the missing values on the rows."""
    prob = 0.5
    g, h = w * (prob - y), w * prob * (1 - prob)
    soft = lambda s: np.sign(s) * max(abs(s) - p.reg_alpha, 0.0)
    score = lambda gs, hs: soft(gs) ** 2 / (hs + p.reg_lambda)
    best = None
    for f in range(bins.shape[1]):
        for b in range(1, bins[:, f].max()):
            for miss_left in (True, False):
                left = np.where(bins[:, f] == 0, miss_left, (bins[:, f] >= 1) & (bins[:, f] <= b))
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                if hl < p.min_child_weight or hr < p.min_child_weight:
                    continue
                gain = score(gl, hl) + score(gr, hr) - score(g.sum(), h.sum())
                if gain > p.gamma and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, b, miss_left, gl, hl, gr, hr)
    return best


@pytest.mark.parametrize("alpha,lam,gamma", [(0.0, 1.0, 0.0), (0.5, 3.0, 0.1)])
def test_root_split_and_leaves_equal_exhaustive_search(spark, alpha, lam, gamma):
    rng = np.random.default_rng(5)
    n = 300
    x1 = rng.normal(size=n)
    x2 = rng.integers(0, 5, n).astype(float)
    x2[rng.random(n) < 0.1] = np.nan
    y = ((x1 + 0.4 * np.nan_to_num(x2, nan=4.0) + rng.normal(scale=0.5, size=n)) > 1.0).astype(float)
    w = np.where(y == 1, 2.0, 1.0)
    rows = [(float(a), None if np.isnan(b) else float(b), float(c), float(d)) for a, b, c, d in zip(x1, x2, y, w)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, label double, weight double")
    p = BoostingParams(n_estimators=1, max_depth=1, learning_rate=1.0, subsample=1.0, colsample_bytree=1.0,
                       reg_alpha=alpha, reg_lambda=lam, gamma=gamma, max_bins=16, min_child_weight=1.0)
    model = fit_boosted_trees(df, ["x1", "x2"], p)
    bins = np.array([r["_bins"] for r in df.withColumn("_bins", __import__("loanloom.operators.boosting", fromlist=["x"])._bins_of(
        model.features, model.cuts)).collect()])
    gain, f, b, miss_left, gl, hl, gr, hr = brute_root(bins, y, w, p)
    tree = model.trees[0]
    assert (tree["feature"][0], tree["cut"][0], tree["left_missing"][0]) == (f, b, miss_left)
    assert tree["gain"][0] == pytest.approx(gain, rel=1e-9)
    soft = lambda s: np.sign(s) * max(abs(s) - alpha, 0.0)
    assert tree["value"][1] == pytest.approx(-soft(gl) / (hl + lam)) and tree["value"][2] == pytest.approx(-soft(gr) / (hr + lam))
    # the Spark margins of training and the numpy margins of scoring agree
    got = np.array([r["pd"] for r in model.transform(df).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-model.margins(bins))))


def test_early_stopping_keeps_the_best_round_and_saves(spark, tmp_path):
    rng = np.random.default_rng(9)
    n = 400
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + rng.normal(scale=1.5, size=n) > 0).astype(float)
    rows = [(*map(float, r), float(t), 1.0, bool(i % 4 == 0)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, weight double, held boolean")
    p = BoostingParams(n_estimators=40, max_depth=3, learning_rate=0.5, early_stopping_rounds=3, seed=1)
    model = fit_boosted_trees(df, ["a", "b", "c"], p, held_out="held")
    assert len(model.trees) == model.best_round + 1 <= len(model.history)
    assert model.history[model.best_round] == max(model.history)
    assert len(model.history) < 40 or model.best_round == 39
    model.write().save(str(tmp_path / "m"))
    again = BoostedTreesModel.load(str(tmp_path / "m"))
    assert [r["pd"] for r in again.transform(df).collect()] == [r["pd"] for r in model.transform(df).collect()]
    assert model.featureImportances.toArray()[0] == max(model.featureImportances.toArray())


def test_nulls_in_label_and_weight_and_empty_validation(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 0.0, 2.0), (None, None, 1.0), (3.0, 1.0, 1.0), (0.5, 0.0, 1.0)],
                               "x double, label double, weight double")
    model = fit_boosted_trees(df, ["x"], BoostingParams(n_estimators=3, max_depth=2, subsample=1.0, min_child_weight=0.0), held_out=None)
    assert len(model.trees) == 3 and model.transform(df).count() == 5
