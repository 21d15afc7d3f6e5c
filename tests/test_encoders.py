from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import CATEGORICAL, CONTINUOUS
from pyspark.sql import functions as F

from loanloom.operators.preprocess import IQRClipper, build_pd_feature_pipeline
from loanloom.operators.woe import WOEEncoder, WOEModel, smoothed_woe


def frame(spark, **columns):
    kinds = {float: "double", int: "int", str: "string", bool: "boolean"}
    names, types = list(columns), []
    for values in columns.values():
        first = next((v for v in values if v is not None), 0.0)
        types.append(kinds[type(first)])
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def values(df, column):
    return [r[column] for r in df.select(column).collect()]


def by_hand(x, y, n_bins=10, reg=0.5, clip=3.0):
    """WOE per row and IV of a continuous feature, with numpy."""
    ok = ~np.isnan(x)
    cuts = np.unique(np.quantile(x[ok], np.linspace(0, 1, n_bins + 1)))[1:-1]
    bins = np.digitize(x, cuts)
    bad_all, good_all = y.sum(), (1 - y).sum()
    out, iv = np.zeros(len(x)), 0.0
    for mask_set, n in (([(bins == b) & ok for b in range(len(cuts) + 1)], len(cuts) + 1), ([~ok], 1)):
        for mask in mask_set:
            if n == 1 and not mask.any() and mask_set[0] is mask:
                continue
            bad = (y[mask].sum() + reg) / (bad_all + reg * n)
            good = ((1 - y)[mask].sum() + reg) / (good_all + reg * n)
            w = float(np.clip(np.log(good / bad), -clip, clip))
            out[mask] = w
            iv += (good - bad) * w
    return out, iv


def test_continuous_woe_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=800).round(1)
    x[:100] = np.nan
    y = (rng.random(800) < np.where(np.isnan(x), 0.7, 0.25)).astype(int)
    expected, iv = by_hand(x, y)
    df = frame(spark, x=[None if math.isnan(v) else float(v) for v in x], y=[int(v) for v in y])
    for rows in (10**6, 10):  # single-pass and bracketed quantiles
        model = WOEEncoder("y", single_pass_rows=rows).fit(df)
        got = model.transform(df)
        np.testing.assert_allclose(values(got, "x_woe"), expected, atol=1e-12)
        assert model.iv["x"] == pytest.approx(iv, abs=1e-12)
    assert got.columns == ["x", "y", "x_woe"]


def test_partition_invariance_and_outputs(credit):
    columns = [*CONTINUOUS, *CATEGORICAL]
    one = WOEEncoder("y", features=columns).fit(credit.coalesce(1))
    many = WOEEncoder("y", features=columns).fit(credit.repartition(7))
    assert one.features == many.features
    assert one.output_names == [f"{c}_woe" for c in columns]
    assert all(v >= 0 for v in one.iv.values())


def test_direction_and_summary(spark, credit):
    model = WOEEncoder("y", features=[*CONTINUOUS, *CATEGORICAL]).fit(credit)
    top = model.iv_summary(spark).first()
    assert top["feature"] == "cibil_score" and top["strength"] == "strong" and top["leakage_warning"]
    woe = model.features[0].bin_woe
    assert woe[0] < woe[-1]  # low scores carry the risk
    clamped = frame(spark, cibil_score=[-999.0, 300.0, 99999.0, 899.0], revolving_utilisation=[0.1] * 4, dpd_90_count_24m=[0.0] * 4, borrower_segment=["ASTRONAUT", "PIRATE", "msme", None])
    out = model.transform(clamped)
    w = values(out, "cibil_score_woe")
    assert w[0] == w[1] and w[2] == w[3]
    s = values(out, "borrower_segment_woe")
    assert s[0] == s[1] == model.features[-1].other_woe and s[3] == 0.0


def test_rare_levels_and_empty_other_group(spark):
    cats = ["A"] * 48 + ["B"] * 48 + ["RARE"] * 4
    y = [1, 0, 0] * 33 + [1]
    df = frame(spark, c=cats, y=y)
    model = WOEEncoder("y", rare_threshold=0.05).fit(df)
    assert set(model.features[0].level_woe) == {"A", "B"}
    # the boundary counts as kept; the empty rest still takes its share of the smoothing
    kept = WOEEncoder("y", rare_threshold=0.04).fit(df).features[0]
    assert set(kept.level_woe) == {"A", "B", "RARE"}
    e = [sum(v for v, c in zip(y, cats, strict=True) if c == k) for k in ("A", "B", "RARE")] + [0]
    g = [cats.count(k) - n for k, n in zip(("A", "B", "RARE"), e, strict=False)] + [0]
    woe, iv = smoothed_woe(e, g, (sum(y), len(y) - sum(y)), 0.5, 3.0)
    assert kept.other_woe == pytest.approx(woe[-1]) and kept.iv == pytest.approx(sum(iv))


def test_null_category_has_its_own_weight(spark):
    df = frame(spark, c=["X", "Y", None] * 40, y=[0, 0, 1] * 30 + [0, 1, 0] * 10)
    out = WOEEncoder("y").fit(df).transform(df)
    weights = {r["c"]: r["c_woe"] for r in out.collect()}
    assert weights[None] < min(weights["X"], weights["Y"])


def test_separation_constant_and_flags(spark):
    half = [0.0] * 50 + [1.0] * 50
    y = [0] * 50 + [1] * 50
    perfect = WOEEncoder("y", n_bins=4, regularization=0.0).fit(frame(spark, p=[v + i / 1000 for i, v in enumerate(half)], y=y))
    assert set(map(abs, perfect.features[0].bin_woe)) == {3.0}
    constant = WOEEncoder("y").fit(frame(spark, k=[7.0] * 100, y=y))
    assert constant.iv["k"] == pytest.approx(0.0, abs=1e-12) and constant.features[0].cuts == []
    flag = WOEEncoder("y", categorical=["f"]).fit(frame(spark, f=[int(v) for v in half], y=y))
    assert flag.features[0].kind == "categorical" and set(flag.features[0].level_woe) == {"0", "1"}
    # a flag widened to double by a join keeps its levels
    widened = frame(spark, f=[0.0, 1.0])
    assert values(flag.transform(widened), "f_woe") == [flag.features[0].level_woe["0"], flag.features[0].level_woe["1"]]


def test_many_levels_are_joined(spark, monkeypatch):
    from loanloom.operators import joins

    monkeypatch.setattr(joins, "HOT_MIN_ROWS", 100)
    rng = np.random.default_rng(5)
    cats = [None if v > 60 else ("hot" if v > 30 else f"c{v}") for v in rng.integers(0, 70, 600).tolist()]
    df = frame(spark, c=cats, y=[int(v) for v in rng.random(600) < 0.3])
    literal = WOEEncoder("y", rare_threshold=0.0).fit(df)
    joined = WOEEncoder("y", rare_threshold=0.0, max_literal_levels=5).fit(df)
    assert joined.features[0].wide and "hot" in joined.features[0].hot_levels
    assert joined.iv["c"] == pytest.approx(literal.iv["c"])
    probe = frame(spark, c=[*cats, "unseen"], n=list(range(601)))
    a = {r["n"]: r["c_woe"] for r in literal.transform(probe).collect()}
    b = {r["n"]: r["c_woe"] for r in joined.transform(probe).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_persistence(spark, credit, tmp_path):
    model = WOEEncoder("y", features=[*CONTINUOUS, *CATEGORICAL]).fit(credit)
    model.write().save(str(tmp_path / "woe"))
    loaded = WOEModel.load(str(tmp_path / "woe"))
    assert loaded.features == model.features
    assert loaded.transform(credit).exceptAll(model.transform(credit)).isEmpty()


@pytest.mark.parametrize(
    ("options", "match"),
    [({"n_bins": 1}, "n_bins"), ({"rare_threshold": 1.0}, "rare_threshold"), ({"forbidden": ["borrower_segment"]}, "Forbidden")],
)
def test_bad_options(credit, options, match):
    with pytest.raises(ValueError, match=match):
        WOEEncoder("y", features=[*CONTINUOUS, *CATEGORICAL], **options).fit(credit)


def test_bad_targets_and_columns(credit):
    features = ["cibil_score"]
    with pytest.raises(ValueError, match="both classes"):
        WOEEncoder("y", features=features).fit(credit.withColumn("y", F.lit(0)))
    with pytest.raises(ValueError, match="binary"):
        WOEEncoder("y", features=features).fit(credit.withColumn("y", F.lit(2)))
    model = WOEEncoder("y", features=features).fit(credit.withColumn("y", F.col("y") == 1))
    with pytest.raises(ValueError, match="missing columns"):
        model.transform(credit.drop("cibil_score"))


# ------------------------------------------------------------------- preprocessing


@pytest.fixture
def mixed(spark):
    return frame(
        spark,
        a=[1.0, 2.0, None, 100.0, 3.0],
        gone=[None] * 5,
        c=["b", "a", None, "a", "b"],
        f=[10, 9, 10, None, 9],
    ).withColumn("extra", F.lit("kept"))


def test_tree_preprocessing(spark, mixed):
    model = build_pd_feature_pipeline("tree", ["a", "gone"], ["c", "f"]).fit(mixed)
    assert model.output_names == ["a", "c", "f"]  # a column without values is dropped
    out = model.transform(mixed)
    assert values(out, "a") == [1.0, 2.0, 2.5, 100.0, 3.0]
    assert values(out, "c") == [1.0, 0.0, 0.0, 0.0, 1.0]  # tie: the smaller level is imputed
    assert values(out, "f") == [1.0, 0.0, 1.0, 0.0, 0.0]  # numeric order: 9 before 10
    probe = frame(spark, a=[None, 5.0], c=["zz", "b"], f=[1, 10])
    assert values(model.transform(probe), "c") == [-1.0, 1.0]
    assert values(model.transform(probe), "f") == [-1.0, 1.0]


def test_neural_preprocessing(spark, mixed):
    model = build_pd_feature_pipeline("neural", ["a"], ["c"]).fit(mixed)
    out = model.transform(mixed)
    filled = np.array([1.0, 2.0, 2.5, 100.0, 3.0])
    q1, q3 = np.percentile(filled, [25, 75])
    clipped = np.clip(filled, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    np.testing.assert_allclose(values(out, "a"), (clipped - clipped.mean()) / clipped.std())
    assert values(out, "c_a") == [0.0, 1.0, 1.0, 1.0, 0.0]
    probe = model.transform(frame(spark, a=[1.0], c=["zz"]))
    assert (values(probe, "c_a"), values(probe, "c_b")) == ([0.0], [0.0])


def test_iqr_clipper_keeps_fitted_bounds(spark):
    model = IQRClipper(["x"], k=0.0).fit(frame(spark, x=[0.0, 1.0, 2.0, 3.0, 4.0]))
    assert values(model.transform(frame(spark, x=[999.0, None, -5.0])), "x") == [3.0, None, 1.0]


def test_pipeline_guards():
    with pytest.raises(ValueError, match="model_type"):
        build_pd_feature_pipeline("logistic", ["a"], [])
    with pytest.raises(ValueError, match="Forbidden"):
        build_pd_feature_pipeline("tree", ["a"], ["state_code"])
    assert build_pd_feature_pipeline("tree", ["a"], ["state_code"], forbidden_features=())
