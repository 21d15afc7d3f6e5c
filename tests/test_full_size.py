"""The registered queries do the whole job of their operators."""

from __future__ import annotations

import glob
import os
from types import SimpleNamespace

import pytest

import __spark_entry__ as contract
from loanloom.operators.splits import TEST, TRAIN, VALIDATION
from loanloom.plans import models, queries


def test_models_are_registered_with_the_defaults_of_their_classes(monkeypatch):
    matrix = SimpleNamespace(continuous=["x"], categorical=["c"])
    assert vars(queries._forest(matrix)) == vars(models.PDRandomForest(["x"], ["c"]))
    assert queries._boosted(matrix).params == models.BOOSTING_DEFAULTS
    asked = []

    def tune(self, train, validation, **options):
        asked.append((train, validation, options))
        raise InterruptedError

    monkeypatch.setattr(queries, "_folds", lambda spark, directory: (matrix, {TRAIN: 1, VALIDATION: 2, TEST: 3}))
    monkeypatch.setattr(models.PDBoostedTrees, "tune", tune)
    with pytest.raises(InterruptedError):
        queries.tuned_params(None, "")
    assert asked == [(1, 2, {})]


DIRECTORY = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables absent")


@needs_tables
@pytest.mark.parametrize("name", ["feature_psi", "feature_jensen_shannon"])
def test_drift_of_every_continuous_feature(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DIRECTORY}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = contract.queries()[name](spark, DIRECTORY)
    got = {r["feature"]: r for r in df.collect()}
    assert set(got) == {"p", *queries._matrix(spark, DIRECTORY).continuous}
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.values())) == sorted(want)


@needs_tables
def test_the_loss_model_reads_the_whole_matrix(spark, monkeypatch):
    seen = []
    start = queries.calibration.TwoStageLGD.__init__
    monkeypatch.setattr(queries.calibration.TwoStageLGD, "__init__", lambda self, features: (seen.append(list(features)), start(self, features))[1])
    rows = contract.queries()["two_stage_lgd"](spark, DIRECTORY).collect()
    matrix = queries._matrix(spark, DIRECTORY)
    assert len(seen[0]) >= len(matrix.continuous) + len(matrix.categorical) + 1 and any(c.startswith("state_code") for c in seen[0])
    assert len(rows) == matrix.df.count() and all(0 <= r["p_loss"] <= 1 and 0 <= r["severity"] <= 1 for r in rows)
