"""What the model and report queries do with many rows: trees on grouped rows
give the trees of single rows, and long rows are not moved."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from kiln.operators import models as ML
from kiln.operators import text as TX
from kiln.plans import cat_sources as CS
from kiln.plans import risk_report as R
from kiln.sources.tables import Tables
from tests.conftest import SF001

FEATS = ["`id.a`", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    n = 3000
    a, b, c = r.integers(0, 12, n), r.integers(0, 9, n), np.full(n, 2)
    y = 3.0 * a - b * (a > 5) + r.normal(size=n)
    d = spark.createDataFrame([(int(i), *map(float, v)) for i, v in enumerate(zip(a, b, c, y, y > 12))],
                              "k long, `id.a` double, b double, c double, y double, cls double").persist()
    yield d
    d.unpersist()


def both(monkeypatch, fit):
    plain = fit()
    monkeypatch.setattr(ML, "TREE_ROWS", 100)
    return plain, fit()


def by_key(model, d):
    return np.array([r.prediction for r in ML.predict(model, d, ["k"]).orderBy("k").collect()])


def test_boosted_regression_on_groups_is_that_on_rows(rows, monkeypatch):
    plain, grouped = both(monkeypatch, lambda: ML.fit_trees(rows, GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, seed=1), FEATS, "y"))
    assert isinstance(grouped.stages[0], Bucketizer) and np.allclose(by_key(plain, rows), by_key(grouped, rows))


def test_boosted_classes_on_groups_are_those_on_rows(rows, monkeypatch):
    plain, grouped = both(monkeypatch, lambda: ML.fit_trees(rows, GBTClassifier(labelCol="cls", maxIter=5, maxDepth=2, seed=1), FEATS, "cls"))
    p, g = (np.array([r.probability.toArray() for r in m.transform(rows).orderBy("k").collect()]) for m in (plain, grouped))
    assert isinstance(grouped.stages[0], Bucketizer) and np.allclose(p, g)


def test_forest_on_groups_takes_every_row_and_fits_as_well(rows, monkeypatch):
    monkeypatch.setattr(ML, "FOREST_GROUPS", 500)
    bins = rows.select(F.col("`id.a`").alias("a"), "b", "y")
    groups = ML.forest_groups(bins, ["a", "b"], "y", rows.count()).toPandas()
    y = np.array([r.y for r in rows.orderBy("k").collect()])
    assert groups.weight.sum() == 3000 and 108 < len(groups) < 1200 and np.isclose((groups.weight * groups.y).sum(), y.sum())
    plain, grouped = both(monkeypatch, lambda: ML.fit_regressor(rows, "forest", FEATS, "y", maxDepth=8, numTrees=25, seed=1))
    error = [np.sqrt(((by_key(m, rows) - y) ** 2).mean()) for m in (plain, grouped)]
    assert isinstance(grouped.stages[0], Bucketizer) and error[1] < 1.05 * error[0]


def test_a_missing_label_is_refused_in_groups_too(rows, monkeypatch):
    monkeypatch.setattr(ML, "TREE_ROWS", 100)
    with pytest.raises(Exception, match="NaN"):
        ML.fit_regressor(rows.withColumn("y", F.when(F.col("k") != 5, F.col("y"))), "gbt", FEATS, "y", maxIter=1)


def test_thresholds_part_few_values_and_heavy_ones():
    assert ML.thresholds([(1.0, 5), (2.0, 1), (4.0, 9)]) == [1.5, 3.0]
    assert ML.thresholds([]) == [] and ML.thresholds([(1.0, 3)]) == []
    cuts = ML.thresholds([(0.0, 900), *[(float(v), 1) for v in range(1, 101)]])
    assert 0.5 in cuts and len(cuts) <= 31


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_not_shuffled(spark):
    d = spark.createDataFrame([(1, "one two two"), (2, "two three"), (2, "three")], "doc_id long, text string")
    got = TX.tfidf(d, F.lit(True), "doc_id", "text")
    w = {(r.doc_id, r.term): r.weight for r in got.collect()}
    a, b = np.log(3 / 2) + 1, np.log(3 / 3) + 1
    assert len(w) == 4 and np.isclose(w[1, "one"], a / np.hypot(a, 2 * b)) and np.isclose(w[2, "three"], 2 * a / np.hypot(2 * a, b))
    assert _plan(got).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_report_moves_long_texts_once(spark):
    plan = R.risk_score_report(Tables(spark, SF001))._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x and "vulnerability_id" in x]
    assert "asset_id" not in joins[0]  # the outermost: the texts come after the solutions


def test_chunk_files_hold_what_the_models_read(spark):
    li, src = CS._lineitem_files(spark, SF001, ["l_orderkey", "l_tax"])
    assert spark.read.parquet(src).columns == ["l_orderkey", "l_tax"] and spark.read.parquet(src).count() == li.count()
