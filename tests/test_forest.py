"""Forests grown whole in tasks: against Spark ML, brute force and their own limits."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor

from voxelframe.catalog import models
from voxelframe.catalog.base import QUERIES
from voxelframe.operators import forest, training


def table(spark, n=400, classes=3, seed=3):
    """Class by two of six features, with one constant feature and one of few values."""
    generator = np.random.default_rng(seed)
    x = generator.normal(size=(n, 6))
    x[:, 4], x[:, 5] = 7.0, generator.integers(0, 3, n)
    y = np.clip(np.floor(x[:, 0] + 0.6 * x[:, 1] + classes / 2), 0, classes - 1)
    rows = [(i, [float(c) for c in x[i]], float(y[i]), 1.0 + i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, v array<double>, y double, weight double").withColumn("features", array_to_vector("v")).drop("v")


def test_no_job_per_level_of_the_trees(spark, monkeypatch):
    """Training rows that fit into a task are not left to Spark ML, whose jobs grow with depth."""
    for kind in (RandomForestClassifier, RandomForestRegressor):
        monkeypatch.setattr(kind, "fit", lambda *_: 1 / 0)
    rows = table(spark)
    fitted = training.fit(training.estimator(training.Settings(trees=60), seed=1), rows, training.Settings())
    assert fitted.trees.count() == 60 and fitted.trees.select("tree").distinct().count() == 60
    with pytest.raises(ZeroDivisionError):  # few trees stay with Spark ML
        training.fit(training.estimator(training.Settings(trees=10)), rows, training.Settings())


@pytest.mark.parametrize("regression", [False, True])
def test_agrees_with_spark_ml(spark, regression, monkeypatch):
    settings = training.Settings(regression=regression, trees=60, depth=6)
    rows, new = table(spark), table(spark, seed=4)
    own = training.fit(training.estimator(settings), rows, settings)
    assert isinstance(own, forest.Forest)
    monkeypatch.setattr(forest, "MOST_CELLS", 10)
    theirs = training.fit(training.estimator(settings), rows, settings)
    assert not isinstance(theirs, forest.Forest)
    value = "prediction" if regression else vector_to_array("probability").alias("prediction")
    a, b = (np.array([r.prediction for r in m.transform(new).select("sample_id", value).orderBy("sample_id").collect()]).reshape(400, -1) for m in (own, theirs))
    assert a.shape == b.shape and np.abs(a - b).mean() < (0.1 if regression else 0.05) and abs((a - b).mean()) < 0.03  # targets are 0 to 2
    if not regression:
        assert a.sum(axis=1) == pytest.approx(1) and a.shape == (400, 3)
    assert own.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.06)
    assert own.featureImportances[4] == 0


def test_same_trees_however_they_are_dealt_out(spark, monkeypatch, tmp_path):
    rows = table(spark, 90)
    seen = []
    for together in (1, 50, 1 << 16):
        bins = np.random.default_rng(0).integers(0, 5, (90, 4)).astype(np.uint8)
        y = np.random.default_rng(1).integers(0, 3, 90).astype(float)
        monkeypatch.setattr(forest, "TOGETHER", together)
        seen.append([[a.tolist() for a in tree[1:]] for tree in forest.grow(bins, y, np.ones(90), forest.Spec(7, 30, 5, "sqrt"), 3, range(7))])
    assert seen[0] == seen[1] == seen[2]
    fitted = forest.fit(rows, [forest.Spec(5, 30, 1, "auto"), forest.Spec(3, 2, 1, "all", 4)], False)
    assert [f.trees.count() for f in fitted] == [5, 3]
    fitted[0].write().overwrite().save(str(tmp_path / "f"))
    again = forest.Forest.load(spark, str(tmp_path / "f"))
    monkeypatch.setattr(forest, "SLAB", 16)
    a, b = (sorted(tuple(r) for r in f.transform(rows).selectExpr("sample_id", "prediction", "cast(probability as string)").collect()) for f in (fitted[0], again))
    assert a == b and len(a) == 90 and forest.Forest.load(spark, str(tmp_path / "none")) is None


def test_splits_are_the_best_ones():
    """The first split of trees over all features has the least impurity of any; limits of depth and leaf size hold."""
    generator = np.random.default_rng(2)
    bins, weight = generator.integers(0, 6, (60, 3)).astype(np.uint8), generator.uniform(0.5, 2, 60)
    y = ((bins[:, 1] > 2) ^ (generator.uniform(size=60) < 0.2)).astype(float)
    for target, classes in ((y, 2), (y * 3 + bins[:, 0], 0)):
        for t, feature, bin_, left, value, gains in forest.grow(bins, target, weight, forest.Spec(4, 3, 9, "all", 5), classes, range(4)):
            times = np.random.default_rng((9, t)).poisson(1.0, 60)
            w = weight * times

            def rest(side):
                if side.any() and w[side].sum() > 0:
                    mean = (w[side] * target[side]).sum() / w[side].sum()
                    return (w[side] * (target[side] - mean) ** 2).sum()
                return 0.0

            found = {(f, b): rest(bins[:, f] <= b) + rest(bins[:, f] > b) for f in range(3) for b in range(5)
                     if min(times[bins[:, f] <= b].sum(), times[bins[:, f] > b].sum()) >= 5}
            assert found[feature[0], bin_[0]] == pytest.approx(min(found.values()))
            assert value[0, 0] == pytest.approx((w * target).sum() / w.sum()) and len(feature) <= 15 and gains.min() >= 0
            at = np.zeros(60, dtype=int)
            for _ in range(4):
                at = np.where(feature[at] >= 0, left[at] + (bins[np.arange(60), feature[at]] > bin_[at]), at)
            assert (feature[at] == -1).all() and np.bincount(at, weights=times)[np.unique(at[times > 0])].min() >= 5


def test_bin_limits():
    assert forest.limits_of(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5] and len(forest.limits_of(np.ones(9))) == 0
    limits = forest.limits_of(np.arange(3200.0))
    assert len(limits) == 31 and set(np.diff(limits)) == {100.0} and np.bincount(np.searchsorted(limits, np.arange(3200.0))).tolist() == [100] * 32
    assert [forest.subset_size(s, 64, 10, False) for s in ("auto", "sqrt", "log2", "0.3", "all", "7")] == [8, 8, 6, 20, 64, 7]


def test_search_query_runs_the_whole_search(spark, monkeypatch):
    """The registered search draws as often, over as many inner folds and from the same grid as the default training."""
    seen = []
    monkeypatch.setattr(models.training, "train_folds", lambda rows, settings: seen.append(settings) or training.Trained([], None, None, None, None, None))
    QUERIES["rf_random_search"](spark, "/root/testdata/sf0.001")
    assert seen == [training.Settings()] and seen[0].tune and seen[0].draws == 20 and seen[0].inner_folds == 3 and seen[0].grid == training.GRID
