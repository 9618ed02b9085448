import json
import threading

import numpy as np
import pandas as pd
import pytest

from voxelframe.operators import metrics, quality, rollup, selection, splits, training
from voxelframe.plans import jobs
from voxelframe.session import read_if_there
from voxelframe.sources import dictionary, records


def docs(spark, **named):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in named.items()], "dataset string, doc string")


def test_label_dictionaries(spark):
    rows = dictionary.label_dim(docs(
        spark,
        ids={"modality": {"0": "mri"}, "labels": {"0": "background", "20": "L1", "21": "L2"}},
        names={"channel_names": {"0": "CT"}, "labels": {"background": 0, "T1": 1, "T2": 2}},
        odd={"channel_names": {"0": "CT", "1": "CT"}, "labels": {"a": 1}},
        bare={"modality": {"0": "CT"}, "labels": {"5": "x"}},
    )).collect()
    got = {(r.dataset, r.modality, r.background_id, r.label_id) for r in rows}
    assert got == {("ids", "MR", 0, 20), ("ids", "MR", 0, 21), ("names", "CT", 0, 1), ("names", "CT", 0, 2), ("bare", "CT", -1, 5)}


def test_validation(spark):
    data = docs(spark, a={"modality": {"0": "CT"}, "labels": {"1": "x"}}, b={"modality": {"0": "PET"}, "labels": {"1": "x"}})
    schema = docs(spark, a={"t": {"type": "classification", "scope": "per_label", "num_classes": 1, "applicable_labels": [1, 7]}})
    got = {(r.dataset, r.violation) for r in jobs.validate(data, schema).collect()}
    assert got == {("a", "classes_required"), ("a", "unknown_labels"), ("b", "no_labels_or_modality")}


def test_icc(spark):
    matrix = [[1, 1.02, 0.98], [2, 2.01, 1.99], [3, 3.03, 2.97], [4, 4.01, 3.99]]
    rows = [("f", i, k, float(v)) for i, row in enumerate(matrix) for k, v in enumerate(row)] + [("g", 0, 0, 1.0)]
    got = {r.feature: r.icc for r in quality.icc(spark.createDataFrame(rows, "feature string, case_id int, repeat int, value double"), 3).collect()}
    assert got["f"] > 0.95 and got["g"] is None


def test_prune_uses_dropped_features_too(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "feature string")
    pairs = spark.createDataFrame([("a", "b", 0.95), ("b", "c", -0.95), ("a", "c", 0.1)], "a string, b string, r double")
    assert [r.feature for r in quality.correlation_prune(names, pairs, 0.9).collect()] == ["a"]


def test_spearman_with_a_hot_value(spark):
    generator = np.random.default_rng(0)
    block = generator.normal(size=(400, 3))
    block[:150, 1] = 0.0
    block[:, 2] = block[:, 0] ** 3
    rows = spark.createDataFrame([(i, f"f{j}", float(block[i, j])) for i in range(400) for j in range(3)], "sample_id int, feature string, value double")
    got = {(r.a, r.b): r.r for r in quality.spearman(rows).collect()}
    import pandas as pd

    want = pd.DataFrame(block, columns=["f0", "f1", "f2"]).rank().corr()
    assert got[("f0", "f1")] == pytest.approx(want.loc["f0", "f1"])
    assert got[("f0", "f2")] == pytest.approx(1)


def fold_rows(spark, shift=0.0):
    generator = np.random.default_rng(1)
    rows = []
    for i in range(60):
        y = float(i % 2)
        for j in range(6):
            value = float(generator.normal() + (3 * y if j == 0 else 0))
            for fold in range(2):
                role = "val" if i % 4 // 2 == fold else "train"
                moved = value + shift if role == "val" else value
                rows.append((fold, role, i, f"f{j}", None if (i + j) % 11 == 0 else moved, y))
    return spark.createDataFrame(rows, "fold int, role string, sample_id int, feature string, value double, y double")


def test_preparation_ignores_validation_rows(spark):
    plain, moved = (selection.select_per_fold(fold_rows(spark, s), k=3).collect() for s in (0.0, 100.0))
    assert sorted(plain) == sorted(moved)
    a, b = (selection.impute_and_scale(fold_rows(spark, s)).where("role = 'train'").orderBy("fold", "sample_id", "feature").collect() for s in (0.0, 50.0))
    assert [(r.fold, r.sample_id, r.feature) for r in a] == [(r.fold, r.sample_id, r.feature) for r in b]
    assert [r.value for r in a] == pytest.approx([r.value for r in b], abs=1e-12)  # sums arrive in any order


@pytest.mark.parametrize("method,imbalance", [("univariate", "class_weight"), ("rf_importance", "oversample"), ("rfe", "none"), ("none", "none")])
def test_training(spark, method, imbalance, tmp_path):
    settings = training.Settings(trees=5, depth=4, k=2, method=method, imbalance=imbalance, tune=False)
    rows = fold_rows(spark)
    out = training.train_folds(rows, settings)
    assert out.predictions.count() == 60
    chosen = out.chosen.groupBy("fold").count().collect()
    assert all(r["count"] == (6 if method == "none" else 2) for r in chosen)
    assert out.chosen.where("feature = 'f0'").count() == 2
    if method == "univariate":
        training.save_bundle(out, str(tmp_path / "b"))
        loaded = training.load_bundle(spark, str(tmp_path / "b"), [0, 1], settings)
        val = rows.where("fold = 0 and role = 'val'").select("sample_id", "feature", "value")
        again = training.score(loaded, val, settings).where("fold = 0").selectExpr("sample_id", "y_pred").collect()
        first = out.predictions.where("fold = 0").selectExpr("sample_id", "y_pred").collect()
        assert sorted(again) == sorted(first)
        assert training.ensemble_predict(loaded, val, settings).count() == 30


def test_finished_folds_are_skipped(spark):
    out = training.train_folds(fold_rows(spark), training.Settings(trees=2, depth=2, k=2, tune=False), done={0})
    assert [m.fold for m in out.models] == [1]


def test_folds_are_fitted_side_by_side_with_cached_nodes(spark, monkeypatch):
    """Every fit waits until the other one has begun; errors of a fold come out."""
    both, make = threading.Barrier(2), training.estimator

    def waiting(settings, **params):
        forest = make(settings, **params)
        assert forest.getCacheNodeIds()
        both.wait(60)
        return forest

    monkeypatch.setattr(training, "estimator", waiting)
    ended = []
    settings = training.Settings(trees=2, depth=2, k=2, tune=False)
    out = training.train_folds(fold_rows(spark), settings, finished=lambda item, *_: ended.append(item.fold))
    assert [m.fold for m in out.models] == [0, 1] == sorted(ended)
    monkeypatch.setattr(training, "estimator", lambda settings: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        training.train_folds(fold_rows(spark), settings)


def test_search_guards(spark):
    few = spark.createDataFrame([(i, float(i % 2)) for i in range(6)], "sample_id int, y double")
    assert training.random_search(few, training.Settings()) == {}
    with pytest.raises(ValueError):
        training.Settings(method="lasso")
    with pytest.raises(ValueError):
        training.Settings(imbalance="smote")


def test_folds(spark):
    cases = spark.range(103).selectExpr("id as case_id", "id % 7 = 0 as s").selectExpr("case_id", "int(s) as stratum")
    for stratum in (None, "stratum"):
        rows = splits.kfold(cases, 5, 42, stratum).join(cases, "case_id").collect()
        assert len({r.case_id for r in rows}) == len(rows) == 103
        for group in ([rows] if stratum is None else [[r for r in rows if r.stratum == s] for s in (0, 1)]):
            sizes = [sum(r.fold == k for r in group) for k in range(5)]
            assert max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        splits.kfold(cases, 1)


def test_holdout(spark):
    five = spark.createDataFrame([(f"case{i:03d}",) for i in range(5)], "case_id string")
    assert splits.holdout(five, 0.2).where("split = 'holdout'").count() == 1
    cases = spark.range(100).selectExpr("id as case_id", "int(id % 10 < 3) as stratum")
    held = splits.holdout(cases, 0.2, 42, "stratum").where("split = 'holdout'").join(cases, "case_id").groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in held} == {0: 14, 1: 6}
    gap = cases.selectExpr("case_id", "stratum * 2 as stratum")  # a missing class between two others: plain split
    assert splits.holdout(gap, 0.2, 42, "stratum").where("split = 'holdout'").count() == 20


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.5), (1, 0.5), (1, 0.9)], "y_true int, proba double")
    assert metrics.roc_auc(rows).first()["auc"] == pytest.approx(0.875)
    assert metrics.roc_auc(rows.where("y_true = 1")).first()["auc"] is None


def test_binary_scores_without_positive_predictions(spark):
    got = metrics.binary_metrics(spark.createDataFrame([(0, 0), (1, 0)], "y_true int, y_pred int")).first()
    assert (got["precision"], got["recall"], got["f1"], got["balanced_accuracy"]) == (0, 0, 0, 0.5)


def test_early_stop_and_best_epoch(spark):
    losses = [5, 4, 3, 3, 3, 2, 2, 2, 2, 2]
    log = spark.createDataFrame([(0, i + 1, float(v)) for i, v in enumerate(losses)], "fold int, epoch bigint, val_loss double")
    assert rollup.early_stop(log, 3, 2).first()["stop_epoch"] == 5
    assert rollup.early_stop(log, 6, 3).first()["stop_epoch"] == 9
    assert rollup.early_stop(log, 3, 20).first()["stop_epoch"] is None
    assert rollup.best_epoch(log.selectExpr("fold", "epoch", "-val_loss as score")).first()["best_epoch"] == 6


def test_icc_files(spark, tmp_path):
    scores = spark.createDataFrame([("b", 0.5), ("a", None)], "feature string, icc double")
    records.write_icc(scores, str(tmp_path))
    assert [r.feature for r in records.read_icc(spark, str(tmp_path / "icc.csv")).collect()] == ["b"]
    assert records.read_icc(spark, str(tmp_path / "icc.json")).count() == 2
    spark.createDataFrame([("x",)], "name string").write.option("header", True).csv(str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError):
        records.read_icc(spark, str(tmp_path / "bad.csv"))


def test_plan_must_be_whole(spark, tmp_path):
    spark.sql("select 1 as version").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        records.read_plan(spark, str(tmp_path / "p"))


def test_results_copy_of_folds_wins(spark, tmp_path):
    one = spark.createDataFrame([(1, 0)], "case_id int, fold int")
    one.write.parquet(str(tmp_path / "prepared"))
    assert records.read_folds(spark, str(tmp_path / "results"), str(tmp_path / "prepared")).count() == 1
    one.unionByName(one).write.parquet(str(tmp_path / "results"))
    assert records.read_folds(spark, str(tmp_path / "results"), str(tmp_path / "prepared")).count() == 2


def test_weighted_sample_is_balanced(spark):
    rows = spark.range(1000).selectExpr("id as sample_id", "int(id < 100) as label")
    drawn = splits.weighted_sample(rows, spark.range(4000).selectExpr("id as draw")).groupBy("label").count().collect()
    assert sum(r["count"] for r in drawn) == 4000
    assert all(abs(r["count"] - 2000) < 200 for r in drawn)


def test_train_job(spark, tmp_path):
    rows = spark.range(240).selectExpr("id as case_id", "int(id % 2) as label_id", "(id * 37 % 101) / 10D as a", "double(id % 2) + (id * 53 % 97) / 97D as b")
    features = rows.selectExpr("case_id", "label_id", "stack(3, 'a', a, 'b', b, 'flat', 1D) as (feature, value)")
    targets = rows.selectExpr("case_id", "label_id", "double(label_id) as value")
    folds = jobs.make_folds(rows.select("case_id"), str(tmp_path / "folds"), 2)
    settings = training.Settings(trees=5, depth=3, k=2, tune=False)
    got = {r.metric: r.value for r in jobs.train(features, targets, folds, 2, str(tmp_path / "out"), settings).where("fold = 0").collect()}
    assert got["auc"] > 0.9
    new = features.selectExpr("concat(case_id, '__label', label_id) as sample_id", "feature", "value")
    assert jobs.predict(spark, new, str(tmp_path / "out"), [0, 1], settings).count() == 240


def test_train_job_per_case_leaves_unstable_features_out(spark, tmp_path):
    rows = spark.range(120).selectExpr("id as case_id", "(id * 37 % 101) / 10D as a", "double(id % 2) + (id * 53 % 97) / 97D as b")
    regions = rows.selectExpr("case_id", "explode(if(case_id % 10 = 0, array(1), array(1, 2))) as label_id", "a", "b")
    features = regions.selectExpr("case_id", "label_id", "stack(2, 'a', a + label_id, 'b', b) as (feature, value)")
    targets = rows.selectExpr("case_id", "double(case_id % 2) as value")
    folds = jobs.make_folds(rows.select("case_id"), str(tmp_path / "folds"), 2)
    icc = spark.createDataFrame([("a", 0.1), ("b", 0.99)], "feature string, icc double")
    out = str(tmp_path / "out")
    jobs.train(features, targets, folds, 2, out, training.Settings(trees=5, depth=3, k=4, tune=False), scope="per_case", icc=icc)
    chosen = spark.read.parquet(f"{out}/bundle/chosen").select("feature").distinct().collect()
    assert {r.feature for r in chosen} <= {"label001_b", "label002_b"} and chosen
    assert spark.read.parquet(f"{out}/predictions").count() == 120


def test_only_a_missing_store_counts_as_none(spark, tmp_path):
    assert read_if_there(spark, f"file:{tmp_path}/none") is None
    (tmp_path / "empty").mkdir()
    assert read_if_there(spark, f"file:{tmp_path}/empty") is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):
        read_if_there(spark, f"file:{tmp_path}/bad")


def test_spearman_of_ragged_features(spark):
    """Samples that lack a feature do not move the others: b = -a stays at -1 however rows are missing."""
    generator = np.random.default_rng(4)
    rows = []
    for i in range(90):
        a = float(generator.normal())
        rows += [(i, "b", -a)] + ([(i, "a", a)] if i % 2 else [(i, "c", float(generator.normal()))])
    frame = spark.createDataFrame(rows, "sample_id int, feature string, value double")
    full = quality.complete(frame, [])
    assert full.count() == 270 and full.where("value is null").count() == 90
    got = {(r.a, r.b): r.r for r in quality.spearman(frame).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    both = quality.spearman(full.where("sample_id % 2 = 1 and feature <> 'c'")).first()
    assert round(both.r, 9) == -1


def test_inner_folds_after_oversampling(spark, monkeypatch):
    """Copies stay in the inner fold of their sample, and the search sees every row once."""
    rows = [(i, float(i < 10), [float(i % 7), float(i % 3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "sample_id int, y double, v array<double>")
    from pyspark.ml.functions import array_to_vector

    train = training.balanced(frame.withColumn("features", array_to_vector("v")).drop("v"), training.Settings(imbalance="random_oversample"))
    seen = []
    keep = training.cut_lineage
    monkeypatch.setattr(training, "cut_lineage", lambda df, *a: seen.append(keep(df, *a)) or seen[-1])
    training.random_search(train, training.Settings(imbalance="oversample", trees=2, draws=1, inner_folds=3, grid={"maxDepth": [2], "min_leaf": [1], "min_split": [2]}))
    folds = seen[0]
    assert folds.count() == train.count()
    assert folds.groupBy("sample_id").agg({"inner": "max"}).count() == folds.select("sample_id", "inner").distinct().count() == 60


def test_spearman_in_tiles_of_columns_is_the_same(spark):
    rng = np.random.default_rng(4)
    rows = [(f, int(i), f"f{k}", float(rng.integers(0, 9))) for f in (0, 1) for i in range(60) for k in range(7)]
    frame = spark.createDataFrame(rows, "fold int, sample_id long, feature string, value double")
    whole = {(r.fold, r.a, r.b): r.r for r in quality.spearman(frame, ["fold"]).collect()}
    tiled = {(r.fold, r.a, r.b): r.r for r in quality.spearman(frame, ["fold"], tile=3).collect()}
    assert len(whole) == 2 * 21 and tiled == pytest.approx(whole)
    table = pd.DataFrame(rows, columns=["fold", "sample_id", "feature", "value"])
    for fold, part in table.groupby("fold"):
        expected = part.pivot(index="sample_id", columns="feature", values="value").rank().corr()
        for (f, a, b), r in whole.items():
            assert f != fold or r == pytest.approx(expected.loc[a, b])


@pytest.mark.parametrize("tile,slab", [(2, 7), (3, 1000), (512, 1 << 15)])
def test_strong_pairs_are_those_of_the_whole_matrix(spark, tile, slab):
    """Two folds, ties, a flat feature, pairs on both sides of the threshold, in tiles and slabs of any size."""
    base = spark.range(60).selectExpr("id as sample_id", "explode(array(0, 1)) as fold").selectExpr(
        "*", "double((sample_id * 37 + fold) % 23) as a", "double((sample_id * 53) % 31) as c"
    ).selectExpr("sample_id", "fold", "a", "2 * a + 1 as b", "if(sample_id % 9 = 0, -a, a) as d", "c", "-c * c as e", "a + c / 4 as f", "1D as g")
    rows = base.selectExpr("sample_id", "fold", "stack(7, 'a', a, 'b', b, 'c', c, 'd', d, 'e', e, 'f', f, 'g', g) as (feature, value)")
    want = {(r.fold, r.a, r.b): r.r for r in quality.correlated_pairs(quality.spearman(rows, ["fold"]), 0.8).collect()}
    got = {(r.fold, r.a, r.b): r.r for r in quality.strong_pairs(rows, 0.8, ["fold"], tile, slab).collect()}
    assert got.keys() == want.keys() and len(want) >= 6 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_specs_go_to_the_targets(spark):
    """The rows of one target do not meet in one task: no exchange by target before the extremes are aggregated."""
    specs = spark.createDataFrame([("a", "classification", 2, 0), ("b", "regression", None, 1)], "target string, type string, num_classes int, position int")
    rows = spark.range(100).selectExpr("id as case_id", "if(id % 4 = 0, 'b', 'a') as target", "cast(null as int) as label_id", "double(id % 2 + 1) as value")
    got = splits.canonical_targets(rows, specs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert {(r.target, r.value) for r in got.collect()} == {("a", 0.0), ("a", 1.0), ("b", 1.0)}


def test_background_is_looked_for_once_per_dictionary(spark):
    docs = spark.createDataFrame([("a", '{"modality":{"0":"ct"},"labels":{"0":"background","1":"x","2":"y"}}')], "dataset string, doc string")
    got = dictionary.label_dim(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan[: plan.index("Generate")] and "filter(" not in plan[: plan.index("Generate")]
    assert {(r.label_id, r.background_id) for r in got.collect()} == {(1, 0), (2, 0)}
