"""Training, tuning, ensembles and inference. Forests are random, so these queries are checked by row counts and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.catalog.base import query, rounded
from voxelframe.catalog.volume import masked_volumes
from voxelframe.operators import rollup, splits, training
from voxelframe.plans import maps
from voxelframe.session import cut_lineage, new_folder
from voxelframe.sources import bindings

SMALL = dict(trees=10, depth=5, k=8, tune=False)


def matrix(spark, folder, folds=3, regression=False):
    """Long fold rows of the sample features; the class is whether the digit is below five."""
    y = "double(label < 5)" if not regression else "double(label)"
    rows = bindings.features(spark, folder).selectExpr("sample_id", "feature", "value", f"{y} as y")
    cases = bindings.samples(spark, folder).selectExpr("sample_id as case_id", "int(label < 5) as stratum")
    own = splits.kfold(cases, folds, 42, "stratum").selectExpr("case_id as sample_id", "fold as own")
    spread = rows.join(own, "sample_id").selectExpr("*", f"explode(sequence(0, {folds - 1})) as fold")
    return cut_lineage(spread.selectExpr("fold", "if(own = fold, 'val', 'train') as role", "sample_id", "feature", "value", "y"))


def trained(spark, folder, settings, folds=3):
    return training.train_folds(matrix(spark, folder, folds, settings.regression), settings)


@query("rf_fit_predict")
def _(spark, folder):
    """One untuned fit per fold: 500 trees without a depth limit on up to 128 features."""
    out = trained(spark, folder, training.Settings(tune=False), 2).predictions
    return rounded(out.selectExpr("fold", "sample_id", "y", "y_pred", "proba[1] as p1"))


@query("train_cv")
def _(spark, folder):
    """Five folds with the default settings but for the search, which `rf_random_search` runs."""
    settings = training.Settings(tune=False)
    out = trained(spark, folder, settings, 5)
    return rounded(rollup.fold_summary(training.fold_metrics(out.predictions, settings)))


@query("train_cv_regression")
def _(spark, folder):
    settings = training.Settings(regression=True, **SMALL)
    return rounded(training.fold_metrics(trained(spark, folder, settings, 2).predictions, settings))


@query("rf_importance")
def _(spark, folder):
    settings = training.Settings(method="rf_importance", **SMALL)
    return rounded(rollup.importance_summary(trained(spark, folder, settings, 2).importances))


@query("rfe")
def _(spark, folder):
    settings = training.Settings(method="rfe", trees=5, depth=4, k=40, tune=False)
    return trained(spark, folder, settings, 2).chosen.select("fold", "feature", "place")


@query("rf_random_search")
def _(spark, folder):
    """The default search in each of two folds: 20 draws of the whole grid over 3 inner folds."""
    out = trained(spark, folder, training.Settings(), 2)
    rows = [(m.fold, k, str(v)) for m in out.models for k, v in m.params.items()]
    return spark.createDataFrame(rows, "fold int, parameter string, value string")


@query("bundle_roundtrip")
def _(spark, folder):
    settings = training.Settings(**SMALL)
    out = trained(spark, folder, settings, 2)
    path = new_folder(spark, "bundle")
    training.save_bundle(out, path)
    loaded = training.load_bundle(spark, path, [m.fold for m in out.models], settings)
    rows = bindings.features(spark, folder).select("sample_id", "feature", "value")
    return rounded(training.score(loaded, rows, settings).selectExpr("fold", "sample_id", "y_pred", "proba[1] as p1"))


@query("ensemble_test")
def _(spark, folder):
    """Hold out a fifth of the samples, train on the rest, vote on the held-out ones and measure."""
    settings = training.Settings(**SMALL)
    cases = bindings.samples(spark, folder).selectExpr("sample_id as case_id", "int(label < 5) as stratum")
    parts = cut_lineage(splits.holdout(cases, 0.2, 42, "stratum").withColumnRenamed("case_id", "sample_id"))
    rows = matrix(spark, folder, 2)
    out = training.train_folds(rows.join(parts.where("split = 'train'"), "sample_id", "left_semi"), settings)
    held = bindings.features(spark, folder).join(parts.where("split = 'holdout'"), "sample_id", "left_semi")
    votes = training.ensemble_predict(out, held.select("sample_id", "feature", "value"), settings)
    truth = bindings.samples(spark, folder).selectExpr("sample_id", "double(label < 5) as y")
    scored = votes.join(truth, "sample_id").withColumn("fold", F.lit(-1))
    return rounded(training.fold_metrics(scored, settings).drop("fold"))


@query("batch_predict")
def _(spark, folder):
    settings = training.Settings(**SMALL)
    rows = bindings.features(spark, folder).where("feature <> 'f07'").selectExpr("sample_id + 1000000 as sample_id", "feature", "value")
    votes = training.ensemble_predict(trained(spark, folder, settings, 2), rows, settings)
    return rounded(votes.selectExpr("sample_id", "y_pred", "n_folds", "proba[1] as p1"))


@query("filter_bank_cv")
def _(spark, folder):
    """Classifier on filter-bank summaries: the same folds, preparation and metrics as the region features."""
    settings = training.Settings(**SMALL)
    table = maps.bank_features(masked_volumes(spark, folder), ["case_id"])
    rows = table.selectExpr("case_id as sample_id", "concat(channel, '_', stat) as feature", "value")
    base = matrix(spark, folder, 2).where("feature = 'f00'").select("fold", "role", "sample_id", "y")
    out = training.train_folds(cut_lineage(base.join(cut_lineage(rows), "sample_id")), settings)
    return rounded(training.fold_metrics(out.predictions, settings))
