"""Feature preparation per training fold, for all folds in one plan: rows carry ``fold`` and ``role`` (train or val)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import quality
from voxelframe.session import cut_lineage

DEFAULT_K = 128


def impute_and_scale(rows: DataFrame) -> DataFrame:
    """Median fill and standardisation with statistics of each fold's own training rows."""
    keys = ["fold"]
    rows = cut_lineage(quality.complete(rows, keys))  # the rows are written once; the statistics have a row per fold and feature
    full = quality.fill_median(rows, cut_lineage(quality.medians(rows.where("role = 'train'"), keys)), keys)
    return quality.standardize(full, cut_lineage(quality.scale_stats(full.where("role = 'train'"), keys)), keys)


def rank_train(
    scaled: DataFrame,
    k: int = DEFAULT_K,
    variance: float = quality.FOLD_VARIANCE,
    correlation: float = quality.FOLD_CORRELATION,
    regression: bool = False,
) -> DataFrame:
    """Features of every fold with score and place on scaled rows: variance, then correlation, then the k best by F."""
    keys = ["fold"]
    train = scaled.where("role = 'train'")
    varied = cut_lineage(quality.variance_filter(train, keys, variance).select(*keys, "feature"))  # a row per fold and feature
    train = train.join(varied, [*keys, "feature"], "left_semi")
    kept = quality.correlation_prune(varied, quality.strong_pairs(train, correlation, keys), correlation, keys)
    train = train.join(kept, [*keys, "feature"], "left_semi")
    scores = quality.f_regression(train, keys) if regression else quality.anova_f(train, keys)
    scores = scores.withColumn("f", F.round("f", 9))  # sums arrive in any order; ties must not hang on their last bits
    placed = scores.withColumn("place", F.expr("int(row_number() over (partition by fold order by f desc nulls last, feature))"))
    return placed.where(F.col("place") <= k)


def select_per_fold(rows: DataFrame, **options) -> DataFrame:
    """Chosen features of every fold from raw rows; see ``rank_train`` for the options."""
    return rank_train(impute_and_scale(rows), **options)
