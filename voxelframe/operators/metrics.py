"""Evaluation metrics as aggregates, exact on ties; ``keys`` (task, fold) keep all folds in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.ranking import value_ranks

_ONE = "_one"


def _keyed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return rows.withColumn(_ONE, F.lit(0)), [*keys, _ONE]


def regression_metrics(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """mae, rmse, r2, pearson, spearman of y_true and y_pred."""
    rows, groups = _keyed(rows, list(keys))
    base = rows.groupBy(*groups).agg(
        F.expr("avg(abs(y_true - y_pred)) as mae"),
        F.expr("sqrt(avg(power(y_true - y_pred, 2))) as rmse"),
        F.expr("if(var_pop(y_true) > 0, 1 - avg(power(y_true - y_pred, 2)) / var_pop(y_true), null) as r2"),
        F.expr("corr(y_true, y_pred) as pearson"),
    )
    ranked = rows
    for name in ("y_true", "y_pred"):
        ranks = value_ranks(rows, groups, name).select(*groups, name, F.col("rank").alias(f"rank_{name}"))
        ranked = ranked.join(ranks, [*groups, name])
    spear = ranked.groupBy(*groups).agg(F.corr("rank_y_true", "rank_y_pred").alias("spearman"))
    return base.join(spear, groups, "left").drop(_ONE)


def confusion_matrix(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts per (y_true, y_pred)."""
    return rows.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 per class (union of true and predicted classes; 0 on zero division)."""
    cells = confusion_matrix(rows, keys)
    sides = cells.selectExpr(
        *keys, "inline(array(named_struct('class', y_true, 't', n, 'p', 0L, 'h', if(y_true = y_pred, n, 0L)),"
        " named_struct('class', y_pred, 't', 0L, 'p', n, 'h', 0L)))"
    )
    sums = sides.groupBy(*keys, "class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    return sums.selectExpr(
        *keys, "class", "support", "predicted", "hits", "coalesce(try_divide(hits, predicted), 0D) as precision",
        "coalesce(try_divide(hits, support), 0D) as recall", "coalesce(try_divide(2D * hits, support + predicted), 0D) as f1",
    )


def binary_metrics(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Balanced accuracy and the scores of class 1."""
    scores, groups = _keyed(class_scores(rows, keys), list(keys))
    return scores.groupBy(*groups).agg(
        F.expr("avg(if(support > 0, recall, null)) as balanced_accuracy"),
        F.expr("coalesce(max(if(class = 1, f1, null)), 0D) as f1"),
        F.expr("coalesce(max(if(class = 1, precision, null)), 0D) as precision"),
        F.expr("coalesce(max(if(class = 1, recall, null)), 0D) as recall"),
    ).drop(_ONE)


def multiclass_f1(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    scores, groups = _keyed(class_scores(rows, keys), list(keys))
    return scores.groupBy(*groups).agg(
        F.expr("avg(if(support > 0, recall, null)) as balanced_accuracy"),
        F.expr("avg(f1) as f1_macro"), F.expr("sum(f1 * support) / sum(support) as f1_weighted"),
    ).drop(_ONE)


def brier(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean squared gap of probability and class, defined only if both classes occur."""
    return rows.groupBy(*keys).agg(F.expr("if(count(distinct y_true) > 1, avg(power(proba - y_true, 2)), null) as brier_score"))


def roc_auc(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Area under the curve from average ranks of ``proba``; NULL with a single class. Counts per distinct score suffice."""
    rows, groups = _keyed(rows, list(keys))
    ranks = value_ranks(rows, groups, "proba", {"pos": "sum(cast(y_true as bigint))"})
    sums = ranks.groupBy(*groups).agg(
        F.expr("sum(rank * pos) as rank_sum"), F.expr("double(sum(pos)) as p"), F.expr("double(sum(n - pos)) as q")
    )
    return sums.selectExpr(*keys, "if(p > 0 and q > 0, (rank_sum - p * (p + 1) / 2) / (p * q), null) as auc", "p as positives")


def roc_auc_ovr(rows: DataFrame, keys: list[str] = (), weighted: bool = False) -> DataFrame:
    """One-vs-rest AUC over classes of y_true; ``proba`` is an array with an entry per class."""
    each = rows.selectExpr(*keys, "y_true", "posexplode(proba) as (class, proba)")
    each = each.selectExpr(*keys, "class", "int(y_true = class) as y_true", "proba")
    scores, groups = _keyed(roc_auc(each, [*keys, "class"]), list(keys))
    value = "sum(auc * positives) / sum(if(auc is null, 0D, positives))" if weighted else "avg(auc)"
    return scores.groupBy(*groups).agg(F.expr(f"{value} as auc_macro")).drop(_ONE)


def log_loss(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Binary cross-entropy of ``proba``, kept away from 0 and 1."""
    p = "greatest(1e-12D, least(1 - 1e-12D, proba))"
    return rows.groupBy(*keys).agg(F.expr(f"avg(-if(y_true = 1, ln({p}), ln(1 - {p}))) as log_loss"))


def cross_entropy(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean negative log of the true class's entry in ``proba``."""
    return rows.groupBy(*keys).agg(F.expr("avg(-ln(greatest(1e-12D, proba[y_true]))) as cross_entropy"))


def huber_loss(rows: DataFrame, keys: list[str] = (), beta: float = 1.0) -> DataFrame:
    """Smooth L1: quadratic below beta, linear above."""
    gap = "abs(y_true - y_pred)"
    return rows.groupBy(*keys).agg(F.expr(f"avg(if({gap} < {beta}D, 0.5D * {gap} * {gap} / {beta}D, {gap} - 0.5D * {beta}D)) as huber_loss"))


def batch_mean_loss(rows: DataFrame, loss: str, batch: str = "batch") -> DataFrame:
    """Mean of per-batch means, as an evaluation loop over batches reports it."""
    return rows.groupBy(batch).agg(F.expr(f"avg({loss}) as loss")).agg(F.avg("loss").alias("mean_loss"))
