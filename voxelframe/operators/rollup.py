"""Roll-ups over folds and training logs, and the report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.ranking import running_before
from voxelframe.functions.single import one_row

EPOCHS_PER_PART = 256


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and count of every metric over folds; missing values are left out."""
    return metrics.where("value is not null and not isnan(value)").groupBy("metric").agg(
        F.expr("avg(value) as mean"), F.expr("stddev_pop(value) as std"), F.expr("min(value) as min"),
        F.expr("max(value) as max"), F.expr("count(1) as n_folds"),
    )


def attention_mean(weights: DataFrame, n_folds: DataFrame) -> DataFrame:
    """Weight per label summed over folds and divided by the number of all folds (one-row ``n_folds``)."""
    sums = weights.groupBy("label").agg(F.sum("weight").alias("total"))
    return sums.withColumn("n_folds", one_row(n_folds)["n_folds"]).selectExpr("label", "total / n_folds as weight")


def importance_summary(importances: DataFrame) -> DataFrame:
    """Mean, population deviation and fold count of a feature's importance over the folds that have it."""
    return importances.groupBy("feature").agg(
        F.expr("avg(importance) as mean"), F.expr("stddev_pop(importance) as std"), F.expr("count(1) as n_folds")
    )


def ensemble_vote(predictions: DataFrame, classes: bool = True) -> DataFrame:
    """Mean prediction per sample over folds (classes: rounded half to even) and mean probability per class."""
    vote = "int(bround(avg(y_pred)))" if classes else "avg(y_pred)"
    hard = predictions.groupBy("sample_id").agg(F.expr(f"{vote} as y_pred"), F.count(F.lit(1)).alias("n_folds"))
    if "proba" not in predictions.columns:
        return hard
    each = predictions.selectExpr("sample_id", "posexplode(proba) as (class, p)").groupBy("sample_id", "class").agg(F.avg("p").alias("p"))
    soft = each.groupBy("sample_id").agg(F.expr("transform(array_sort(collect_list(struct(class, p))), c -> c.p) as proba"))
    return hard.join(soft, "sample_id")


def union_results(current: DataFrame, older: DataFrame) -> DataFrame:
    """Result rows of two layouts; where both have a fold the current layout wins."""
    key = ["task", "fold", "metric"]
    return current.unionByName(older.join(current.select(*key), key, "left_anti"))


def best_epoch(log: DataFrame) -> DataFrame:
    """First epoch with the greatest score of every fold."""
    return log.groupBy("fold").agg(F.expr("min_by(epoch, struct(-score, epoch)) as best_epoch"), F.max("score").alias("best_score"))


def early_stop(log: DataFrame, min_epochs: int, patience: int) -> DataFrame:
    """First epoch, not before ``min_epochs``, that is ``patience`` epochs after the last drop of val_loss; NULL if none."""
    parts = log.selectExpr("fold", "epoch", "val_loss", f"epoch div {EPOCHS_PER_PART} as part")
    seen = running_before(parts, ["fold"], "part", ["epoch"], {"lowest": ("min", "val_loss")})
    marked = seen.selectExpr("fold", "epoch", "part", "if(lowest is null or val_loss < lowest, epoch, null) as gain")
    last = running_before(marked, ["fold"], "part", ["epoch"], {"last_gain": ("max", "gain")})
    waited = last.selectExpr("fold", "epoch", "epoch - coalesce(gain, last_gain) as waited")
    hit = f"epoch >= {min_epochs} and waited >= {patience}"
    return waited.groupBy("fold").agg(F.expr(f"min(if({hit}, epoch, null)) as stop_epoch"))


def report_lines(summary: DataFrame, attention: DataFrame) -> DataFrame:
    """Markdown rows: a table line per metric, a bar per label."""
    table = summary.selectExpr(
        "'metric' as section", "metric as name", "format_string('| %s | %.4f | %.4f | %.4f | %.4f |', metric, mean, std, min, max) as line"
    )
    bars = attention.selectExpr(
        "'attention' as section", "label as name", "format_string('- Label %s: %.3f `%s`', label, weight, repeat('#', int(bround(weight * 20)))) as line"
    )
    return table.unionByName(bars)


def write_report(lines: DataFrame, path: str) -> None:
    """One text file; the rows are metrics and labels, so there are few of them."""
    lines.orderBy("section", "name").select("line").coalesce(1).write.mode("overwrite").text(path)


def report_document(task: str, model: str, metrics: DataFrame, run_times: DataFrame, attention: DataFrame | None = None) -> DataFrame:
    """The whole report as rows (part, name, line): title, model, folds, run time, a table of metrics, and label weights if any.

    ``metrics`` is fold, metric, value; ``run_times`` is fold, seconds. Parts and names give the order of the lines.
    """
    folds = metrics.agg(F.countDistinct("fold").alias("n"))
    seconds = run_times.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("s"))
    head = folds.withColumn("s", one_row(seconds)["s"]).selectExpr(f"""inline(array(
        named_struct('part', 0, 'name', '', 'line', '# Report: {task}'), named_struct('part', 1, 'name', '', 'line', ''),
        named_struct('part', 2, 'name', '', 'line', '- Model: `{model}`'), named_struct('part', 3, 'name', '', 'line', concat('- Folds: ', n)),
        named_struct('part', 4, 'name', '', 'line', format_string('- Runtime (s): %.2f', s)), named_struct('part', 5, 'name', '', 'line', ''),
        named_struct('part', 6, 'name', '', 'line', '## Metrics Summary'), named_struct('part', 7, 'name', '', 'line', ''),
        named_struct('part', 8, 'name', '', 'line', '| Metric | Mean | Std | Min | Max |'), named_struct('part', 9, 'name', '', 'line', '|---|---:|---:|---:|---:|')))""")
    none = metrics.sparkSession.createDataFrame([], "label string, weight double")
    lines = report_lines(fold_summary(metrics), none if attention is None else attention)
    body = lines.selectExpr("if(section = 'metric', 10, 14) as part", "name", "line")
    if attention is None:
        return head.unionByName(body)
    label_head = attention.agg(F.count(F.lit(1)).alias("n")).where("n > 0").selectExpr("""inline(array(
        named_struct('part', 11, 'name', '', 'line', ''), named_struct('part', 12, 'name', '', 'line', '## Mean Attention Weights'),
        named_struct('part', 13, 'name', '', 'line', '')))""")
    return head.unionByName(body).unionByName(label_head)


def write_document(rows: DataFrame, path: str) -> None:
    """The lines of ``report_document`` as one text file; there are as many as metrics and labels."""
    rows.orderBy("part", "name").select("line").coalesce(1).write.mode("overwrite").text(path)
