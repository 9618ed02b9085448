"""Feature quality, selection, metrics and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.catalog.base import EPOCHS, MAT, SCORED, near, query, rounded
from voxelframe.functions import scalar
from voxelframe.functions.ranking import average_rank
from voxelframe.operators import metrics, quality, rollup, selection
from voxelframe.session import cut_lineage, new_folder
from voxelframe.sources import bindings, records
from voxelframe.sources.bindings import table

# A wider set of columns for the filter chain: one empty, one constant, one nearly constant, and two near copies.
WIDE = MAT + """, wide AS (SELECT * FROM mat
  UNION ALL SELECT sample_id, label, 'g_empty', NULL FROM mat WHERE feature = 'f00'
  UNION ALL SELECT sample_id, label, 'g_flat', 1 FROM mat WHERE feature = 'f00'
  UNION ALL SELECT sample_id, label, 'g_tiny', CASE WHEN sample_id % 2 = 0 THEN 1e-6 ELSE 0 END FROM mat WHERE feature = 'f00'
  UNION ALL SELECT sample_id, label, 'h_copy1', value * 2 + 1 FROM mat WHERE feature = 'f01'
  UNION ALL SELECT sample_id, label, 'h_copy2', CASE WHEN sample_id % 40 = 0 THEN -value ELSE value END FROM mat WHERE feature = 'f02')"""
FILLED = WIDE + """, med AS (SELECT feature, median(value) AS med FROM wide GROUP BY ALL HAVING count(value) > 0),
filled AS (SELECT sample_id, label, feature, coalesce(value, med) AS value FROM wide JOIN med USING (feature))"""


def wide(spark, folder):
    rows = bindings.features(spark, folder)
    first, second, third = (rows.where(F.col("feature") == f"f0{k}") for k in range(3))
    return (
        rows.unionByName(first.selectExpr("sample_id", "label", "'g_empty' as feature", "cast(null as double) as value"))
        .unionByName(first.selectExpr("sample_id", "label", "'g_flat' as feature", "1D as value"))
        .unionByName(first.selectExpr("sample_id", "label", "'g_tiny' as feature", "if(sample_id % 2 = 0, 1e-6D, 0D) as value"))
        .unionByName(second.selectExpr("sample_id", "label", "'h_copy1' as feature", "value * 2 + 1 as value"))
        .unionByName(third.selectExpr("sample_id", "label", "'h_copy2' as feature", "if(sample_id % 40 = 0, -value, value) as value"))
    )


def filled(spark, folder):
    rows = wide(spark, folder)
    return cut_lineage(quality.fill_median(rows, quality.medians(rows, []), []))


@query("valid_features", f"WITH {WIDE} SELECT feature, count(value) AS n_values, count(value) > 0 AS any_value, count(DISTINCT value) > 1 AS varies FROM wide GROUP BY ALL")
def _(spark, folder):
    return quality.valid_features(wide(spark, folder))


@query("variance_filter", f"WITH {FILLED} SELECT feature, {near('var_pop(value)', 9)} AS variance FROM filled GROUP BY ALL HAVING var_pop(value) > 1e-8")
def _(spark, folder):
    return rounded(quality.variance_filter(filled(spark, folder), [], quality.GLOBAL_VARIANCE), 9)


@query("average_rank", f"WITH {MAT} SELECT sample_id, feature, rank() OVER w + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rank FROM mat WHERE value IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY value)")
def _(spark, folder):
    rows = bindings.features(spark, folder).where("value is not null")
    return average_rank(rows, ["feature"], "value").select("sample_id", "feature", "rank")


SPEAR = FILLED + """, rk AS (SELECT sample_id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk FROM filled),
sp AS (SELECT p.feature AS a, q.feature AS b, CASE WHEN stddev_pop(p.rk) > 0 AND stddev_pop(q.rk) > 0 THEN corr(p.rk, q.rk) ELSE 0 END AS r
  FROM rk p JOIN rk q ON p.sample_id = q.sample_id AND p.feature < q.feature GROUP BY ALL)"""


@query("spearman_matrix", f"WITH {SPEAR} SELECT a, b, {near('r')} AS r FROM sp")
def _(spark, folder):
    return rounded(quality.spearman(filled(spark, folder)))


@query("high_corr_pairs", f"WITH {SPEAR} SELECT a, b, {near('r')} AS r FROM sp WHERE abs(r) > 0.9 ORDER BY abs(r) DESC")
def _(spark, folder):
    pairs = quality.strong_pairs(filled(spark, folder), 0.9)
    return rounded(pairs).orderBy(F.abs("r").desc(), "a", "b")


@query("corr_prune", f"WITH {SPEAR} SELECT DISTINCT feature FROM filled WHERE feature NOT IN (SELECT b FROM sp WHERE abs(r) > 0.9)")
def _(spark, folder):
    rows = filled(spark, folder)
    return quality.correlation_prune(rows.select("feature").distinct(), quality.strong_pairs(rows, 0.9), 0.9)


REPEATS = MAT + """, rep AS (SELECT feature, sample_id // 5 AS case_id, sample_id % 5 AS repeat,
  CASE WHEN feature IN ('f01', 'f02', 'f03') THEN (sample_id // 5) % 7 + value / 4 ELSE value END AS value FROM mat),
rc AS (SELECT feature, case_id, avg(value) AS m, var_pop(value) * 5 AS w FROM rep GROUP BY ALL HAVING count(value) = 5 AND count(*) = 5),
ms AS (SELECT feature, count(*) AS n, 5 * var_samp(m) AS b, sum(w) / (count(*) * 4.0::DOUBLE) AS w FROM rc GROUP BY ALL),
ic AS (SELECT feature, n, CASE WHEN n >= 2 AND b + 4 * w > 0 THEN (b - w) / (b + 4 * w) END AS icc FROM ms)"""


def icc_scores(spark, folder):
    value = "if(feature in ('f01', 'f02', 'f03'), (sample_id div 5) % 7 + value / 4, value)"
    rows = bindings.features(spark, folder).selectExpr("feature", "sample_id div 5 as case_id", "sample_id % 5 as repeat", f"{value} as value")
    return quality.icc(rows, 5)


@query("icc_1_1", f"WITH {REPEATS} SELECT feature, n, {near('icc')} AS icc FROM ic")
def _(spark, folder):
    return rounded(icc_scores(spark, folder))


@query("icc_summary", f"WITH {REPEATS} SELECT max(n) AS n_cases, 5 AS repeats, count(*) AS n_features, count(*) FILTER (icc >= 0.75) AS n_stable FROM ic")
def _(spark, folder):
    return quality.icc_summary(icc_scores(spark, folder), 5)


@query("icc_load", f"WITH {REPEATS} SELECT feature, {near('icc', 5)} AS icc FROM ic WHERE icc IS NOT NULL")
def _(spark, folder):
    target = new_folder(spark, "icc")
    records.write_icc(icc_scores(spark, folder), target)
    return rounded(records.read_icc(spark, f"{target}/icc.csv"), 5)


NAMED = """nm AS (SELECT DISTINCT CASE WHEN feature < 'f20' THEN feature ELSE 'label' || substr(feature, 2) || '_f0' || substr(feature, 3, 1) END AS feature,
  CASE WHEN feature < 'f20' THEN feature ELSE 'f0' || substr(feature, 3, 1) END AS bare FROM mat)"""


@query("icc_filter", f"""WITH {REPEATS}, {NAMED}, l AS (SELECT nm.feature, coalesce(a.icc, b.icc, -1) AS icc FROM nm LEFT JOIN ic a ON a.feature = nm.feature
  LEFT JOIN ic b ON b.feature = nm.bare) SELECT feature, {near('icc', 5)} AS icc FROM l WHERE icc >= 0.75""")
def _(spark, folder):
    name = "if(feature < 'f20', feature, concat('label', substr(feature, 2), '_f0', substr(feature, 3, 1)))"
    names = bindings.features(spark, folder).selectExpr(f"{name} as feature").distinct()
    return rounded(quality.icc_filter(names, icc_scores(spark, folder)), 5)


STAGED = WIDE + """, md AS (SELECT feature, median(value) AS med, count(value) AS n, count(DISTINCT value) AS d FROM wide GROUP BY ALL),
vr AS (SELECT feature, any_value(n) AS n, any_value(d) AS d, var_pop(coalesce(value, med)) AS v FROM wide JOIN md USING (feature) GROUP BY ALL),
sg AS (SELECT feature, CASE WHEN n = 0 THEN 'invalid' WHEN d < 2 THEN 'constant' WHEN v <= 1e-8 THEN 'low_variance' ELSE 'kept' END AS stage FROM vr)"""


@query("pre_cv_filter", f"WITH {STAGED} SELECT feature, stage FROM sg")
def _(spark, folder):
    return quality.global_filter(wide(spark, folder))


@query("filter_audit", f"""WITH {STAGED} SELECT count(*) AS n_input, count(*) FILTER (stage <> 'invalid') AS n_valid,
  count(*) FILTER (stage NOT IN ('invalid', 'constant')) AS n_varying, count(*) FILTER (stage = 'kept') AS n_variance, count(*) FILTER (stage = 'kept') AS n_kept FROM sg""")
def _(spark, folder):
    return quality.filter_audit(quality.global_filter(wide(spark, folder)))


TRAIN = MAT + """, tr AS (SELECT feature, median(value) AS med FROM mat WHERE sample_id % 5 <> 0 GROUP BY ALL),
im AS (SELECT sample_id, label, feature, sample_id % 5 = 0 AS val, coalesce(value, med) AS value FROM mat JOIN tr USING (feature))"""


def imputed(spark, folder):
    rows = bindings.features(spark, folder)
    stats = quality.medians(rows.where("sample_id % 5 <> 0"), [])
    return quality.fill_median(rows, stats, [])


@query("impute_median", f"WITH {TRAIN} SELECT sample_id, feature, {near('value')} AS value FROM im")
def _(spark, folder):
    return rounded(imputed(spark, folder).select("sample_id", "feature", "value"))


@query("standardize", f"""WITH {TRAIN}, st AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM im WHERE NOT val GROUP BY ALL)
SELECT sample_id, feature, {near('(value - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END')} AS value FROM im JOIN st USING (feature)""")
def _(spark, folder):
    rows = imputed(spark, folder).select("sample_id", "feature", "value")
    return rounded(quality.standardize(rows, quality.scale_stats(rows.where("sample_id % 5 <> 0"), []), []))


ALLFOLDS = WIDE + """, fo AS (SELECT w.*, CAST(k AS INTEGER) AS fold, sample_id % 5 = k AS val FROM wide w, unnest([0, 1, 2, 3, 4]) t(k)),
fm AS (SELECT fold, feature, median(value) AS med FROM fo WHERE NOT val GROUP BY ALL HAVING count(value) > 0),
fi AS (SELECT fold, sample_id, label, feature, val, coalesce(value, med) AS value FROM fo JOIN fm USING (fold, feature)),
fs AS (SELECT fold, feature, avg(value) AS mu, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS sd FROM fi WHERE NOT val GROUP BY ALL),
fz AS (SELECT fold, sample_id, label, feature, val, (value - mu) / sd AS value FROM fi JOIN fs USING (fold, feature))"""


def folded(spark, folder):
    return wide(spark, folder).selectExpr("*", "explode(array(0, 1, 2, 3, 4)) as fold").withColumn(
        "role", F.expr("if(sample_id % 5 = fold, 'val', 'train')")
    )


@query("variance_filter_fold", f"WITH {ALLFOLDS} SELECT fold, feature, {near('var_pop(value)')} AS variance FROM fz WHERE NOT val GROUP BY ALL HAVING var_pop(value) > 1e-6")
def _(spark, folder):
    scaled = selection.impute_and_scale(folded(spark, folder))
    return rounded(quality.variance_filter(scaled.where("role = 'train'"), ["fold"], quality.FOLD_VARIANCE))


@query("train_fold_prep", f"""WITH {ALLFOLDS}, vk AS (SELECT fold, feature FROM fz WHERE NOT val GROUP BY ALL HAVING var_pop(value) > 1e-6),
rk AS (SELECT fold, sample_id, feature, rank() OVER (PARTITION BY fold, feature ORDER BY value) + (count(*) OVER (PARTITION BY fold, feature, value) - 1) / 2.0::DOUBLE AS rk
  FROM fz JOIN vk USING (fold, feature) WHERE NOT val),
dr AS (SELECT DISTINCT p.fold, q.feature FROM rk p JOIN rk q ON p.fold = q.fold AND p.sample_id = q.sample_id AND p.feature < q.feature
  GROUP BY p.fold, p.feature, q.feature HAVING abs(corr(p.rk, q.rk)) > 0.9),
kp AS (SELECT fold, feature FROM vk WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.fold = vk.fold AND dr.feature = vk.feature)),
cl AS (SELECT fold, feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM fz JOIN kp USING (fold, feature) WHERE NOT val GROUP BY ALL),
an AS (SELECT fold, feature, (sum(n * m * m) - power(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS f FROM cl GROUP BY ALL)
SELECT fold, feature, {near('f', 5)} AS f, CAST(row_number() OVER (PARTITION BY fold ORDER BY f DESC, feature) AS INTEGER) AS place FROM an
QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f DESC, feature) <= 10""")
def _(spark, folder):
    rows = folded(spark, folder).withColumnRenamed("label", "y")
    return rounded(selection.select_per_fold(rows, k=10).select("fold", "feature", "f", "place"), 5)


ANOVA = TRAIN + """, cl AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM im GROUP BY ALL),
an AS (SELECT feature, (sum(n * m * m) - power(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS f FROM cl GROUP BY ALL)"""


@query("anova_f", f"WITH {ANOVA} SELECT feature, {near('f', 5)} AS f FROM an")
def _(spark, folder):
    return rounded(quality.anova_f(imputed(spark, folder).withColumnRenamed("label", "y")), 5)


@query("f_regression", f"""WITH {TRAIN}, y AS (SELECT vec_id AS sample_id, CAST(embedding[6] AS DOUBLE) + CAST(embedding[8] AS DOUBLE) AS y FROM embeddings),
c AS (SELECT feature, corr(value, y) AS r, count(*) AS n FROM im JOIN y USING (sample_id) GROUP BY ALL)
SELECT feature, {near('r * r / (1 - r * r) * (n - 2)', 5)} AS f FROM c""")
def _(spark, folder):
    y = bindings.samples(spark, folder).selectExpr("sample_id", "double(embedding[5]) + double(embedding[7]) as y")
    return rounded(quality.f_regression(imputed(spark, folder).join(y, "sample_id")), 5)


@query("select_k_best", f"WITH {ANOVA} SELECT feature, {near('f', 5)} AS f FROM an ORDER BY an.f DESC, feature LIMIT 12")
def _(spark, folder):
    return rounded(quality.top_k(quality.anova_f(imputed(spark, folder).withColumnRenamed("label", "y")), 12), 5)


IMPORT = """imp AS (SELECT CAST(c_nationkey AS INTEGER) AS fold, c_mktsegment AS feature, avg(c_acctbal) / 1000 AS importance FROM customer GROUP BY ALL)"""


def importances(spark, folder):
    rows = table(spark, folder, "customer")
    return rows.groupBy(F.col("c_nationkey").alias("fold"), F.col("c_mktsegment").alias("feature")).agg(F.expr("avg(c_acctbal) / 1000 as importance"))


@query("importance_summary", f"WITH {IMPORT} SELECT feature, {near('avg(importance)')} AS mean, {near('stddev_pop(importance)')} AS std, count(*) AS n_folds FROM imp GROUP BY ALL")
def _(spark, folder):
    return rounded(rollup.importance_summary(importances(spark, folder)))


@query("top_k_features", f"WITH {ANOVA} SELECT feature, {near('sqrt(f)', 5)} AS f FROM an ORDER BY an.f DESC, feature LIMIT 5")
def _(spark, folder):
    scores = quality.anova_f(imputed(spark, folder).withColumnRenamed("label", "y"))
    return rounded(quality.top_k(scores.selectExpr("feature", "sqrt(f) as f"), 5), 5)


@query("align_features", f"""WITH {MAT}, o AS (SELECT * FROM (VALUES (0, 'f05'), (1, 'zz_new'), (2, 'f01'), (3, 'f63')) t(position, feature))
SELECT s.vec_id AS sample_id, o.position, o.feature, m.value FROM embeddings s, o LEFT JOIN mat m ON m.sample_id = s.vec_id AND m.feature = o.feature""")
def _(spark, folder):
    order = spark.sql("select * from values (0, 'f05'), (1, 'zz_new'), (2, 'f01'), (3, 'f63') as t(position, feature)")
    return quality.align(bindings.features(spark, folder), order)


# ------------------------------------------------------------------ metrics
PRED = """pr AS (SELECT vec_id AS sample_id, label % 5 AS fold, CAST(embedding[1] AS DOUBLE) AS y_true,
  round(CAST(embedding[1] AS DOUBLE) * 0.7 + CAST(embedding[2] AS DOUBLE) * 0.5, 2) AS y_pred FROM embeddings)"""


def regressed(spark, folder):
    return bindings.samples(spark, folder).selectExpr(
        "sample_id", "label % 5 as fold", "double(embedding[0]) as y_true", "round(double(embedding[0]) * 0.7D + double(embedding[1]) * 0.5D, 2) as y_pred"
    )


@query("regression_metrics", f"""WITH {PRED}, rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY y_true) + (count(*) OVER (PARTITION BY fold, y_true) - 1) / 2.0::DOUBLE AS rt,
  rank() OVER (PARTITION BY fold ORDER BY y_pred) + (count(*) OVER (PARTITION BY fold, y_pred) - 1) / 2.0::DOUBLE AS rp FROM pr)
SELECT fold, {near('avg(abs(y_true - y_pred))')} AS mae, {near('sqrt(avg(power(y_true - y_pred, 2)))')} AS rmse,
  {near('1 - avg(power(y_true - y_pred, 2)) / var_pop(y_true)')} AS r2, {near('corr(y_true, y_pred)')} AS pearson, {near('corr(rt, rp)')} AS spearman
FROM rk GROUP BY ALL""")
def _(spark, folder):
    return rounded(metrics.regression_metrics(regressed(spark, folder), ["fold"]))


@query("huber_loss", f"WITH {PRED} SELECT fold, {near('avg(CASE WHEN abs(y_true - y_pred) < 0.1 THEN 0.5 * power(y_true - y_pred, 2) / 0.1 ELSE abs(y_true - y_pred) - 0.05 END)')} AS huber_loss FROM pr GROUP BY ALL")
def _(spark, folder):
    return rounded(metrics.huber_loss(regressed(spark, folder), ["fold"], 0.1))


@query("confusion_matrix", f"WITH {SCORED} SELECT y_true, y_pred, count(*) AS n FROM scored GROUP BY ALL")
def _(spark, folder):
    return metrics.confusion_matrix(bindings.scored(spark, folder))


@query("binary_metrics", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1)::DOUBLE AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0)::DOUBLE AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE AS tn FROM scored)
SELECT {near('(tp / (tp + fn) + tn / (tn + fp)) / 2')} AS balanced_accuracy, {near('2 * tp / (2 * tp + fp + fn)')} AS f1, {near('tp / (tp + fp)')} AS precision,
  {near('tp / (tp + fn)')} AS recall FROM c""")
def _(spark, folder):
    return rounded(metrics.binary_metrics(bindings.scored(spark, folder)))


@query("brier", f"WITH {SCORED} SELECT {near('avg(power(proba - y_true, 2))')} AS brier_score FROM scored")
def _(spark, folder):
    return rounded(metrics.brier(bindings.scored(spark, folder)))


@query("roc_auc", f"""WITH {SCORED}, r AS (SELECT y_true, rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2.0::DOUBLE AS rk FROM scored),
s AS (SELECT sum(rk) FILTER (y_true = 1) AS rs, count(*) FILTER (y_true = 1)::DOUBLE AS p, count(*) FILTER (y_true = 0)::DOUBLE AS q FROM r)
SELECT {near('(rs - p * (p + 1) / 2) / (p * q)')} AS auc, p AS positives FROM s""")
def _(spark, folder):
    return rounded(metrics.roc_auc(bindings.scored(spark, folder)))


@query("log_loss", f"WITH {SCORED} SELECT {near('avg(-CASE WHEN y_true = 1 THEN ln(proba) ELSE ln(1 - proba) END)')} AS log_loss FROM scored")
def _(spark, folder):
    return rounded(metrics.log_loss(bindings.scored(spark, folder)))


@query("evaluation_loss", f"""WITH {SCORED}, b AS (SELECT sample_id // 32 AS batch, avg(-CASE WHEN y_true = 1 THEN ln(proba) ELSE ln(1 - proba) END) AS l FROM scored GROUP BY ALL)
SELECT {near('avg(l)')} AS mean_loss FROM b""")
def _(spark, folder):
    rows = bindings.scored(spark, folder).selectExpr("*", "sample_id div 32 as batch")
    return rounded(metrics.batch_mean_loss(rows, "-if(y_true = 1, ln(proba), ln(1 - proba))"))


@query("predictions_wide", f"WITH {SCORED} SELECT sample_id, y_true, y_pred, {near('1 - proba')} AS p0, {near('proba')} AS p1 FROM scored")
def _(spark, folder):
    rows = bindings.scored(spark, folder).withColumn("proba", F.expr("array(1 - proba, proba)"))
    return rounded(records.predictions_wide(rows, 2))


MULTI = """mu AS (SELECT vec_id AS sample_id, label AS y_true, c, exp(4 * CAST(embedding[c + 1] AS DOUBLE)) AS e FROM embeddings, unnest(range(0, 10)) t(c)),
mp AS (SELECT sample_id, y_true, c, e / sum(e) OVER (PARTITION BY sample_id) AS p FROM mu),
ma AS (SELECT sample_id, any_value(y_true) AS y_true, CAST(arg_max(c, p) AS INTEGER) AS y_pred FROM mp GROUP BY ALL)"""


def multiclass(spark, folder):
    rows = bindings.samples(spark, folder).selectExpr("sample_id", "label as y_true", "transform(slice(embedding, 1, 10), v -> 4 * double(v)) as s")
    return rows.selectExpr("sample_id", "y_true", f"{scalar.softmax('s')} as proba").selectExpr("*", f"{scalar.argmax('proba')} as y_pred")


@query("multiclass_f1", f"""WITH {MULTI}, k AS (SELECT c, (SELECT count(*) FROM ma WHERE y_true = c) AS s, (SELECT count(*) FROM ma WHERE y_pred = c) AS q,
   (SELECT count(*) FROM ma WHERE y_true = c AND y_pred = c) AS h FROM unnest(range(0, 10)) t(c)),
f AS (SELECT s, 2.0::DOUBLE * h / (s + q) AS f1, h / s::DOUBLE AS rec FROM k WHERE s + q > 0)
SELECT {near('avg(rec) FILTER (s > 0)')} AS balanced_accuracy, {near('avg(f1)')} AS f1_macro, {near('sum(f1 * s) / sum(s)')} AS f1_weighted FROM f""")
def _(spark, folder):
    return rounded(metrics.multiclass_f1(multiclass(spark, folder)))


@query("class_scores", f"""WITH {MULTI}, k AS (SELECT c AS class, (SELECT count(*) FROM ma WHERE y_true = c) AS support, (SELECT count(*) FROM ma WHERE y_pred = c) AS predicted,
   (SELECT count(*) FROM ma WHERE y_true = c AND y_pred = c) AS hits FROM unnest(range(0, 10)) t(c))
SELECT CAST(class AS INTEGER) AS class, support, predicted, hits, {near('coalesce(hits / nullif(predicted, 0)::DOUBLE, 0)')} AS precision,
  {near('coalesce(hits / nullif(support, 0)::DOUBLE, 0)')} AS recall, {near('2.0::DOUBLE * hits / (support + predicted)')} AS f1 FROM k WHERE support + predicted > 0""")
def _(spark, folder):
    return rounded(metrics.class_scores(multiclass(spark, folder)))


@query("cross_entropy", f"WITH {MULTI} SELECT {near('avg(-ln(p))')} AS cross_entropy FROM mp WHERE c = y_true")
def _(spark, folder):
    return rounded(metrics.cross_entropy(multiclass(spark, folder)))


OVR = MULTI + """, rr AS (SELECT c, y_true = c AS pos, rank() OVER (PARTITION BY c ORDER BY p) + (count(*) OVER (PARTITION BY c, p) - 1) / 2.0::DOUBLE AS rk FROM mp),
au AS (SELECT c, sum(rk) FILTER (pos) AS rs, count(*) FILTER (pos)::DOUBLE AS p, count(*) FILTER (NOT pos)::DOUBLE AS q FROM rr GROUP BY ALL)"""


@query("roc_auc_ovr", f"WITH {OVR} SELECT {near('avg((rs - p * (p + 1) / 2) / (p * q))')} AS auc_macro FROM au")
def _(spark, folder):
    return rounded(metrics.roc_auc_ovr(multiclass(spark, folder)))


@query("roc_auc_ovr_weighted", f"WITH {OVR} SELECT {near('sum((rs - p * (p + 1) / 2) / (p * q) * p) / sum(p)')} AS auc_macro FROM au")
def _(spark, folder):
    return rounded(metrics.roc_auc_ovr(multiclass(spark, folder), weighted=True))


# ------------------------------------------------------------------ roll-ups
DOCS = """concat('{', if(event_id % 10 = 0, '', concat('"model":"', if(event_id % 3 = 0, 'bank', 'forest'), '",')), '"metrics":{"', event_type, '":',
  if(event_id % 17 = 0, 'null', string(value)), ',"confusion_matrix":[[1,2],[3,4]],"auc":', (event_id % 100) / 100D, '},"runtime_seconds":', event_id % 60, '}')"""
SCAN = """sc AS (SELECT CAST(user_id AS INTEGER) AS fold, event_type AS metric, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_id % 10 = 0 OR event_id % 3 <> 0
  UNION ALL SELECT CAST(user_id AS INTEGER), 'auc', (event_id % 100) / 100.0::DOUBLE FROM events WHERE event_id % 10 = 0 OR event_id % 3 <> 0)"""


def scanned(spark, folder):
    docs = table(spark, folder, "events").selectExpr("concat('results/task/forest/fold_', user_id, '/metrics.json') as path", f"{DOCS} as doc")
    return records.read_fold_metrics(docs, "forest")


@query("fold_metrics_scan", f"WITH {SCAN} SELECT fold, metric, value FROM sc")
def _(spark, folder):
    return scanned(spark, folder)


@query("fold_summary", f"""WITH {SCAN} SELECT metric, {near('avg(value)')} AS mean, {near('stddev_pop(value)')} AS std, min(value) AS min, max(value) AS max, count(*) AS n_folds
FROM sc WHERE value IS NOT NULL GROUP BY ALL""")
def _(spark, folder):
    out = rollup.fold_summary(scanned(spark, folder))
    return rounded(out)


# Weights of event types per user; a type with a share below 0.15 counts as a label the fold lacks.
ATT = """tot AS (SELECT user_id, sum(value) AS t FROM events GROUP BY ALL),
aw AS (SELECT user_id, event_type AS label, sum(value / t) AS weight FROM events JOIN tot USING (user_id) GROUP BY ALL),
am AS (SELECT label, sum(weight) / (SELECT count(DISTINCT user_id) FROM events) AS weight FROM aw WHERE weight >= 0.15 GROUP BY ALL)"""


def attention(spark, folder):
    events = table(spark, folder, "events")
    raw = events.groupBy(F.col("user_id").alias("fold"), F.col("event_type").alias("label")).agg(F.sum("value").alias("v"))
    total = raw.groupBy("fold").agg(F.sum("v").alias("t"))
    folds = events.agg(F.countDistinct("user_id").alias("n_folds"))
    return rollup.attention_mean(raw.join(total, "fold").selectExpr("label", "v / t as weight").where("weight >= 0.15D"), folds)


@query("attention_mean", f"WITH {ATT} SELECT label, {near('weight')} AS weight FROM am")
def _(spark, folder):
    return rounded(attention(spark, folder))


REPORT = f"""{SCAN}, fsum AS (SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi FROM sc WHERE value IS NOT NULL GROUP BY ALL),
{ATT}"""


@query("report_lines", f"""WITH {REPORT} SELECT 'metric' AS section, metric AS name, printf('| %s | %.4f | %.4f | %.4f | %.4f |', metric, mean, std, lo, hi) AS line FROM fsum
UNION ALL SELECT 'attention', label, printf('- Label %s: %.3f `%s`', label, weight, repeat('#', CAST(round_even(weight * 20, 0) AS INTEGER))) FROM am""")
def _(spark, folder):
    return rollup.report_lines(rollup.fold_summary(scanned(spark, folder)), attention(spark, folder))


@query("union_results", """WITH n AS (SELECT DISTINCT 't' || event_type AS task, CAST(user_id AS INTEGER) AS fold, 'auc' AS metric, 1.0::DOUBLE AS value FROM events WHERE user_id % 3 = 0),
o AS (SELECT DISTINCT 't' || event_type AS task, CAST(user_id AS INTEGER) AS fold, 'auc' AS metric, 2.0::DOUBLE AS value FROM events WHERE user_id % 2 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.task = o.task AND n.fold = o.fold)""")
def _(spark, folder):
    rows = table(spark, folder, "events").selectExpr("concat('t', event_type) as task", "int(user_id) as fold", "'auc' as metric").distinct()
    return rollup.union_results(rows.where("fold % 3 = 0").selectExpr("*", "1D as value"), rows.where("fold % 2 = 0").selectExpr("*", "2D as value"))


@query("best_epoch", f"WITH {EPOCHS} SELECT fold, min(epoch) AS best_epoch, any_value(val_loss) AS best_score FROM (SELECT *, max(val_loss) OVER (PARTITION BY fold) AS m FROM epochs) WHERE val_loss = m GROUP BY fold")
def _(spark, folder):
    return rollup.best_epoch(bindings.epochs(spark, folder).withColumnRenamed("val_loss", "score"))


@query("early_stop_epoch", f"""WITH {EPOCHS}, m AS (SELECT *, min(val_loss) OVER (PARTITION BY fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM epochs),
g AS (SELECT *, max(CASE WHEN low IS NULL OR val_loss < low THEN epoch END) OVER (PARTITION BY fold ORDER BY epoch) AS last FROM m)
SELECT fold, min(epoch) FILTER (epoch >= 10 AND epoch - last >= 8) AS stop_epoch FROM g GROUP BY ALL""")
def _(spark, folder):
    return rollup.early_stop(bindings.epochs(spark, folder), 10, 8)


@query("ensemble_vote", f"""WITH v AS (SELECT vec_id // 4 AS sample_id, CAST(floor((CAST(embedding[1] AS DOUBLE) + 1) * 2.5) AS INTEGER) AS y_pred,
  1 / (1 + exp(-CAST(embedding[2] AS DOUBLE))) AS p FROM embeddings)
SELECT sample_id, CAST(round_even(avg(y_pred), 0) AS INTEGER) AS y_pred, count(*) AS n_folds, {near('avg(1 - p)')} AS p0, {near('avg(p)')} AS p1 FROM v GROUP BY ALL""")
def _(spark, folder):
    p = scalar.sigmoid("double(embedding[1])")
    rows = bindings.samples(spark, folder).selectExpr(
        "sample_id div 4 as sample_id", "int(floor((double(embedding[0]) + 1) * 2.5D)) as y_pred", f"array(1 - {p}, {p}) as proba"
    )
    out = rollup.ensemble_vote(rows)
    return rounded(out.selectExpr("sample_id", "y_pred", "n_folds", "proba[0] as p0", "proba[1] as p1"))


# ------------------------------------------------------------------ reports and correlation files of jobs
def scanned_times(spark, folder):
    docs = table(spark, folder, "events").selectExpr("concat('results/task/forest/fold_', user_id, '/metrics.json') as path", f"{DOCS} as doc")
    return records.read_fold_times(docs, "forest")


@query("fold_times", """SELECT CAST(user_id AS INTEGER) AS fold, CAST(sum(event_id % 60) AS DOUBLE) AS seconds FROM events
WHERE event_id % 10 = 0 OR event_id % 3 <> 0 GROUP BY ALL""")
def _(spark, folder):
    return scanned_times(spark, folder).groupBy("fold").agg(F.sum("seconds").alias("seconds"))


HEAD_LINES = ["'# Report: task'", "''", "'- Model: `forest`'", "'- Folds: ' || n", "printf('- Runtime (s): %.2f', t)", "''", "'## Metrics Summary'", "''",
              "'| Metric | Mean | Std | Min | Max |'", "'|---|---:|---:|---:|---:|'"]
HEAD_SQL = " UNION ALL ".join(f"SELECT {k} AS part, '' AS name, {line} AS line FROM hd" for k, line in enumerate(HEAD_LINES))


@query("report_document", f"""WITH {REPORT}, hd AS (SELECT (SELECT count(DISTINCT fold) FROM sc) AS n,
  (SELECT CAST(sum(event_id % 60) AS DOUBLE) FROM events WHERE event_id % 10 = 0 OR event_id % 3 <> 0) AS t)
{HEAD_SQL}
UNION ALL SELECT 10, metric, printf('| %s | %.4f | %.4f | %.4f | %.4f |', metric, mean, std, lo, hi) FROM fsum
UNION ALL SELECT 11, '', '' UNION ALL SELECT 12, '', '## Mean Attention Weights' UNION ALL SELECT 13, '', ''
UNION ALL SELECT 14, label, printf('- Label %s: %.3f `%s`', label, weight, repeat('#', CAST(round_even(weight * 20, 0) AS INTEGER))) FROM am""")
def _(spark, folder):
    return rollup.report_document("task", "forest", scanned(spark, folder), scanned_times(spark, folder), attention(spark, folder))


@query("intercorrelation_summary", f"""WITH {WIDE}, vary AS (SELECT feature FROM wide GROUP BY feature HAVING count(DISTINCT value) > 1),
f2 AS (SELECT sample_id, feature, coalesce(value, m) AS value FROM wide JOIN vary USING (feature) JOIN (SELECT feature, median(value) AS m FROM wide GROUP BY ALL) USING (feature)),
rk AS (SELECT sample_id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk FROM f2),
sp AS (SELECT corr(p.rk, q.rk) AS r FROM rk p JOIN rk q ON p.sample_id = q.sample_id AND p.feature < q.feature GROUP BY p.feature, q.feature)
SELECT (SELECT count(DISTINCT sample_id) FROM wide) AS n_samples, (SELECT count(*) FROM vary) AS n_features, 0.9::DOUBLE AS corr_threshold,
  (SELECT count(*) FROM sp WHERE abs(r) > 0.9) AS n_high_corr_pairs""")
def _(spark, folder):
    from voxelframe.plans import jobs

    return jobs.intercorrelation(cut_lineage(wide(spark, folder).select("sample_id", "feature", "value")), new_folder(spark, "correlation"), 0.9)
