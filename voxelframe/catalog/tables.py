"""Scans, scalar rules, joins, set operations and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.catalog.base import CASES, MAT, REG, RFEAT, RTAB, RTARGET, VOX, near, query, rounded
from voxelframe.functions import scalar
from voxelframe.functions.ranking import percentiles
from voxelframe.operators import matrix, splits
from voxelframe.session import new_folder
from voxelframe.sources import bindings, dictionary, records
from voxelframe.sources.bindings import REGION, table


# ------------------------------------------------------------------ dictionaries and targets
@query("label_dim", """WITH s AS (SELECT s_nationkey AS dataset, CAST(s_suppkey AS INTEGER) AS label_id,
   CASE WHEN s_suppkey % 13 = 5 THEN 'Background' ELSE s_name END AS label_name FROM supplier),
b AS (SELECT dataset, coalesce(min(label_id) FILTER (label_name = 'Background'), min(label_id) FILTER (label_id = 0), -1) AS background_id
  FROM s GROUP BY ALL)
SELECT CAST(dataset AS VARCHAR) AS dataset, CASE WHEN dataset % 2 = 0 THEN 'CT' ELSE 'MR' END AS modality, background_id, label_id, label_name
FROM s JOIN b USING (dataset) WHERE label_id <> background_id AND dataset % 7 <> 3""")
def _(spark, folder):
    named = table(spark, folder, "supplier").selectExpr(
        "s_nationkey as dataset", "s_suppkey as id", "if(s_suppkey % 13 = 5, 'Background', s_name) as name"
    )
    # Datasets with id -> name and name -> id dictionaries, both ways to name the modality, and one unknown modality.
    docs = named.groupBy("dataset").agg(F.expr("array_sort(collect_list(struct(id, name))) as e"), F.expr("bool_or(name = 'Background') as has")).selectExpr(
        "string(dataset) as dataset",
        """concat('{', if(dataset % 7 = 3, '"modality":{"0":"PET"}', if(dataset % 2 = 0, '"channel_names":{"0":"ct"}', '"modality":{"0":"mri"}')),
           ',"labels":{', array_join(transform(e, c -> if(dataset % 3 = 0 and not has,
              concat('"', c.name, '":', c.id), concat('"', c.id, '":"', c.name, '"'))), ','), '}}') as doc""",
    )
    return dictionary.label_dim(docs)


SPECS = """specs AS (SELECT p_brand AS dataset, 't' || p_partkey AS target, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position,
  CASE p_size % 4 WHEN 0 THEN 'classification' WHEN 1 THEN 'regression' WHEN 2 THEN 'classification' ELSE 'survival' END AS type,
  CASE p_partkey % 5 WHEN 0 THEN 'per_label' WHEN 1 THEN 'per_case' WHEN 2 THEN 'per_case' WHEN 3 THEN 'per_label' ELSE 'per_scan' END AS scope,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 6 END AS num_classes,
  list_sort(list_distinct(CASE WHEN p_partkey % 8 = 0 THEN CAST([] AS INTEGER[]) ELSE [CAST(p_partkey % 4 AS INTEGER), p_size % 5, CAST(p_partkey % 4 AS INTEGER)] END)) AS labels
  FROM part)"""


def spec_docs(spark, folder):
    parts = table(spark, folder, "part").selectExpr(
        "p_brand as dataset", "p_partkey",
        """concat('"t', p_partkey, '":{"type":"', element_at(array('classification','regression','classification','survival'), int(p_size % 4) + 1),
           '","scope":"', element_at(array('per_label','per_case','per_case','per_label','per_scan'), int(p_partkey % 5) + 1), '"',
           if(p_size % 3 = 0, '', concat(',"num_classes":', p_size % 6)),
           if(p_partkey % 8 = 0, '', concat(',"applicable_labels":[', p_partkey % 4, ',', p_size % 5, ',', p_partkey % 4, ']')), '}') as entry""",
    )
    return parts.groupBy("dataset").agg(F.expr("concat('{', array_join(transform(array_sort(collect_list(struct(p_partkey, entry))), c -> c.entry), ','), '}') as doc"))


@query("target_spec_violations", f"""WITH {SPECS}, v AS (SELECT dataset, target, unnest([
  CASE WHEN type NOT IN ('classification', 'regression') THEN 'unknown_type' END,
  CASE WHEN scope NOT IN ('per_label', 'per_case') THEN 'unknown_scope' END,
  CASE WHEN type = 'classification' AND coalesce(num_classes, 0) < 2 THEN 'classes_required' END,
  CASE WHEN type = 'regression' AND num_classes IS NOT NULL THEN 'classes_not_allowed' END,
  CASE WHEN scope = 'per_label' AND len(labels) = 0 THEN 'labels_required' END,
  CASE WHEN len(list_filter(labels, lambda x: x > 3)) > 0 THEN 'unknown_labels' END]) AS violation FROM specs)
SELECT * FROM v WHERE violation IS NOT NULL""")
def _(spark, folder):
    specs = dictionary.target_specs(spec_docs(spark, folder))
    known = specs.select("dataset").distinct().selectExpr("dataset", "array(0, 1, 2, 3) as labels")
    return dictionary.target_violations(specs, known)


@query("unknown_labels", f"WITH {SPECS} SELECT dataset, target, unnest(list_filter(labels, lambda x: x > 3)) AS label_id FROM specs")
def _(spark, folder):
    specs = dictionary.target_specs(spec_docs(spark, folder))
    return specs.selectExpr("dataset", "target", "explode(array_except(applicable_labels, array(0, 1, 2, 3))) as label_id")


@query("distinct_sorted", f"WITH {SPECS} SELECT dataset, target, array_to_string(labels, ',') AS labels FROM specs")
def _(spark, folder):
    specs = dictionary.target_specs(spec_docs(spark, folder))
    return specs.selectExpr("dataset", "target", "array_join(transform(applicable_labels, l -> string(l)), ',') as labels")


@query("pick_target", f"""WITH {SPECS}, r AS (SELECT *, CASE WHEN type = 'classification' AND scope = 'per_case' THEN 0
   WHEN type = 'classification' THEN 1 WHEN type = 'regression' THEN 2 END AS pri FROM specs)
SELECT dataset, target FROM r WHERE pri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY pri, position) = 1""")
def _(spark, folder):
    specs = dictionary.target_specs(spec_docs(spark, folder))
    return splits.pick_target(specs.selectExpr("*", "int(substr(target, 2)) as position"))


CASE_DOC = """concat('{"k":', if(event_id % 9 = 0, '"n/a"', get_json_object(props, '$.k')), ',"junk":1,"grade":{"1":', event_id % 3,
  ',"2":"x","3":', event_id % 2, ',"9":1}', if(event_id % 4 = 0, concat(',"targets":{"k":', if(event_id % 8 = 0, 'null', '7'), '}'), ''), '}')"""
LOGK = "logk AS (SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)"


@query("targets_long", f"""WITH {LOGK}
SELECT event_id AS case_id, 'k' AS target, CAST(NULL AS INTEGER) AS label_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE k END AS value FROM logk
UNION ALL SELECT event_id, 'grade', 1, CAST(event_id % 3 AS DOUBLE) FROM logk
UNION ALL SELECT event_id, 'grade', 2, NULL FROM logk""")
def _(spark, folder):
    docs = table(spark, folder, "events").selectExpr("event_id as case_id", f"{CASE_DOC} as doc")
    specs = spark.sql("select inline(array(named_struct('target', 'k', 'scope', 'per_case', 'applicable_labels', array(1)), named_struct('target', 'grade', 'scope', 'per_label', 'applicable_labels', array(1, 2))))")
    return dictionary.case_targets(docs, specs)


@query("nested_lookup", f"""WITH {LOGK} SELECT event_id AS case_id, CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 4 = 0 THEN '7'
  WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(CAST(k AS INTEGER) AS VARCHAR) END AS value FROM logk""")
def _(spark, folder):
    docs = table(spark, folder, "events").selectExpr("event_id as case_id", f"{CASE_DOC} as doc")
    return docs.selectExpr("case_id", f"{dictionary.nested_lookup('doc', 'k')} as value")


# ------------------------------------------------------------------ scalar rules
@query("coerce_float", f"""WITH {LOGK} SELECT event_id, CASE WHEN event_id % 5 < 3 THEN NULL ELSE k END AS value FROM logk""")
def _(spark, folder):
    text = "case event_id % 5 when 0 then 'n/a' when 1 then 'NaN' when 2 then 'Infinity' else get_json_object(props, '$.k') end"
    return table(spark, folder, "events").selectExpr("event_id", f"{text} as raw").selectExpr("event_id", f"{scalar.coerce_float('raw')} as value")


@query("sanitize_values", f"WITH {MAT} SELECT sample_id, feature, CASE WHEN value > 0.25 OR value < -0.25 THEN NULL ELSE value END AS value FROM mat")
def _(spark, folder):
    rows = bindings.features(spark, folder).selectExpr(
        "sample_id", "feature", "if(value > 0.25D, double('inf'), if(value < -0.25D, double('nan'), value)) as raw"
    )
    return rows.selectExpr("sample_id", "feature", f"{scalar.finite('raw')} as value")


@query("drop_prefix", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'diagnostics_' ELSE 'original_' END || s_name AS feature FROM supplier WHERE s_suppkey % 4 <> 0")
def _(spark, folder):
    rows = table(spark, folder, "supplier").selectExpr("s_suppkey", "concat(if(s_suppkey % 4 = 0, 'diagnostics_', 'original_'), s_name) as feature")
    return rows.where("not startswith(feature, 'diagnostics_')")


KEYED = f"""{RTAB}, keyed AS (SELECT case_id, label_id, printf('case%d_label%03d', case_id, label_id) ||
  CASE WHEN case_id % 3 = 0 THEN printf('_aug%03d', case_id % 5) ELSE '' END AS key FROM rtab)"""


def keyed(spark, folder):
    plain, varied = scalar.region_key("concat('case', case_id)", "label_id"), scalar.region_key("concat('case', case_id)", "label_id", "case_id % 5")
    return bindings.region_table(spark, folder).selectExpr(*REGION, f"if(case_id % 3 = 0, {varied}, {plain}) as key")


@query("build_region_key", f"WITH {KEYED} SELECT case_id, label_id, key FROM keyed")
def _(spark, folder):
    return keyed(spark, folder)


@query("parse_region_key", f"""WITH {KEYED} SELECT key, CASE WHEN case_id % 10 > 0 THEN 'case' || case_id END AS case_part,
  CASE WHEN case_id % 10 > 0 THEN label_id END AS label_part, CASE WHEN case_id % 10 > 0 AND case_id % 3 = 0 THEN CAST(case_id % 5 AS INTEGER) END AS variant_part
FROM (SELECT case_id, label_id, CASE WHEN case_id % 10 = 0 THEN replace(key, '_label', '-') ELSE key END AS key FROM keyed)""")
def _(spark, folder):
    rows = keyed(spark, folder).selectExpr("if(case_id % 10 = 0, replace(key, '_label', '-'), key) as key")
    return rows.selectExpr("key", *[f"{e} as {n}" for n, e in scalar.parse_region_key("key").items()])


@query("case_of_sample", f"WITH {RTAB} SELECT case_id || '__label' || label_id AS sample_id, CAST(case_id AS VARCHAR) AS case_name FROM rtab")
def _(spark, folder):
    rows = bindings.region_table(spark, folder).selectExpr(f"{scalar.sample_id('case_id', 'label_id')} as sample_id")
    return rows.selectExpr("sample_id", f"{scalar.case_of_sample('sample_id')} as case_name")


@query("filter_labels", f"WITH {RTAB} SELECT case_id, label_id FROM rtab WHERE label_id IN (2, 3, 5)")
def _(spark, folder):
    # The task lists labels 2, 3, 5; the schema's own list is used only when the task names none.
    resolved = "coalesce(array(2, 3, 5), array(1, 2, 3))"
    return bindings.region_table(spark, folder).select(*REGION).where(f"array_contains({resolved}, label_id)")


@query("drop_missing_target", f"WITH {CASES} SELECT case_id, CAST(source_level AS INTEGER) AS y FROM cases WHERE source_level IS NOT NULL")
def _(spark, folder):
    return bindings.cases(spark, folder).where("source_level is not null").selectExpr("case_id", "int(source_level) as y")


@query("config_hash", """SELECT p_partkey, substr(sha256('{"bin_width":' || p_size || ',"image_types":["Original"],"modality":"CT"}'), 1, 8) AS config_hash FROM part""")
def _(spark, folder):
    text = """concat('{"bin_width":', p_size, ',"image_types":["Original"],"modality":"CT"}')"""
    return table(spark, folder, "part").selectExpr("p_partkey", f"{scalar.config_hash(text)} as config_hash")


@query("variant_seed", "SELECT vec_id, v AS variant, substr(sha256('case' || vec_id || ':' || v || ':42'), 1, 16) AS seed FROM embeddings, unnest([0, 1, 2]) t(v)")
def _(spark, folder):
    rows = table(spark, folder, "embeddings").selectExpr("vec_id", "explode(array(0, 1, 2)) as variant")
    return rows.selectExpr("vec_id", "variant", f"{scalar.variant_seed('concat(' + repr('case') + ', vec_id)', 'variant', '42')} as seed")


@query("logits_to_class", f"""WITH s AS (SELECT vec_id AS sample_id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2 FROM embeddings),
x AS (SELECT *, exp(e0) + exp(e1) + exp(e2) AS t FROM s)
SELECT sample_id, {near('1 / (1 + exp(-e0))')} AS proba, CAST(1 / (1 + exp(-e0)) >= 0.5 AS INTEGER) AS binary_class,
  CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS multi_class, {near('exp(e2) / t')} AS p2 FROM x""")
def _(spark, folder):
    rows = bindings.samples(spark, folder).selectExpr("sample_id", "transform(slice(embedding, 1, 3), v -> double(v)) as s")
    rows = rows.selectExpr("sample_id", "s", f"{scalar.softmax('s')} as p", f"{scalar.sigmoid('s[0]')} as proba")
    return rounded(rows.selectExpr("sample_id", "proba", "int(proba >= 0.5D) as binary_class", f"{scalar.argmax('p')} as multi_class", "p[2] as p2"))


# ------------------------------------------------------------------ feature records
REC = f"""{RFEAT}, rec AS (SELECT case_id, label_id, feature, value, CASE WHEN (case_id + label_id) % 3 > 0 THEN 'aaaa0001' ELSE 'old00000' END AS config_hash FROM rfeat)"""


def feature_records(spark, folder):
    rows = bindings.region_features(spark, folder)
    return rows.withColumn("config_hash", F.expr("if((case_id + label_id) % 3 > 0, 'aaaa0001', 'old00000')"))


@query("features_current", f"WITH {REC} SELECT case_id, label_id, feature, {near('value', 4)} AS value FROM rec WHERE config_hash = 'aaaa0001'")
def _(spark, folder):
    target = new_folder(spark, "features")
    records.write_features(feature_records(spark, folder), target)
    return rounded(records.read_features(spark, target, "aaaa0001"), 4)


@query("feature_table", f"""WITH {RTAB} SELECT case_id, label_id, unnest(['discount', 'tax', 'note']) AS feature,
  unnest([CASE WHEN label_id = 2 THEN NULL ELSE discount END, tax, NULL]) AS value FROM rtab WHERE label_id <> 4""")
def _(spark, folder):
    # Stored documents: label 4 is not an object, discount of label 2 is text, and one value is never a number.
    doc = """if(label_id = 4, '[1, 2]', concat('{"config_hash":"x","features":{"discount":', if(label_id = 2, '"bad"', string(discount)),
             ',"tax":', tax, ',"note":"n/a"}}'))"""
    return records.parse_records(bindings.region_table(spark, folder).selectExpr(*REGION, f"{doc} as doc"))


@query("feature_universe", f"WITH {RFEAT} SELECT DISTINCT 'label' || label_id || '_' || feature AS feature FROM rfeat")
def _(spark, folder):
    rows = bindings.region_features(spark, folder).selectExpr("concat('label', label_id, '_', feature) as feature")
    return rows.distinct().orderBy("feature")


# ------------------------------------------------------------------ joins
@query("matrix_per_label", f"""WITH {RFEAT}, t AS (SELECT case_id, label_id, CASE WHEN case_id % 7 = 0 AND label_id = 1 THEN NULL ELSE CAST(flag AS DOUBLE) END AS y FROM rtab)
SELECT case_id || '__label' || label_id AS sample_id, case_id, label_id, feature, {near('value', 4)} AS value, y FROM rfeat JOIN t USING (case_id, label_id) WHERE y IS NOT NULL""")
def _(spark, folder):
    return rounded(matrix.matrix_per_label(bindings.region_features(spark, folder), bindings.region_targets(spark, folder)), 4)


MEASURES = ("discount", "price", "quantity", "tax")
PIVOT = ", ".join(f"{near(f'''max(CASE WHEN label_id = {k} THEN {n} END)''', 4)} AS label{k:03d}_{n}" for k in range(1, 8) for n in MEASURES)


@query("matrix_per_case", f"""WITH {RTAB}, {CASES}, p AS (SELECT case_id, {PIVOT} FROM rtab GROUP BY ALL)
SELECT p.*, source_level AS y FROM p JOIN cases USING (case_id) WHERE source_level IS NOT NULL""")
def _(spark, folder):
    target = bindings.cases(spark, folder).selectExpr("case_id", "source_level as value")
    return rounded(matrix.matrix_per_case(bindings.region_features(spark, folder), target, list(range(1, 8)), list(MEASURES)), 4)


PLAIN_HOLD = f"""{CASES}, hp AS (SELECT case_id, row_number() OVER (ORDER BY md5('42:' || case_id), case_id) - 1 AS pos, count(*) OVER () AS n FROM cases),
hold AS (SELECT case_id, CASE WHEN pos < greatest(1, least(n - 1, round_even(n * 0.2::DOUBLE, 0))) THEN 'holdout' ELSE 'train' END AS split FROM hp)"""


@query("matrix_test", f"""WITH {RFEAT}, {PLAIN_HOLD}
SELECT case_id || '__label' || label_id AS sample_id, f.case_id, f.label_id, f.feature, {near('f.value', 4)} AS value, CAST(t.flag AS DOUBLE) AS y
FROM rfeat f JOIN rtab t USING (case_id, label_id) JOIN hold USING (case_id) WHERE split = 'holdout' AND NOT (case_id % 7 = 0 AND label_id = 1)""")
def _(spark, folder):
    held = splits.holdout(bindings.cases(spark, folder), 0.2, 42)
    return rounded(matrix.matrix_test(bindings.region_features(spark, folder), bindings.region_targets(spark, folder), held), 4)


PLAIN_FOLD = "fd AS (SELECT case_id, CAST((row_number() OVER (ORDER BY md5('42:' || case_id), case_id) - 1) % 5 AS INTEGER) AS fold FROM cases)"


@query("fold_train_val", f"""WITH {CASES}, {PLAIN_FOLD}
SELECT case_id, CAST(k AS INTEGER) AS fold, CASE WHEN k = fd.fold THEN 'val' ELSE 'train' END AS role FROM fd, unnest([0, 1, 2, 3, 4]) t(k)""")
def _(spark, folder):
    cases = bindings.cases(spark, folder).select("case_id")
    return matrix.fold_roles(cases, splits.kfold(cases), 5)


@query("pending_regions", f"WITH {RTAB} SELECT case_id, label_id FROM rtab WHERE (case_id + label_id) % 3 = 0")
def _(spark, folder):
    rows = feature_records(spark, folder).where("feature = 'tax'").select(*REGION, "config_hash")
    return matrix.pending_regions(bindings.region_table(spark, folder).select(*REGION), rows, "aaaa0001")


@query("pending_variants", f"""WITH {REG}, c AS (SELECT DISTINCT case_id, label_id FROM reg)
SELECT case_id, label_id, v AS variant FROM c, unnest([0, 1, 2, 3]) t(v) WHERE NOT ((case_id + label_id + v) % 2 = 0 AND v < 3)""")
def _(spark, folder):
    crops = bindings.regions(spark, folder).select(*REGION).distinct()
    maps = crops.selectExpr("*", "explode(array(0, 1, 2)) as variant").where("(case_id + label_id + variant) % 2 = 0")
    return matrix.pending_variants(crops, maps, 3)


@query("cache_integrity", f"""WITH {RTAB} SELECT case_id, label_id, 'missing' AS state FROM rtab WHERE case_id % 4 = 0 AND label_id < 6
UNION ALL SELECT case_id, label_id, 'stale' FROM rtab WHERE label_id >= 6 AND case_id % 4 <> 0""")
def _(spark, folder):
    rows = bindings.region_table(spark, folder).select(*REGION)
    return matrix.cache_integrity(rows.where("label_id < 6"), rows.where("case_id % 4 <> 0"))


@query("enumerate_samples", f"""WITH {RTARGET}, {CASES}, maps AS (SELECT case_id, label_id FROM rtab WHERE (case_id + label_id) % 4 > 0)
SELECT 'per_label' AS scope, case_id, label_id, value FROM rtarget JOIN maps USING (case_id, label_id) WHERE value IS NOT NULL
UNION ALL SELECT 'per_case', case_id, NULL, source_level FROM cases WHERE source_level IS NOT NULL AND case_id IN (SELECT case_id FROM maps)""")
def _(spark, folder):
    maps = bindings.region_table(spark, folder).select(*REGION).where("(case_id + label_id) % 4 > 0")
    per_label = matrix.enumerate_samples(bindings.region_targets(spark, folder), maps, "per_label").selectExpr("'per_label' as scope", "*")
    target = bindings.cases(spark, folder).selectExpr("case_id", "source_level as value")
    per_case = matrix.enumerate_samples(target, maps, "per_case").selectExpr("'per_case' as scope", "case_id", "cast(null as int) as label_id", "value")
    return per_label.unionByName(per_case)


@query("label_slots", f"""WITH {RTAB}, {CASES} SELECT c.case_id, k AS label_id, t.discount IS NOT NULL AS present, coalesce(t.discount, 0) AS value
FROM cases c CROSS JOIN unnest([1, 2, 3]) l(k) LEFT JOIN rtab t ON t.case_id = c.case_id AND t.label_id = k""")
def _(spark, folder):
    maps = bindings.region_table(spark, folder).selectExpr(*REGION, "discount as value")
    return matrix.label_slots(bindings.cases(spark, folder), maps, [1, 2, 3])


# ------------------------------------------------------------------ splits
@query("class_shift", f"WITH {CASES} SELECT CASE WHEN min(CAST(source_level AS INTEGER)) >= 1 AND max(CAST(source_level AS INTEGER)) = 5 THEN 1 ELSE 0 END AS shift FROM cases")
def _(spark, folder):
    return splits.class_shift(bindings.cases(spark, folder).selectExpr("source_level as value"), 5)


@query("canonical_class", f"WITH {CASES} SELECT case_id, CASE WHEN case_id % 50 = 1 THEN 9 ELSE source_level - 1 END AS value FROM cases WHERE source_level IS NOT NULL")
def _(spark, folder):
    known = bindings.cases(spark, folder).where("source_level is not null").selectExpr("case_id", "source_level as value")
    shift = splits.class_shift(known, 5)
    odd = known.selectExpr("case_id", "if(case_id % 50 = 1, 9D, value) as value")
    return splits.canonical_class(odd, shift, 5)


@query("strat_value", f"""WITH {RTARGET}, {CASES}, a AS (SELECT case_id, max(CAST(value > 0.5 AS INTEGER)) AS hit, avg(value) AS mean FROM rtarget WHERE value IS NOT NULL GROUP BY ALL)
SELECT case_id, CAST(coalesce(hit, 0) AS DOUBLE) AS binary_value, {near('coalesce(mean, -1)')} AS mean_value FROM cases LEFT JOIN a USING (case_id)""")
def _(spark, folder):
    targets, cases = bindings.region_targets(spark, folder), bindings.cases(spark, folder)
    hit = splits.strat_value(targets, cases, True).withColumnRenamed("value", "binary_value")
    return rounded(hit.join(splits.strat_value(targets, cases, False).withColumnRenamed("value", "mean_value"), "case_id"))


QUART = """qt AS (SELECT quantile_cont(age, 0.25) AS q25, quantile_cont(age, 0.5) AS q50, quantile_cont(age, 0.75) AS q75 FROM cases),
qb AS (SELECT case_id, age, CAST(age > q25 AS INTEGER) + CAST(age > q50 AS INTEGER) + CAST(age > q75 AS INTEGER) AS stratum FROM cases, qt)"""


@query("quartile_bin", f"WITH {CASES}, {QUART} SELECT * FROM qb")
def _(spark, folder):
    return splits.quartile_bin(bindings.cases(spark, folder).select("case_id", "age"), "age")


@query("kfold_plain", f"WITH {CASES}, {PLAIN_FOLD} SELECT case_id, fold FROM fd")
def _(spark, folder):
    return splits.kfold(bindings.cases(spark, folder))


STRAT_FOLD = """st AS (SELECT case_id, coalesce(CAST(source_level AS INTEGER), -1) AS s FROM cases),
sc AS (SELECT s, sum(count(*)) OVER (ORDER BY s) - count(*) AS start FROM st GROUP BY s),
sf AS (SELECT case_id, CAST((row_number() OVER (PARTITION BY s ORDER BY md5('42:' || case_id), case_id) - 1 + start) % 5 AS INTEGER) AS fold FROM st JOIN sc USING (s))"""


@query("kfold_stratified", f"WITH {CASES}, {STRAT_FOLD} SELECT case_id, fold FROM sf")
def _(spark, folder):
    cases = bindings.cases(spark, folder).selectExpr("case_id", "coalesce(int(source_level), -1) as stratum")
    return splits.kfold(cases, stratum="stratum")


@query("folds", f"WITH {CASES}, {STRAT_FOLD} SELECT case_id, fold FROM sf")
def _(spark, folder):
    cases = bindings.cases(spark, folder).selectExpr("case_id", "coalesce(int(source_level), -1) as stratum")
    prepared, results = new_folder(spark, "folds"), new_folder(spark, "folds-results")
    splits.kfold(cases, stratum="stratum").write.mode("overwrite").parquet(prepared)
    return records.read_folds(spark, results, prepared)


HOLD = """ht AS (SELECT stratum, count(*) AS n FROM qb GROUP BY ALL),
hs AS (SELECT stratum, n, sum(n) OVER () AS t, CAST(greatest(1, least(sum(n) OVER () - 1, round_even(sum(n) OVER () * 0.2::DOUBLE, 0))) AS BIGINT) AS w FROM ht),
hq AS (SELECT stratum, (w * n) // t AS base, (w * n) % t AS rest, w FROM hs),
hr AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= w - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM hq)"""


@query("holdout_split", f"""WITH {CASES}, {QUART}, {HOLD}, hp AS (SELECT case_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || case_id), case_id) - 1 AS pos FROM qb)
SELECT case_id, CASE WHEN pos < quota THEN 'holdout' ELSE 'train' END AS split FROM hp JOIN hr USING (stratum)""")
def _(spark, folder):
    cases = splits.quartile_bin(bindings.cases(spark, folder).select("case_id", "age"), "age")
    return splits.holdout(cases, 0.2, 42, "stratum")


@query("holdout_plain", f"WITH {PLAIN_HOLD} SELECT case_id, split FROM hold")
def _(spark, folder):
    return splits.holdout(bindings.cases(spark, folder), 0.2, 42)


@query("holdout_audit", f"""WITH {PLAIN_HOLD}, e AS (SELECT case_id, g FROM hold, unnest(['images', 'labels', 'targets']) t(g) WHERE split = 'holdout')
SELECT g AS file_group, CASE WHEN case_id % 10 = 3 THEN 'missing_source' WHEN case_id % 10 = 4 AND g = 'labels' THEN 'skipped_exists' ELSE 'moved' END AS outcome,
  count(*) AS files FROM e GROUP BY ALL""")
def _(spark, folder):
    cases = bindings.cases(spark, folder)
    groups = "explode(array('images', 'labels', 'targets')) as file_group"
    expected = splits.holdout(cases, 0.2, 42).where("split = 'holdout'").selectExpr("case_id", groups)
    present = cases.selectExpr("case_id", groups).where("case_id % 20 <> 3").selectExpr(
        "case_id", "file_group", "case_id % 10 <> 3 as at_source", "case_id % 10 = 4 and file_group = 'labels' as at_target"
    )
    return splits.holdout_audit(expected, present)


SAMP = "sm AS (SELECT vec_id AS sample_id, label FROM embeddings)"


@query("class_weights", f"WITH {SAMP} SELECT sample_id, label, n_class, {near('1.0::DOUBLE / n_class / k', 9)} AS weight FROM sm JOIN (SELECT label, count(*) AS n_class, count(*) OVER () AS k FROM sm GROUP BY ALL) c USING (label)")
def _(spark, folder):
    return rounded(splits.class_weights(bindings.samples(spark, folder).select("sample_id", "label")), 9)


@query("balanced_weights", f"WITH {SAMP}, c AS (SELECT label, count(*) AS n_class FROM sm GROUP BY ALL) SELECT label, n_class, {near('(SELECT count(*) FROM sm) / ((SELECT count(*) FROM c) * n_class::DOUBLE)')} AS weight FROM c")
def _(spark, folder):
    return rounded(splits.balanced_weights(bindings.samples(spark, folder)))


@query("oversample", f"""WITH {SAMP}, c AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS m FROM sm GROUP BY ALL),
p AS (SELECT sample_id, label, n, m, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id) - 1 AS pos FROM sm JOIN c USING (label))
SELECT sample_id, label, CAST(unnest(range(1, (m // n + CASE WHEN pos < m % n THEN 1 ELSE 0 END) + 1)) AS INTEGER) AS copy FROM p""")
def _(spark, folder):
    return splits.oversample(bindings.samples(spark, folder).select("sample_id", "label"))


def uniform_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query("weighted_sample", f"""WITH {SAMP}, c0 AS (SELECT label, count(*) AS n FROM sm GROUP BY ALL),
c AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS ci, count(*) OVER () AS k FROM c0),
d AS (SELECT sample_id AS draw, floor({uniform_sql("'42:class:' || sample_id")} * (SELECT max(k) FROM c)) AS ci, {uniform_sql("'42:place:' || sample_id")} AS u FROM sm),
p AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id) - 1 AS pos FROM sm)
SELECT draw, p.sample_id, p.label FROM d JOIN c USING (ci) JOIN p ON p.label = c.label AND p.pos = floor(u * n)""")
def _(spark, folder):
    rows = bindings.samples(spark, folder).select("sample_id", "label")
    return splits.weighted_sample(rows, rows.selectExpr("sample_id as draw"))


@query("sample_voxels", f"""WITH {REG} SELECT case_id, z, y, x, label_id FROM reg
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY md5('42:' || case_id || ':' || z || ':' || y || ':' || x)) <= 10""")
def _(spark, folder):
    return splits.sample_voxels(bindings.voxels(spark, folder), 10).drop("intensity")


@query("limit_cases", "SELECT vec_id AS case_id, 42 + 1009 * (row_number() OVER (ORDER BY vec_id) - 1) AS run_seed FROM embeddings ORDER BY vec_id LIMIT 20")
def _(spark, folder):
    return splits.limit_cases(bindings.volumes(spark, folder), 20).selectExpr("case_id", "cast(run_seed as bigint) as run_seed")


@query("even_pick", f"""WITH {SAMP}, r AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS place, count(*) OVER () AS n FROM sm)
SELECT sample_id, place FROM r WHERE place IN (SELECT CAST(floor(i * ((n - 1) / 6.0::DOUBLE)) AS BIGINT) FROM unnest(range(0, 7)) t(i), (SELECT count(*) AS n FROM sm))""")
def _(spark, folder):
    return splits.even_pick(bindings.samples(spark, folder), 7)
