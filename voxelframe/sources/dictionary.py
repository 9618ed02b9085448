"""Label dictionaries, target schemas and case targets from JSON documents, one document per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.scalar import coerce_float

DATASET_SCHEMA = "modality map<string,string>, channel_names map<string,string>, labels map<string,string>"
TARGET_SCHEMA = "map<string, struct<type:string, scope:string, num_classes:int, applicable_labels:array<int>>>"
# The accepted target types, scopes and modalities.
TYPES = ["classification", "regression"]
SCOPES = ["per_label", "per_case"]
MODALITIES = ["CT", "MR"]


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def label_dim(docs: DataFrame) -> DataFrame:
    """Foreground labels of every dataset document (dataset, doc): label_id, label_name, modality, background_id.

    Labels may be written id -> name or name -> id. The background is the first label with that name, else id 0 if
    present, else -1.
    """
    parsed = docs.select("dataset", F.from_json("doc", DATASET_SCHEMA).alias("d"))
    modality = "upper(coalesce(d.modality, d.channel_names)['0'])"
    parsed = parsed.selectExpr(
        "dataset", f"if({modality} = 'MRI', 'MR', {modality}) as modality",
        "map_keys(coalesce(d.modality, d.channel_names)) as channels", "d.labels as labels",
    ).where(f"channels = array('0') and modality in ({_listed(MODALITIES)})")
    entry = "if(try_cast(e.key as int) is not null, named_struct('id', try_cast(e.key as int), 'name', e.value), named_struct('id', try_cast(e.value as int), 'name', e.key))"
    listed = parsed.selectExpr("dataset", "modality", f"transform(map_entries(labels), e -> {entry}) as labels")
    named = "filter(labels, e -> lower(e.name) = 'background')"
    background = f"coalesce(get({named}, 0).id, if(exists(labels, e -> e.id = 0), 0, -1))"
    # A generator of one row: a plain column would be moved behind the next one and look through all labels for every label.
    found = listed.selectExpr("dataset", "modality", f"inline(array(named_struct('background_id', {background}, 'labels', labels)))")
    rows = found.selectExpr("dataset", "modality", "background_id", "inline(labels)")
    return rows.where("id <> background_id").selectExpr("dataset", "modality", "background_id", "id as label_id", "name as label_name")


def target_specs(docs: DataFrame) -> DataFrame:
    """Target specifications of every schema document (dataset, doc); labels sorted and distinct."""
    rows = docs.select("dataset", F.explode(F.from_json("doc", TARGET_SCHEMA)).alias("target", "s"))
    labels = "array_sort(array_distinct(coalesce(s.applicable_labels, array())))"
    return rows.selectExpr("dataset", "target", "s.type", "s.scope", "s.num_classes", f"{labels} as applicable_labels")


def target_violations(specs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per broken rule: type, scope, class count, missing or unknown labels. ``known`` is (dataset, labels)."""
    rules = {
        "unknown_type": f"not coalesce(type in ({_listed(TYPES)}), false)",
        "unknown_scope": f"not coalesce(scope in ({_listed(SCOPES)}), false)",
        "classes_required": "type = 'classification' and coalesce(num_classes, 0) < 2",
        "classes_not_allowed": "type = 'regression' and num_classes is not null",
        "labels_required": "scope = 'per_label' and size(applicable_labels) = 0",
        "unknown_labels": "size(array_except(applicable_labels, coalesce(labels, array()))) > 0",
    }
    found = ", ".join(f"if({rule}, '{name}', null)" for name, rule in rules.items())
    return specs.join(known, "dataset", "left").selectExpr("dataset", "target", f"explode(array_compact(array({found}))) as violation")


def case_targets(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """Long targets (case_id, target, label_id, value) from case documents (case_id, doc).

    Keys outside the schema are dropped, as are labels outside the target's list (an empty list admits all).
    Values that are not numbers become NULL.
    """
    entries = docs.select("case_id", F.explode(F.from_json("doc", "map<string,string>")).alias("target", "raw"))
    rows = entries.join(specs.select("target", "scope", "applicable_labels"), "target")
    per_case = rows.where("scope = 'per_case'").selectExpr(
        "case_id", "target", "cast(null as int) as label_id", f"{coerce_float('raw')} as value"
    )
    per_label = rows.where("scope = 'per_label'").selectExpr(
        "case_id", "target", "applicable_labels", "explode(from_json(raw, 'map<string,string>')) as (label, raw)"
    ).selectExpr("case_id", "target", "applicable_labels", "try_cast(label as int) as label_id", f"{coerce_float('raw')} as value")
    per_label = per_label.where("label_id is not null and (size(applicable_labels) = 0 or array_contains(applicable_labels, label_id))")
    return per_case.unionByName(per_label.drop("applicable_labels"))


def nested_lookup(doc: str, key: str) -> str:
    """SQL: ``targets.<key>`` if that key exists (even as null), else the top-level key."""
    inner = f"from_json(get_json_object({doc}, '$.targets'), 'map<string,string>')"
    outer = f"from_json({doc}, 'map<string,string>')"
    return f"if(coalesce(map_contains_key({inner}, '{key}'), false), {inner}['{key}'], {outer}['{key}'])"
