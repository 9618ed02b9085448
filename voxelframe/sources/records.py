"""Feature records, folds, metrics and plans on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.scalar import coerce_float
from voxelframe.session import read_if_there

PLAN_VERSION = 1
# Keys a stored plan must have.
PLAN_KEYS = [
    "version", "dataset_name", "modality", "target_spacing", "crop_size", "intensity_clip", "intensity_mean", "intensity_std",
    "label_coverage", "bbox_percentiles",
]


def write_features(rows: DataFrame, path: str, replace: bool = False) -> None:
    """Append long feature rows; the hash is a partition folder, so a scan of one configuration reads only its files.

    ``replace`` overwrites the folders of the hashes in ``rows`` and leaves the others.
    """
    parts = rows.hint("rebalance", "config_hash")  # as many writers a configuration as its rows need
    mode = parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else parts.write.mode("append")
    mode.partitionBy("config_hash").parquet(path)


def read_features(spark: SparkSession, path: str, config_hash: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("config_hash") == config_hash).drop("config_hash")


def parse_records(docs: DataFrame) -> DataFrame:
    """Feature rows of JSON records ``{config_hash, features: {name: value}}``; other documents are skipped."""
    schema = "config_hash string, features map<string,string>"
    keys = [c for c in docs.columns if c != "doc"]
    rows = docs.where("startswith(ltrim(doc), '{')").select(*keys, F.explode(F.from_json("doc", schema)["features"]).alias("feature", "raw"))
    return rows.selectExpr(*keys, "feature", f"{coerce_float('raw')} as value")


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from a folder with one JSON file per region; the key is the file name."""
    files = spark.read.text(path, wholetext=True).selectExpr(
        "regexp_extract(_metadata.file_name, '^(.+)[.]json$', 1) as region_key", "value as doc"
    )
    return parse_records(files)


def read_folds(spark: SparkSession, results: str, prepared: str) -> DataFrame:
    """Fold table; a copy among the results wins over the prepared one."""
    copy = read_if_there(spark, results)
    return spark.read.parquet(prepared) if copy is None else copy


def read_icc(spark: SparkSession, path: str) -> DataFrame:
    """ICC scores from CSV (header feature, icc) or JSON lines; rows without a score are dropped in CSV only."""
    if path.rstrip("/").endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
        missing = {"feature", "icc"} - set(rows.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
        return rows.selectExpr("feature", f"{coerce_float('icc')} as icc").where("icc is not null")
    return spark.read.schema("feature string, icc double").json(path)


def write_icc(scores: DataFrame, path: str) -> None:
    """Sorted by feature, as CSV and JSON side by side."""
    ordered = scores.select("feature", "icc").orderBy("feature")
    ordered.write.mode("overwrite").option("header", True).csv(f"{path}/icc.csv")
    ordered.write.mode("overwrite").json(f"{path}/icc.json")


def predictions_wide(predictions: DataFrame, n_classes: int) -> DataFrame:
    """sample_id, y_true, y_pred and a column per class probability."""
    return predictions.selectExpr("sample_id", "y_true", "y_pred", *[f"proba[{k}] as p{k}" for k in range(n_classes)])


def read_fold_metrics(docs: DataFrame, model: str) -> DataFrame:
    """Scalar metrics (fold, metric, value) of JSON documents (path, doc); the fold is in the path.

    Documents of another model are left out, documents without a model stay; list-valued metrics are skipped.
    """
    schema = "model string, metrics map<string,string>, runtime_seconds double"
    rows = docs.selectExpr("int(regexp_extract(path, 'fold[_]?([0-9]+)', 1)) as fold", f"from_json(doc, '{schema}') as d")
    rows = rows.where(F.col("d.model").isNull() | (F.col("d.model") == model))
    each = rows.select("fold", F.explode("d.metrics").alias("metric", "raw")).where("raw is null or not startswith(ltrim(raw), '[')")
    return each.selectExpr("fold", "metric", f"{coerce_float('raw')} as value")


def read_fold_times(docs: DataFrame, model: str) -> DataFrame:
    """Run time (fold, seconds) of the same documents, 0 where one has none."""
    rows = docs.selectExpr("int(regexp_extract(path, 'fold[_]?([0-9]+)', 1)) as fold", "from_json(doc, 'model string, runtime_seconds double') as d")
    return rows.where(F.col("d.model").isNull() | (F.col("d.model") == model)).selectExpr("fold", "coalesce(d.runtime_seconds, 0D) as seconds")


def write_plan(plan: DataFrame, path: str) -> None:
    plan.coalesce(1).write.mode("overwrite").parquet(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """One-row plan; fails on a missing key or another version."""
    plan = spark.read.parquet(path)
    missing = [key for key in PLAN_KEYS if key not in plan.columns]
    if missing:
        raise ValueError(f"plan lacks {missing}")
    if plan.where(F.col("version") != PLAN_VERSION).head(1):
        raise ValueError("unsupported plan version")
    return plan
