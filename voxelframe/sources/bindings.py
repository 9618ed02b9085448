"""The supplied tables seen as the engine's tables: volumes, region features, targets, logs, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.ranking import running_before
from voxelframe.session import configure

REGION = ["case_id", "label_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per case: a 4x4x4 image with a label image and a spacing that depends on the case."""
    emb = table(spark, folder, "embeddings")
    label = F.transform(
        "embedding", lambda v: F.when(v.cast("double") > 0.1, 2).when(v > 0, 1).otherwise(0).cast("smallint")
    )
    return emb.select(
        F.col("vec_id").alias("case_id"),
        F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"),
        F.array(
            F.lit(1.0), F.lit(0.5) + (F.col("vec_id") % 4) * 0.25, F.lit(0.5) + (F.col("vec_id") % 3) * 0.25
        ).alias("spacing"),
        F.col("embedding").alias("image"),
        label.alias("label"),
    )


def voxels(spark: SparkSession, folder: str) -> DataFrame:
    """Long voxel table of ``volumes``: case_id, z, y, x, intensity, label_id."""
    from voxelframe.sources.volumes import voxels_of

    return voxels_of(volumes(spark, folder))


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """Foreground voxels only; a region is a (case, label)."""
    return voxels(spark, folder).where("label_id > 0")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Wide sample rows: sample_id, class label 0-9, array of 64 features."""
    emb = table(spark, folder, "embeddings")
    return emb.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("int").alias("label"), "embedding")


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Long features f00..f63 per sample; every 17th cell is missing so that imputation has work to do."""
    long = samples(spark, folder).select("sample_id", "label", F.posexplode("embedding").alias("pos", "raw"))
    missing = (F.col("sample_id") + F.col("pos")) % 17 == 0
    return long.select(
        "sample_id",
        "label",
        F.format_string("f%02d", "pos").alias("feature"),
        F.when(~missing, F.col("raw").cast("double")).alias("value"),
    )


def region_table(spark: SparkSession, folder: str) -> DataFrame:
    """Region features of order lines, one row per (case, label): quantity, price, discount, tax and a class."""
    lines = table(spark, folder, "lineitem")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return lines.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("label_id")).agg(
        F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("price"),
        F.max("l_discount").alias("discount"),
        F.max("l_tax").alias("tax"),
        F.max(code).alias("flag"),
    )


def region_features(spark: SparkSession, folder: str) -> DataFrame:
    """Long form of ``region_table``: case_id, label_id, feature, value."""
    wide = region_table(spark, folder)
    return wide.selectExpr(
        "case_id", "label_id",
        "stack(4, 'discount', discount, 'price', price, 'quantity', quantity, 'tax', tax) as (feature, value)",
    )


def region_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Per-label class target; the smallest label of every seventh case has no value."""
    wide = region_table(spark, folder)
    gone = (F.col("case_id") % 7 == 0) & (F.col("label_id") == 1)
    return wide.select("case_id", "label_id", F.when(~gone, F.col("flag").cast("double")).alias("value"))


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Per-case targets: a 1-based class from the priority and a price; every 11th class is missing."""
    orders = table(spark, folder, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("double")
    return orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderkey") % 11 != 0, level).alias("source_level"),
        F.col("o_totalprice").alias("age"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Binary truth with a probability and a hard prediction."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    joined = table(spark, folder, "labels").join(docs, "doc_id")
    proba = F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))
    return joined.select(
        F.col("doc_id").alias("sample_id"),
        F.col("quality").cast("int").alias("y_true"),
        (proba >= 0.5).cast("int").alias("y_pred"),
        proba.alias("proba"),
    )


def epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Training-log rows: fold = user, epoch = order of the user's events, loss = event value, metric = event type."""
    events = table(spark, folder, "events").selectExpr(
        "user_id as fold", "ts", "event_id", "value as val_loss", "event_type as metric", "date_trunc('HOUR', ts) as slot"
    )
    placed = running_before(events, ["fold"], "slot", ["ts", "event_id"], {"seen": ("sum", "1")})
    return placed.selectExpr("fold", "cast(seen + 1 as bigint) as epoch", "val_loss", "metric")
