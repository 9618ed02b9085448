"""Filter-map cache: pending (crop, variant) pairs are augmented, filtered and stored under their configuration hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import augment, bank as packed_bank, filters, matrix
from voxelframe.operators.tiles import AXES
from voxelframe.session import cut_lineage, read_if_there


def crop_voxels(crops: DataFrame, keys: list[str]) -> DataFrame:
    """Crop rows (keys, shape, image, mask) to voxel rows with ``inside``."""
    rows = crops.selectExpr(*keys, "shape", "posexplode(arrays_zip(image, mask)) as (k, cell)")
    return rows.selectExpr(
        *keys, "int(k div (shape[1] * shape[2])) as z", "int((k div shape[2]) % shape[1]) as y", "int(k % shape[2]) as x",
        "double(cell.image) as intensity", "int(cell.mask) as inside",
    )


def cache_filter_maps(crops: DataFrame, store: str, config_hash: str, variants: int, **bank) -> DataFrame:
    """Append the maps the store lacks for this hash and return all of them: case_id, label_id, variant, channel, values."""
    keys = ["case_id", "label_id", "variant"]
    spark = crops.sparkSession
    todo = crops.selectExpr("*", f"explode(sequence(0, {variants})) as variant")
    stored = read_if_there(spark, store)
    if stored is not None:
        known = stored.where(F.col("config_hash") == config_hash).select(*keys).distinct()
        todo = todo.join(matrix.pending_variants(crops.select("case_id", "label_id"), known, variants), keys, "left_semi")
    moved = cut_lineage(augment.augment_geometry(todo.select(*keys, "shape", "image", "mask")))  # read by every filter
    rows = crop_voxels(moved, keys)
    plain, varied = rows.where("variant = 0"), rows.where("variant > 0")
    changed = augment.augment_intensity(varied, "concat_ws(':', case_id, label_id, variant)").select(*rows.columns)
    cases, rest = packed_bank.split(cut_lineage(plain.unionByName(changed)), keys)  # noise is drawn once
    packed = packed_bank.arrays(cases, keys, **bank)
    if rest is not None:
        packed = packed.unionByName(filters.filter_bank(rest, keys, **bank).groupBy(*keys, "channel").agg(
            F.expr(f"transform(array_sort(collect_list(struct({', '.join(AXES)}, value))), c -> float(c.value)) as values")
        ))
    packed.withColumn("config_hash", F.lit(config_hash)).write.mode("append").partitionBy("config_hash").parquet(store)
    return spark.read.parquet(store).where(F.col("config_hash") == config_hash).drop("config_hash")


def bank_features(voxels: DataFrame, keys: list[str], **bank) -> DataFrame:
    """Tabular summary of the filter bank: masked mean and sequence texture of every channel, long.

    Cases inside one tile are filtered and summed up many at once; larger ones line by line.
    """
    cases, rest = packed_bank.split(voxels, keys)
    found = packed_bank.features(cases, keys, **bank)
    return found if rest is None else found.unionByName(_spread_features(rest, keys, **bank))


def _spread_features(voxels: DataFrame, keys: list[str], **bank) -> DataFrame:
    """The same of cases of any size."""
    channels = filters.filter_bank(voxels, keys, **bank)
    mask = voxels.select(*keys, *AXES, "inside")
    rows = channels.join(mask, [*keys, *AXES]).selectExpr(*keys, "channel", *AXES, "round(value, 8) as value", "inside")
    means = filters.masked_mean(rows, keys).selectExpr(*keys, "channel", "'mean' as stat", "value")
    inner = rows.where("inside = 1").select(*keys, "channel", *AXES, "value")
    texture = filters.sequence_texture(inner, [*keys, "channel"], value="value")
    stats = texture.selectExpr(
        *keys, "channel",
        "stack(4, 'energy', energy, 'contrast', contrast, 'homogeneity', homogeneity, 'correlation', correlation) as (stat, value)",
    )
    return means.unionByName(stats)
