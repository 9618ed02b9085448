"""Voxel intensities: clipping, z-scores, windows, discretisation. Group statistics are aggregated, then joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.ranking import percentiles
from voxelframe.functions.single import one_row

FLAT = 1e-8  # ranges below this count as flat


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def foreground_stats(voxels: DataFrame, keys: list[str], value: str = "intensity") -> DataFrame:
    """Mean and population deviation over the foreground, or over all voxels where a group has no foreground."""
    inside = F.when(F.col("label_id") > 0, F.col(value))
    return voxels.groupBy(*keys).agg(
        F.coalesce(F.avg(inside), F.avg(value)).alias("mean"),
        F.coalesce(F.stddev_pop(inside), F.stddev_pop(value)).alias("std"),
    )


def _scaled(value: Column) -> Column:
    return (value - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)


def zscore_case(voxels: DataFrame, out: str = "intensity") -> DataFrame:
    """Normalise every case with its own foreground statistics (MR)."""
    stats = foreground_stats(voxels, ["case_id"])
    return voxels.join(stats, "case_id").withColumn(out, _scaled(F.col("intensity"))).drop("mean", "std")


def intensity_stats(voxels: DataFrame, clip_range: tuple[float, float]) -> DataFrame:
    """One row: mean and population deviation of clipped foreground intensities over all cases (CT plan)."""
    row = voxels.where("label_id > 0").agg(
        F.avg(clip(F.col("intensity"), *clip_range)).alias("mean"),
        F.stddev_pop(clip(F.col("intensity"), *clip_range)).alias("std"),
    )
    return row.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def zscore_plan(voxels: DataFrame, plan_stats: DataFrame, clip_range: tuple[float, float]) -> DataFrame:
    """Clip and normalise all cases with the one-row statistics of the plan (CT)."""
    value = clip(F.col("intensity"), *clip_range)
    rows = voxels.withColumn("plan", one_row(plan_stats.select("mean", "std")))
    return rows.withColumn("intensity", (value - F.col("plan.mean")) / F.col("plan.std")).drop("plan")


def minmax01(voxels: DataFrame, keys: list[str], value: str = "intensity", out: str = "unit") -> DataFrame:
    """Scale to [0, 1] per group; a flat group becomes 0."""
    ends = voxels.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    unit = F.when(span < FLAT, F.lit(0.0)).otherwise((F.col(value) - F.col("_lo")) / span)
    return voxels.join(ends, keys).withColumn(out, unit).drop("_lo", "_hi")


def robust_window(voxels: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Scale to [0, 1] between two percentiles of the mask (of everything if the mask is empty), clipped.

    Falls back to the extremes when the percentiles coincide and to 0 when the group is flat.
    """
    has_mask = voxels.groupBy(*keys).agg(F.max((F.col("label_id") > 0).cast("int")).alias("_any"))
    used = voxels.join(has_mask, keys).where((F.col("_any") == 0) | (F.col("label_id") > 0))
    ends = used.groupBy(*keys).agg(F.min("intensity").alias("_min"), F.max("intensity").alias("_max"))
    cuts = percentiles(used, keys, "intensity", {"_plo": low, "_phi": high}).join(ends, keys)
    narrow = F.col("_phi") - F.col("_plo") < FLAT
    cuts = cuts.select(
        *keys,
        F.when(narrow, F.col("_min")).otherwise(F.col("_plo")).alias("lo"),
        F.when(narrow, F.col("_max")).otherwise(F.col("_phi")).alias("hi"),
    )
    span = F.col("hi") - F.col("lo")
    unit = F.when(span < FLAT, F.lit(0.0)).otherwise(clip((F.col("intensity") - F.col("lo")) / span, 0.0, 1.0))
    return voxels.join(cuts, keys).withColumn("unit", unit)


def discretize_width(voxels: DataFrame, keys: list[str], width: float, value: str = "intensity") -> DataFrame:
    """Fixed bin width: ``level`` counts from 1 at the bin of the group minimum; ``n_levels`` is the highest level."""
    bins = F.floor(F.col(value) / F.lit(float(width)))
    ends = voxels.groupBy(*keys).agg(F.min(bins).alias("_lo"), F.max(bins).alias("_hi"))
    level = (bins - F.col("_lo") + 1).cast("int").alias("level")
    n_levels = (F.col("_hi") - F.col("_lo") + 1).cast("int").alias("n_levels")
    return voxels.join(ends, keys).select(*voxels.columns, level, n_levels)


def discretize_count(voxels: DataFrame, keys: list[str], count: int = 32, value: str = "intensity") -> DataFrame:
    """Fixed bin count between the group's extremes; the maximum belongs to the last bin, a flat group to bin 1."""
    ends = voxels.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    bin_ = F.floor((F.col(value) - F.col("_lo")) / span * count) + 1
    level = F.when(span > 0, F.least(F.lit(count), bin_)).otherwise(1).cast("int")
    return voxels.join(ends, keys).select(*voxels.columns, level.alias("level"), F.lit(count).alias("n_levels"))
