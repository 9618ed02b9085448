"""Region features of all families and image types, extracted incrementally."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.scalar import finite
from voxelframe.functions.single import one_row
from voxelframe.operators import bank, compact, copies, filters, intensity, matrix, quality, shape, texture
from voxelframe.operators.tiles import AXES
from voxelframe.plans import isolate
from voxelframe.plans.maps import crop_voxels
from voxelframe.session import cut_lineage, read_if_there
from voxelframe.sources import records

# Extraction settings per modality.
CT_BIN_WIDTH = 25.0
MR_BIN_COUNT = 32
LOG_SIGMAS = (1.0, 2.0, 3.0)
FAMILIES = {
    "firstorder": texture.firstorder, "glcm": texture.glcm, "glrlm": texture.glrlm, "glszm": texture.glszm,
    "gldm": texture.gldm, "ngtdm": texture.ngtdm,
}


def image_types(cropped: DataFrame, keys: list[str], sigmas: tuple[float, ...] = LOG_SIGMAS) -> DataFrame:
    """Region voxels of the original, wavelet and LoG images; the image type becomes a key."""
    rows = cropped.select(*keys, *AXES, "intensity", "inside")
    packed, rest = bank.split(rows, keys)
    named = """case when channel = 'image' then 'original'
        when startswith(channel, 'swt_') then concat('wavelet-', translate(substr(channel, 5), 'ad', 'LH'))
        else concat('log-sigma-', substr(channel, 5)) end as image_type"""
    out = bank.region_voxels(packed, keys, "post_pool", sigmas=sigmas, gradient=False).selectExpr(*keys, *AXES, named, "value as intensity")
    if rest is None:
        return out
    found = filters.filter_bank(rest, keys, sigmas=sigmas, gradient=False, mask_mode="post_pool")
    inside = rest.where("inside = 1").select(*keys, *AXES)
    return out.unionByName(found.selectExpr(*keys, *AXES, named, "round(value, 8) as intensity").join(inside, [*keys, *AXES]))


#: Intensities of MR crops are brought to this deviation before image types are made.
MR_SCALE = 100.0


def normalised(cropped: DataFrame, keys: list[str], modality: str) -> DataFrame:
    """Crop voxels with the intensities the image types start from: CT as it is, MR by mean and sample deviation of the whole
    crop, times ``MR_SCALE``; a flat crop becomes 0."""
    if modality == "CT":
        return cropped
    stats = cropped.groupBy(*keys).agg(F.avg("intensity").alias("_mean"), F.stddev_samp("intensity").alias("_std"))
    scaled = (F.col("intensity") - F.col("_mean")) / F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0) * MR_SCALE
    return cropped.join(stats, keys).withColumn("intensity", scaled).drop("_mean", "_std")


def typed_levels(cropped: DataFrame, keys: list[str], modality: str, width: float = CT_BIN_WIDTH) -> DataFrame:
    """Region voxels of all image types with the levels of the modality's settings: input of ``region_features``."""
    rows = image_types(cut_lineage(normalised(cropped, keys, modality)), keys)
    return discretised(rows, [*keys, "image_type"], modality, width)


def discretised(regions: DataFrame, keys: list[str], modality: str, width: float = CT_BIN_WIDTH) -> DataFrame:
    if modality == "CT":
        return intensity.discretize_width(regions, keys, width)
    return intensity.discretize_count(regions, keys, MR_BIN_COUNT)


def region_features(
    regions: DataFrame, keys: list[str], families: tuple[str, ...] = tuple(FAMILIES), with_shape: bool = True
) -> DataFrame:
    """Long features of the given families from discretised region voxels; an ``image_type`` column acts as a key.

    A region without voxels yields no rows.
    """
    regions = cut_lineage(regions)  # every family reads it
    typed = "image_type" in regions.columns
    groups = [*keys, "image_type"] if typed else keys
    wanted = tuple(families) + (("shape",) if with_shape and not typed else ())
    parts = []
    if wanted:
        small, large = compact.region_rows(regions, groups, wanted, "image_type" if typed else "'original'")
        parts.append(small.select(*keys, "feature", "value"))
        if large is not None:
            parts.append(_spread_features(large, keys, families, with_shape and not typed))
    if with_shape and typed:
        parts.append(region_features(regions.where("image_type = 'original'").drop("image_type"), keys, ()))
    return reduce(DataFrame.unionByName, parts)


def _spread_features(regions: DataFrame, keys: list[str], families: tuple[str, ...], with_shape: bool) -> DataFrame:
    """The same rows of regions of any size."""
    regions = cut_lineage(regions)
    typed = "image_type" in regions.columns
    groups = [*keys, "image_type"] if typed else keys
    prefix = F.col("image_type") if typed else "original"
    parts = []
    near = tuple(name for name in families if name in texture.NEIGHBOURS)
    counts = cut_lineage(texture.neighbour_counts(regions, groups, near)) if near else None
    for name in families:
        shared = {"counts": counts} if name in near else {}
        if name == "glcm":
            shared["wanted"] = [*texture.GLCM_FEATURES, "MCC"]
        wide = FAMILIES[name](regions, groups, **shared)
        parts.append(texture.to_long(wide, keys, name, prefix))
    if with_shape:
        parts.append(texture.to_long(shape.shape(regions, keys), keys, "shape"))
    return reduce(DataFrame.unionByName, parts)


def extract_pending(
    regions: DataFrame, store: str, config_hash: str, keys: list[str], families: tuple[str, ...], force: bool = False,
    with_shape: bool = True,
) -> DataFrame:
    """Compute and append features of regions the store lacks for this configuration; returns the store's current rows."""
    spark = regions.sparkSession
    todo, stored = regions, read_if_there(spark, store)
    if stored is not None:
        known = stored.select(*keys, "config_hash").distinct()
        crops = regions.select(*keys).distinct()
        todo = regions.join(matrix.pending_regions(crops, known, config_hash, force), keys, "left_semi")
    rows = region_features(todo, keys, families, with_shape=with_shape).where("not startswith(feature, 'diagnostics_')")
    rows = rows.selectExpr(*keys, "feature", f"{finite('value')} as value")
    records.write_features(rows.withColumn("config_hash", F.lit(config_hash)), store, replace=force)
    return records.read_features(spark, store, config_hash)


def extract_safely(
    crops: DataFrame, store: str, config_hash: str, levels: Callable[[DataFrame], DataFrame], keys: list[str], families: tuple[str, ...] = tuple(FAMILIES),
    with_shape: bool = True, voxels: Callable[[DataFrame, list[str]], DataFrame] = crop_voxels,
) -> DataFrame:
    """``extract_pending`` over crop rows (keys, shape, image, mask) that a broken crop does not stop; ``levels`` makes
    discretised region voxels of crop voxels, which ``voxels`` makes of crop rows.

    Returns the crops without a result: key, error. They have no record in the store, so the next run tries them again.
    """
    stored = read_if_there(crops.sparkSession, store)
    todo = crops
    if stored is not None:
        known = stored.select(*keys, "config_hash").distinct()
        todo = crops.join(matrix.pending_regions(crops.select(*keys).distinct(), known, config_hash), keys, "left_semi")
    todo = cut_lineage(todo)
    faults = cut_lineage(isolate.named_faults(todo, keys))
    good = todo.join(faults.select(*keys), keys, "left_anti")

    def work(part: DataFrame) -> None:
        rows = region_features(levels(voxels(part, keys)), keys, families, with_shape)
        rows = rows.selectExpr(*keys, "feature", f"{finite('value')} as value")
        records.write_features(rows.withColumn("config_hash", F.lit(config_hash)), store)

    failed = isolate.attempt(good, keys, work)
    named = faults.select(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("key"), "error")
    return named.unionByName(failed)


#: Perturbed copies of a mask a feature has to be stable under.
REPEATS = 8


def perturbed_features(
    masks: DataFrame, values: DataFrame, keys: list[str], modality: str = "CT", repeats: int = REPEATS, seed: int = 42, width: float = CT_BIN_WIDTH,
    with_shape: bool = True, stacked: bool = False,
) -> DataFrame:
    """Features of all families of every mask and its perturbed copies: keys, repeat, feature, value, or ``stacked`` as
    ``copies.stacked`` has them, which is what ``reproducibility`` needs without a shuffle of the features.

    ``masks`` has keys, the grid size and z, y, x; ``values`` the intensity of every voxel of a case (case_id, z, y, x).
    """
    marked = copies.perturbed(masks, keys, repeats, seed).join(values.select("case_id", *AXES, "intensity"), ["case_id", *AXES])
    bins = {"width": width} if modality == "CT" else {"count": MR_BIN_COUNT}
    return (copies.stacked if stacked else copies.features)(marked, keys, repeats, with_shape=with_shape, **bins)


def reproducibility(perturbed: DataFrame, repeats: int) -> tuple[DataFrame, DataFrame]:
    """ICC per feature over perturbed extractions (case_id, label_id, repeat, feature, value), or stacked ones, and its summary."""
    if "found" in perturbed.columns:
        scores = quality.icc_stacked(perturbed, repeats)
        return scores, quality.icc_summary(scores, repeats)
    rows = perturbed.selectExpr("feature", "concat_ws(':', case_id, label_id) as case_id", "repeat", "value")
    scores = quality.icc(rows, repeats)
    return scores, quality.icc_summary(scores, repeats)


def _varying(features: DataFrame) -> DataFrame:
    """Complete rows of the features that vary, with medians for what is missing."""
    varying = quality.valid_features(features).where("any_value and varies").select("feature")
    rows = quality.complete(features.join(varying, "feature", "left_semi"), [])
    return cut_lineage(quality.fill_median(rows, quality.medians(rows, []), []))


def intercorrelation(features: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """All feature pairs and the strongly correlated ones, on valid, varying, median-filled features. The first table has a row
    per pair of features; who wants the second one only takes ``strong_correlations``."""
    pairs = quality.spearman(_varying(features))
    return pairs, quality.correlated_pairs(pairs, threshold).orderBy(F.abs("r").desc(), "a", "b")


def strong_correlations(features: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The strongly correlated pairs, strongest first."""
    return quality.strong_pairs(_varying(features), threshold).orderBy(F.abs("r").desc(), "a", "b")


def intercorrelation_summary(features: DataFrame, strong: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row: samples, features with values that vary, the threshold, and the pairs above it."""
    varying = quality.valid_features(features).where("any_value and varies").agg(F.count(F.lit(1)).alias("n"))
    samples = features.agg(F.countDistinct("sample_id").alias("n_samples"))
    pairs = strong.agg(F.count(F.lit(1)).alias("n"))
    return samples.withColumn("n_features", one_row(varying)["n"]).withColumn("corr_threshold", F.lit(float(threshold))).withColumn("n_high_corr_pairs", one_row(pairs)["n"])
