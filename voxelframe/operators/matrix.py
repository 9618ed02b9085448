"""Joins that assemble feature matrices, find pending work and check caches. Features stay long until a model needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.scalar import sample_id

REGION = ["case_id", "label_id"]


def matrix_per_label(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Region features with the region's target; regions without a value drop out."""
    known = targets.where("value is not null").selectExpr(*REGION, "value as y")
    return features.join(known, REGION).selectExpr(
        f"{sample_id('case_id', 'label_id')} as sample_id", *REGION, "feature", "value", "y"
    )


def matrix_per_case(features: DataFrame, targets: DataFrame, labels: list[int], names: list[str]) -> DataFrame:
    """One row per case with a block of columns per label, ``label003_price``; an absent label leaves NULLs."""
    known = [f"label{label:03d}_{name}" for label in labels for name in names]
    keyed = features.selectExpr("case_id", "concat(format_string('label%03d_', label_id), feature) as slot", "value")
    wide = keyed.groupBy("case_id").pivot("slot", known).agg(F.first("value"))
    return wide.join(targets.where("value is not null").selectExpr("case_id", "value as y"), "case_id")


def matrix_per_case_long(features: DataFrame, targets: DataFrame) -> DataFrame:
    """The same as long rows for training: a feature per label and name; a label that a case lacks has no row."""
    known = targets.where("value is not null").selectExpr("case_id", "value as y")
    named = features.selectExpr("case_id", "concat(format_string('label%03d_', label_id), feature) as feature", "value")
    return named.join(known, "case_id").selectExpr("string(case_id) as sample_id", "case_id", "feature", "value", "y")


def matrix_test(features: DataFrame, targets: DataFrame, holdout: DataFrame) -> DataFrame:
    """Per-label matrix of the held-out cases only; both inputs are cut before they are joined."""
    cases = holdout.where("split = 'holdout'").select("case_id")
    return matrix_per_label(features.join(cases, "case_id", "left_semi"), targets.join(cases, "case_id", "left_semi"))


def matrix_test_per_case(features: DataFrame, targets: DataFrame, holdout: DataFrame) -> DataFrame:
    """Per-case matrix of the held-out cases only, as long rows."""
    cases = holdout.where("split = 'holdout'").select("case_id")
    return matrix_per_case_long(features.join(cases, "case_id", "left_semi"), targets.join(cases, "case_id", "left_semi"))


def fold_roles(samples: DataFrame, folds: DataFrame, n_folds: int) -> DataFrame:
    """Every sample once per fold with its role: ``val`` in its case's own fold, ``train`` in the others."""
    own = samples.join(folds.selectExpr("case_id", "fold as own_fold"), "case_id")
    return own.selectExpr("*", f"explode(sequence(0, {n_folds - 1})) as fold").selectExpr(
        *samples.columns, "fold", "if(fold = own_fold, 'val', 'train') as role"
    )


def pending_regions(crops: DataFrame, records: DataFrame, config_hash: str, force: bool = False) -> DataFrame:
    """Crops without a feature record of the current hash; all crops if forced."""
    if force:
        return crops
    return crops.join(records.where(F.col("config_hash") == config_hash), REGION, "left_anti")


def pending_variants(crops: DataFrame, maps: DataFrame, variants: int) -> DataFrame:
    """Missing (crop, variant) pairs; variant 0 is the plain crop."""
    return crops.selectExpr("*", f"explode(sequence(0, {variants})) as variant").join(maps, [*REGION, "variant"], "left_anti")


def cache_integrity(crops: DataFrame, maps: DataFrame) -> DataFrame:
    """Regions with a crop but no map (``missing``) or a map but no crop (``stale``)."""
    both = crops.selectExpr(*REGION, "true as crop").join(maps.selectExpr(*REGION, "true as map"), REGION, "full_outer")
    return both.where("crop is null or map is null").selectExpr(*REGION, "if(map is null, 'missing', 'stale') as state")


def enumerate_samples(targets: DataFrame, maps: DataFrame, scope: str) -> DataFrame:
    """Samples that have both a target value and a map: per region, or per case with any map."""
    known = targets.where("value is not null")
    keys = REGION if scope == "per_label" else ["case_id"]
    return known.join(maps.select(*keys), keys, "left_semi").select(*keys, "value")


def label_slots(cases: DataFrame, maps: DataFrame, labels: list[int]) -> DataFrame:
    """A slot per (case, label) with a ``present`` flag; an absent slot holds 0."""
    slots = cases.selectExpr("case_id", f"explode(array({', '.join(map(str, labels))})) as label_id")
    return slots.join(maps.selectExpr(*REGION, "value"), REGION, "left").selectExpr(
        *REGION, "value is not null as present", "coalesce(value, 0D) as value"
    )
