"""Volumes to normalised region crops, with the training shifts applied to targets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voxelframe.operators import geometry, intensity, splits
from voxelframe.operators.tiles import AXES
from voxelframe.session import cut_lineage
from voxelframe.sources.volumes import crop_rows, voxels_of


def resampled_voxels(volumes: DataFrame, target: tuple[float, float, float]) -> DataFrame:
    """Image by cubic spline, labels by nearest neighbour, on the target grid."""
    grid = voxels_of(volumes, ("shape", "spacing"))
    labels = geometry.resample_nearest(grid.drop("intensity"), target, ["label_id"])
    image = geometry.resample_spline(voxels_of(volumes, ("spacing",)), target)
    return cut_lineage(image.join(labels, ["case_id", *AXES]))  # statistics, boxes and crops all read it


def preprocess_regions(
    volumes: DataFrame, target: tuple[float, float, float], modality: str, plan_stats: DataFrame | None = None,
    clip: tuple[float, float] = (-1000.0, 1000.0),
) -> DataFrame:
    """Crop voxels of every region: resample, normalise (CT by the plan, MR by the case), crop to the tight box.

    A region that falls between the positions of the target grid is a crop of one voxel, the nearest to it.
    """
    voxels = resampled_voxels(volumes, target)
    if modality == "CT" and plan_stats is not None:
        voxels = intensity.zscore_plan(voxels, plan_stats, clip)
    else:
        voxels = intensity.zscore_case(voxels)
    boxes = geometry.label_bbox(voxels)
    lost = geometry.lost_regions(voxels_of(volumes, ("shape", "spacing")), boxes, target)
    alone = voxels.drop("label_id").join(lost, ["case_id", *AXES])
    single = alone.selectExpr("case_id", "label_id", *[f"0 as {a}" for a in AXES], "intensity", "1 as inside")
    return geometry.crop_voxels(voxels, boxes).unionByName(single)


def write_crops(cropped: DataFrame, path: str) -> None:
    """One row per region; replaces what an earlier run left."""
    crop_rows(cropped).write.mode("overwrite").parquet(path)


def preprocess_test(
    volumes: DataFrame, targets: DataFrame, train_shift: DataFrame, num_classes: int, target: tuple[float, float, float],
    modality: str = "MR", plan_stats: DataFrame | None = None, clip: tuple[float, float] = (-1000.0, 1000.0),
) -> tuple[DataFrame, DataFrame]:
    """Test cases with a target only, normalised as the training cases were (CT by the plan) and with the class shift found
    on them: (crop voxels, targets)."""
    known = volumes.join(targets.select("case_id").distinct(), "case_id", "left_semi")
    return preprocess_regions(known, target, modality, plan_stats, clip), splits.canonical_class(targets, train_shift, num_classes)
