"""Dataset planning: coverage, spacing, box sizes, crop size and intensity statistics in one plan row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.ranking import percentiles
from voxelframe.functions.single import one_row
from voxelframe.operators.geometry import label_bbox, next_multiple, resample_nearest
from voxelframe.operators.intensity import intensity_stats
from voxelframe.operators.tiles import AXES
from voxelframe.sources.records import PLAN_VERSION

CT_CLIP = (-1000.0, 1000.0)
DEFAULT_CROP = 64


def label_coverage(labels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cases per label; labels no case has count 0."""
    counts = boxes.groupBy("label_id").agg(F.count(F.lit(1)).alias("n_cases"))  # one box per case and label
    return labels.join(counts, "label_id", "left").selectExpr(*labels.columns, "coalesce(n_cases, 0L) as n_cases")


def median_spacing(volumes: DataFrame) -> DataFrame:
    """Per-axis median spacing over cases, one row: z, y, x."""
    axes = volumes.selectExpr("posexplode(spacing) as (axis, value)")
    each = percentiles(axes, ["axis"], "value", {"median": 0.5})
    return each.agg(*[F.expr(f"max(if(axis = {i}, median, null)) as {a}") for i, a in enumerate(AXES)])


def box_millimetres(boxes: DataFrame, volumes: DataFrame) -> DataFrame:
    """Box sizes in millimetres, long: label_id, axis, mm."""
    sized = boxes.join(volumes.select("case_id", "spacing"), "case_id")
    sizes = ", ".join(f"({a}1 - {a}0) * spacing[{i}]" for i, a in enumerate(AXES))
    return sized.selectExpr("label_id", f"posexplode(array({sizes})) as (axis, mm)")


def bbox_percentiles(boxes: DataFrame, volumes: DataFrame, labels: DataFrame, target: tuple[float, float, float]) -> DataFrame:
    """p50 and p95 box size per label and axis in target voxels, rounded up; 0 for a label without boxes."""
    cuts = percentiles(box_millimetres(boxes, volumes), ["label_id", "axis"], "mm", {"p50": 0.5, "p95": 0.95})
    grid = labels.selectExpr("label_id", "explode(array(0, 1, 2)) as axis")
    step = f"array({', '.join(f'{float(t)}D' for t in target)})[axis]"
    sized = "cast(coalesce(ceil(round({} / " + step + ", 9)), 0) as int)"
    return grid.join(cuts, ["label_id", "axis"], "left").selectExpr(
        "label_id", "axis", f"{sized.format('p50')} as p50", f"{sized.format('p95')} as p95"
    )


def crop_size(boxes: DataFrame) -> DataFrame:
    """One row: p99 box size over all resampled boxes per axis, rounded up to a multiple; 64 per axis without boxes."""
    sizes = ", ".join(f"{a}1 - {a}0" for a in AXES)
    long = boxes.selectExpr(f"posexplode(array({sizes})) as (axis, size)").selectExpr("axis", "cast(size as double) as size")
    cuts = percentiles(long, ["axis"], "size", {"p99": 0.99})
    top = next_multiple("greatest(1, ceil(round(p99, 9)))")
    each = cuts.selectExpr("axis", f"{top} as crop")
    return each.agg(*[F.expr(f"coalesce(max(if(axis = {i}, crop, null)), {DEFAULT_CROP}) as {a}") for i, a in enumerate(AXES)])


def make_plan(volumes: DataFrame, labels: DataFrame, dataset: str, modality: str, clip: tuple[float, float] = CT_CLIP) -> DataFrame:
    """The plan row. Only the three numbers of the target spacing come to the driver; they parameterise the resampling."""
    from voxelframe.sources.volumes import voxels_of

    voxels = voxels_of(volumes)
    spacing = median_spacing(volumes)
    target = tuple(float(v) for v in spacing.first())
    boxes = label_bbox(voxels)
    grid = voxels_of(volumes, ("shape", "spacing")).drop("intensity")
    resampled = label_bbox(resample_nearest(grid, target, ["label_id"]))
    coverage = label_coverage(labels, boxes).agg(F.expr("map_from_entries(collect_list(struct(label_id, n_cases))) as label_coverage"))
    cuts = bbox_percentiles(boxes, volumes, labels, target).groupBy("label_id").agg(
        F.expr("transform(array_sort(collect_list(struct(axis, p50, p95))), c -> c.p50) as p50"),
        F.expr("transform(array_sort(collect_list(struct(axis, p50, p95))), c -> c.p95) as p95"),
    ).agg(F.expr("map_from_entries(collect_list(struct(label_id, struct(p50, p95)))) as bbox_percentiles"))
    crop = crop_size(resampled).selectExpr("array(z, y, x) as crop_size")
    out = coverage.withColumn("bbox_percentiles", cuts.scalar()).withColumn("crop_size", crop.scalar())
    if modality == "CT":
        out = out.withColumn("stats", one_row(intensity_stats(voxels, clip))).selectExpr(
            "*", "stats.mean as intensity_mean", "stats.std as intensity_std", f"array({clip[0]!r}D, {clip[1]!r}D) as intensity_clip"
        )
    else:
        out = out.selectExpr(
            "*", "cast(null as double) as intensity_mean", "cast(null as double) as intensity_std", "cast(null as array<double>) as intensity_clip"
        )
    return out.selectExpr(
        f"{PLAN_VERSION} as version", f"'{dataset}' as dataset_name", f"'{modality}' as modality",
        f"array({', '.join(f'{t!r}D' for t in target)}) as target_spacing", "crop_size", "intensity_clip", "intensity_mean",
        "intensity_std", "label_coverage", "bbox_percentiles",
    )
