"""Grid geometry on voxel rows: boxes, crops, orientation, resampling, padding."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.tiles import AXES, TILE_KEYS, TILE_SIZE, partitions, tile_index
from voxelframe.session import cut_lineage

PAD_MULTIPLE = 8
SMALLEST_CROP = 32


def label_bbox(voxels: DataFrame, keys: list[str] = ("case_id", "label_id")) -> DataFrame:
    """Tight half-open box per region: z0, z1, y0, y1, x0, x1."""
    ends = [F.expr(e) for a in AXES for e in (f"min({a}) as {a}0", f"max({a}) + 1 as {a}1")]
    return voxels.where("label_id > 0").groupBy(*keys).agg(*ends)


def crop_voxels(voxels: DataFrame, boxes: DataFrame, margin: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Voxels inside each region's box plus margin, re-based to the box; ``inside`` tells the region itself.

    Coordinates below zero do not exist and a margin beyond the far side finds no voxels, so the clamp is implicit.
    Boxes and voxels meet on (case, tile): a voxel sees only boxes that touch its tile, and a large case is spread.
    """
    wide = boxes.selectExpr(
        "case_id", "label_id as region",
        *[f"greatest(0, {a}0 - {m}) as {a}0" for a, m in zip(AXES, margin)],
        *[f"{a}1 + {m} as {a}1" for a, m in zip(AXES, margin)],
    )
    for axis, key, size in zip(AXES, TILE_KEYS, TILE_SIZE):
        wide = wide.selectExpr("*", f"explode(sequence(cast({axis}0 div {size} as int), cast(({axis}1 - 1) div {size} as int))) as {key}")
    placed = voxels.selectExpr("*", *[f"cast({tile_index(a, s)} as int) as {k}" for a, s, k in zip(AXES, TILE_SIZE, TILE_KEYS)])
    hit = " and ".join(f"{a} >= {a}0 and {a} < {a}1" for a in AXES)
    rows = placed.join(wide, ["case_id", *TILE_KEYS]).where(hit)
    return rows.selectExpr(
        "case_id", "region as label_id", *[f"{a} - {a}0 as {a}" for a in AXES], "intensity",
        "int(label_id = region) as inside",
    )


def margin_voxels(spacing: str, millimetres: float) -> str:
    """SQL: voxels per axis that cover a margin in millimetres."""
    return f"transform({spacing}, s -> cast(ceil({float(millimetres)}D / s) as int))"


def next_multiple(value: str, multiple: int = PAD_MULTIPLE, smallest: int = SMALLEST_CROP) -> str:
    """SQL: value rounded up to a multiple, with a floor."""
    return f"cast(greatest({smallest}, ceil({value} / {float(multiple)}D) * {multiple}) as int)"


def reorient(voxels: DataFrame, order: str = "axis_order", flips: str = "axis_flips", shape: str = "shape") -> DataFrame:
    """Permute and flip axes by a per-case code: ``order[i]`` is the old axis that becomes new axis i."""
    old = "array(z, y, x)"
    moved = [
        f"if({flips}[{i}], {shape}[{order}[{i}]] - 1 - {old}[{order}[{i}]], {old}[{order}[{i}]]) as {a}"
        for i, a in enumerate(AXES)
    ]
    rest = [c for c in voxels.columns if c not in (*AXES, order, flips, shape)]
    return voxels.selectExpr(*rest, *moved)


def new_size(size: str, spacing: str, target: float) -> str:
    """SQL: voxels along an axis after resampling (half rounds to even, at least one)."""
    return f"greatest(1, cast(bround({size} * {spacing} / {float(target)}D) as int))"


def resample_nearest(voxels: DataFrame, target: tuple[float, float, float], values: list[str]) -> DataFrame:
    """Nearest-neighbour resampling; needs ``shape`` and ``spacing`` on every row. Positions outside become 0.

    Each source voxel emits the target positions that round to it, so there is neither a grid nor a join.
    """
    out = voxels
    for i, axis in enumerate(AXES):
        size, sp, step = f"shape[{i}]", f"spacing[{i}]", f"{float(target[i])}D"
        count = new_size(size, sp, target[i])
        low = f"greatest(0, cast(floor(({axis} - 0.5D) * {sp} / {step}) as int) - 1)"
        high = f"if({axis} = {size} - 1, {count} - 1, least({count} - 1, cast(ceil(({axis} + 0.5D) * {sp} / {step}) as int) + 1))"
        source = f"cast(floor(k * {step} / {sp} + 0.5D) as int)"
        keep = f"least({source}, {size} - 1) = {axis}"
        near = f"filter(if({high} >= {low}, sequence({low}, {high}), array()), k -> {keep})"
        cell = f"transform({near}, k -> named_struct('k{axis}', k, 'in{axis}', k * {step} / {sp} < {size} - 0.5D))"
        out = out.selectExpr("*", f"inline({cell})")
    kept = [c for c in voxels.columns if c not in (*AXES, *values, "shape", "spacing")]
    inside = " and ".join(f"in{a}" for a in AXES)
    return out.selectExpr(
        *kept, *[f"k{a} as {a}" for a in AXES], *[f"if({inside}, {v}, cast(0 as {dict(voxels.dtypes)[v]})) as {v}" for v in values]
    )


def lost_regions(voxels: DataFrame, kept: DataFrame, target: tuple[float, float, float]) -> DataFrame:
    """case_id, label_id, z, y, x: for every region of ``voxels`` (with ``shape`` and ``spacing``) that ``kept`` lacks, the target
    position nearest to one of its voxels. A region thinner than a step of the target grid may lie between its positions."""
    ends = [f"{new_size(f'shape[{i}]', f'spacing[{i}]', t)} - 1" for i, t in enumerate(target)]
    spots = [f"least({end}, cast(bround({a} * spacing[{i}] / {float(t)!r}D) as int)) as p{a}" for i, (a, t, end) in enumerate(zip(AXES, target, ends))]
    gap = " + ".join(f"power({a} * spacing[{i}] - p{a} * {float(t)!r}D, 2)" for i, (a, t) in enumerate(zip(AXES, target)))
    shown, region = voxels.where("label_id > 0"), ["case_id", "label_id"]
    # Stored, so that Spark knows how few they are before it joins them with all voxels.
    lost = cut_lineage(shown.select(*region).distinct().join(kept.select(*region), region, "left_anti"))
    placed = shown.join(lost, region).selectExpr("*", *spots).groupBy(*region).agg(F.expr(f"min_by(struct(pz, py, px), struct({gap}, z, y, x)) as at"))
    return cut_lineage(placed.selectExpr(*region, *[f"at.p{a} as {a}" for a in AXES]))


@lru_cache(maxsize=64)
def _spline_weights(n: int, spacing: float, target: float) -> np.ndarray:
    """Cubic B-spline through a line of n values with mirrored ends, sampled at a new spacing and 0 outside the line, as the
    matrix (samples x n) by which the values are multiplied."""
    m = max(1, int(np.round(n * spacing / target)))
    system = np.eye(n)
    if n > 1:
        system = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
        system[0, 1] = system[-1, -2] = 2.0
        system /= 6.0
    at = np.arange(m) * target / spacing
    base = np.floor(at).astype(int)
    taps = np.zeros((m, n))
    for tap in range(-1, 3):
        distance = np.abs(at - (base + tap))
        weight = np.where(distance < 1, 2 / 3 - distance**2 + distance**3 / 2, np.where(distance < 2, (2 - distance) ** 3 / 6, 0))
        index = np.abs(base + tap)
        if n > 1:
            period = 2 * (n - 1)
            index = index % period
            index = np.where(index >= n, period - index, index)
        else:
            index = np.zeros_like(index)
        np.add.at(taps, (np.arange(m), index), weight)
    taps[at >= n - 0.5] = 0.0
    return np.linalg.solve(system.T, taps.T).T


def _spline_lines(lines: pa.ListArray, spacing: np.ndarray, target: float) -> pa.ListArray:
    """All lines of a batch at the new spacing; those of one length and spacing share one product."""
    sizes = lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lines.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(sizes) - sizes
    kinds, which = np.unique(np.stack([sizes.astype(float), spacing.astype(float)], axis=1), axis=0, return_inverse=True)
    weights = [_spline_weights(int(n), float(s), float(target)) for n, s in kinds]
    new = np.array([len(w) for w in weights], dtype=np.int64)[which.ravel()]
    ends = np.concatenate([[0], np.cumsum(new)])
    out = np.empty(ends[-1])
    for k, w in enumerate(weights):
        rows = np.flatnonzero(which.ravel() == k)
        values = flat[starts[rows][:, None] + np.arange(w.shape[1])]
        out[ends[:-1][rows][:, None] + np.arange(w.shape[0])] = values @ w.T
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def resample_spline(voxels: DataFrame, target: tuple[float, float, float], value: str = "intensity") -> DataFrame:
    """Cubic B-spline resampling, one axis after another; the unit of work is a line of voxels, never a volume."""
    out = voxels.select("case_id", *AXES, "spacing", F.col(value).cast("double").alias("v"))
    for i, axis in enumerate(AXES):
        rest = [a for a in AXES if a != axis]
        spread = out.repartition(partitions(out), "case_id", *rest, "spacing")  # few bytes, much work
        lines = spread.groupBy("case_id", *rest, "spacing").agg(
            F.expr(f"transform(array_sort(collect_list(struct({axis}, v))), c -> c.v) as v")
        )

        def resampled(batches, i=i):
            for batch in batches:
                if batch.num_rows:
                    steps = batch.column("spacing").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    done = _spline_lines(batch.column("v"), steps[:, i], target[i])
                    yield batch.set_column(batch.schema.get_field_index("v"), "v", done)

        kept = ["case_id", *rest, "spacing"]
        out = lines.select(*kept, "v").mapInArrow(resampled, lines.select(*kept, "v").schema)
        out = out.selectExpr(*kept, f"posexplode(v) as ({axis}, v)")
    return out.select("case_id", *AXES, F.col("v").alias(value))


def pad_batch(crops: DataFrame, batch: str = "batch") -> DataFrame:
    """Crop rows (batch, case_id, label_id, shape, image) padded with trailing zeros to the largest shape of the batch."""
    top = crops.groupBy(batch).agg(*[F.expr(f"max(shape[{i}]) as m{i}") for i in range(3)])
    rows = crops.join(top, batch)
    old = "(k div (m1 * m2)) * shape[1] * shape[2] + ((k div m2) % m1) * shape[2] + k % m2"
    fits = "k div (m1 * m2) < shape[0] and (k div m2) % m1 < shape[1] and k % m2 < shape[2]"
    image = f"transform(sequence(0, m0 * m1 * m2 - 1), k -> if({fits}, image[int({old})], 0D))"
    return rows.selectExpr(batch, "case_id", "label_id", "array(m0, m1, m2) as shape", f"{image} as image")


def shape_mismatch(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases whose image and label grids differ."""
    pair = images.selectExpr("case_id", "shape as image_shape").join(labels.selectExpr("case_id", "shape as label_shape"), "case_id")
    return pair.where("image_shape <> label_shape")


def median_slice(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Median foreground slice per group, the middle slice if there is no foreground.

    Counted per slice first: the window sees one row per slice, not one per voxel.
    """
    slices = voxels.groupBy(*keys, "z").agg(F.expr("count_if(label_id > 0) as n"))
    per = f"over (partition by {', '.join(keys)}"
    ranked = slices.selectExpr(*keys, "z", "n", f"sum(n) {per} order by z) as upto", f"sum(n) {per}) as total", f"max(z) {per}) + 1 as depth")
    spot = "total > 0 and upto - n <= {0} and {0} < upto"
    low, high = spot.format("(total - 1) div 2"), spot.format("total div 2")
    ends = ranked.groupBy(*keys).agg(
        F.expr(f"max(if({low}, z, null)) as lo"), F.expr(f"max(if({high}, z, null)) as hi"), F.expr("max(depth) as depth")
    )
    return ends.selectExpr(*keys, "cast(coalesce(floor((lo + hi) / 2.0D), depth div 2) as int) as slice")
