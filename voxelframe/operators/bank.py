"""Filter bank of cases that fill one tile at most: all channels of many cases at once, one shuffle and no join.

A case travels as one row of bounded size. Every filter is separable and becomes one small matrix per axis, so results are
those of ``filters.filter_bank`` up to the order of sums. Larger cases, and cases with gaps, stay with the lines there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.filters import CENTRE_TAP, COIF1_HIGH, COIF1_LOW, gaussian_taps
from voxelframe.operators.tiles import AXES, TILE_SIZE
from voxelframe.session import cut_lineage

CHUNK = 1 << 18  # voxels whose channels a task holds at once
STATS = ["mean", "energy", "contrast", "homogeneity", "correlation"]


def split(voxels: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Cases as rows with ``cells`` (z, y, x, intensity, inside), and the voxels of cases that do not fit, if there are any."""
    fits = " and ".join([*[f"min({a}) = 0 and max({a}) < {n}" for a, n in zip(AXES, TILE_SIZE)],
                         f"count(1) = {' * '.join(f'(max({a}) + 1)' for a in AXES)}", "count(intensity) = count(1)", "count_if(inside in (0, 1)) = count(1)"])
    spread = cut_lineage(voxels.groupBy(*keys).agg(F.expr(f"coalesce({fits}, false) as fits")).where("not fits").select(*keys))
    rest = None
    if not spread.isEmpty():
        known = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        spread = spread.select(*[F.col(k).alias(f"_{k}") for k in keys])
        voxels, rest = voxels.join(spread, known, "left_anti"), voxels.join(spread, known, "left_semi")
    cell = ", ".join([*[f"'{a}', int({a})" for a in AXES], "'intensity', double(intensity)", "'inside', int(inside)"])
    return voxels.groupBy(*keys).agg(F.expr(f"collect_list(named_struct({cell})) as cells")), rest


def _wrapped(taps: list[float], n: int, dilation: int) -> np.ndarray:
    out, m = np.zeros((n, n)), n + n % 2
    for i, t in enumerate(taps):
        for k in range(n):
            out[k, (k + (CENTRE_TAP - i) * dilation) % m % n] += t
    return out


def _clamped(taps: list[float], n: int) -> np.ndarray:
    out, radius = np.zeros((n, n)), len(taps) // 2
    for i, t in enumerate(taps):
        for k in range(n):
            out[k, min(n - 1, max(0, k + i - radius))] += t
    return out


def _along(matrix: np.ndarray, images: np.ndarray, axis: int) -> np.ndarray:
    return np.moveaxis(np.tensordot(images, matrix, (axis, 1)), -1, axis)


def channels(images: np.ndarray, sigmas=(1.0, 2.0, 3.0), levels: int = 1, gradient: bool = True, spacing=(1.0, 1.0, 1.0)) -> dict[str, np.ndarray]:
    """Channels of images (case, z, y, x) of one shape."""
    sizes, out, low = images.shape[1:], {"image": images}, images
    for level in range(levels):
        bands = {"": low}
        for axis, n in enumerate(sizes, 1):
            a, d = (_wrapped(taps, n, 2**level) for taps in (COIF1_LOW, COIF1_HIGH))
            bands = {name + side: _along(m, band, axis) for name, band in bands.items() for side, m in (("a", a), ("d", d))}
        low, suffix = bands["aaa"], "" if levels == 1 else f"_l{level + 1}"
        out |= {f"swt_{name}{suffix}": band for name, band in bands.items() if name != "aaa" or level == levels - 1}
    for sigma in sigmas:
        (gz, hz), (gy, hy), (gx, hx) = ([_clamped(t, n) for t in gaussian_taps(sigma, step)] for n, step in zip(sizes, spacing))
        smooth, second = _along(gz, images, 1), _along(hz, images, 1)
        curved = _along(gy, second, 2) + _along(hy, smooth, 2)
        out[f"log_{sigma:g}"] = sigma * sigma * (_along(gx, curved, 3) + _along(hx, _along(gy, smooth, 2), 3))
    if gradient:
        slopes = [_along(_clamped([-0.5 / step, 0.0, 0.5 / step], n), images, axis) for axis, (n, step) in enumerate(zip(sizes, spacing), 1)]
        out["gradient"] = np.sqrt(sum(s * s for s in slopes))
    return out


def _chunks(batch: pa.RecordBatch, mask_mode: str, **bank):
    """(rows of the batch, channel names, values (row, channel, voxel), inside (row, voxel)), voxels in z, y, x order."""
    cells = batch.column("cells")
    row = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
    z, y, x, value, inside = (cells.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(5))
    order = np.lexsort((x, y, z, row))
    starts = np.searchsorted(row, np.arange(len(cells)))
    shapes = np.stack([np.maximum.reduceat(a, starts) + 1 for a in (z, y, x)], axis=1)
    value, inside = value[order], inside[order]
    for shape in np.unique(shapes, axis=0):
        n, rows = int(shape.prod()), np.flatnonzero((shapes == shape).all(axis=1))
        step = max(1, CHUNK // n)
        for part in (rows[i:i + step] for i in range(0, len(rows), step)):
            at = starts[part][:, None] + np.arange(n)
            images = np.where(inside[at] == 1, value[at], 0.0) if mask_mode == "zero" else value[at]
            found = channels(images.reshape(-1, *shape), **bank)
            yield part, list(found), np.stack([c.reshape(len(part), n) for c in found.values()], axis=1), inside[at]


def _texture(values: np.ndarray, inside: np.ndarray, bins: int = 32) -> np.ndarray:
    """Energy, contrast, homogeneity, correlation (row, channel, 4), as ``filters.sequence_texture`` has them."""
    rows, kinds = values.shape[:2]
    row, at = np.nonzero(inside)
    seen = values[row, :, at]
    n = inside.sum(axis=1)
    full = np.flatnonzero(n > 0)
    lo, hi = np.zeros((rows, kinds)), np.zeros((rows, kinds))
    if len(full):
        starts = np.searchsorted(row, full)
        lo[full], hi[full] = np.minimum.reduceat(seen, starts), np.maximum.reduceat(seen, starts)
    low, width = lo[row], hi[row] - lo[row]
    varied = width > 0
    guess = np.clip(np.floor((seen - low) / np.where(varied, width, 1.0) * bins), 0, bins - 1).astype(np.int64)
    step = width / bins
    moved = guess - ((guess > 0) & (seen < low + guess * step)) + ((guess < bins - 1) & (seen >= low + (guess + 1) * step))
    pair = row[1:] == row[:-1]
    i, j = np.minimum(moved[:-1], moved[1:])[pair], np.maximum(moved[:-1], moved[1:])[pair]
    group = row[1:][pair][:, None] * kinds + np.arange(kinds)

    def total(weights):
        return np.bincount(group.ravel(), weights.ravel(), rows * kinds)

    links = np.maximum(total(np.ones(i.shape)), 1)
    cells, count = np.unique((group * bins + i) * bins + j, return_counts=True)
    twin = cells // bins % bins == cells % bins
    squares = np.bincount(cells // bins**2, np.where(twin, 1.0, 0.5) * count.astype(float) ** 2, rows * kinds)
    mean = total((i + j) / 2) / links
    spread = total((i * i + j * j) / 2) / links - mean**2
    bent = np.sqrt(np.maximum(spread, 0)) >= 1e-8
    together = np.where(bent, (total(i * j) / links - mean**2) / np.where(bent, spread, 1.0), 0.0)
    out = np.stack([squares / links**2, total((i - j) ** 2) / links, total(1 / (1.0 + j - i)) / links, together], axis=1).reshape(rows, kinds, 4)
    out[hi == lo] = (1.0, 0.0, 1.0, 0.0)
    out[n < 4] = 0.0
    return out


def features(packed: DataFrame, keys: list[str], mask_mode: str = "zero", **bank) -> DataFrame:
    """keys, channel, stat, value of packed cases: masked mean and sequence texture of values rounded to 8 places."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, names, values, inside in _chunks(batch, mask_mode, **bank):
                values = np.sign(values) * np.floor(np.abs(values) * 1e8 + 0.5) / 1e8
                n = inside.sum(axis=1)
                means = (values * inside[:, None]).sum(axis=2) / np.maximum(n, 1)[:, None]
                table = np.concatenate([means[:, :, None], _texture(values, inside)], axis=2)
                wanted = np.ones(table.shape, dtype=bool)
                wanted[n == 0, :, 1:] = False  # a case without a region has no texture
                r, c, s = np.nonzero(wanted)
                ids = pa.array(part[r])
                columns = [batch.column(k).take(ids) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names).take(pa.array(c)), pa.array(STATS).take(pa.array(s)), pa.array(table[r, c, s])], names=[*keys, "channel", "stat", "value"])

    return packed.mapInArrow(work, f"{_ddl(packed, keys)}, channel string, stat string, value double")


def arrays(packed: DataFrame, keys: list[str], mask_mode: str = "zero", **bank) -> DataFrame:
    """keys, channel, values (floats in z, y, x order) of packed cases."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, names, values, _ in _chunks(batch, mask_mode, **bank):
                rows, kinds, n = values.shape
                ids = pa.array(np.repeat(part, kinds))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows * kinds + 1) * n, pa.int32()), pa.array(values.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(ids) for k in keys], pa.array(names * rows), lists], names=[*keys, "channel", "values"])

    return packed.mapInArrow(work, f"{_ddl(packed, keys)}, channel string, values array<float>")


def region_voxels(packed: DataFrame, keys: list[str], mask_mode: str = "zero", **bank) -> DataFrame:
    """keys, z, y, x, channel, value of the region's voxels of packed cases; values are rounded to 8 places."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cells")
            sizes = cells.value_lengths().to_numpy(zero_copy_only=False)
            ends = [np.maximum.reduceat(cells.flatten().field(i).to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes) + 1 for i in range(3)]
            for part, names, values, inside in _chunks(batch, mask_mode, **bank):
                values = np.sign(values) * np.floor(np.abs(values) * 1e8 + 0.5) / 1e8
                row, spot = np.nonzero(inside)
                at = np.unravel_index(spot, [int(e[part[0]]) for e in ends])  # cases of a chunk have one shape
                many = inside.sum(axis=1).astype(np.int64)
                places = [pa.array(np.repeat(np.arange(len(part)), many * len(names)))]
                order = np.argsort(np.tile(row, len(names)), kind="stable")  # case by case, its channels one after the other
                flat = [pa.array(np.tile(a, len(names))[order].astype(np.int32)) for a in at] + [pa.array(values[row, :, spot].T.ravel()[order])]
                ids = pa.array(part).take(places[0])
                channel = np.repeat(np.arange(len(names)), len(row))[order]
                columns = [batch.column(k).take(ids) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, *flat[:3], pa.array(names).take(pa.array(channel)), flat[3]], names=[*keys, *AXES, "channel", "value"])

    return packed.mapInArrow(work, f"{_ddl(packed, keys)}, z int, y int, x int, channel string, value double")


def _ddl(packed: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema)
