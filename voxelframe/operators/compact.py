"""All feature families of regions inside one tile: a region is one packed row, whatever the number of masks on it.

A region (or a mask on it) of that size travels once and its features are made where it arrives, many regions at once; no matrix,
neighbour or copy of it is shuffled or stored. Results are those of ``texture`` and ``shape`` up to the order of sums. Larger
regions, and those with missing values or places that come twice, stay with the tables there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import shape, texture
from voxelframe.operators.tiles import AXES, HALF_13, TILE_KEYS, TILE_SIZE, tile_index
from voxelframe.session import cut_lineage

CHUNK = 1 << 17  # voxels of all masks that a task measures at once
FIRST = [
    "Energy", "TotalEnergy", "Entropy", "Minimum", "10Percentile", "90Percentile", "Maximum", "Mean", "Median", "InterquartileRange", "Range",
    "MeanAbsoluteDeviation", "RobustMeanAbsoluteDeviation", "RootMeanSquared", "Skewness", "Kurtosis", "Variance", "Uniformity",
]
TONES = ["Coarseness", "Contrast", "Busyness", "Complexity", "Strength"]
MOMENTS = ["VoxelVolume", "MajorAxisLength", "MinorAxisLength", "LeastAxisLength", "Elongation", "Flatness"]
MESH = ["MeshVolume", "SurfaceArea", "SurfaceVolumeRatio", "Sphericity"]


def size_names(family: str) -> list[str]:
    names = texture.SIZE_NAMES[family]
    small, large, unit, size = names["small"], names["large"], names["unit"], names["size"]
    low_high = "" if family == "gldm" else unit
    out = [
        f"{small}Emphasis", f"{large}Emphasis", "GrayLevelNonUniformity", f"{size}NonUniformity", f"{size}NonUniformityNormalized", "GrayLevelVariance",
        f"{unit}Variance", f"{unit}Entropy", f"LowGrayLevel{low_high}Emphasis", f"HighGrayLevel{low_high}Emphasis", f"{small}LowGrayLevelEmphasis",
        f"{small}HighGrayLevelEmphasis", f"{large}LowGrayLevelEmphasis", f"{large}HighGrayLevelEmphasis",
    ]
    return out if family == "gldm" else [*out, "GrayLevelNonUniformityNormalized", f"{unit}Percentage"]


NAMES = {
    "firstorder": FIRST, "glcm": [*texture.GLCM_FEATURES, "MCC"], **{f: size_names(f) for f in ("glrlm", "glszm", "gldm")}, "ngtdm": TONES,
    "shape": [*MOMENTS, *MESH, *shape.DIAMETERS],
}


def split(rows: DataFrame, keys: list[str], fields: list[str], constant: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """Regions as rows with ``cells`` (z, y, x and the fields), and the voxels of regions that do not fit, if there are any;
    fields in ``constant`` have one value in a region that fits."""
    tile = f"struct({', '.join(tile_index(a, s) for a, s in zip(AXES, TILE_SIZE))})"
    missing = " or ".join(f"{c} is null" for c in [*keys, *AXES])
    ends = rows.groupBy(*keys).agg(F.expr(f"min({tile}) < max({tile}) or count(1) > {texture.TILE_VOXELS} or bool_or({missing}) as spread"))
    spread = cut_lineage(ends.where("coalesce(spread, true)").select(*[F.col(k).alias(f"_{k}") for k in keys]))
    rest = None
    if not spread.isEmpty():
        known = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        rows, rest = rows.join(spread, known, "left_anti"), rows.join(spread, known, "left_semi")
    place = "(c.z * 4194304L + c.y) * 1048576L + c.x"
    odd = f"size(array_distinct(transform(cells, c -> {place}))) < size(cells) or exists(cells, c -> {' or '.join(f'c.{f} is null' for f in fields)}) or {' or '.join(['false', *(f'exists(cells, c -> c.{f} <> cells[0].{f})' for f in constant)])} as odd"
    packed = rows.groupBy(*keys).agg(F.expr(f"collect_list(struct({', '.join([*AXES, *fields])})) as cells"))
    packed = cut_lineage(packed.selectExpr(*keys, "cells", odd))
    strange = packed.where("odd")
    if not strange.isEmpty():
        strange = strange.selectExpr(*keys, "inline(cells)")
        rest = strange if rest is None else rest.select(*strange.columns).unionByName(strange)
    return packed.where("not odd").drop("odd"), rest


class Voxels:
    """Voxels of many masks in the order of mask, z, y, x."""

    def __init__(self, of: np.ndarray, at: np.ndarray, level: np.ndarray, value: np.ndarray, tops: np.ndarray):
        self.rows = len(tops)
        low = np.full((3, self.rows), np.iinfo(np.int64).max)
        for axis in range(3):
            np.minimum.at(low[axis], of, at[axis])
        inner = at - low[:, of]
        self.wide = inner.max(axis=1, initial=0) + 3
        ids = ((of * self.wide[0] + inner[0] + 1) * self.wide[1] + inner[1] + 1) * self.wide[2] + inner[2] + 1
        order = np.argsort(ids, kind="stable")
        self.ids, self.of, self.at, self.level, self.value, self.tops = ids[order], of[order], at[:, order], level[order], value[order], tops
        self.kinds, self.code = np.unique(self.level, return_inverse=True)

    def add(self, weights=None, of=None) -> np.ndarray:
        return np.bincount(self.of if of is None else of, weights=weights, minlength=self.rows)

    def neighbour(self, offset: tuple[int, int, int]) -> np.ndarray:
        """Per voxel the place of its neighbour, -1 without one."""
        wanted = self.ids + (offset[0] * self.wide[1] + offset[1]) * self.wide[2] + offset[2]
        spot = np.minimum(np.searchsorted(self.ids, wanted), len(self.ids) - 1)
        return np.where(self.ids[spot] == wanted, spot, -1)


def _firstorder(v: Voxels) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.lexsort((v.value, v.of))
    x, n = v.value[order], v.add()
    starts = np.cumsum(n) - n

    def cut(p: float) -> np.ndarray:
        spot = p * (n - 1)
        low = np.floor(spot).astype(np.int64)
        a, b = x[starts + low], x[starts + np.ceil(spot).astype(np.int64)]
        return a + (b - a) * (spot - low)

    p10, p25, p50, p75, p90 = (cut(p) for p in texture.FIRST_CUTS.values())
    low, high = x[starts], x[starts + n - 1]
    mean = np.where(low == high, low, v.add(v.value) / n)
    gap = v.value - mean[v.of]
    m2, m3, m4 = (v.add(gap**k) for k in (2, 3, 4))
    varied = m2 > 0
    safe = np.where(varied, m2, 1.0)
    middle = (v.value >= p10[v.of]) & (v.value <= p90[v.of])
    inner = v.add(middle.astype(float))
    there = inner > 0
    mid = v.add(np.where(middle, v.value, 0.0)) / np.maximum(inner, 1)
    spots, count = np.unique(v.of * len(v.kinds) + v.code, return_counts=True)
    own = spots // len(v.kinds)
    energy = v.add(v.value**2)
    out = {
        "Energy": energy, "TotalEnergy": energy, "Entropy": np.log2(n) - v.add(count * np.log2(count), own) / n, "Minimum": low, "10Percentile": p10, "90Percentile": p90,
        "Maximum": high, "Mean": mean, "Median": p50, "InterquartileRange": p75 - p25, "Range": high - low, "MeanAbsoluteDeviation": v.add(np.abs(gap)) / n,
        "RobustMeanAbsoluteDeviation": v.add(np.where(middle, np.abs(v.value - mid[v.of]), 0.0)) / np.maximum(inner, 1), "RootMeanSquared": np.sqrt(energy / n),
        "Skewness": np.where(varied, np.sqrt(n) * m3 / safe**1.5, 0.0), "Kurtosis": np.where(varied, n * m4 / safe**2, 0.0), "Variance": m2 / n,
        "Uniformity": v.add(count.astype(float) ** 2, own) / n.astype(float) ** 2,
    }
    return there, [out[name] for name in FIRST]


def _sizes(row: np.ndarray, code: np.ndarray, size: np.ndarray, n: np.ndarray, kinds: np.ndarray, rows: int, family: str) -> list[np.ndarray]:
    """Features of level x size matrices given as cells, each once."""
    def add(weights, of=row):
        return np.bincount(of, weights=weights, minlength=rows)

    def squares(place):
        spots, at = np.unique(place, return_inverse=True)
        return spots, np.bincount(at, weights=n, minlength=len(spots)) ** 2

    i, j, n = kinds[code].astype(float), size.astype(float), n.astype(float)
    t, i1, i2, j1, j2 = add(n), add(n * i), add(n * i * i), add(n * j), add(n * j * j)
    spots, square = squares(row * len(kinds) + code)
    levels = np.bincount(spots // len(kinds), weights=square, minlength=rows)
    most = int(size.max(initial=0)) + 1
    spots, square = squares(row * most + size)
    sizes = np.bincount(spots // most, weights=square, minlength=rows)
    out = [
        add(n / (j * j)) / t, j2 / t, levels / t, sizes / t, sizes / (t * t), i2 / t - (i1 / t) ** 2, j2 / t - (j1 / t) ** 2, np.log2(t) - add(n * np.log2(n)) / t,
        add(n / (i * i)) / t, i2 / t, add(n / (i * i * j * j)) / t, add(n * i * i / (j * j)) / t, add(n * j * j / (i * i)) / t, add(n * i * i * j * j) / t,
    ]
    return out if family == "gldm" else [*out, levels / (t * t), t / j1]


def _cells(row: np.ndarray, code: np.ndarray, size: np.ndarray, kinds: int):
    """The cells of level x size matrices with their counts."""
    most = int(size.max(initial=0)) + 1
    packed, n = np.unique((row * kinds + code) * most + size, return_counts=True)
    rest, size = np.divmod(packed, most)
    return *np.divmod(rest, kinds), size, n


def _tones(v: Voxels, near: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    seen = np.flatnonzero(near > 0)
    spots, place, n = np.unique(v.of[seen] * len(v.kinds) + v.code[seen], return_inverse=True, return_counts=True)
    s = np.bincount(place, weights=np.abs(v.level[seen] - around[seen] / near[seen]), minlength=len(spots))
    own, i = spots // len(v.kinds), v.kinds[spots % len(v.kinds)].astype(float)
    total, present = v.add(n, own), np.bincount(own, minlength=v.rows)
    p = n / total[own]
    sums = np.zeros((4, v.rows))  # over pairs of levels, so many at a time
    last = np.cumsum(present)[own]
    many = last - np.arange(len(own)) - 1  # an unequal pair counts twice, an equal one nothing
    cuts = np.flatnonzero(np.diff(np.cumsum(many) // (1 << 20))) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(own)]):
        a = np.repeat(np.arange(start, stop), many[start:stop])
        b = np.arange(len(a)) - np.repeat(np.cumsum(many[start:stop]) - many[start:stop] - np.arange(start, stop) - 1, many[start:stop])
        gap = np.abs(i[a] - i[b])
        for k, term in enumerate((p[a] * p[b] * gap * gap, np.abs(i[a] * p[a] - i[b] * p[b]), gap * (p[a] * s[a] + p[b] * s[b]) / (p[a] + p[b]), (p[a] + p[b]) * gap * gap)):
            sums[k] += 2 * v.add(term, own[a])
    spread, busy, complexity, strength = sums
    ps, ss = v.add(p * s, own), v.add(s, own)
    there = present > 0
    total = np.maximum(total, 1)
    pairs = np.where(present > 1, present * (present - 1), 1)
    return there, [
        np.where(ps > 0, 1 / np.where(ps > 0, ps, 1), 1e6), np.where(present > 1, spread / pairs * ss / total, 0.0),
        np.where(busy > 1e-12, ps / np.where(busy > 1e-12, busy, 1), 0.0), complexity / total, np.where(ss > 0, strength / np.where(ss > 0, ss, 1), 0.0),
    ]


def _neighbours(v: Voxels, families: tuple[str, ...]) -> dict:
    alike, near, around, pairs = np.ones(len(v.of), dtype=np.int64), np.zeros(len(v.of), dtype=np.int64), np.zeros(len(v.of)), []
    kinds, out, runs = len(v.kinds), {}, []
    zone = np.arange(len(v.of))
    links = []
    for d, offset in enumerate(HALF_13):
        after = v.neighbour(offset)
        a = np.flatnonzero(after >= 0)
        b = after[a]  # no voxel is met twice on one side
        same = v.level[a] == v.level[b]
        alike[a] += same
        alike[b] += same
        near[a] += 1
        near[b] += 1
        around[a] += v.level[b]
        around[b] += v.level[a]
        pairs.append(((v.of[a] * len(HALF_13) + d) * kinds + np.minimum(v.code[a], v.code[b])) * kinds + np.maximum(v.code[a], v.code[b]))
        going = np.full(len(v.of), -1)
        going[a[same]] = b[same]
        links.append(np.stack([a[same], b[same]]))
        if "glrlm" in families:
            first = np.ones(len(v.of), dtype=bool)
            first[b[same]] = False
            start = np.flatnonzero(first)
            end, size = start.copy(), np.ones(len(start), dtype=np.int64)
            on = np.flatnonzero(going[end] >= 0)
            while len(on):
                end[on] = going[end[on]]
                size[on] += 1
                on = on[going[end[on]] >= 0]
            runs.append(np.stack([v.of[start] * len(HALF_13) + d, v.code[start], size]))
    if "glcm" in families:
        packed, n = np.unique(np.concatenate(pairs), return_counts=True)
        rest, hi = np.divmod(packed, kinds)
        rest, lo = np.divmod(rest, kinds)
        present, row = np.unique(rest, return_inverse=True)
        own = present // len(HALF_13)
        many = np.bincount(own, minlength=v.rows)
        names = NAMES["glcm"]
        found = texture.matrix_features(row, v.kinds[lo], v.kinds[hi], n, v.tops[own][row].astype(float), len(present), names) if len(present) else {name: np.zeros(0) for name in names}
        out["glcm"] = many > 0, [v.add(found[name], own) / np.maximum(many, 1) for name in names]
    if "glrlm" in families:
        cells = _cells(*np.concatenate(runs, axis=1), kinds)
        each = _sizes(*cells, v.kinds, v.rows * len(HALF_13), "glrlm")
        out["glrlm"] = np.ones(v.rows, dtype=bool), [e.reshape(v.rows, -1).mean(axis=1) for e in each]
    if "glszm" in families:
        a, b = np.concatenate(links, axis=1)
        while True:  # the least place of a zone travels along its links; places jump to their root's root
            low, before = np.minimum(zone[a], zone[b]), zone.copy()
            for ends in (zone[a], zone[b], a, b):
                np.minimum.at(zone, ends, low)
            zone = zone[zone]
            if (zone == before).all():
                break
        tops, size = np.unique(zone, return_counts=True)
        out["glszm"] = np.ones(v.rows, dtype=bool), _sizes(*_cells(v.of[tops], v.code[tops], size, kinds), v.kinds, v.rows, "glszm")
    if "gldm" in families:
        out["gldm"] = np.ones(v.rows, dtype=bool), _sizes(*_cells(v.of, v.code, alike, kinds), v.kinds, v.rows, "gldm")
    if "ngtdm" in families:
        out["ngtdm"] = _tones(v, near, around)
    return out


def _moments(v: Voxels) -> list[np.ndarray]:
    n = v.add().astype(float)
    s = [v.add(a.astype(float)) / n for a in v.at]
    c = {(i, j): v.add(v.at[i].astype(float) * v.at[j]) / n - s[i] * s[j] for i in range(3) for j in range(i, 3)}
    zz, yy, xx, zy, zx, yx = c[0, 0], c[1, 1], c[2, 2], c[0, 1], c[0, 2], c[1, 2]
    q = (zz + yy + xx) / 3
    p = np.sqrt(((zz - q) ** 2 + (yy - q) ** 2 + (xx - q) ** 2 + 2 * (zy * zy + zx * zx + yx * yx)) / 6)
    det = (zz - q) * ((yy - q) * (xx - q) - yx * yx) - zy * (zy * (xx - q) - yx * zx) + zx * (zy * yx - (yy - q) * zx)
    round_ = p <= 1e-12
    phi = np.where(round_, 0.0, np.arccos(np.clip(det / np.where(round_, 1.0, p) ** 3 / 2, -1, 1)) / 3)
    e1, e3 = q + 2 * p * np.cos(phi), q + 2 * p * np.cos(phi + 2 * np.pi / 3)
    major, minor, least = (np.where(e < shape.TINY, 0.0, e) for e in (e1, 3 * q - e1 - e3, e3))
    safe = np.where(major > 0, major, 1.0)
    return [n, 4 * np.sqrt(major), 4 * np.sqrt(minor), 4 * np.sqrt(least), np.where(major > 0, np.sqrt(minor / safe), 0.0), np.where(major > 0, np.sqrt(least / safe), 0.0)]


def _shape(v: Voxels) -> list[np.ndarray]:
    # Cubes: a voxel adds its bit to the eight around it; places are those of ``ids``, whose rim is free.
    cubes, bits = [], []
    for bit, (z, y, x) in enumerate(shape.CORNERS):
        cubes.append(v.ids - (z * v.wide[1] + y) * v.wide[2] - x)
        bits.append(np.full(len(v.ids), 1 << bit))
    spots, place = np.unique(np.concatenate(cubes), return_inverse=True)
    config = np.bincount(place, weights=np.concatenate(bits)).astype(np.int64)
    rest, x = np.divmod(spots, v.wide[2])
    rest, y = np.divmod(rest, v.wide[1])
    own, z = np.divmod(rest, v.wide[0])
    table = np.zeros((256, 5))
    for row in shape.cube_table():
        table[row[0]] = row[1:]
    area = v.add(table[config, 0], own)
    volume = np.abs(v.add(table[config, 1] + z * table[config, 2] + y * table[config, 3] + x * table[config, 4], own))
    mesh = [volume, area, area / volume, (36 * np.pi * volume * volume) ** (1 / 3) / area]
    points = []
    for axis, step in enumerate(((1, 0, 0), (0, 1, 0), (0, 0, 1))):
        after = v.neighbour(step)
        before = np.ones(len(v.ids), dtype=bool)
        before[after[after >= 0]] = False
        for sign, free in ((1, after < 0), (-1, before)):
            points.append(np.concatenate([v.of[None, free], 2 * v.at[:, free] + sign * np.array(step)[:, None]]))
    of, *at = np.concatenate(points, axis=1)
    at = np.stack(at)
    ends = []
    for kind, (a, b) in enumerate(((1, 2), (2, 1))):  # lines along x in (z, y), along y in (z, x)
        order = np.lexsort((at[b], at[a], at[0], of))
        line = np.stack([of, at[0], at[a]])[:, order]
        new = (line[:, 1:] != line[:, :-1]).any(axis=0)
        picked = np.unique(np.concatenate([order[np.concatenate([[True], new])], order[np.concatenate([new, [True]])]]))
        ends.append(np.concatenate([of[None, picked], np.full((1, len(picked)), kind), at[:, picked]]))
    ends = np.concatenate(ends, axis=1)
    ends = ends[:, np.argsort(ends[0], kind="stable")]
    return [*_moments(v), *mesh, *shape.line_distances(ends[0], ends[1], ends[2:], v.rows)]


def measured(v: Voxels, families: tuple[str, ...]) -> np.ndarray:
    """All features of the families (mask, feature), NaN where a mask has none of a family."""
    found = _neighbours(v, families) if set(families) - {"firstorder", "shape"} else {}
    if "firstorder" in families:
        found["firstorder"] = _firstorder(v)
    if "shape" in families:
        found["shape"] = np.ones(v.rows, dtype=bool), _shape(v)
    return np.stack([np.where(found[f][0], value, np.nan) for f in families for value in found[f][1]], axis=1)


def feature_values(packed: DataFrame, keys: list[str], families: tuple[str, ...], fields: list[str], masks: Callable, count: int = 1) -> DataFrame:
    """keys and ``found``: the features of the families, each for all ``count`` masks of the region, NULL where there is none.

    ``masks`` makes of the cells of some regions (their number, region, place and fields of a voxel): mask, region x count + number,
    and voxel of every mask, with level, and the number of levels by mask.
    """
    wide = sum(len(NAMES[f]) for f in families)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cells")
            sizes = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = cells.flatten()
            at = np.stack([flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            more = [flat.field(3 + i).to_numpy(zero_copy_only=False) for i in range(len(fields))]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            parts = np.flatnonzero(np.diff(upto[1:] * count // CHUNK)) + 1
            for first, last in zip([0, *parts], [*parts, len(sizes)]):
                here = slice(upto[first], upto[last])
                of = np.repeat(np.arange(last - first), sizes[first:last])
                mask, voxel, level, tops = masks(last - first, of, *[m[here] for m in more])
                out = np.full((len(tops), wide), np.nan)
                seen, own = np.unique(mask, return_inverse=True)
                value = more[0][here].astype(np.float64)
                if len(seen):
                    out[seen] = measured(Voxels(own, at[:, here][:, voxel], level.astype(np.int64), value[voxel], tops[seen]), families)
                values = out.reshape(last - first, count, wide).swapaxes(1, 2).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1) * wide * count, pa.int32()), pa.array(values, mask=np.isnan(values)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(first, last - first) for k in keys], lists], names=[*keys, "found"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema)
    return packed.select(*keys, "cells").mapInArrow(work, f"{ddl}, found array<double>")


def named(families: tuple[str, ...], value: str, prefix: str = "'original'") -> str:
    """SQL: rows (feature, and what ``value`` makes of its place i) of the features in ``found``."""
    return f"inline(transform(array({', '.join(f'{chr(39)}_{f}_{n}{chr(39)}' for f in families for n in NAMES[f])}), (n, i) -> named_struct('feature', concat({prefix}, n), {value})))"


def region_rows(regions: DataFrame, keys: list[str], families: tuple[str, ...], prefix: str = "'original'") -> tuple[DataFrame, DataFrame | None]:
    """keys, feature, value of regions with levels, and the voxels of those that do not fit, if there are any."""
    fields = ["intensity" if "intensity" in regions.columns else "level", "level", *(["n_levels"] if "n_levels" in regions.columns else [])]
    named_fields = [f"{f} as _{i}" for i, f in enumerate(fields)]
    packed, rest = split(regions.selectExpr("*", *named_fields), keys, [f"_{i}" for i in range(len(fields))], ("_2",) if len(fields) > 2 else ())

    def masks(count, of, value, level, tops=None):
        return of, np.arange(len(of)), level, np.ones(count) if tops is None else tops[np.searchsorted(of, np.arange(count))]

    wide = feature_values(packed, keys, families, [f"_{i}" for i in range(len(fields))], masks)
    long = wide.selectExpr(*keys, named(families, "'value', found[i]", prefix)).where("value is not null")
    return long, None if rest is None else rest.selectExpr(*keys, *AXES, *{f: f"_{i} as {f}" for i, f in enumerate(fields)}.values())
