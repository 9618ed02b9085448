"""Shape of a region: moments, surface mesh, diameters. Voxels count as 1 mm cubes."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators.tiles import AXES

CORNERS = list(product((0, 1), repeat=3))  # bit i of a cube configuration is corner i, in z, y, x
TINY = 1e-6  # eigenvalues below this are zero: lattice regions have none between


def moments(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Voxel volume and principal axes from the population covariance of the coordinates."""
    pairs = [("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x")]
    sums = regions.groupBy(*keys).agg(
        F.expr("count(1) as n"), *[F.expr(f"sum(cast({a} as bigint)) as s{a}") for a in AXES],
        *[F.expr(f"sum(cast({a} as bigint) * {b}) as s{a}{b}") for a, b in pairs],
    )
    cov = sums.selectExpr(*keys, "n", *[f"s{a}{b} / n - (s{a} / n) * (s{b} / n) as c{a}{b}" for a, b in pairs])
    cov = cov.selectExpr("*", "(czz + cyy + cxx) / 3 as q").selectExpr(
        "*", "sqrt((power(czz - q, 2) + power(cyy - q, 2) + power(cxx - q, 2) + 2 * (czy * czy + czx * czx + cyx * cyx)) / 6) as p"
    )
    det = "((czz - q) * ((cyy - q) * (cxx - q) - cyx * cyx) - czy * (czy * (cxx - q) - cyx * czx) + czx * (czy * cyx - (cyy - q) * czx))"
    cov = cov.selectExpr("*", f"if(p > 1e-12D, acos(greatest(-1D, least(1D, {det} / power(p, 3) / 2))) / 3, 0D) as phi")
    cov = cov.selectExpr(*keys, "n", "q", "q + 2 * p * cos(phi) as e1", "q + 2 * p * cos(phi + 2 * pi() / 3) as e3")
    zero = "if({0} < 1e-6D, 0D, {0})"
    eigen = cov.selectExpr(
        *keys, "n", f"{zero.format('e1')} as major", f"{zero.format('3 * q - e1 - e3')} as minor", f"{zero.format('e3')} as least_"
    )
    return eigen.selectExpr(
        *keys, "cast(n as double) as VoxelVolume", "4 * sqrt(major) as MajorAxisLength", "4 * sqrt(minor) as MinorAxisLength",
        "4 * sqrt(least_) as LeastAxisLength", "if(major > 0, sqrt(minor / major), 0D) as Elongation",
        "if(major > 0, sqrt(least_ / major), 0D) as Flatness",
    )


def _cube_loops(config: int) -> list[list[np.ndarray]]:
    """Closed polygons through edge midpoints that separate inside from outside corners of one cube.

    On every face each inside corner pair or single corner is cut off on its own, so neighbouring cubes agree on
    their shared face; polygons run with the inside on a fixed side.
    """
    inside = {c for i, c in enumerate(CORNERS) if config >> i & 1}
    following: dict[tuple, tuple] = {}
    for axis in range(3):
        u, v = [(1, 2), (2, 0), (0, 1)][axis]
        for side in (0, 1):
            ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
            if side == 0:
                ring = ring[::-1]
            corners = []
            for a, b in ring:
                corner = [0, 0, 0]
                corner[axis], corner[u], corner[v] = side, a, b
                corners.append(tuple(corner))
            # Walking round the face seen from outside: a cut starts where the walk leaves the inside and ends where it entered.
            for k in range(4):
                here, after = corners[k], corners[(k + 1) % 4]
                if here in inside and after not in inside:
                    back = k
                    while corners[back - 1] in inside:
                        back -= 1
                    entry = (corners[back - 1], corners[back])
                    key = tuple((p + q) / 2 for p, q in zip(here, after))
                    following[key] = tuple((p + q) / 2 for p, q in zip(*entry))
    loops = []
    while following:
        start, spot = next(iter(following.items()))
        loop = [start]
        del following[start]
        while spot != start:
            loop.append(spot)
            spot = following.pop(spot)
        loops.append([np.array(p) for p in loop])
    return loops


def cube_table() -> list[tuple[int, float, float, float, float, float]]:
    """Per configuration: surface area, signed volume about the cube's origin, and the sum of normals (z, y, x).

    Loops with more than three points are fanned out from their centre.
    """
    rows = []
    for config in range(1, 255):
        area, volume, normal = 0.0, 0.0, np.zeros(3)
        for loop in _cube_loops(config):
            centre = loop[0] if len(loop) == 3 else sum(loop) / len(loop)
            for a, b in zip(loop, loop[1:] + loop[:1]):
                cross = np.cross(a - centre, b - centre)
                area += float(np.linalg.norm(cross)) / 2
                normal += np.cross(a, b) + np.cross(b, centre) + np.cross(centre, a)
                volume += float(np.dot(centre, np.cross(a, b)))
        rows.append((config, area, volume / 6, *(float(n) / 6 for n in normal)))
    return rows


def mesh(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Surface area and enclosed volume. A voxel adds its bit to the eight cubes around it; cubes of one
    configuration are counted with their coordinate sums, and only those counts meet the 254-row table."""
    spark: SparkSession = regions.sparkSession
    bits = ", ".join(
        f"named_struct('dz', {1 - z}, 'dy', {1 - y}, 'dx', {1 - x}, 'bit', {1 << CORNERS.index((z, y, x))})"
        for z, y, x in CORNERS
    )
    cubes = regions.select(*keys, *AXES).selectExpr("*", f"inline(array({bits}))").selectExpr(
        *keys, "z + dz as z", "y + dy as y", "x + dx as x", "bit"
    )
    cubes = cubes.groupBy(*keys, *AXES).agg(F.expr("sum(bit) as config"))
    counted = cubes.where("config < 255").groupBy(*keys, "config").agg(
        F.expr("count(1) as n"), *[F.expr(f"sum(cast({a} - 1 as bigint)) as s{a}") for a in AXES]
    )
    table = spark.createDataFrame(cube_table(), "config bigint, area double, volume double, nz double, ny double, nx double")
    sums = counted.join(F.broadcast(table), "config").groupBy(*keys).agg(  # 254 rows
        F.expr("sum(n * area) as SurfaceArea"), F.expr("abs(sum(n * volume + sz * nz + sy * ny + sx * nx)) as MeshVolume")
    )
    return sums.selectExpr(
        *keys, "MeshVolume", "SurfaceArea", "SurfaceArea / MeshVolume as SurfaceVolumeRatio",
        "power(36 * pi() * MeshVolume * MeshVolume, 1 / 3D) / SurfaceArea as Sphericity",
    )


def surface_points(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Mesh vertices in half voxels: midpoints of steps from an inside voxel to an outside one."""
    steps = ", ".join(
        f"named_struct('dz', {z}, 'dy', {y}, 'dx', {x})"
        for z, y, x in [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    )
    mids = regions.select(*keys, *AXES).selectExpr("*", f"inline(array({steps}))").selectExpr(
        *keys, "2 * z + dz as z", "2 * y + dy as y", "2 * x + dx as x"
    )
    return mids.groupBy(*keys, *AXES).agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of integer points in the plane."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    chains = []
    for ordered in (points, points[::-1]):
        chain: list = []
        for p in ordered.tolist():
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chains.extend(chain[:-1])
    return np.array(chains)


def _farthest(points: np.ndarray, block: int = 2048) -> float:
    best = 0
    for start in range(0, len(points), block):
        part = points[start:start + block]
        gaps = sum((part[:, k][:, None] - points[:, k][None, :]) ** 2 for k in range(points.shape[1]))
        best = max(best, int(gaps.max()))
    return math.sqrt(best) / 2


DIAMETERS = ["Maximum3DDiameter", "Maximum2DDiameterSlice", "Maximum2DDiameterColumn", "Maximum2DDiameterRow"]
FEW = 512  # line ends of a region up to which all distances are taken, many regions at once
PAIRS = 1 << 22  # distances a task holds at a time


def _all_distances(of: np.ndarray, points: np.ndarray, rows: int, planes: tuple[int, ...]) -> list[np.ndarray]:
    """Per region the largest squared distance of any two of its points (z, y, x), and of two that agree in an axis of ``planes``."""
    near = points.max(initial=0) - points.min(initial=0) < 1 << 14  # squares fit into 32 bits
    points = points.astype(np.int32 if near else np.int64)
    best = [np.zeros(rows, dtype=np.int64) for _ in range(1 + len(planes))]
    sizes = np.bincount(of, minlength=rows)
    later = np.cumsum(sizes)[of] - np.arange(len(of))  # itself and the points of its region that follow
    cuts = np.flatnonzero(np.diff(np.cumsum(later) // PAIRS)) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(of)]):
        many = later[start:stop]
        heads = np.cumsum(many) - many
        a = np.repeat(np.arange(start, stop), many)
        b = np.arange(len(a)) - np.repeat(heads - np.arange(start, stop), many)
        gaps = points[:, a] - points[:, b]
        total = (gaps * gaps).sum(axis=0, dtype=points.dtype)
        for top, found in zip(best, (total, *(total * (gaps[axis] == 0) for axis in planes))):
            np.maximum.at(top, of[start:stop], np.maximum.reduceat(found, heads))
    return best


def _hull_distances(kind: np.ndarray, points: np.ndarray) -> list[float]:
    """The four diameters of one region of any size, by the hulls of its planes."""
    z, y, x = points

    def planes(of: np.ndarray, a: np.ndarray, b: np.ndarray, pick: np.ndarray):
        of, flat = of[pick], np.stack([a[pick], b[pick]], axis=1)
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order])) + 1
        return [(of[part[0]], _hull(flat[part])) for part in np.split(order, cuts)]

    first, second = kind == 0, kind == 1
    slices = planes(z, y, x, first)
    corners = np.concatenate([np.column_stack([np.full(len(h), level), h]) for level, h in slices])
    values = [_farthest(corners)]
    for found in (slices, planes(y, z, x, first), planes(x, z, y, second)):
        values.append(max(_farthest(h) for _, h in found))
    return values


def line_distances(of: np.ndarray, kind: np.ndarray, points: np.ndarray, rows: int) -> np.ndarray:
    """The four diameters of many regions from their line ends: region (in order), kind (0 along x, 1 along y), z, y, x."""
    sizes = np.bincount(of, minlength=rows)
    few = (sizes <= FEW)[of]
    along_x, along_y = (few & (kind == k) for k in (0, 1))
    best = _all_distances(of[along_x], points[:, along_x], rows, (0, 1))
    best.append(_all_distances(of[along_y], points[:, along_y], rows, (2,))[1])
    out = np.sqrt(np.stack(best)) / 2
    upto = np.cumsum(sizes)
    for row in np.flatnonzero(sizes > FEW):
        part = slice(upto[row] - sizes[row], upto[row])
        out[:, row] = _hull_distances(kind[part], points[:, part])
    return out


def _measured(keys: list[str]):
    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, ends = batch.num_rows, batch.column("ends")
            sizes = ends.value_lengths().to_numpy(zero_copy_only=False)
            flat = ends.flatten()
            kind, *at = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            out = line_distances(np.repeat(np.arange(rows), sizes), kind, np.stack(at), rows)
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, *[pa.array(v) for v in out]], names=[*keys, *DIAMETERS])

    return work


def diameters(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Largest distances between surface points: in 3-D, and within a slice, column plane or row plane.

    Only the two ends of a line of points can be a corner of a convex hull, so a task gets line ends. Regions of few ends
    are measured many at once; of a larger one every slice is cut down to its hull corners before distances are taken.
    Exact at every step.
    """
    points = surface_points(regions, keys)
    along_x = points.groupBy(*keys, "z", "y").agg(F.expr("array_distinct(array(min(x), max(x))) as e"))
    along_y = points.groupBy(*keys, "z", "x").agg(F.expr("array_distinct(array(min(y), max(y))) as e"))
    ends = along_x.selectExpr(*keys, "0 as kind", "z", "y", "explode(e) as x").unionByName(
        along_y.selectExpr(*keys, "1 as kind", "z", "explode(e) as y", "x")
    )
    kinds = dict(regions.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{n} double" for n in DIAMETERS]])
    packed = ends.groupBy(*keys).agg(F.expr("collect_list(struct(kind, z, y, x)) as ends"))
    return packed.select(*keys, "ends").mapInArrow(_measured(keys), schema)


def shape(regions: DataFrame, keys: list[str]) -> DataFrame:
    """All 14 shape features."""
    return moments(regions, keys).join(mesh(regions, keys), keys).join(diameters(regions, keys), keys)
