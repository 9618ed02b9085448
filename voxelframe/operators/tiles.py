"""Spatial tiling: the one shuffle behind every operator that looks at neighbouring voxels.

A case is cut into fixed cuboids. Each voxel goes to its own tile and, near a border, also to the tiles that see it
in their halo; rows are then hash-partitioned on (keys, tile). A single huge case spreads over many tiles, and all
neighbour look-ups of a tile happen inside its partition without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

AXES = ["z", "y", "x"]
TILE_KEYS = ["tz", "ty", "tx"]
TILE_SIZE = (16, 32, 32)  # voxels per tile; 16 384 rows at most, plus the halo

# Half of the 26 neighbours: first non-zero component positive. Offsets are (z, y, x).
FULL_26 = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) != (0, 0, 0)]
HALF_13 = [offset for offset in FULL_26 if offset > (0, 0, 0)]
CUBE_27 = [(0, 0, 0), *FULL_26]


def tile_index(axis: str, size: int) -> str:
    """SQL: tile number of a coordinate (coordinates are not negative)."""
    return f"{axis} div {size}"


def offsets_array(offsets: list[tuple[int, int, int]]) -> str:
    """SQL: array of (dz, dy, dx) structs."""
    return "array(" + ", ".join(f"named_struct('dz', {z}, 'dy', {y}, 'dx', {x})" for z, y, x in offsets) + ")"


def partitions(df: DataFrame) -> int:
    """Partition count for stages that multiply their rows; their input size says little about their work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def into_tiles(voxels: DataFrame, keys: list[str], radius: int = 0, tile: tuple[int, int, int] = TILE_SIZE) -> DataFrame:
    """Voxels with tile columns, copied into every tile whose halo of ``radius`` holds them, partitioned by tile."""
    known = " and ".join(f"{axis} is not null" for axis in AXES)
    out = voxels.where(known)
    kept = [f"`{c}`" for c in voxels.columns]
    if radius == 0:
        out = out.selectExpr(*kept, *[f"cast({tile_index(a, s)} as int) as {k}" for a, s, k in zip(AXES, tile, TILE_KEYS)])
    else:
        for axis, key, size in zip(AXES, TILE_KEYS, tile):
            low, high = f"greatest(0, {axis} - {radius}) div {size}", f"({axis} + {radius}) div {size}"
            out = out.selectExpr(*kept, f"explode(sequence(cast({low} as int), cast({high} as int))) as {key}")
            kept.append(key)
    return out.repartition(partitions(voxels), *keys, *TILE_KEYS)


def owned(tile: tuple[int, int, int] = TILE_SIZE) -> str:
    """SQL: true where a row sits in its own tile, false for halo copies."""
    return " and ".join(f"{key} = {tile_index(axis, size)}" for axis, key, size in zip(AXES, TILE_KEYS, tile))


def neighbour_pairs(
    voxels: DataFrame,
    keys: list[str],
    payload: str,
    offsets: list[tuple[int, int, int]],
    tile: tuple[int, int, int] = TILE_SIZE,
    by: list[str] | None = None,
) -> DataFrame:
    """Each voxel with every present neighbour: keys, tile, z, y, x, payload, dz, dy, dx, ``n_<payload>``.

    ``by`` are the keys tiles are dealt out by, if some of the others may be constant: Spark leaves constants out of joins
    and groups, whose rows would then be shuffled again.

    The ownership test sits inside the generator, not in a filter that would move below the exchange, so both join
    sides keep the same exchange and it is reused.
    """
    radius = max(max(abs(c) for c in offset) for offset in offsets)
    halo = into_tiles(voxels.select(*keys, *AXES, payload), by or keys, radius, tile)
    base = [*keys, *TILE_KEYS, *AXES, payload]
    centre = halo.selectExpr(*base, f"inline(if({owned(tile)}, {offsets_array(offsets)}, null))")
    centre = centre.selectExpr("*", "z + dz as nz", "y + dy as ny", "x + dx as nx")
    other = halo.selectExpr(*keys, *TILE_KEYS, "z as nz", "y as ny", "x as nx", f"{payload} as n_{payload}")
    return centre.join(other.hint("shuffle_hash"), [*keys, *TILE_KEYS, "nz", "ny", "nx"])
