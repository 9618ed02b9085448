"""Mask morphology with a full 3x3x3 element on sparse mask rows.

Mask rows carry ``keys`` plus sz, sy, sx (the grid size, constant per case), z, y, x. Outside counts as background.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.tiles import AXES, CUBE_27, TILE_KEYS, TILE_SIZE, into_tiles, neighbour_pairs, offsets_array, owned
from voxelframe.session import cut_lineage

GRID = ["sz", "sy", "sx"]
IN_GRID = " and ".join(f"{a} >= 0 and {a} < s{a}" for a in AXES)
MODES = ["dilate", "erode", "open", "close", "shift"]


def dilate(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the mask moved by all 27 offsets; duplicates vanish inside the tile."""
    groups = [*keys, *GRID]
    halo = into_tiles(mask.select(*groups, *AXES), keys, 1)  # grid sizes may be constants
    moved = halo.selectExpr(*groups, *TILE_KEYS, *AXES, f"inline({offsets_array(CUBE_27)})")
    moved = moved.selectExpr(*groups, *TILE_KEYS, *[f"{a} + d{a} as {a}" for a in AXES])
    return moved.where(f"{IN_GRID} and {owned(TILE_SIZE)}").distinct().select(*groups, *AXES)


def erode(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels whose 27 cells are all in the mask."""
    groups = [*keys, *GRID]
    rows = mask.select(*groups, *AXES).selectExpr("*", "1 as inside")
    full = neighbour_pairs(rows, groups, "inside", CUBE_27, by=keys).groupBy(*groups, *TILE_KEYS, *AXES).agg(F.count(F.lit(1)).alias("n"))
    return full.where("n = 27").select(*groups, *AXES)


def opening(mask: DataFrame, keys: list[str]) -> DataFrame:
    return dilate(erode(mask, keys), keys)


def closing(mask: DataFrame, keys: list[str]) -> DataFrame:
    return erode(dilate(mask, keys), keys)


def shift(mask: DataFrame, keys: list[str], dz: str = "dz", dy: str = "dy", dx: str = "dx") -> DataFrame:
    """Mask moved by per-row offsets; what leaves the grid is lost."""
    moved = mask.selectExpr(*keys, *GRID, f"z + ({dz}) as z", f"y + ({dy}) as y", f"x + ({dx}) as x")
    return moved.where(IN_GRID)


def draw(label: str, count: int) -> str:
    """SQL: a stable pick in 0..count-1 from a string expression."""
    return f"cast(conv(substr(md5({label}), 1, 8), 16, 10) as bigint) % {count}"


def perturb(mask: DataFrame, keys: list[str], repeats: int, seed: int = 42) -> DataFrame:
    """Copies 0..repeats of every mask; copy 0 is the original, the others get one of five changes.

    A change that empties the mask leaves the original in place.
    """
    tag = f"concat_ws(':', {seed}, {', '.join(keys)}, repeat)"
    copies = mask.selectExpr(*keys, *GRID, *AXES, f"explode(sequence(0, {repeats})) as repeat")
    copies = copies.selectExpr(
        "*", f"if(repeat = 0, -1, {draw(tag, 5)}) as mode",
        *[f"cast({draw(f'concat({tag}, {chr(39)}:{a}{chr(39)})', 3)} as int) - 1 as d{a}" for a in AXES],
    )
    copies = cut_lineage(copies, ("mode",))  # every change below reads its own part only
    groups = [*keys, "repeat"]
    changed = [
        dilate(copies.where("mode = 0"), groups), erode(copies.where("mode = 1"), groups),
        opening(copies.where("mode = 2"), groups), closing(copies.where("mode = 3"), groups),
        shift(copies.where("mode = 4"), groups),
    ]
    out = copies.where("mode = -1").select(*groups, *GRID, *AXES)
    made = changed[0]
    for part in changed[1:]:
        made = made.unionByName(part)
    kept = made.select(*groups).distinct()
    lost = copies.where("mode >= 0").join(kept, groups, "left_anti").select(*groups, *GRID, *AXES)
    return out.unionByName(made).unionByName(lost)
