"""Features of a region under many masks at once: a voxel is one row with a bit per copy of the mask.

Copy 0 is the original, the others are perturbed. All copies are made in one pass over tiles with a halo of two voxels,
as every change is a combination of the mask, its dilation and its erosion nearby. Levels depend on the extremes of a
copy, so a voxel carries an array with its level in every copy, 0 where it is outside. Copies are told apart inside the
tile, after the shuffle; their neighbours, runs and zones are counted there, many tiles at once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import compact, shape, texture
from voxelframe.operators.morphology import GRID, IN_GRID, draw
from voxelframe.operators.tiles import AXES, CUBE_27, TILE_KEYS, TILE_SIZE, into_tiles, offsets_array, owned
from voxelframe.session import cut_lineage

MOVED = 4  # the change that moves the mask; 0 to 3 are dilation, erosion, opening, closing
NEAR_TILE = " and ".join(f"{a} between {k} * {s} - 1 and {k} * {s} + {s}" for a, k, s in zip(AXES, TILE_KEYS, TILE_SIZE))


def changes(keys: list[str], repeats: int, seed: int) -> tuple[str, str]:
    """SQL: arrays over the copies 1..repeats: the change of each, and the offset of a moved one as a number (else -1).

    The draws are those of ``morphology.perturb``.
    """
    modes, codes = [], []
    for k in range(1, repeats + 1):
        tag = f"concat_ws(':', {seed}, {', '.join(keys)}, {k})"
        mode = draw(tag, 5)
        modes.append(f"cast({mode} as int)")
        code = " + ".join(f"{w} * ({draw(f'concat({tag}, {chr(39)}:{a}{chr(39)})', 3)})" for a, w in zip(AXES, (9, 3, 1)))
        codes.append(f"cast(if({mode} = {MOVED}, {code}, -1) as int)")
    return f"array({', '.join(modes)})", f"array({', '.join(codes)})"


def perturbed(mask: DataFrame, keys: list[str], repeats: int, seed: int = 42) -> DataFrame:
    """Voxels of any copy of every mask: keys, z, y, x, ``copies`` (bit k is set where copy k has the voxel).

    The masks are those of ``morphology.perturb``: copies 1..repeats get one of five changes each, and one that empties the
    mask leaves the original in place.
    """
    if not 0 < repeats < 63:
        raise ValueError("between 1 and 62 repeats fit into the bits of a voxel")
    modes, codes = changes(keys, repeats, seed)
    groups = [*keys, *GRID, "modes", "codes"]
    halo = into_tiles(mask.selectExpr(*keys, *GRID, f"{modes} as modes", f"{codes} as codes", *AXES), keys, 2)  # grid sizes may be constants
    cell = [*groups, *TILE_KEYS]
    here = f"inline({offsets_array(CUBE_27)})"
    move = [f"{a} + d{a} as {a}" for a in AXES]
    moved = " | ".join(f"if(codes[{k - 1}] = (dz + 1) * 9 + (dy + 1) * 3 + dx + 1, {1 << k}L, 0L)" for k in range(1, repeats + 1))
    own = "int(dz = 0 and dy = 0 and dx = 0)"
    first = halo.selectExpr(*cell, *AXES, here).selectExpr(*cell, *move, f"{own} as own", f"{moved} as moved").where(f"{IN_GRID} and {NEAR_TILE}")
    first = first.groupBy(*cell, *AXES).agg(
        F.max("own").alias("m"), F.bit_or("moved").alias("moved"), (F.count(F.lit(1)) == 27).cast("int").alias("e"),
    )
    second = first.selectExpr(*cell, *AXES, "m", "moved", "e", here)
    second = second.selectExpr(
        *cell, *move, f"if({own} = 1, m, 0) as m", f"if({own} = 1, moved, 0L) as moved", f"if({own} = 1, e, 0) as e", f"{own} as d", "e as around",
    ).where(f"{IN_GRID} and {owned()}")
    second = second.groupBy(*cell, *AXES).agg(
        F.max("m").alias("m"), F.bit_or("moved").alias("moved"), F.max("e").alias("e"), F.max("d").alias("d"),
        F.max("around").alias("o"), (F.count(F.lit(1)) == 27).cast("int").alias("c"),
    )
    bits = " | ".join(
        ["bigint(m)", "moved", *(f"shiftleft(bigint(case modes[{k - 1}] when 0 then d when 1 then e when 2 then o when 3 then c else 0 end), {k})" for k in range(1, repeats + 1))]
    )
    made = cut_lineage(second.where("d = 1").selectExpr(*keys, *AXES, "m", f"{bits} as copies"))
    emptied = made.groupBy(*keys).agg(F.bit_or("copies").alias("present")).selectExpr(*keys, f"{(2 << repeats) - 1}L & ~present as emptied")
    whole = made.join(emptied, keys).selectExpr(*keys, *AXES, "if(m = 1, copies | emptied, copies) as copies")
    return whole.where("copies <> 0")


def levels(rows: DataFrame, keys: list[str], repeats: int, width: float | None = None, count: int = 32) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, z, y, x, intensity, ``cell``: the level in every copy, 0 outside), and keys, repeat, n_levels.

    With a ``width``, levels are bins of that width from the copy's lowest; else ``count`` bins between its extremes.
    """
    value = f"floor(intensity / {float(width)!r}D)" if width else "intensity"
    inside = [f"copies & {1 << k}L <> 0" for k in range(repeats + 1)]
    ends = rows.groupBy(*keys).agg(
        *[F.expr(f"{fn}(if({at}, {value}, null)) as {fn}{k}") for k, at in enumerate(inside) for fn in ("min", "max")]
    )
    level = "{0} - min{1} + 1" if width else f"if(max{{1}} > min{{1}}, least({count}, floor(({{0}} - min{{1}}) / (max{{1}} - min{{1}}) * {count}) + 1), 1)"
    cells = ", ".join(f"if({at}, int({level.format(value, k)}), 0)" for k, at in enumerate(inside))
    top = "int(max{0} - min{0} + 1)" if width else f"if(max{{0}} is null, null, {count})"
    tops = ", ".join(f"named_struct('repeat', {k}, 'n_levels', {top.format(k)})" for k in range(repeats + 1))
    leveled = rows.join(ends, keys).selectExpr(*keys, *AXES, "intensity", f"array({cells}) as cell")
    return leveled, ends.selectExpr(*keys, f"inline(array({tops}))").where("n_levels is not null")


def _apart(expression: str, repeats: int) -> str:
    """SQL: rows (repeat, and what the expression names) of the copies for which its ``level`` is over 0; ``k`` is the copy."""
    return f"inline(filter(transform(sequence(0, {repeats}), k -> named_struct('repeat', k, {expression})), s -> s.level > 0))"


def _masks(repeats: int, width: float | None, count: int):
    """The masks of packed regions: every copy with its levels, as ``levels`` has them."""
    n = repeats + 1

    def masks(regions, of, intensity, bits):
        value = intensity.astype(np.float64)
        voxel, k = np.nonzero((bits.astype(np.int64)[:, None] >> np.arange(n)) & 1)
        mask, value = of[voxel] * n + k, (np.floor(value / width) if width else value)[voxel]
        low, high = np.full(regions * n, np.inf), np.full(regions * n, -np.inf)
        np.minimum.at(low, mask, value)
        np.maximum.at(high, mask, value)
        if width:
            return mask, voxel, value - low[mask] + 1, high - low + 1
        span = (high - low)[mask]
        level = np.where(span > 0, np.minimum(count, np.floor((value - low[mask]) / np.where(span > 0, span, 1.0) * count) + 1), 1)
        return mask, voxel, level, np.full(regions * n, count)

    return masks


def stacked(rows: DataFrame, keys: list[str], repeats: int, width: float | None = None, count: int = 32, with_shape: bool = True) -> DataFrame:
    """``features`` with a row per region and feature: keys, feature, ``found`` (repeat, value of every copy that has one).

    Regions inside one tile are packed and nothing of them is shuffled after that.
    """
    families = tuple(f for f in compact.NAMES if with_shape or f != "shape")
    packed, rest = compact.split(rows, keys, ["intensity", "copies"])
    near = compact.feature_values(packed, keys, families, ["intensity", "copies"], _masks(repeats, width, count), repeats + 1)
    each = f"transform(sequence(0, {repeats}), k -> named_struct('repeat', k, 'value', found[i * {repeats + 1} + k]))"
    out = near.selectExpr(*keys, compact.named(families, f"'found', filter({each}, c -> c.value is not null)")).where("size(found) > 0")
    if rest is None:
        return out
    far = _spread_features(rest, keys, repeats, width, count, with_shape)
    return out.unionByName(far.groupBy(*keys, "feature").agg(F.collect_list(F.struct("repeat", "value")).alias("found")))


def features(rows: DataFrame, keys: list[str], repeats: int, width: float | None = None, count: int = 32, with_shape: bool = True) -> DataFrame:
    """Long features of all families and copies: keys, repeat, feature, value.

    ``rows`` has keys, z, y, x, intensity and ``copies`` as made by ``perturbed``.
    """
    return stacked(rows, keys, repeats, width, count, with_shape).selectExpr(*keys, "feature", "inline(found)").select(*keys, "repeat", "feature", "value")


def _spread_features(rows: DataFrame, keys: list[str], repeats: int, width: float | None, count: int, with_shape: bool) -> DataFrame:
    """The same rows of regions of any size."""
    leveled, tops = levels(rows, keys, repeats, width, count)
    leveled, tops = cut_lineage(leveled), cut_lineage(tops)  # every family reads them
    groups = [*keys, "repeat"]
    apart = _apart("'level', cell[k]", repeats)
    tiled = into_tiles(leveled.select(*keys, *AXES, "cell"), keys).selectExpr(*keys, *TILE_KEYS, *AXES, apart)
    halo = into_tiles(leveled.select(*keys, *AXES, "cell"), keys, 1).selectExpr(*keys, *TILE_KEYS, *AXES, apart)
    counts = cut_lineage(texture.neighbour_counts(leveled, groups, tiled=halo))
    pairs = texture.pair_counts(counts, groups).join(tops, groups)
    each = leveled.selectExpr(*keys, *AXES, "intensity", apart)
    wide = {
        "firstorder": texture.firstorder(each, groups), "glcm": texture.glcm_means(pairs, groups, [*texture.GLCM_FEATURES, "MCC"]), "glrlm": texture.glrlm(each, groups, tiled=tiled),
        "glszm": texture.glszm(each, groups, tiled=tiled), "gldm": texture.gldm(each, groups, counts=counts), "ngtdm": texture.ngtdm(each, groups, counts=counts),
    }
    parts = [texture.to_long(frame, groups, family) for family, frame in wide.items()]
    if with_shape:
        parts.append(texture.to_long(shape.shape(each.select(*groups, *AXES), groups), groups, "shape"))
    return reduce(DataFrame.unionByName, parts)
