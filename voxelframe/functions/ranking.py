"""Exact ranks, percentiles and hashed orders that never put one group into one task.

A value is mapped to a *cell*: sign, binary exponent and ten mantissa bits. Cells keep the order of the values,
do not depend on the data, and their number per group has a fixed bound, so a window over the cells of a group is
small however large the group is. Full rows are only ordered inside a (group, cell).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.session import cut_lineage

CELLS_PER_OCTAVE = 1024
_EXPONENT_SHIFT = 1100  # above the smallest binary exponent of a double, so codes of positive values are positive
_ALL = "_all"
CROWDED = 1 << 16  # rows of a cell beyond which equal values are counted before they are ordered


def cell_code(value: str) -> str:
    """SQL: order-preserving bucket number of a finite double."""
    exponent = f"floor(log2(abs({value})))"
    code = f"({exponent} + {_EXPONENT_SHIFT}) * {CELLS_PER_OCTAVE} + floor((abs({value}) / power(2D, {exponent}) - 1) * {CELLS_PER_OCTAVE})"
    return f"cast(if({value} = 0, 0, sign({value}) * ({code})) as bigint)"


def _earlier(keys: list[str], order: str) -> str:
    return f"over (partition by {', '.join(keys)} order by {order} rows between unbounded preceding and 1 preceding)"


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per (keys, _cell), rows in earlier cells, and rows of the whole group.

    The windows leave cells dealt out by the keys alone; dealt out anew by cell, they do not draw the rows they are
    joined with into one task per group.
    """
    counts = rows.groupBy(*keys, "_cell").agg(F.expr("count(1) as _cell_n"))
    return counts.selectExpr(
        *keys, "_cell", "_cell_n", f"coalesce(sum(_cell_n) {_earlier(keys, '_cell')}, 0) as _start",
        f"sum(_cell_n) over (partition by {', '.join(keys)}) as total",
    ).repartition(*keys, "_cell")


def value_ranks(df: DataFrame, keys: list[str], value: str, sums: dict[str, str] | None = None) -> DataFrame:
    """One row per distinct value of a group: ``n`` rows, average ``rank`` (ties share it), ``total`` rows of the group.

    ``sums`` adds aggregates per distinct value (name -> SQL).
    """
    groups = [*keys, _ALL]
    df = df.where(f"{value} is not null").selectExpr("*", f"0 as {_ALL}", f"{cell_code(value)} as _cell")
    extra = [F.expr(f"{sql} as {name}") for name, sql in (sums or {}).items()]
    distinct = df.groupBy(*groups, "_cell", value).agg(F.expr("count(1) as n"), *extra)
    located = distinct.join(_cells(df, groups).drop("_cell_n"), [*groups, "_cell"])
    inside = f"coalesce(sum(n) {_earlier([*groups, '_cell'], value)}, 0)"
    return located.selectExpr(*keys, value, "n", *(sums or {}), "total", f"_start + {inside} + (n + 1) / 2D as rank")


def value_cells(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Stored table of the cells of every group: keys, _cell, ``_cell_n`` rows, rows before them, ``total`` rows of the group."""
    rows = df.where(f"{value} is not null").selectExpr(*keys, f"0 as {_ALL}", f"{cell_code(value)} as _cell")
    return cut_lineage(_cells(rows, [*keys, _ALL]).drop(_ALL))


def row_ranks(df: DataFrame, keys: list[str], value: str, cells: DataFrame, out: str = "rank") -> DataFrame:
    """Rows that have a value, with its average rank (``out``) and ``total`` rows of the group; ``cells`` is ``value_cells`` of them.

    Rows travel once, to their cell, and are ordered there. Only in crowded cells are values counted first, which costs a
    join but keeps a value that fills a third of a group out of one task.
    """
    groups = [*keys, "_cell"]
    rows = df.where(f"{value} is not null").selectExpr("*", f"{cell_code(value)} as _cell")
    over = f"over (partition by {', '.join(groups)} order by {value}"
    ranked = rows.join(cells.where(f"_cell_n <= {CROWDED}"), groups).selectExpr(
        *df.columns, "total", f"_start + rank() {over}) + (count(1) {over} range between current row and current row) - 1) / 2D as {out}"
    )
    crowded = cells.where(f"_cell_n > {CROWDED}")
    if crowded.isEmpty():
        return ranked
    counted = rows.groupBy(*groups, value).agg(F.expr("count(1) as _n")).join(crowded, groups)
    inside = f"coalesce(sum(_n) {_earlier(groups, value)}, 0)"
    known = counted.selectExpr(*groups, value, "total", f"_start + {inside} + (_n + 1) / 2D as {out}")
    return ranked.unionByName(rows.join(known, [*groups, value]).select(*ranked.columns))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rows with the average rank of ``value`` in their group; rows without a value get NULL."""
    ranks = value_ranks(df, keys, value).selectExpr(*keys, value, f"rank as {out}")
    return df.join(ranks, [*keys, value], "left")


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles, one column per entry of ``probs``, for groups of any size.

    A histogram over cells finds which cells hold the wanted positions; only rows of those cells are ordered.
    """
    groups = [*keys, _ALL]
    rows = df.where(f"{value} is not null").selectExpr(*keys, value, f"0 as {_ALL}", f"{cell_code(value)} as _cell")
    low = {name: f"cast(floor({float(p)!r}D * (total - 1)) as bigint)" for name, p in probs.items()}
    high = {name: f"cast(ceil({float(p)!r}D * (total - 1)) as bigint)" for name, p in probs.items()}
    wanted = f"array_distinct(array({', '.join([*low.values(), *high.values()])}))"
    hit = _cells(rows, groups).selectExpr(
        *groups, "_cell", "_start", "total", f"filter({wanted}, i -> i >= _start and i < _start + _cell_n) as _at"
    ).where("size(_at) > 0")
    counted = rows.join(hit, [*groups, "_cell"]).groupBy(*groups, "_cell", value).agg(
        F.expr("count(1) as _k"), F.expr("first(_start) as _start"), F.expr("first(total) as total"), F.expr("first(_at) as _at")
    )
    first = f"_start + coalesce(sum(_k) {_earlier([*groups, '_cell'], value)}, 0)"
    at = counted.selectExpr(*groups, "total", value, "_k", "_at", f"{first} as _first").selectExpr(
        *groups, "total", value, "explode(filter(_at, i -> i >= _first and i < _first + _k)) as _i"
    )
    picks = [F.expr(f"max(if(_i = {position[name]}, {value}, null)) as `{side}{name}`")
             for name in probs for side, position in (("<", low), (">", high))]
    ends = at.groupBy(*groups, "total").agg(*picks)
    share = "({0!r}D * (total - 1) - floor({0!r}D * (total - 1)))"
    return ends.selectExpr(
        *keys, *[f"`<{name}` + (`>{name}` - `<{name}`) * {share.format(float(p))} as `{name}`" for name, p in probs.items()]
    )


def hashed_position(df: DataFrame, keys: list[str], ident: str, seed: object, out: str = "position") -> DataFrame:
    """0-based position of each row in its group in md5 order of ``seed:ident``, with the group size in ``<out>_of``.

    The first three hex digits split every group into 4096 even, ordered parts, so no task sorts a whole group.
    """
    groups = [*keys, _ALL]
    rows = df.selectExpr("*", f"0 as {_ALL}", f"md5(concat('{seed}:', {ident})) as _md5").selectExpr("*", "substr(_md5, 1, 3) as _part")
    parts = rows.groupBy(*groups, "_part").agg(F.expr("count(1) as _n"))
    parts = parts.selectExpr(
        *groups, "_part", f"coalesce(sum(_n) {_earlier(groups, '_part')}, 0) as _start",
        f"sum(_n) over (partition by {', '.join(groups)}) as {out}_of",
    ).repartition(*groups, "_part")
    inner = f"row_number() over (partition by {', '.join([*groups, '_part'])} order by _md5, {ident})"
    return rows.join(parts, [*groups, "_part"]).selectExpr(*df.columns, f"{out}_of", f"_start + {inner} - 1 as {out}")


def running_before(df: DataFrame, keys: list[str], part: str, order: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """Running aggregates over all earlier rows of a group, computed part by part.

    ``part`` is an order-preserving bucket of the rows; ``values`` maps an output name to (sum|min|max, SQL value).
    Windows see either the parts of one group or the rows of one part, never a whole group of rows.
    """
    joined = {"sum": "coalesce({0}, 0) + coalesce({1}, 0)", "min": "least({0}, {1})", "max": "greatest({0}, {1})"}
    parts = df.groupBy(*keys, part).agg(*[F.expr(f"{fn}({sql}) as _p_{name}") for name, (fn, sql) in values.items()])
    per_group = f"over (partition by {', '.join(keys)} order by {part} rows between unbounded preceding and 1 preceding)"
    parts = parts.selectExpr(*keys, part, *[f"{fn}(_p_{name}) {per_group} as _b_{name}" for name, (fn, _) in values.items()]).repartition(*keys, part)
    per_part = f"over (partition by {', '.join([*keys, part])} order by {', '.join(order)} rows between unbounded preceding and 1 preceding)"
    return df.join(parts, [*keys, part]).selectExpr(
        *df.columns,
        *[f"{joined[fn].format(f'_b_{name}', f'{fn}({sql}) {per_part}')} as {name}" for name, (fn, sql) in values.items()],
    )
