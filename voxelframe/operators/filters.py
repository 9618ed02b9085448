"""Fixed filter bank on dense voxel rows: stationary wavelet, Laplacian of Gaussian, gradient magnitude.

Separable filters run axis by axis. A line of voxels is packed into one array, filtered with array functions in the
JVM, and unpacked; a line is as long as the grid is wide, so no task ever holds a whole volume.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.tiles import AXES, TILE_KEYS, into_tiles, owned

# coif1 decomposition taps.
COIF1_LOW = [
    -0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539,
]
COIF1_HIGH = [
    0.0727326195128539, 0.3378976624578092, -0.8525720202122554, 0.38486484686420286, 0.0727326195128539, -0.01565572813546454,
]
CENTRE_TAP = len(COIF1_LOW) // 2  # output k sums tap t times input k + (3 - t) * dilation, wrapped


def along_axis(voxels: DataFrame, keys: list[str], axis: str, values: list[str], outputs: dict[str, str], edge: int = 0) -> DataFrame:
    """Filter along one axis. An output is SQL over arrays named like ``values``, position ``k`` and length ``n``.

    The arrays start and end with ``edge`` more copies of the first and the last value of the line.
    """
    rest = [a for a in AXES if a != axis]
    packed = f"array_sort(collect_list(struct({', '.join([axis, *values])})))"
    lines = voxels.groupBy(*keys, *rest).agg(F.expr(f"{packed} as line"))
    lines = lines.selectExpr(*keys, *rest, "size(line) as n", *[_with_edges(f"transform(line, c -> c.{v})", v, edge) for v in values])
    cell = ", ".join(f"'{name}', {sql}" for name, sql in outputs.items())
    return lines.selectExpr(
        *keys, *rest, f"inline(transform(sequence(0, n - 1), k -> named_struct('{axis}', k, {cell})))"
    )


def _with_edges(line: str, value: str, edge: int) -> str:
    if not edge:
        return f"{line} as {value}"
    return f"concat(array_repeat(line[0].{value}, {edge}), {line}, array_repeat(line[size(line) - 1].{value}, {edge})) as {value}"


def taps_wrapped(value: str, taps: list[float], dilation: int) -> str:
    """Periodic convolution, half the taps to each side; an odd length is first extended by wrapping one sample."""
    m, centre = "(n + n % 2)", len(taps) // 2
    terms = [f"{t!r}D * {value}[pmod(pmod(k + {(centre - i) * dilation}, {m}), n)]" for i, t in enumerate(taps)]
    return "(" + " + ".join(terms) + ")"


def swt_bands(voxels: DataFrame, keys: list[str], value: str = "intensity", levels: int = 1) -> DataFrame:
    """Undecimated coif1 bands: keys, z, y, x, ``band`` (aad..ddd of every level, aaa of the last), ``value``."""
    low = voxels.selectExpr(*keys, *AXES, f"cast({value} as double) as a")
    parts = []
    for level in range(levels):
        step = 2**level
        names = ["a"]
        bands = low
        for axis in AXES:
            outputs = {}
            for name in names:
                stem = "" if axis == "z" else name
                outputs[f"{stem}a"] = taps_wrapped(name, COIF1_LOW, step)
                outputs[f"{stem}d"] = taps_wrapped(name, COIF1_HIGH, step)
            bands = along_axis(bands, keys, axis, names, outputs)
            names = list(outputs)
        last = level == levels - 1
        kept = [n for n in names if last or n != "aaa"]
        suffix = "" if levels == 1 else f"_l{level + 1}"
        pairs = ", ".join(f"'{n}{suffix}', {n}" for n in kept)
        parts.append(bands.selectExpr(*keys, *AXES, f"stack({len(kept)}, {pairs}) as (band, value)"))
        low = bands.selectExpr(*keys, *AXES, "aaa as a")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gaussian_taps(sigma: float, spacing: float) -> tuple[list[float], list[float]]:
    """Sampled Gaussian (sum 1) and its second derivative (sum 0), radius four sigma."""
    radius = max(1, math.ceil(4 * sigma / spacing))
    at = [i * spacing for i in range(-radius, radius + 1)]
    smooth = [math.exp(-t * t / (2 * sigma * sigma)) for t in at]
    total = sum(smooth)
    smooth = [s / total for s in smooth]
    second = [s * (t * t - sigma * sigma) / sigma**4 for s, t in zip(smooth, at)]
    mean = sum(second) / len(second)
    return smooth, [s - mean for s in second]


def taps_clamped(value: str, taps: list[float], edge: int) -> str:
    """Symmetric filter on a line with ``edge`` repeated values on both sides; equal taps share one product."""
    radius = len(taps) // 2
    terms = [f"{taps[radius]!r}D * {value}[k + {edge}]"]
    terms += [f"{taps[radius + i]!r}D * ({value}[k + {edge - i}] + {value}[k + {edge + i}])" for i in range(1, radius + 1)]
    return "(" + " + ".join(terms) + ")"


def log_filter(
    voxels: DataFrame, keys: list[str], sigma: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), value: str = "intensity"
) -> DataFrame:
    """Scale-normalised Laplacian of Gaussian: smoothing along two axes, second derivative along the third, summed."""
    return log_filters(voxels, keys, (sigma,), spacing, value).drop("channel")


def log_filters(
    voxels: DataFrame, keys: list[str], sigmas: tuple[float, ...], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), value: str = "intensity"
) -> DataFrame:
    """Laplacian of Gaussian of every sigma: keys, z, y, x, ``channel`` (log_<sigma>), ``value``.

    All sigmas travel together, so voxels are shuffled once per axis.
    """
    taps = [[gaussian_taps(sigma, step) for step in spacing] for sigma in sigmas]
    ez, ey, ex = (max(len(steps[i][0]) // 2 for steps in taps) for i in range(3))
    rows = voxels.selectExpr(*keys, *AXES, f"cast({value} as double) as v")
    outputs = {}
    for i, ((g, h), _, _) in enumerate(taps):
        outputs |= {f"g{i}": taps_clamped("v", g, ez), f"h{i}": taps_clamped("v", h, ez)}
    rows = along_axis(rows, keys, "z", ["v"], outputs, ez)
    names, outputs = list(outputs), {}
    for i, (_, (g, h), _) in enumerate(taps):
        outputs |= {f"c{i}": f"({taps_clamped(f'h{i}', g, ey)} + {taps_clamped(f'g{i}', h, ey)})", f"g{i}": taps_clamped(f"g{i}", g, ey)}
    rows = along_axis(rows, keys, "y", names, outputs, ey)
    names, outputs = list(outputs), {}
    for i, (sigma, (_, _, (g, h))) in enumerate(zip(sigmas, taps)):
        outputs[f"v{i}"] = f"{sigma * sigma!r}D * ({taps_clamped(f'c{i}', g, ex)} + {taps_clamped(f'g{i}', h, ex)})"
    rows = along_axis(rows, keys, "x", names, outputs, ex)
    pairs = ", ".join(f"'log_{sigma:g}', v{i}" for i, sigma in enumerate(sigmas))
    return rows.selectExpr(*keys, *AXES, f"stack({len(sigmas)}, {pairs}) as (channel, value)")


def gradient_magnitude(
    voxels: DataFrame, keys: list[str], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), value: str = "intensity"
) -> DataFrame:
    """Central differences with repeated edges; one shuffle into tiles with a halo of one voxel."""
    halo = into_tiles(voxels.selectExpr(*keys, *AXES, f"cast({value} as double) as v"), keys, 1)
    slopes = []
    for axis, step in zip(AXES, spacing):
        rest = [a for a in AXES if a != axis]
        per = f"over (partition by {', '.join([*keys, *TILE_KEYS, *rest])} order by {axis})"
        slopes.append(f"(coalesce(lead(v) {per}, v) - coalesce(lag(v) {per}, v)) / {2 * step!r}D as s{axis}")
    rows = halo.selectExpr(*keys, *TILE_KEYS, *AXES, *slopes).where(owned())
    return rows.selectExpr(*keys, *AXES, "sqrt(sz * sz + sy * sy + sx * sx) as value")


def filter_bank(
    voxels: DataFrame,
    keys: list[str],
    sigmas: tuple[float, ...] = (1.0, 2.0, 3.0),
    levels: int = 1,
    gradient: bool = True,
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0),
    mask_mode: str = "zero",
) -> DataFrame:
    """Channel table: image, wavelet bands, LoG per sigma, gradient. Mode ``zero`` blanks voxels outside the region."""
    if mask_mode not in ("zero", "post_pool"):
        raise ValueError(f"unknown mask mode: {mask_mode}")
    image = "if(inside = 1, intensity, 0D)" if mask_mode == "zero" else "intensity"
    rows = voxels.selectExpr(*keys, *AXES, f"{image} as intensity")
    parts = [rows.selectExpr(*keys, *AXES, "'image' as channel", "intensity as value")]
    parts.append(swt_bands(rows, keys, levels=levels).withColumnRenamed("band", "channel").selectExpr(*keys, *AXES, "concat('swt_', channel) as channel", "value"))
    if sigmas:
        parts.append(log_filters(rows, keys, sigmas, spacing))
    if gradient:
        parts.append(gradient_magnitude(rows, keys, spacing).selectExpr(*keys, *AXES, "'gradient' as channel", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def masked_mean(channels: DataFrame, keys: list[str]) -> DataFrame:
    """Masked average pooling per channel: sum of value times mask over at least one voxel."""
    return channels.groupBy(*keys, "channel").agg(F.expr("sum(value * inside) / greatest(sum(inside), 1) as value"))


def attention_pool(slots: DataFrame, case: str = "case_id") -> DataFrame:
    """Softmax of ``score`` over the present labels of a case, weighted sum of ``value``; absent labels get weight 0."""
    top = slots.where("present").groupBy(case).agg(F.expr("max(score) as top"))
    shifted = slots.join(top, case, "left").selectExpr("*", "if(present, exp(score - top), 0D) as raw")
    totals = shifted.groupBy(case).agg(F.expr("sum(raw) as total"), F.expr("sum(raw * value) as pooled"))
    return totals.selectExpr(case, "pooled / greatest(total, 1e-8D) as pooled")


def sequence_texture(regions: DataFrame, keys: list[str], bins: int = 32, value: str = "intensity") -> DataFrame:
    """Texture of the voxel sequence in z, y, x order: energy, contrast, homogeneity, correlation of adjacent bins.

    Neighbours in the sequence are found per (z, y) row; only row ends are linked across rows, in two further steps.
    Fewer than 4 voxels give zeros, a flat region gives (1, 0, 1, 0).
    """
    k = ", ".join(keys)
    ends = regions.groupBy(*keys).agg(
        F.expr(f"min({value}) as lo"), F.expr(f"max({value}) as hi"), F.expr("count(1) as voxels")
    )
    edges = f"transform(sequence(1, {bins - 1}), e -> lo + e * ((hi - lo) / {float(bins)}D))"
    guess = f"cast(least({bins - 1}, greatest(0, floor(({value} - lo) / (hi - lo) * {bins}))) as int)"
    exact = f"{guess} - if({guess} > 0 and {value} < edges[{guess} - 1], 1, 0) + if({guess} < {bins - 1} and {value} >= edges[{guess}], 1, 0)"
    rows = regions.join(ends.where("hi > lo and voxels >= 4").selectExpr(*keys, "lo", "hi", f"{edges} as edges"), keys)
    rows = rows.selectExpr(*keys, *AXES, f"{exact} as bin")
    inner = rows.selectExpr(*keys, "bin as i", f"lead(bin) over (partition by {k}, z, y order by x) as j").where("j is not null")
    heads = rows.groupBy(*keys, "z", "y").agg(F.expr("min_by(bin, x) as head"), F.expr("max_by(bin, x) as tail"))
    across = heads.selectExpr(*keys, "tail as i", f"lead(head) over (partition by {k}, z order by y) as j").where("j is not null")
    slabs = heads.groupBy(*keys, "z").agg(F.expr("min_by(head, y) as head"), F.expr("max_by(tail, y) as tail"))
    between = slabs.selectExpr(*keys, "tail as i", f"lead(head) over (partition by {k} order by z) as j").where("j is not null")
    links = inner.unionByName(across).unionByName(between)
    counts = links.groupBy(*keys, F.expr("least(i, j) as a"), F.expr("greatest(i, j) as b")).agg(F.expr("count(1) as n"))
    sums = counts.groupBy(*keys).agg(
        F.expr("sum(n) as links"),
        F.expr("sum(if(a = b, power(n, 2), power(n, 2) / 2)) as squares"),
        F.expr("sum(n * (a - b) * (a - b)) as gaps"),
        F.expr("sum(n / (1D + b - a)) as alike"),
        F.expr("sum(n * (a + b)) / 2 as first"),
        F.expr("sum(n * (a * a + b * b)) / 2 as second"),
        F.expr("sum(n * a * b) as cross"),
    )
    mean, spread = "first / links", "second / links - power(first / links, 2)"
    textured = sums.selectExpr(
        *keys, "squares / power(links, 2) as energy", "gaps / links as contrast", "alike / links as homogeneity",
        f"if(sqrt({spread}) < 1e-8D, 0D, (cross / links - power({mean}, 2)) / ({spread})) as correlation",
    )
    names = ["energy", "contrast", "homogeneity", "correlation"]
    simple = "if(voxels < 4, 0D, if(hi = lo, {}, {}))"
    flat = {"energy": "1D", "contrast": "0D", "homogeneity": "1D", "correlation": "0D"}
    joined = ends.join(textured, keys, "left")
    return joined.selectExpr(*keys, *[f"{simple.format(flat[n], n)} as {n}" for n in names])
