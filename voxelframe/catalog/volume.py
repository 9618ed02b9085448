"""Volume geometry, morphology and the filter bank."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.catalog.base import OFF, REG, VOX, near, near_col, query, rounded
from voxelframe.operators import copies, filters, geometry, intensity, morphology
from voxelframe.operators.tiles import AXES
from voxelframe.session import new_folder
from voxelframe.sources.bindings import REGION, regions, volumes, voxels
from voxelframe.sources.volumes import crop_rows, voxels_of

BOX = VOX + """, box AS (
  SELECT case_id, label_id, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1
  FROM vox WHERE label_id > 0 GROUP BY ALL)"""
SPACING = """spc AS (SELECT vec_id AS case_id, CAST(1 AS DOUBLE) AS sz, 0.5::DOUBLE + (vec_id % 4) * 0.25::DOUBLE AS sy,
  0.5::DOUBLE + (vec_id % 3) * 0.25::DOUBLE AS sx FROM embeddings)"""


@query("label_bbox", f"WITH {BOX} SELECT * FROM box")
def _(spark, folder):
    return geometry.label_bbox(voxels(spark, folder))


def crop_sql(margin: int) -> str:
    hit = " AND ".join(f"v.{a} >= greatest(0, {a}0 - {margin}) AND v.{a} < {a}1 + {margin}" for a in AXES)
    based = ", ".join(f"v.{a} - greatest(0, {a}0 - {margin}) AS {a}" for a in AXES)
    return f"""SELECT v.case_id, b.label_id, {based}, v.intensity, CAST(v.label_id = b.label_id AS INTEGER) AS inside
FROM vox v JOIN box b ON b.case_id = v.case_id WHERE {hit}"""


@query("crop_voxels", f"WITH {BOX} {crop_sql(1)}")
def _(spark, folder):
    vox = voxels(spark, folder)
    return geometry.crop_voxels(vox, geometry.label_bbox(vox), (1, 1, 1))


@query("crop_roundtrip", f"""WITH {BOX}, c AS ({crop_sql(0)})
SELECT case_id, label_id, max(z) + 1 AS depth, max(y) + 1 AS height, max(x) + 1 AS width, count(*) AS voxels,
  CAST(sum(inside) AS BIGINT) AS mask_voxels, {near('sum(intensity)', 5)} AS total FROM c GROUP BY ALL""")
def _(spark, folder):
    vox = voxels(spark, folder)
    crops = crop_rows(geometry.crop_voxels(vox, geometry.label_bbox(vox)))
    target = new_folder(spark, "crops")
    crops.write.mode("overwrite").parquet(target)
    total = "aggregate(image, 0D, (s, v) -> s + v)"
    return spark.read.parquet(target).select(
        *REGION, F.expr("shape[0] as depth"), F.expr("shape[1] as height"), F.expr("shape[2] as width"),
        F.expr("cast(size(image) as bigint) as voxels"), F.expr("aggregate(mask, 0L, (s, v) -> s + v) as mask_voxels"),
        near_col(F.expr(total), 5).alias("total"),
    )


@query("shape_mismatch", """SELECT vec_id AS case_id, 4 AS image_depth, 4 + CAST(vec_id % 5 = 0 AS INTEGER) AS label_depth
FROM embeddings WHERE vec_id % 5 = 0""")
def _(spark, folder):
    vol = volumes(spark, folder)
    labels = vol.selectExpr("case_id", "array(4 + int(case_id % 5 = 0), 4, 4) as shape")
    found = geometry.shape_mismatch(vol, labels)
    return found.selectExpr("case_id", "image_shape[0] as image_depth", "label_shape[0] as label_depth")


@query("margin_voxels", f"""WITH {SPACING} SELECT case_id, CAST(ceil(2.5 / sz) AS INTEGER) AS mz, CAST(ceil(2.5 / sy) AS INTEGER) AS my,
  CAST(ceil(2.5 / sx) AS INTEGER) AS mx FROM spc""")
def _(spark, folder):
    rows = volumes(spark, folder).selectExpr("case_id", f"{geometry.margin_voxels('spacing', 2.5)} as m")
    return rows.selectExpr("case_id", "m[0] as mz", "m[1] as my", "m[2] as mx")


@query("next_multiple", """SELECT vec_id AS case_id, CAST(greatest(32, ceil(vec_id / 8.0::DOUBLE) * 8) AS INTEGER) AS size FROM embeddings""")
def _(spark, folder):
    return volumes(spark, folder).selectExpr("case_id", f"{geometry.next_multiple('case_id')} as size")


@query("reorient", f"""WITH {VOX}, n AS (
  SELECT case_id, intensity, label_id, CASE WHEN case_id % 3 = 0 THEN [z, y, x] WHEN case_id % 3 = 1 THEN [y, x, z] ELSE [x, z, y] END AS a FROM vox)
SELECT case_id, CASE WHEN case_id % 2 = 1 THEN 3 - a[1] ELSE a[1] END AS z, CASE WHEN case_id % 4 >= 2 THEN 3 - a[2] ELSE a[2] END AS y,
  CASE WHEN case_id % 8 >= 4 THEN 3 - a[3] ELSE a[3] END AS x, intensity, label_id FROM n""")
def _(spark, folder):
    rows = voxels_of(volumes(spark, folder), ("shape",)).selectExpr(
        "*", "if(case_id % 3 = 0, array(0, 1, 2), if(case_id % 3 = 1, array(1, 2, 0), array(2, 0, 1))) as axis_order",
        "array(case_id % 2 = 1, case_id % 4 >= 2, case_id % 8 >= 4) as axis_flips",
    )
    return geometry.reorient(rows)


RESAMPLE = SPACING + """, nn AS (
  SELECT case_id, sz, sy, sx, greatest(1, round_even(4 * sz / 0.8::DOUBLE, 0))::INT AS nz,
    greatest(1, round_even(4 * sy / 0.8::DOUBLE, 0))::INT AS ny, greatest(1, round_even(4 * sx / 0.7::DOUBLE, 0))::INT AS nx FROM spc),
grid AS (SELECT case_id, z, y, x, z * 0.8::DOUBLE / sz AS fz, y * 0.8::DOUBLE / sy AS fy, x * 0.7::DOUBLE / sx AS fx
  FROM nn, unnest(range(0, nz)) a(z), unnest(range(0, ny)) b(y), unnest(range(0, nx)) c(x))"""


@query("resample_nn", f"""WITH {VOX}, {RESAMPLE}
SELECT g.case_id, CAST(g.z AS INTEGER) AS z, CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x,
  CASE WHEN fz < 3.5 AND fy < 3.5 AND fx < 3.5 THEN v.label_id ELSE 0 END AS label_id
FROM grid g JOIN vox v ON v.case_id = g.case_id AND v.z = least(3, floor(fz + 0.5)) AND v.y = least(3, floor(fy + 0.5))
  AND v.x = least(3, floor(fx + 0.5))""")
def _(spark, folder):
    rows = voxels_of(volumes(spark, folder), ("shape", "spacing")).drop("intensity")
    return geometry.resample_nearest(rows, (0.8, 0.8, 0.7), ["label_id"])


@query("resample_bspline")
def _(spark, folder):
    rows = voxels_of(volumes(spark, folder), ("spacing",))
    return rounded(geometry.resample_spline(rows, (0.8, 0.8, 0.7)))


@query("clip_intensity", f"WITH {VOX} SELECT case_id, z, y, x, greatest(-0.1::DOUBLE, least(0.15::DOUBLE, intensity)) AS clipped FROM vox")
def _(spark, folder):
    return voxels(spark, folder).select("case_id", *AXES, intensity.clip(F.col("intensity"), -0.1, 0.15).alias("clipped"))


@query("zscore_case", f"""WITH {VOX}, s AS (SELECT case_id, coalesce(avg(intensity) FILTER (label_id > 0), avg(intensity)) AS mu,
  coalesce(stddev_pop(intensity) FILTER (label_id > 0), stddev_pop(intensity)) AS sd FROM vox GROUP BY ALL)
SELECT case_id, z, y, x, label_id, {near('(intensity - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END')} AS intensity
FROM vox JOIN s USING (case_id)""")
def _(spark, folder):
    return rounded(intensity.zscore_case(voxels(spark, folder)))


@query("intensity_stats", f"""WITH {VOX}, s AS (SELECT avg(greatest(-0.1, least(0.15, intensity))) AS mu,
  stddev_pop(greatest(-0.1, least(0.15, intensity))) AS sd FROM vox WHERE label_id > 0)
SELECT {near('mu')} AS mean, {near('CASE WHEN sd > 0 THEN sd ELSE 1 END')} AS std FROM s""")
def _(spark, folder):
    return rounded(intensity.intensity_stats(voxels(spark, folder), (-0.1, 0.15)))


@query("zscore_plan", f"""WITH {VOX}, s AS (SELECT avg(greatest(-0.1, least(0.15, intensity))) AS mu,
  stddev_pop(greatest(-0.1, least(0.15, intensity))) AS sd FROM vox WHERE label_id > 0)
SELECT case_id, z, y, x, label_id, {near('(greatest(-0.1, least(0.15, intensity)) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END')} AS intensity
FROM vox, s""")
def _(spark, folder):
    vox = voxels(spark, folder)
    return rounded(intensity.zscore_plan(vox, intensity.intensity_stats(vox, (-0.1, 0.15)), (-0.1, 0.15)))


@query("norm01", f"""WITH {VOX}, s AS (SELECT case_id, min(intensity) AS lo, max(intensity) AS hi FROM vox GROUP BY ALL)
SELECT case_id, z, y, x, {near('CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (intensity - lo) / (hi - lo) END')} AS unit FROM vox JOIN s USING (case_id)""")
def _(spark, folder):
    return rounded(intensity.minmax01(voxels(spark, folder), ["case_id"]).select("case_id", *AXES, "unit"))


@query("robust_window", f"""WITH {VOX}, s AS (SELECT case_id, quantile_cont(intensity, 0.01) AS lo, quantile_cont(intensity, 0.99) AS hi
  FROM vox WHERE label_id > 0 GROUP BY ALL)
SELECT case_id, z, y, x, {near('CASE WHEN hi - lo < 1e-8 THEN 0 ELSE greatest(0, least(1, (intensity - lo) / (hi - lo))) END')} AS unit
FROM vox JOIN s USING (case_id)""")
def _(spark, folder):
    return rounded(intensity.robust_window(voxels(spark, folder), ["case_id"]).select("case_id", *AXES, "unit"))


@query("median_slice", f"""WITH {VOX} SELECT case_id, CAST(coalesce(floor(median(z) FILTER (label_id = 2)), 2) AS INTEGER) AS slice
FROM vox GROUP BY ALL""")
def _(spark, folder):
    rows = voxels(spark, folder).selectExpr("case_id", "z", "int(label_id = 2) as label_id")
    return geometry.median_slice(rows, ["case_id"])


# ------------------------------------------------------------------ morphology
def masks(spark, folder):
    return regions(spark, folder).selectExpr(*REGION, "4 as sz", "4 as sy", "4 as sx", *AXES)


def dilate_sql(source: str) -> str:
    return f"""SELECT DISTINCT case_id, label_id, z + dz AS z, y + dy AS y, x + dx AS x FROM {source}, cube
  WHERE z + dz BETWEEN 0 AND 3 AND y + dy BETWEEN 0 AND 3 AND x + dx BETWEEN 0 AND 3"""


def erode_sql(source: str) -> str:
    return f"""SELECT a.case_id, a.label_id, a.z, a.y, a.x FROM {source} a, cube, {source} b
  WHERE b.case_id = a.case_id AND b.label_id = a.label_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx
  GROUP BY ALL HAVING count(*) = 27"""


# Regions of the sample volumes are too ragged to survive an erosion, so erosion and opening act on dilated masks.
HULL = f"{REG}, {OFF}, hull AS ({dilate_sql('reg')})"


def hull(spark, folder):
    return morphology.dilate(masks(spark, folder), REGION)


@query("mask_dilate", f"WITH {REG}, {OFF} {dilate_sql('reg')}")
def _(spark, folder):
    return morphology.dilate(masks(spark, folder), REGION).select(*REGION, *AXES)


@query("mask_erode", f"WITH {HULL} {erode_sql('hull')}")
def _(spark, folder):
    return morphology.erode(hull(spark, folder), REGION).select(*REGION, *AXES)


@query("mask_open", f"WITH {HULL}, e AS ({erode_sql('hull')}) {dilate_sql('e')}")
def _(spark, folder):
    return morphology.opening(hull(spark, folder), REGION).select(*REGION, *AXES)


@query("mask_close", f"WITH {REG}, {OFF}, d AS ({dilate_sql('reg')}) {erode_sql('d')}")
def _(spark, folder):
    return morphology.closing(masks(spark, folder), REGION).select(*REGION, *AXES)


@query("mask_shift", f"""WITH {REG} SELECT case_id, label_id, z + 1 AS z, y - 1 AS y, x FROM reg WHERE z + 1 <= 3 AND y - 1 >= 0""")
def _(spark, folder):
    return morphology.shift(masks(spark, folder), REGION, "1", "-1", "0").select(*REGION, *AXES)


def draw_sql(text: str, count: int) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) % {count}"


TAG = "concat('42:', case_id, ':', label_id, ':', rep)"
# A region of the 4x4x4 sample volumes as the list of its cells; copies are made from five lists of a region.
LIST_CELLS = {
    "dilated": ("whole", "list_has_any(near, cells)"), "eroded": ("whole", "len(near) = 27 AND list_has_all(cells, near)"),
    "opened": ("eroded", "list_has_any(near, cells)"), "closed": ("dilated", "len(near) = 27 AND list_has_all(cells, near)"),
}


def perturb_sql(repeats: int) -> str:
    """CTEs up to ``pt``: the voxels of every copy (case_id, label_id, rep, z, y, x)."""
    made = ", ".join(
        f"{name} AS MATERIALIZED (SELECT case_id, label_id, list(q) AS cells FROM {source}, nb WHERE {rule} GROUP BY ALL)"
        for name, (source, rule) in LIST_CELLS.items()
    )
    drawn = ", ".join(f"{draw_sql(f'concat({TAG}, {chr(39)}:{a}{chr(39)})', 3)} - 1 AS m{a}" for a in AXES)
    moved = "list_transform(list_filter(c.cells, lambda p: p // 16 + mz BETWEEN 0 AND 3 AND (p // 4) % 4 + my BETWEEN 0 AND 3 AND p % 4 + mx BETWEEN 0 AND 3), lambda p: p + 16 * mz + 4 * my + mx)"
    cases = " ".join(f"WHEN {k} THEN {name}.cells" for k, name in enumerate(LIST_CELLS))
    joins = " ".join(f"LEFT JOIN {name} ON {name}.case_id = c.case_id AND {name}.label_id = c.label_id" for name in LIST_CELLS)
    return f"""{REG}, nb AS MATERIALIZED (SELECT a.p AS q, list(b.p) AS near FROM range(64) a(p), range(64) b(p)
  WHERE abs(a.p // 16 - b.p // 16) <= 1 AND abs((a.p // 4) % 4 - (b.p // 4) % 4) <= 1 AND abs(a.p % 4 - b.p % 4) <= 1 GROUP BY ALL),
whole AS MATERIALIZED (SELECT case_id, label_id, list(CAST(z * 16 + y * 4 + x AS BIGINT)) AS cells FROM reg GROUP BY ALL), {made},
cp AS MATERIALIZED (SELECT *, {drawn}, CASE WHEN rep = 0 THEN -1 ELSE {draw_sql(TAG, 5)} END AS mode FROM whole, range({repeats + 1}) t(rep)),
pl AS MATERIALIZED (SELECT c.case_id, c.label_id, c.rep, c.cells, CASE c.mode {cases} WHEN 4 THEN {moved} END AS made FROM cp c {joins}),
pt AS MATERIALIZED (SELECT case_id, label_id, rep, p // 16 AS z, (p // 4) % 4 AS y, p % 4 AS x
  FROM (SELECT case_id, label_id, rep, unnest(CASE WHEN coalesce(len(made), 0) = 0 THEN cells ELSE made END) AS p FROM pl))"""


@query("perturb_masks", f"""WITH {perturb_sql(2)}
SELECT case_id, label_id, rep AS repeat, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM pt""")
def _(spark, folder):
    return morphology.perturb(masks(spark, folder), REGION, 2).select(*REGION, "repeat", *AXES)


@query("perturbed_copies", f"""WITH {perturb_sql(8)}
SELECT case_id, label_id, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(sum(1 << rep) AS BIGINT) AS copies FROM pt GROUP BY ALL""")
def _(spark, folder):
    return copies.perturbed(masks(spark, folder), REGION, 8)


@query("shift_augment", f"""WITH {REG}, s AS (SELECT *, CASE WHEN {draw_sql("concat('7:', case_id)", 2)} = 0 THEN 1 ELSE 0 END AS go,
  {', '.join(f"{draw_sql(f"concat('7:', case_id, ':{a}')", 5)} - 2 AS m{a}" for a in AXES)} FROM reg)
SELECT case_id, label_id, CAST(z + go * mz AS INTEGER) AS z, CAST(y + go * my AS INTEGER) AS y, CAST(x + go * mx AS INTEGER) AS x FROM s
WHERE z + go * mz BETWEEN 0 AND 3 AND y + go * my BETWEEN 0 AND 3 AND x + go * mx BETWEEN 0 AND 3""")
def _(spark, folder):
    moves = [f"{morphology.draw(f'concat({chr(39)}7:{chr(39)}, case_id, {chr(39)}:{a}{chr(39)})', 5)} - 2" for a in AXES]
    go = f"if({morphology.draw(f'concat({chr(39)}7:{chr(39)}, case_id)', 2)} = 0, 1, 0)"
    rows = masks(spark, folder).selectExpr("*", *[f"cast(({go}) * ({m}) as int) as d{a}" for a, m in zip(AXES, moves)])
    return morphology.shift(rows, REGION).select(*REGION, *AXES)


# ------------------------------------------------------------------ filter bank
def taps_sql(name: str, low: list[float], high: list[float], centre: int) -> str:
    rows = ", ".join(f"({centre - i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(low, high)))
    return f"{name}(o, lo, hi) AS (VALUES {rows})"


SWT = f"""{VOX}, {taps_sql('taps', filters.COIF1_LOW, filters.COIF1_HIGH, filters.CENTRE_TAP)},
w1 AS (SELECT v.case_id, v.y, v.x, k.k AS z, sum(lo * intensity) AS a, sum(hi * intensity) AS d
  FROM vox v, taps, unnest([0, 1, 2, 3]) k(k) WHERE v.z = (k.k + o + 8) % 4 GROUP BY ALL),
w2 AS (SELECT w.case_id, w.z, w.x, k.k AS y, sum(lo * a) AS aa, sum(hi * a) AS ad, sum(lo * d) AS da, sum(hi * d) AS dd
  FROM w1 w, taps, unnest([0, 1, 2, 3]) k(k) WHERE w.y = (k.k + o + 8) % 4 GROUP BY ALL),
w3 AS (SELECT w.case_id, w.z, w.y, k.k AS x, sum(lo * aa) AS aaa, sum(hi * aa) AS aad, sum(lo * ad) AS ada, sum(hi * ad) AS "add",
   sum(lo * da) AS daa, sum(hi * da) AS dad, sum(lo * dd) AS dda, sum(hi * dd) AS ddd
  FROM w2 w, taps, unnest([0, 1, 2, 3]) k(k) WHERE w.x = (k.k + o + 8) % 4 GROUP BY ALL),
swt AS (UNPIVOT w3 ON aaa, aad, ada, "add", daa, dad, dda, ddd INTO NAME band VALUE value)"""


@query("swt_bands", f"WITH {SWT} SELECT case_id, z, y, x, band, {near('value')} AS value FROM swt")
def _(spark, folder):
    return rounded(filters.swt_bands(voxels(spark, folder), ["case_id"]))


def log_sql(sigma: float, source: str, name: str, key: str = "case_id") -> str:
    r = int(4 * sigma)
    clamp = "least(3, greatest(0, k.k + o))"
    axis = "unnest([0, 1, 2, 3]) k(k)"
    return f"""{name}0 AS (SELECT o, exp(-o * o / (2 * {sigma}::DOUBLE * {sigma})) AS e FROM unnest(range({-r}, {r + 1})) t(o)),
{name}1 AS (SELECT o, e / sum(e) OVER () AS g FROM {name}0),
{name}t AS (SELECT o, g, h - avg(h) OVER () AS h FROM (SELECT o, g, g * (o * o - {sigma}::DOUBLE * {sigma}) / ({sigma}::DOUBLE ** 4) AS h FROM {name}1)),
{name}z AS (SELECT {key}, y, x, k.k AS z, sum(g * intensity) AS g, sum(h * intensity) AS h FROM {source} v, {name}t t, {axis}
  WHERE v.z = {clamp} GROUP BY ALL),
{name}y AS (SELECT {key}, z, x, k.k AS y, sum(t.g * v.h + t.h * v.g) AS c, sum(t.g * v.g) AS g FROM {name}z v, {name}t t, {axis}
  WHERE v.y = {clamp} GROUP BY ALL),
{name} AS (SELECT {key}, z, y, k.k AS x, {sigma}::DOUBLE * {sigma} * sum(t.g * v.c + t.h * v.g) AS value FROM {name}y v, {name}t t, {axis}
  WHERE v.x = {clamp} GROUP BY ALL)"""


@query("log_filter", f"WITH {VOX}, {log_sql(1.0, 'vox', 'lg')} SELECT case_id, z, y, x, {near('value')} AS value FROM lg")
def _(spark, folder):
    return rounded(filters.log_filter(voxels(spark, folder), ["case_id"], 1.0))


def gradient_sql(source: str, keys: str = "case_id", steps=("1.0", "0.8", "0.8")) -> str:
    terms = []
    for axis, step in zip(AXES, steps):
        rest = ", ".join(a for a in AXES if a != axis)
        per = f"OVER (PARTITION BY {keys}, {rest} ORDER BY {axis})"
        terms.append(f"power((coalesce(lead(intensity) {per}, intensity) - coalesce(lag(intensity) {per}, intensity)) / (2 * {step}::DOUBLE), 2)")
    return f"SELECT {keys}, z, y, x, sqrt({' + '.join(terms)}) AS value FROM {source}"


@query("gradient_magnitude", f"WITH {VOX}, g AS ({gradient_sql('vox')}) SELECT case_id, z, y, x, {near('value')} AS value FROM g")
def _(spark, folder):
    return rounded(filters.gradient_magnitude(voxels(spark, folder), ["case_id"], (1.0, 0.8, 0.8)))


# Whole volumes masked by their labels as the region of every case.
MASKED = VOX.replace("vox AS", "vox0 AS", 1) + """, vox AS (SELECT case_id, z, y, x,
  CASE WHEN label_id > 0 THEN intensity ELSE 0 END AS intensity, CAST(label_id > 0 AS INTEGER) AS inside FROM vox0)"""
LOGS = ", ".join(log_sql(float(s), "vox", f"lg{s}") for s in (1, 2, 3))
BANK = f"""{MASKED}{SWT[len(VOX):]}, {LOGS}, gr AS ({gradient_sql('vox', steps=('1.0', '1.0', '1.0'))}),
bank AS (SELECT case_id, z, y, x, 'image' AS channel, intensity AS value FROM vox
  UNION ALL SELECT case_id, z, y, x, 'swt_' || band, value FROM swt
  UNION ALL SELECT case_id, z, y, x, 'log_1', value FROM lg1 UNION ALL SELECT case_id, z, y, x, 'log_2', value FROM lg2
  UNION ALL SELECT case_id, z, y, x, 'log_3', value FROM lg3
  UNION ALL SELECT case_id, z, y, x, 'gradient', value FROM gr)"""


def masked_volumes(spark, folder):
    return voxels(spark, folder).selectExpr("case_id", *AXES, "intensity", "int(label_id > 0) as inside")


def bank(spark, folder):
    return filters.filter_bank(masked_volumes(spark, folder), ["case_id"])


@query("filter_bank", f"WITH {BANK} SELECT case_id, z, y, x, channel, {near('value')} AS value FROM bank")
def _(spark, folder):
    return rounded(bank(spark, folder))


@query("masked_gap", f"""WITH {BANK} SELECT case_id, channel, {near('sum(value * inside) / greatest(sum(inside), 1)')} AS value
FROM bank JOIN (SELECT case_id, z, y, x, inside FROM vox) m USING (case_id, z, y, x) GROUP BY ALL""")
def _(spark, folder):
    mask = masked_volumes(spark, folder).select("case_id", *AXES, "inside")
    return rounded(filters.masked_mean(bank(spark, folder).join(mask, ["case_id", *AXES]), ["case_id"]))


@query("attention_pool", f"""WITH {VOX}, s AS (SELECT case_id, label_id, avg(intensity) AS value, count(*) / 10.0::DOUBLE AS score,
   case_id % 5 <> label_id AS present FROM vox GROUP BY ALL),
e AS (SELECT case_id, value, CASE WHEN present THEN exp(score) ELSE 0 END AS w FROM s)
SELECT case_id, {near('sum(w * value) / greatest(sum(w), 1e-8)')} AS pooled FROM e GROUP BY ALL""")
def _(spark, folder):
    slots = voxels(spark, folder).groupBy(*REGION).agg(
        F.expr("avg(intensity) as value"), F.expr("count(1) / 10D as score")
    )
    return rounded(filters.attention_pool(slots.selectExpr("*", "case_id % 5 <> label_id as present")))


@query("glcm_sequence", f"""WITH {REG}, e AS (SELECT case_id, label_id, min(intensity) AS lo, max(intensity) AS hi, count(*) AS n FROM reg GROUP BY ALL),
b AS (SELECT case_id, label_id, z, y, x, (SELECT count(*) FROM range(1, 32) t(k) WHERE lo + k * ((hi - lo) / 32.0::DOUBLE) <= intensity) AS bin
  FROM reg JOIN e USING (case_id, label_id) WHERE n >= 4 AND hi > lo),
l AS (SELECT case_id, label_id, bin AS i, lead(bin) OVER (PARTITION BY case_id, label_id ORDER BY z, y, x) AS j FROM b),
s AS (SELECT case_id, label_id, i, j FROM l WHERE j IS NOT NULL UNION ALL SELECT case_id, label_id, j, i FROM l WHERE j IS NOT NULL),
c AS (SELECT case_id, label_id, i, j, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY case_id, label_id) AS p FROM c),
m AS (SELECT case_id, label_id, sum(i * p) AS mu FROM p GROUP BY ALL),
f AS (SELECT case_id, label_id, sum(p * p) AS energy, sum((i - j) * (i - j) * p) AS contrast, sum(p / (1 + abs(i - j))) AS homogeneity,
   sum((i - mu) * (j - mu) * p) AS cov, sum((i - mu) * (i - mu) * p) AS v FROM p JOIN m USING (case_id, label_id) GROUP BY ALL)
SELECT case_id, label_id, {near('CASE WHEN n < 4 THEN 0 WHEN hi = lo THEN 1 ELSE energy END')} AS energy,
  {near('CASE WHEN n < 4 OR hi = lo THEN 0 ELSE contrast END')} AS contrast,
  {near('CASE WHEN n < 4 THEN 0 WHEN hi = lo THEN 1 ELSE homogeneity END')} AS homogeneity,
  {near('CASE WHEN n < 4 OR hi = lo OR sqrt(v) < 1e-8 THEN 0 ELSE cov / v END')} AS correlation
FROM e LEFT JOIN f USING (case_id, label_id)""")
def _(spark, folder):
    return rounded(filters.sequence_texture(regions(spark, folder), REGION))


@query("pad_batch", f"""WITH {BOX}, c AS ({crop_sql(0)}), s AS (SELECT case_id, label_id, case_id % 50 AS batch, max(z) + 1 AS nz, max(y) + 1 AS ny,
   max(x) + 1 AS nx FROM c GROUP BY ALL),
m AS (SELECT batch, max(nz) AS mz, max(ny) AS my, max(nx) AS mx FROM s GROUP BY ALL)
SELECT s.batch, s.case_id, s.label_id, CAST(g.z AS INTEGER) AS z, CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x,
  {near('coalesce(c.intensity, 0)')} AS value
FROM s JOIN m USING (batch), unnest(range(0, mz)) g1(z), unnest(range(0, my)) g2(y), unnest(range(0, mx)) g3(x),
 (SELECT g1.z, g2.y, g3.x) g LEFT JOIN c ON c.case_id = s.case_id AND c.label_id = s.label_id AND c.z = g.z AND c.y = g.y AND c.x = g.x""")
def _(spark, folder):
    vox = voxels(spark, folder)
    crops = crop_rows(geometry.crop_voxels(vox, geometry.label_bbox(vox))).withColumn("batch", F.expr("case_id % 50"))
    rows = geometry.pad_batch(crops).selectExpr("batch", *REGION, "shape", "posexplode(image) as (k, v)")
    rows = rows.selectExpr(
        "batch", *REGION, "int(k div (shape[1] * shape[2])) as z", "int((k div shape[2]) % shape[1]) as y", "int(k % shape[2]) as x",
        "cast(v as double) as value",
    )
    return rounded(rows)
