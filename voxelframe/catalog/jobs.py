"""Planning, preprocessing, shape, extraction and filter-map jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.catalog.base import CASES, LEV, ORACLE, REG, RTARGET, VOX, near, near_all, near_col, query, rounded
from voxelframe.catalog.texture import FIRST, FIRST_SQL, GLCM_AVG, GLCM_SQL, WIDTH, levels
from voxelframe.catalog.volume import BANK, BOX, LOGS, MASKED, SPACING, SWT, crop_sql, masked_volumes, perturb_sql
from voxelframe.operators import augment, geometry, intensity, shape, splits, texture
from voxelframe.operators.tiles import AXES
from voxelframe.plans import extraction, maps, planning, preprocess
from voxelframe.session import cut_lineage, new_folder
from voxelframe.sources import bindings, records
from voxelframe.sources.bindings import REGION, regions, samples, volumes, voxels
from voxelframe.sources.volumes import blocks_of, crop_rows, ingest_violations, voxels_of, voxels_of_blocks

TARGET = (0.8, 0.8, 0.7)


def known_labels(spark):
    return spark.sql("select explode(array(1, 2, 3)) as label_id")


@query("label_coverage", f"WITH {VOX} SELECT l AS label_id, count(DISTINCT case_id) AS n_cases FROM unnest([1, 2, 3]) t(l) LEFT JOIN vox ON label_id = l GROUP BY ALL")
def _(spark, folder):
    return planning.label_coverage(known_labels(spark), geometry.label_bbox(voxels(spark, folder)))


@query("median_spacing", f"WITH {SPACING} SELECT median(sz) AS z, median(sy) AS y, median(sx) AS x FROM spc")
def _(spark, folder):
    return planning.median_spacing(volumes(spark, folder))


MM = f"""{BOX}, {SPACING}, mm AS (SELECT label_id, 0 AS axis, (z1 - z0) * sz AS mm FROM box JOIN spc USING (case_id) UNION ALL
  SELECT label_id, 1, (y1 - y0) * sy FROM box JOIN spc USING (case_id) UNION ALL SELECT label_id, 2, (x1 - x0) * sx FROM box JOIN spc USING (case_id)),
bq AS (SELECT label_id, axis, quantile_cont(mm, 0.5) AS a, quantile_cont(mm, 0.95) AS b, CASE axis WHEN 2 THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AS step
  FROM mm GROUP BY ALL),
bp AS (SELECT label_id, axis, CAST(ceil(round(a / step, 9)) AS INTEGER) AS p50, CAST(ceil(round(b / step, 9)) AS INTEGER) AS p95 FROM bq)"""


@query("bbox_percentiles", f"""WITH {MM} SELECT l AS label_id, a AS axis, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95
FROM unnest([1, 2, 3]) t(l) CROSS JOIN unnest([0, 1, 2]) u(a) LEFT JOIN bp ON label_id = l AND axis = a""")
def _(spark, folder):
    boxes = geometry.label_bbox(voxels(spark, folder))
    return planning.bbox_percentiles(boxes, volumes(spark, folder), known_labels(spark), TARGET)


@query("crop_size", f"""WITH {BOX}, b AS (SELECT z1 - z0 AS z, y1 - y0 AS y, x1 - x0 AS x FROM box)
SELECT {', '.join(f"CAST(greatest(32, ceil(greatest(1, ceil(round(quantile_cont({a} * 9.0::DOUBLE, 0.99), 9))) / 8.0::DOUBLE) * 8) AS INTEGER) AS {a}" for a in AXES)} FROM b""")
def _(spark, folder):
    # Boxes are scaled up ninefold so that the size passes the floor of 32.
    boxes = geometry.label_bbox(voxels(spark, folder)).selectExpr("case_id", "label_id", *[f"{a}{i} * 9 as {a}{i}" for a in AXES for i in (0, 1)])
    return planning.crop_size(boxes)


CLIPPED = "greatest(-1000, least(1000, intensity))"


@query("plans_roundtrip", f"""WITH {VOX}, {SPACING}, c AS (SELECT label_id, count(DISTINCT case_id) AS n FROM vox WHERE label_id > 0 GROUP BY ALL)
SELECT 1 AS version, 'CT' AS modality, (SELECT median(sz) FROM spc) AS spacing_z, (SELECT median(sy) FROM spc) AS spacing_y, (SELECT median(sx) FROM spc) AS spacing_x,
  32 AS crop_z, (SELECT n FROM c WHERE label_id = 1) AS coverage_1, (SELECT n FROM c WHERE label_id = 2) AS coverage_2, 0 AS coverage_3,
  (SELECT {near(f'avg({CLIPPED})')} FROM vox WHERE label_id > 0) AS intensity_mean, (SELECT {near(f'stddev_pop({CLIPPED})')} FROM vox WHERE label_id > 0) AS intensity_std""")
def _(spark, folder):
    plan = planning.make_plan(volumes(spark, folder), known_labels(spark), "toy", "CT")
    target = new_folder(spark, "plan")
    records.write_plan(plan, target)
    stored = records.read_plan(spark, target)
    return rounded(stored.selectExpr(
        "version", "modality", "target_spacing[0] as spacing_z", "target_spacing[1] as spacing_y", "target_spacing[2] as spacing_x",
        "crop_size[0] as crop_z", "label_coverage[1] as coverage_1", "label_coverage[2] as coverage_2", "cast(label_coverage[3] as int) as coverage_3",
        "intensity_mean", "intensity_std",
    ))


@query("preprocess_regions", f"""WITH {BOX}, s AS (SELECT case_id, coalesce(avg(intensity) FILTER (label_id > 0), avg(intensity)) AS mu,
  coalesce(stddev_pop(intensity) FILTER (label_id > 0), stddev_pop(intensity)) AS sd FROM vox GROUP BY ALL),
c AS ({crop_sql(0)}) SELECT c.case_id, c.label_id, c.z, c.y, c.x, {near('(c.intensity - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END', 5)} AS intensity, c.inside
FROM c JOIN s USING (case_id)""")
def _(spark, folder):
    # The grid already has the target spacing, so resampling has to give the voxels back.
    same = volumes(spark, folder).withColumn("spacing", F.expr("array(1D, 0.8D, 0.8D)"))
    return rounded(preprocess.preprocess_regions(same, (1.0, 0.8, 0.8), "MR"), 5)


@query("preprocess_resampled")
def _(spark, folder):
    return rounded(preprocess.preprocess_regions(volumes(spark, folder), TARGET, "MR"))


# ------------------------------------------------------------------ shape
MOMENTS = ["VoxelVolume", "MajorAxisLength", "MinorAxisLength", "LeastAxisLength", "Elongation", "Flatness"]


@query("shape_moments", f"""WITH {REG}, c AS (SELECT case_id, label_id, count(*)::DOUBLE AS n, var_pop(z) AS a, var_pop(y) AS b, var_pop(x) AS c,
  covar_pop(z, y) AS d, covar_pop(z, x) AS e, covar_pop(y, x) AS f FROM reg GROUP BY ALL),
q AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - b) ** 2 + (b - c) ** 2 + (c - a) ** 2 + 6 * (d * d + e * e + f * f)) / 18) AS p FROM c),
g AS (SELECT *, CASE WHEN p > 1e-12 THEN acos(greatest(-1, least(1, ((a - q) * (b - q) * (c - q) + 2 * d * e * f - (a - q) * f * f - (b - q) * e * e - (c - q) * d * d) / (2 * p ** 3)))) / 3 ELSE 0 END AS phi FROM q),
h AS (SELECT case_id, label_id, n, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi - 2 * pi() / 3) AS e2, q + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM g),
z AS (SELECT case_id, label_id, n, CASE WHEN e1 < 1e-6 THEN 0 ELSE e1 END AS e1, CASE WHEN e2 < 1e-6 THEN 0 ELSE e2 END AS e2, CASE WHEN e3 < 1e-6 THEN 0 ELSE e3 END AS e3 FROM h),
w AS (SELECT case_id, label_id, n AS "VoxelVolume", 4 * sqrt(e1) AS "MajorAxisLength", 4 * sqrt(e2) AS "MinorAxisLength", 4 * sqrt(e3) AS "LeastAxisLength",
  CASE WHEN e1 > 0 THEN sqrt(e2 / e1) ELSE 0 END AS "Elongation", CASE WHEN e1 > 0 THEN sqrt(e3 / e1) ELSE 0 END AS "Flatness" FROM z)
SELECT {near_all(["case_id", "label_id"], MOMENTS, 4)} FROM w""")
def _(spark, folder):
    return rounded(shape.moments(regions(spark, folder), REGION), 4)


POINTS = f"""{REG}, st(dz, dy, dx) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
pt AS (SELECT r.case_id, r.label_id, 2 * r.z + dz AS z, 2 * r.y + dy AS y, 2 * r.x + dx AS x FROM reg r, st WHERE NOT EXISTS (
  SELECT 1 FROM reg o WHERE o.case_id = r.case_id AND o.label_id = r.label_id AND o.z = r.z + dz AND o.y = r.y + dy AND o.x = r.x + dx))"""


@query("shape_diameters", f"""WITH {POINTS}, d AS (SELECT case_id, label_id, a.z = b.z AS sz, a.y = b.y AS sy, a.x = b.x AS sx,
  sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) / 2 AS d FROM pt a JOIN pt b USING (case_id, label_id))
SELECT case_id, label_id, {near('max(d)')} AS "Maximum3DDiameter", {near('max(d) FILTER (sz)')} AS "Maximum2DDiameterSlice",
  {near('max(d) FILTER (sy)')} AS "Maximum2DDiameterColumn", {near('max(d) FILTER (sx)')} AS "Maximum2DDiameterRow" FROM d GROUP BY ALL""")
def _(spark, folder):
    return rounded(shape.diameters(regions(spark, folder), REGION))


@query("shape_mesh")
def _(spark, folder):
    return rounded(shape.mesh(regions(spark, folder), REGION))


@query("shape")
def _(spark, folder):
    return rounded(shape.shape(regions(spark, folder), REGION), 4)


# ------------------------------------------------------------------ extraction
IMAGES = f"""{MASKED.replace("CASE WHEN label_id > 0 THEN intensity ELSE 0 END AS intensity", "intensity")}{SWT[len(VOX):]}, {LOGS},
img AS (SELECT i.case_id, i.image_type AS label_id, i.z, i.y, i.x, round(i.v, 8) AS v FROM (
   SELECT case_id, z, y, x, 'original' AS image_type, intensity AS v FROM vox UNION ALL
   SELECT case_id, z, y, x, 'wavelet-' || translate(band, 'ad', 'LH'), value FROM swt UNION ALL
   SELECT case_id, z, y, x, 'log-sigma-1', value FROM lg1 UNION ALL SELECT case_id, z, y, x, 'log-sigma-2', value FROM lg2 UNION ALL
   SELECT case_id, z, y, x, 'log-sigma-3', value FROM lg3) i JOIN vox USING (case_id, z, y, x) WHERE inside = 1),
ends AS (SELECT case_id, label_id, min(floor(v / 0.05::DOUBLE)) AS lo, max(floor(v / 0.05::DOUBLE)) AS hi FROM img GROUP BY ALL),
lev AS (SELECT img.*, v AS intensity, CAST(floor(v / 0.05::DOUBLE) - lo + 1 AS INTEGER) AS level, CAST(hi - lo + 1 AS INTEGER) AS n_levels FROM img JOIN ends USING (case_id, label_id))"""


def families_sql(source: str, key: str, prefix: str, digits: int = 6) -> str:
    """Long rows of the six texture families, from their own queries over another table of levels (``source``).

    ``digits`` is for the first-order features, which alone see intensities and not levels. The second singular value
    (MCC) is left to `glcm_mcc` and, for copies, to `whole_copies_sql`.
    """
    parts = []
    for family in extraction.FAMILIES:
        own = f"""{FIRST_SQL} SELECT {near_all(["case_id", "label_id"], FIRST, digits)} FROM f""" if family == "firstorder" else ORACLE[family]
        sql = own.replace("WITH RECURSIVE", "WITH", 1).replace(f"WITH {LEV}", f"WITH RECURSIVE {source}", 1)
        parts.append(f"""SELECT {key}, {prefix} || '_{family}_' || feature AS feature, value
  FROM (UNPIVOT ({sql}) ON COLUMNS(* EXCLUDE (case_id, label_id)) INTO NAME feature VALUE value)""")
    return " UNION ALL ".join(parts)


def families(rows, digits=6):
    """The same rows of a feature table, rounded as in the queries of the families."""
    return near_families(rows.where("not endswith(feature, '_glcm_MCC')"), digits)


def near_families(rows, digits=6):
    """Long or stacked features rounded as in the queries of their families."""
    def near(value):
        tones = F.when(F.contains("feature", F.lit("_ngtdm_")), near_col(value, 4))
        shapes = tones.when(F.contains("feature", F.lit("_shape_")), near_col(value, 4))
        return shapes.when(F.contains("feature", F.lit("_firstorder_")), near_col(value, digits)).otherwise(near_col(value))

    if "found" in rows.columns:
        return rows.withColumn("found", F.transform("found", lambda c: F.struct(c["repeat"].alias("repeat"), near(c["value"]).alias("value"))))
    return rows.withColumn("value", near(F.col("value")))


@query("features_by_image_type", families_sql(IMAGES, "case_id", "label_id", 4))
def _(spark, folder):
    rows = extraction.image_types(masked_volumes(spark, folder), ["case_id"])
    rows = intensity.discretize_width(rows, ["case_id", "image_type"], WIDTH)
    return families(extraction.region_features(rows, ["case_id"], with_shape=False), 4)


FAMILIES_LONG = families_sql(LEV, "case_id, label_id", "'original'")
ALL = tuple(extraction.FAMILIES)


@query("extract_regions", FAMILIES_LONG)
def _(spark, folder):
    return families(extraction.region_features(levels(spark, folder), REGION, with_shape=False))


@query("extract_pending", FAMILIES_LONG)
def _(spark, folder):
    store, rows = new_folder(spark, "features-pending"), levels(spark, folder)
    extraction.extract_pending(rows.where("case_id % 3 = 0"), store, "aaaa0001", REGION, ALL)
    extraction.extract_pending(rows.where("case_id % 3 = 1"), store, "bbbb0002", REGION, ALL)
    return families(extraction.extract_pending(rows, store, "aaaa0001", REGION, ALL).where("not startswith(feature, 'original_shape_')"))


@query("extract_all_families")
def _(spark, folder):
    return rounded(extraction.region_features(levels(spark, folder), REGION))


FLAG_SQL = f"""WITH {BOX}, sc AS (SELECT case_id, avg(intensity) FILTER (label_id > 0) AS mu, stddev_pop(intensity) FILTER (label_id > 0) AS sd FROM vox GROUP BY ALL),
nz AS (SELECT c.case_id, c.label_id, c.z, c.y, c.x, round((c.intensity - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 8) AS v
  FROM ({crop_sql(0)}) c JOIN sc USING (case_id) WHERE inside = 1),
ends AS (SELECT case_id, label_id, min(floor(v / 0.5::DOUBLE)) AS lo, max(floor(v / 0.5::DOUBLE)) AS hi FROM nz GROUP BY ALL),
lev AS (SELECT nz.*, CAST(floor(v / 0.5::DOUBLE) - lo + 1 AS INTEGER) AS level, CAST(hi - lo + 1 AS INTEGER) AS n_levels FROM nz JOIN ends USING (case_id, label_id))"""


@query("region_texture_matrix", f"""{FLAG_SQL}{GLCM_SQL[len(LEV):]}, f AS (SELECT case_id, label_id, {GLCM_AVG} FROM fd GROUP BY ALL)
SELECT {near_all(["case_id", "label_id"], texture.GLCM_FEATURES, 5)}, CAST(e.label AS INTEGER) AS y FROM f JOIN embeddings e ON e.vec_id = f.case_id""")
def _(spark, folder):
    vox = voxels(spark, folder)
    cropped = geometry.crop_voxels(intensity.zscore_case(vox), geometry.label_bbox(vox)).where("inside = 1")
    rows = intensity.discretize_width(cropped.withColumn("intensity", F.round("intensity", 8)), REGION, 0.5)
    target = samples(spark, folder).selectExpr("sample_id as case_id", "label as y")
    return rounded(texture.glcm(rows, REGION), 5).join(target, "case_id")


# ------------------------------------------------------------------ filter-bank tables and augmentation
SEQ = f"""{BANK}, reg2 AS (SELECT case_id, channel, z, y, x, round(value, 8) AS v FROM bank JOIN (SELECT case_id, z, y, x, inside FROM vox) m USING (case_id, z, y, x) WHERE inside = 1),
e AS (SELECT case_id, channel, min(v) AS lo, max(v) AS hi, count(*) AS n FROM reg2 GROUP BY ALL),
b AS (SELECT case_id, channel, z, y, x, (SELECT count(*) FROM range(1, 32) t(k) WHERE lo + k * ((hi - lo) / 32.0::DOUBLE) <= v) AS bin
  FROM reg2 JOIN e USING (case_id, channel) WHERE n >= 4 AND hi > lo),
l AS (SELECT case_id, channel, bin AS i, lead(bin) OVER (PARTITION BY case_id, channel ORDER BY z, y, x) AS j FROM b),
s AS (SELECT case_id, channel, i, j FROM l WHERE j IS NOT NULL UNION ALL SELECT case_id, channel, j, i FROM l WHERE j IS NOT NULL),
c AS (SELECT case_id, channel, i, j, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY case_id, channel) AS p FROM c),
m AS (SELECT case_id, channel, sum(i * p) AS mu FROM p GROUP BY ALL),
f AS (SELECT case_id, channel, sum(p * p) AS energy, sum((i - j) * (i - j) * p) AS contrast, sum(p / (1 + abs(i - j))) AS homogeneity,
   sum((i - mu) * (j - mu) * p) AS cov, sum((i - mu) * (i - mu) * p) AS v FROM p JOIN m USING (case_id, channel) GROUP BY ALL),
st AS (SELECT case_id, channel, CASE WHEN n < 4 THEN 0 WHEN hi = lo THEN 1 ELSE energy END AS energy, CASE WHEN n < 4 OR hi = lo THEN 0 ELSE contrast END AS contrast,
  CASE WHEN n < 4 THEN 0 WHEN hi = lo THEN 1 ELSE homogeneity END AS homogeneity, CASE WHEN n < 4 OR hi = lo OR sqrt(v) < 1e-8 THEN 0 ELSE cov / v END AS correlation
  FROM e LEFT JOIN f USING (case_id, channel))"""


@query("filter_bank_features", f"""WITH {SEQ} SELECT case_id, channel, 'mean' AS stat, {near('avg(v)', 5)} AS value FROM reg2 GROUP BY ALL
UNION ALL SELECT case_id, channel, stat, {near('value', 5)} FROM (UNPIVOT st ON energy, contrast, homogeneity, correlation INTO NAME stat VALUE value)""")
def _(spark, folder):
    return rounded(maps.bank_features(masked_volumes(spark, folder), ["case_id"]), 5)


def uni(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


AUG_KEY = "'42:' || case_id || ':' || label_id"
AUG_SPOT = "'42:' || case_id || ':' || label_id || ':' || z || ':' || y || ':' || x"


@query("augment_intensity", f"""WITH {REG} SELECT case_id, label_id, z, y, x, {near(f'''intensity * (0.9::DOUBLE + 0.2::DOUBLE * {uni(AUG_KEY + " || ':scale'")})
  + (0.2::DOUBLE * {uni(AUG_KEY + " || ':shift'")} - 0.1::DOUBLE) + 0.05::DOUBLE * {uni(AUG_KEY + " || ':sigma'")}
  * sqrt(-2 * ln(1 - {uni(AUG_SPOT + " || ':n1'")})) * cos(2 * pi() * {uni(AUG_SPOT + " || ':n2'")})''')} AS intensity FROM reg""")
def _(spark, folder):
    return rounded(augment.augment_intensity(regions(spark, folder), "concat_ws(':', case_id, label_id)"))


def whole_crops(spark, folder):
    vox = voxels(spark, folder)
    return crop_rows(geometry.crop_voxels(vox, geometry.label_bbox(vox)))


@query("augment_geom")
def _(spark, folder):
    crops = whole_crops(spark, folder).selectExpr("*", "explode(array(0, 1)) as variant")
    return rounded(maps.crop_voxels(augment.augment_geometry(crops), [*REGION, "variant"]), 5)


@query("filter_map_cache")
def _(spark, folder):
    store, crops = new_folder(spark, "maps"), whole_crops(spark, folder)
    maps.cache_filter_maps(crops.where("case_id % 2 = 0"), store, "cccc0003", 0)
    cached = maps.cache_filter_maps(crops, store, "cccc0003", 1)
    return cached.selectExpr(*REGION, "variant", "channel", "size(values) as n_values")


# Levels of every copy of a region, which is a label of its own: label * 10 + copy.
COPIES = f"""{perturb_sql(extraction.REPEATS)}, cv AS (SELECT pt.case_id, pt.label_id * 10 + rep AS label_id, z, y, x, intensity
  FROM pt JOIN (SELECT case_id, z, y, x, intensity FROM vox) v USING (case_id, z, y, x)),
ends AS (SELECT case_id, label_id, min(floor(intensity / 0.05::DOUBLE)) AS lo, max(floor(intensity / 0.05::DOUBLE)) AS hi FROM cv GROUP BY ALL),
lev AS MATERIALIZED (SELECT cv.*, CAST(floor(intensity / 0.05::DOUBLE) - lo + 1 AS INTEGER) AS level, CAST(hi - lo + 1 AS INTEGER) AS n_levels
  FROM cv JOIN ends USING (case_id, label_id))"""
COPIES_LONG = families_sql(COPIES, "case_id, label_id // 10 AS label_id, label_id % 10 AS repeat", "'original'")


def perturbed(spark, folder, with_shape=False, stacked=False):
    from voxelframe.catalog.volume import masks

    values = voxels(spark, folder).select("case_id", *AXES, "intensity")
    return extraction.perturbed_features(masks(spark, folder), values, REGION, width=WIDTH, with_shape=with_shape, stacked=stacked)


# Second singular value of a co-occurrence matrix scaled by its marginals: the largest of what is left without their product.
# The matrix is squared and brought back to norm 1 so often that only the largest value counts; equal matrices are taken once.
SQUARINGS = 30
MCC_SQL = f"""ms AS MATERIALIZED (SELECT case_id, label_id, dir, list(struct_pack(i := i, j := j, n := n) ORDER BY i, j) AS cells FROM sym GROUP BY ALL),
dm AS MATERIALIZED (SELECT cells, row_number() OVER () AS id FROM (SELECT DISTINCT cells FROM ms)),
ce AS (SELECT id, unnest(cells) AS c FROM dm),
ct AS MATERIALIZED (SELECT id, c.i AS i, c.j AS j, CAST(c.n AS DOUBLE) / sum(c.n) OVER (PARTITION BY id) AS p FROM ce),
mk AS MATERIALIZED (SELECT id, i, sum(p) AS px FROM ct GROUP BY ALL),
b0 AS (SELECT a.id, a.i, b.i AS j, coalesce(p, 0) / sqrt(a.px * b.px) - sqrt(a.px * b.px) AS v FROM mk a JOIN mk b USING (id) LEFT JOIN ct ON ct.id = a.id AND ct.i = a.i AND ct.j = b.i),
pw(id, i, j, v, l, step) AS (SELECT id, i, j, v / f, ln(f), 0 FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY id)) AS f FROM b0) WHERE f > 1e-12
  UNION ALL SELECT id, i, j, v / f, 2 * l + ln(f), step + 1 FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY id)) AS f FROM (
    SELECT a.id, a.i, b.j, sum(a.v * b.v) AS v, a.l, a.step FROM pw a JOIN pw b ON a.id = b.id AND a.j = b.i WHERE a.step < {SQUARINGS} GROUP BY a.id, a.i, b.j, a.l, a.step)) WHERE f > 0),
sv AS (SELECT id, any_value(exp(l / power(2, {SQUARINGS}))) AS s FROM pw WHERE step = {SQUARINGS} GROUP BY id),
lk AS (SELECT id, count(*) AS k FROM mk GROUP BY id),
mc AS (SELECT case_id, label_id, avg(CASE WHEN k = 1 THEN 1 ELSE coalesce(s, 0) END) AS mcc FROM ms JOIN dm USING (cells) JOIN lk USING (id) LEFT JOIN sv USING (id) GROUP BY ALL)"""
CUBES = ", ".join(f"({', '.join(repr(float(v)) + '::DOUBLE' for v in row)})" for row in shape.cube_table())
CUBE_CORNERS = ", ".join(f"({z}, {y}, {x}, {1 << i})" for i, (z, y, x) in enumerate(shape.CORNERS))
MESH_SQL = f""", cube(config, area, volume, nz, ny, nx) AS (VALUES {CUBES}), corner(cz, cy, cx, bit) AS (VALUES {CUBE_CORNERS}),
cells AS (SELECT case_id, label_id, z - cz AS cz, y - cy AS cy, x - cx AS cx, sum(bit) AS config FROM reg, corner GROUP BY case_id, label_id, z - cz, y - cy, x - cx),
sums AS (SELECT case_id, label_id, sum(area) AS a, abs(sum(volume + cz * nz + cy * ny + cx * nx)) AS v FROM cells JOIN cube USING (config) GROUP BY ALL)
SELECT case_id, label_id, v AS "MeshVolume", a AS "SurfaceArea", a / v AS "SurfaceVolumeRatio", power(36 * pi() * v * v, 1 / 3.0::DOUBLE) / a AS "Sphericity" FROM sums"""


def whole_copies_sql() -> str:
    """The rows of COPIES_LONG, the second singular value, and shape of every copy."""
    key = "case_id, label_id // 10 AS label_id, label_id % 10 AS repeat"
    parts = [COPIES_LONG, f"""SELECT {key}, 'original_glcm_MCC' AS feature, value FROM (
  WITH RECURSIVE {COPIES}{GLCM_SQL[len(LEV):]}, {MCC_SQL} SELECT case_id, label_id, {near('mcc')} AS value FROM mc)"""]
    for tail in (ORACLE["shape_moments"][len(f"WITH {REG}"):], ORACLE["shape_diameters"][len(f"WITH {REG}"):], MESH_SQL):
        parts.append(f"""SELECT {key}, 'original_shape_' || feature AS feature, {near('value', 4)} AS value FROM (UNPIVOT (
  WITH RECURSIVE {COPIES} SELECT * FROM (WITH reg AS (SELECT * FROM cv){tail})) ON COLUMNS(* EXCLUDE (case_id, label_id)) INTO NAME feature VALUE value)""")
    return " UNION ALL ".join(parts)


@query("perturbed_features", whole_copies_sql())
def _(spark, folder):
    return near_families(perturbed(spark, folder, True))


def icc_sql(digits: int) -> str:
    """ICC per feature over all regions and copies, from rounded features."""
    return f"""WITH rows AS MATERIALIZED ({COPIES_LONG}), n AS (SELECT {extraction.REPEATS + 1} AS k),
c AS (SELECT feature, case_id, label_id, avg(value) AS mean, var_pop(value) * k AS within FROM rows, n GROUP BY feature, case_id, label_id, k HAVING count(value) = k AND count(*) = k),
f AS (SELECT feature, count(*) AS n, k * var_samp(mean) AS msb, sum(within) / (count(*) * (k - 1)) AS msw FROM c, n GROUP BY feature, k)
SELECT feature, n, CASE WHEN n >= 2 AND msb + (k - 1) * msw > 0 THEN {near('(msb - msw) / (msb + (k - 1) * msw)', digits)} END AS icc FROM f, n"""


@query("reproducibility_icc", icc_sql(4))
def _(spark, folder):
    """Texture families as the SQL has them; shape and the second singular value of the co-occurrence are in `reproducibility_all`."""
    rows = families(perturbed(spark, folder, stacked=True))
    return rounded(extraction.reproducibility(rows, extraction.REPEATS + 1)[0], 4)


@query("reproducibility_all")
def _(spark, folder):
    return rounded(extraction.reproducibility(perturbed(spark, folder, True, True), extraction.REPEATS + 1)[0], 4)


# ------------------------------------------------------------------ jobs
BROKEN = "case_id % 100 = 7"


def broken_crops(spark, folder):
    """The crops, every hundredth case with an image that lacks its last voxel."""
    return whole_crops(spark, folder).withColumn("image", F.expr(f"if({BROKEN}, slice(image, 1, size(image) - 1), image)"))


def safe_levels(rows):
    return intensity.discretize_width(rows.where("inside = 1"), REGION, WIDTH)


@query("extract_safely", f"SELECT * FROM ({FAMILIES_LONG}) WHERE NOT {BROKEN}")
def _(spark, folder):
    store = new_folder(spark, "features-safe")
    extraction.extract_safely(broken_crops(spark, folder), store, "dddd0004", safe_levels, REGION, with_shape=False)
    return families(records.read_features(spark, store, "dddd0004"))


@query("extract_errors", f"WITH {REG} SELECT DISTINCT case_id || ':' || label_id AS key, 'image does not fill its shape' AS error FROM reg WHERE {BROKEN}")
def _(spark, folder):
    return extraction.extract_safely(broken_crops(spark, folder), new_folder(spark, "features-safe"), "dddd0004", safe_levels, REGION, ("firstorder",), False)


@query("normalised_mr", f"""WITH {BOX}, c AS ({crop_sql(0)}), s AS (SELECT case_id, label_id, avg(intensity) AS mu, stddev_samp(intensity) AS sd FROM c GROUP BY ALL)
SELECT case_id, label_id, z, y, x, {near('(intensity - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END * 100', 4)} AS intensity FROM c JOIN s USING (case_id, label_id)""")
def _(spark, folder):
    vox = voxels(spark, folder)
    cropped = geometry.crop_voxels(vox, geometry.label_bbox(vox))
    return rounded(extraction.normalised(cropped, REGION, "MR").select(*REGION, *AXES, "intensity"), 4)


SPECS = [("flag", "classification", "per_label", 3, 0), ("source_level", "classification", "per_case", 5, 1), ("age", "regression", "per_case", None, 2)]
TARGETS = f"""{RTARGET}, {CASES}, tg AS (SELECT case_id, 'flag' AS target, label_id, value FROM rtarget
  UNION ALL SELECT case_id, 'source_level', NULL, source_level FROM cases UNION ALL SELECT case_id, 'age', NULL, age FROM cases)"""


def all_targets(spark, folder):
    """Targets of three kinds: a class per label, a class counted from 1 per case, and a number per case."""
    cases = bindings.cases(spark, folder)
    per_case = cases.selectExpr("case_id", "inline(array(named_struct('target', 'source_level', 'value', source_level), named_struct('target', 'age', 'value', age)))")
    rows = bindings.region_targets(spark, folder).selectExpr("case_id", "'flag' as target", "label_id", "value")
    return rows.unionByName(per_case.selectExpr("case_id", "target", "cast(null as int) as label_id", "value"))


def target_table(spark):
    return spark.createDataFrame(SPECS, "target string, type string, scope string, num_classes int, position int")


@query("canonical_targets", f"""WITH {TARGETS}, kinds AS (SELECT * FROM (VALUES ('flag', 3), ('source_level', 5)) t(target, classes)),
s AS (SELECT target, classes, min(value) >= 1 AND max(value) = classes AS shifted FROM tg JOIN kinds USING (target) GROUP BY target, classes)
SELECT case_id, target, label_id, CASE WHEN shifted AND value - 1 BETWEEN 0 AND classes - 1 THEN value - 1 ELSE value END AS value FROM tg LEFT JOIN s USING (target)""")
def _(spark, folder):
    return splits.canonical_targets(all_targets(spark, folder), target_table(spark))


# Hold-out by classes of cases: those without a class are a stratum of their own.
@query("holdout_manifest", f"""WITH {CASES}, n AS (SELECT count(*) AS n FROM cases), h AS (SELECT n, greatest(1, least(n - 1, round_even(n * 0.2::DOUBLE, 0))) AS h FROM n)
SELECT 42 AS seed, 'targets' AS source, 0.2::DOUBLE AS holdout_fraction, 'stratified_shuffle' AS strategy, 'source_level' AS stratification_key, n AS n_cases,
  CAST(n - h AS BIGINT) AS n_train, CAST(h AS BIGINT) AS n_holdout FROM h""")
def _(spark, folder):
    from voxelframe.plans import jobs

    rows = all_targets(spark, folder).where("target <> 'flag'")
    return jobs.holdout_manifest(rows, target_table(spark), new_folder(spark, "holdout"))[1]


@query("preprocess_job", f"""WITH {REG}, {RTARGET}, t AS (SELECT case_id, label_id, v.value FROM (SELECT DISTINCT case_id, label_id FROM reg) r
  LEFT JOIN (SELECT case_id, label_id, value FROM rtarget) v USING (case_id, label_id))
SELECT 'plan' AS step, 1 AS n_rows UNION ALL SELECT 'crops', count(*) FROM (SELECT DISTINCT case_id, label_id FROM reg)
UNION ALL SELECT 'targets', count(*) FROM t UNION ALL SELECT 'folds', count(*) FROM embeddings""")
def _(spark, folder):
    """Plan, crops, targets and folds of all volumes: what each step left in the ledger; features and maps have their own queries."""
    from voxelframe.plans import jobs

    vol = volumes(spark, folder)
    shown = regions(spark, folder).select(*REGION).distinct()
    targets = shown.join(bindings.region_targets(spark, folder), REGION, "left").selectExpr("case_id", "'flag' as target", "label_id", "value")
    ledger = jobs.preprocess(vol, spark.sql("select explode(array(1, 2)) as label_id"), targets, target_table(spark), "volumes", "MR", new_folder(spark, "job"), "none")
    rows = [(step, row.n_rows) for (step, _), row in ledger.rows.items()]
    return spark.createDataFrame(rows, "step string, n_rows long")


# ------------------------------------------------------------------ ingest and stream
def nifti_bytes(values, spacing) -> bytes:
    """A gzipped NIfTI-1 file of a (z, y, x) array."""
    import gzip

    import numpy as np

    code = {"float32": (16, 32), "int16": (4, 16)}[str(values.dtype)]
    head = bytearray(352)
    head[0:4] = np.int32(348).tobytes()
    head[40:56] = np.array([3, *values.shape[::-1], 1, 1, 1, 1], "<i2").tobytes()
    head[70:74] = np.array(code, "<i2").tobytes()
    head[76:108] = np.array([1, *spacing[::-1], 0, 0, 0, 0], "<f4").tobytes()
    head[108:116] = np.array([352, 1], "<f4").tobytes()
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + values.tobytes(), 1)


def nifti_files(volumes, folder: str):
    """Image and label files (path, content) of every case, stored by Spark below the shared folder."""
    import numpy as np
    import pandas as pd

    def encoded(batches):
        for batch in batches:
            for row in batch.itertuples():
                for tail, cells, kind in (("_0000", row.image, "float32"), ("", row.label, "int16")):
                    values = np.asarray(cells, dtype=kind).reshape((-1, *row.shape[1:]))
                    yield pd.DataFrame({"path": [f"{folder}/case{row.case_id}{tail}.nii.gz"], "content": [nifti_bytes(values, row.spacing)]})

    return cut_lineage(volumes.select("case_id", "shape", "spacing", "image", "label").mapInPandas(encoded, "path string, content binary"))


IS_IMAGE = "endswith(path, '_0000.nii.gz')"


@query("volume_ingest", f"""WITH {VOX}, {SPACING} SELECT 'case' || case_id AS case_id, z, y, x, intensity, label_id, round(sy, 6) AS spacing_y, round(sx, 6) AS spacing_x
FROM vox JOIN spc USING (case_id)""")
def _(spark, folder):
    files = nifti_files(volumes(spark, folder), "files")
    rows = voxels_of_blocks(blocks_of(files.where(IS_IMAGE), files.where(f"not {IS_IMAGE}")), ("spacing",))
    return rows.selectExpr("case_id", *AXES, "intensity", "label_id", "round(spacing[1], 6) as spacing_y", "round(spacing[2], 6) as spacing_x")


@query("ingest_violations", """SELECT 'case' || vec_id AS case_id,
  CASE vec_id % 5 WHEN 0 THEN 'no_label' WHEN 1 THEN 'no_image' ELSE 'unequal_grids' END AS violation FROM embeddings WHERE vec_id % 5 < 3""")
def _(spark, folder):
    """Of every five cases one lacks its label file, one its image file, and one has a label without the last slice."""
    cut = "if(case_id % 5 = 2, slice(label, 1, size(label) - shape[1] * shape[2]), label) as label"
    files = nifti_files(volumes(spark, folder).selectExpr("case_id", "shape", "spacing", "image", cut), "files")
    case = "cast(regexp_extract(path, 'case([0-9]+)', 1) as bigint)"
    return ingest_violations(files.where(f"{IS_IMAGE} and {case} % 5 <> 1"), files.where(f"not {IS_IMAGE} and {case} % 5 <> 0"))


@query("extract_stream", FAMILIES_LONG)
def _(spark, folder):
    """Crops that arrive in two batches end up in the store once."""
    from voxelframe.streaming.crops import extract_stream

    crops, store, marks = new_folder(spark, "stream-crops"), new_folder(spark, "stream-store"), new_folder(spark, "stream-marks")
    rows = whole_crops(spark, folder)
    for part in (0, 1):
        rows.where(f"case_id % 2 = {part}").write.mode("append").parquet(crops)
        extract_stream(
            spark, crops, store, marks, "aaaa0001", ALL, lambda r: intensity.discretize_width(r, REGION, WIDTH),
            with_shape=False,
        ).awaitTermination()
    return families(records.read_features(spark, store, "aaaa0001"))
