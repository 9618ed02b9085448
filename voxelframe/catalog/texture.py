"""Region features: discretisation and the texture families."""

from __future__ import annotations

from voxelframe.catalog.base import LEV, OFF, REG, near, near_all, query, rounded
from voxelframe.operators import intensity, texture
from voxelframe.operators.tiles import neighbour_pairs
from voxelframe.sources.bindings import REGION, regions

WIDTH = 0.05


def levels(spark, folder):
    return intensity.discretize_width(regions(spark, folder), REGION, WIDTH)


@query("discretize_width", f"WITH {LEV} SELECT case_id, label_id, z, y, x, level, n_levels FROM lev")
def _(spark, folder):
    return levels(spark, folder).select(*REGION, "z", "y", "x", "level", "n_levels")


@query("discretize_count", f"""WITH {REG}, e AS (
  SELECT case_id, label_id, min(intensity) AS lo, max(intensity) AS hi FROM reg GROUP BY ALL)
SELECT case_id, label_id, z, y, x,
  CASE WHEN hi = lo THEN 1 ELSE CAST(least(32, floor((intensity - lo) / (hi - lo) * 32) + 1) AS INTEGER) END AS level
FROM reg JOIN e USING (case_id, label_id)""")
def _(spark, folder):
    return intensity.discretize_count(regions(spark, folder), REGION, 32).select(*REGION, "z", "y", "x", "level")


FIRST = [
    "Energy", "TotalEnergy", "Entropy", "Minimum", "10Percentile", "90Percentile", "Maximum", "Mean", "Median",
    "InterquartileRange", "Range", "MeanAbsoluteDeviation", "RobustMeanAbsoluteDeviation", "RootMeanSquared", "Skewness",
    "Kurtosis", "Variance", "Uniformity",
]


FIRST_SQL = f"""WITH {LEV}, m AS (
  SELECT case_id, label_id, avg(intensity) AS mu, quantile_cont(intensity, 0.1) AS p10, quantile_cont(intensity, 0.9) AS p90,
         quantile_cont(intensity, 0.25) AS p25, quantile_cont(intensity, 0.75) AS p75, median(intensity) AS med
  FROM lev GROUP BY ALL),
mid AS (SELECT case_id, label_id, avg(intensity) AS rmu FROM lev JOIN m USING (case_id, label_id)
  WHERE intensity BETWEEN p10 AND p90 GROUP BY ALL),
rob AS (SELECT case_id, label_id, avg(abs(intensity - rmu)) AS rmad FROM lev JOIN m USING (case_id, label_id)
  JOIN mid USING (case_id, label_id) WHERE intensity BETWEEN p10 AND p90 GROUP BY ALL),
h0 AS (SELECT case_id, label_id, level, count(*) AS n FROM lev GROUP BY ALL),
h AS (SELECT *, sum(n) OVER (PARTITION BY case_id, label_id) AS t FROM h0),
u AS (SELECT case_id, label_id, -sum(n / t * log2(n / t)) AS ent, sum((n / t) * (n / t)) AS uni FROM h GROUP BY ALL),
c AS (SELECT case_id, label_id, max(m.mu) AS mean, avg(power(intensity - mu, 2)) AS m2, avg(power(intensity - mu, 3)) AS m3,
        avg(power(intensity - mu, 4)) AS m4, avg(abs(intensity - mu)) AS mad, sum(intensity * intensity) AS e,
        min(intensity) AS lo, max(intensity) AS hi, avg(intensity * intensity) AS ms
  FROM lev JOIN m USING (case_id, label_id) GROUP BY ALL),
f AS (SELECT case_id, label_id, e AS "Energy", e AS "TotalEnergy", ent AS "Entropy", lo AS "Minimum", p10 AS "10Percentile",
  p90 AS "90Percentile", hi AS "Maximum", mean AS "Mean", med AS "Median", p75 - p25 AS "InterquartileRange", hi - lo AS "Range",
  mad AS "MeanAbsoluteDeviation", rmad AS "RobustMeanAbsoluteDeviation", sqrt(ms) AS "RootMeanSquared",
  CASE WHEN hi > lo THEN m3 / power(m2, 1.5) ELSE 0 END AS "Skewness", CASE WHEN hi > lo THEN m4 / (m2 * m2) ELSE 0 END AS "Kurtosis",
  m2 AS "Variance", uni AS "Uniformity"
  FROM c JOIN m USING (case_id, label_id) JOIN u USING (case_id, label_id) JOIN rob USING (case_id, label_id))"""


@query("firstorder", f"""{FIRST_SQL} SELECT {near_all(["case_id", "label_id"], FIRST)} FROM f""")
def _(spark, folder):
    return rounded(texture.firstorder(levels(spark, folder), REGION))


PAIRS = LEV + ", " + OFF


@query("neighbour_pairs", f"""WITH {PAIRS}
SELECT dz, dy, dx, count(*) AS n_pairs, CAST(sum((a.level - b.level) * (a.level - b.level)) AS BIGINT) AS squared_gap
FROM lev a JOIN half13 ON true JOIN lev b ON b.case_id = a.case_id AND b.label_id = a.label_id
 AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL""")
def _(spark, folder):
    from pyspark.sql import functions as F

    pairs = neighbour_pairs(levels(spark, folder), REGION, "level", texture.HALF_13)
    gap = (F.col("level") - F.col("n_level")).cast("bigint")
    return pairs.groupBy("dz", "dy", "dx").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(gap * gap).alias("squared_gap"))


GLCM_SQL = PAIRS + """, raw AS (
  SELECT a.case_id, a.label_id, a.n_levels AS g, dz * 9 + dy * 3 + dx AS dir, a.level AS i, b.level AS j, count(*) AS n
  FROM lev a, half13, lev b WHERE b.case_id = a.case_id AND b.label_id = a.label_id
   AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
sym AS (SELECT case_id, label_id, g, dir, i, j, sum(n) AS n FROM (
  SELECT * FROM raw UNION ALL SELECT case_id, label_id, g, dir, j, i, n FROM raw) GROUP BY ALL),
pm AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY case_id, label_id, dir) AS p FROM sym),
mg AS (SELECT case_id, label_id, dir, i, sum(p) AS px FROM pm GROUP BY ALL),
mo AS (SELECT case_id, label_id, dir, sum(i * px) AS mu, -sum(px * log2(px)) AS hx FROM mg GROUP BY ALL),
hh AS (SELECT a.case_id, a.label_id, a.dir, -sum(a.px * b.px * log2(a.px * b.px)) AS hxy2 FROM mg a JOIN mg b
   USING (case_id, label_id, dir) GROUP BY ALL),
ps AS (SELECT case_id, label_id, dir, -sum(q * log2(q)) AS se FROM (
   SELECT case_id, label_id, dir, i + j AS k, sum(p) AS q FROM pm GROUP BY ALL) GROUP BY ALL),
pd AS (SELECT case_id, label_id, dir, -sum(q * log2(q)) AS de, sum(k * q) AS da, sum(k * k * q) AS kk FROM (
   SELECT case_id, label_id, dir, abs(i - j) AS k, sum(p) AS q FROM pm GROUP BY ALL) GROUP BY ALL),
fx AS (SELECT case_id, label_id, dir, any_value(mu) AS mu, any_value(hx) AS hx,
   sum(i * j * p) AS ac, sum(power(i + j - 2 * mu, 4) * p) AS cp, sum(power(i + j - 2 * mu, 3) * p) AS cs,
   sum(power(i + j - 2 * mu, 2) * p) AS ct, sum((i - j) * (i - j) * p) AS con, sum((i - mu) * (j - mu) * p) AS cov,
   sum((i - mu) * (i - mu) * p) AS ss, sum(p * p) AS je, -sum(p * log2(p)) AS hxy, -sum(p * log2(a.px * b.px)) AS hxy1,
   sum(p / (1 + abs(i - j))) AS id, sum(p / (1 + (i - j) * (i - j))) AS idm, sum(p / (1 + abs(i - j) / g::DOUBLE)) AS idn,
   sum(p / (1 + (i - j) * (i - j) / (g * g)::DOUBLE)) AS idmn,
   coalesce(sum(CASE WHEN i <> j THEN p / ((i - j) * (i - j)) END), 0) AS iv, max(p) AS mp
  FROM pm JOIN mo USING (case_id, label_id, dir) JOIN mg a USING (case_id, label_id, dir, i)
   JOIN (SELECT case_id, label_id, dir, i AS j, px FROM mg) b USING (case_id, label_id, dir, j) GROUP BY ALL),
fd AS (SELECT case_id, label_id, ac AS "Autocorrelation", mu AS "JointAverage", cp AS "ClusterProminence", cs AS "ClusterShade",
   ct AS "ClusterTendency", con AS "Contrast", CASE WHEN ss > 1e-12 THEN cov / ss ELSE 1 END AS "Correlation",
   da AS "DifferenceAverage", de AS "DifferenceEntropy", kk - da * da AS "DifferenceVariance", je AS "JointEnergy",
   hxy AS "JointEntropy", CASE WHEN hx > 1e-12 THEN (hxy - hxy1) / hx ELSE 0 END AS "Imc1",
   sqrt(greatest(0, 1 - exp(-2 * (hxy2 - hxy)))) AS "Imc2", id AS "Id", idm AS "Idm", idn AS "Idn", idmn AS "Idmn",
   iv AS "InverseVariance", mp AS "MaximumProbability", 2 * mu AS "SumAverage", se AS "SumEntropy", ss AS "SumSquares"
  FROM fx JOIN ps USING (case_id, label_id, dir) JOIN pd USING (case_id, label_id, dir) JOIN hh USING (case_id, label_id, dir))"""
GLCM_AVG = ", ".join(f'avg("{n}") AS "{n}"' for n in texture.GLCM_FEATURES)


@query("glcm", f"""WITH {GLCM_SQL}, f AS (SELECT case_id, label_id, {GLCM_AVG} FROM fd GROUP BY ALL)
SELECT {near_all(["case_id", "label_id"], texture.GLCM_FEATURES)} FROM f""")
def _(spark, folder):
    return rounded(texture.glcm(levels(spark, folder), REGION))


@query("glcm_mcc")
def _(spark, folder):
    return rounded(texture.glcm_mcc(levels(spark, folder), REGION))


def size_sql(matrix: str, family: str, directions: bool) -> str:
    """SQL of the level-by-size features over a CTE ``m`` (case_id, label_id, dir, level, size, n)."""
    names = texture.SIZE_NAMES[family]
    s, l, u, z = names["small"], names["large"], names["unit"], names["size"]
    g = "" if family == "gldm" else u
    f = {
        f"{s}Emphasis": "e1", f"{l}Emphasis": "e2", "GrayLevelNonUniformity": "gl / t", f"{z}NonUniformity": "rl / t",
        f"{z}NonUniformityNormalized": "rl / (t * t)", "GrayLevelVariance": "gv", f"{u}Variance": "rv", f"{u}Entropy": "ent",
        f"LowGrayLevel{g}Emphasis": "e3", f"HighGrayLevel{g}Emphasis": "e4", f"{s}LowGrayLevelEmphasis": "e5",
        f"{s}HighGrayLevelEmphasis": "e6", f"{l}LowGrayLevelEmphasis": "e7", f"{l}HighGrayLevelEmphasis": "e8",
    }
    if family != "gldm":
        f["GrayLevelNonUniformityNormalized"] = "gl / (t * t)"
        f[f"{u}Percentage"] = "t / np"
    k = "case_id, label_id, dir"
    body = ", ".join(f'avg({e}) AS "{n}"' for n, e in f.items())
    return f"""WITH {matrix},
tt AS (SELECT {k}, sum(n)::DOUBLE AS t, sum(n * size)::DOUBLE AS np, sum(n * level)::DOUBLE / sum(n) AS mi,
   sum(n * size)::DOUBLE / sum(n) AS mj FROM m GROUP BY ALL),
g1 AS (SELECT {k}, sum(q * q)::DOUBLE AS gl FROM (SELECT {k}, level, sum(n) AS q FROM m GROUP BY ALL) GROUP BY ALL),
g2 AS (SELECT {k}, sum(q * q)::DOUBLE AS rl FROM (SELECT {k}, size, sum(n) AS q FROM m GROUP BY ALL) GROUP BY ALL),
g3 AS (SELECT {k}, sum(p / (j * j)) AS e1, sum(p * j * j) AS e2, sum(p / (i * i)) AS e3, sum(p * i * i) AS e4,
   sum(p / (i * i * j * j)) AS e5, sum(p * i * i / (j * j)) AS e6, sum(p * j * j / (i * i)) AS e7, sum(p * i * i * j * j) AS e8,
   sum(p * (i - mi) * (i - mi)) AS gv, sum(p * (j - mj) * (j - mj)) AS rv, -sum(p * log2(p)) AS ent
  FROM (SELECT {k}, level::DOUBLE AS i, size::DOUBLE AS j, n / t AS p, mi, mj FROM m JOIN tt USING ({k})) GROUP BY ALL),
f AS (SELECT case_id, label_id, {body} FROM tt JOIN g1 USING ({k}) JOIN g2 USING ({k}) JOIN g3 USING ({k}) GROUP BY ALL)
SELECT {near_all(["case_id", "label_id"], list(f))} FROM f"""


RUNS = PAIRS + """, walk AS (
  SELECT case_id, label_id, dz * 9 + dy * 3 + dx AS dir, level, CASE WHEN dz > 0 THEN z WHEN dy > 0 THEN y ELSE x END AS t, z, y, x,
         dz, dy, dx FROM lev, half13),
isl AS (SELECT *, t - row_number() OVER (PARTITION BY case_id, label_id, dir, z - t * dz, y - t * dy, x - t * dx, level ORDER BY t) AS grp
  FROM walk),
rr AS (SELECT case_id, label_id, dir, level, z - t * dz AS a, y - t * dy AS b, x - t * dx AS c, grp, count(*) AS size FROM isl GROUP BY ALL),
m AS (SELECT case_id, label_id, dir, level, size, count(*) AS n FROM rr GROUP BY ALL)"""


@query("glrlm", size_sql(RUNS, "glrlm", True))
def _(spark, folder):
    return rounded(texture.glrlm(levels(spark, folder), REGION))


ZONES = PAIRS.replace("vox AS (", "RECURSIVE vox AS (", 1) + """, node AS (
  SELECT case_id, label_id, level, z, y, x, z * 16 + y * 4 + x AS id FROM lev),
link AS (SELECT a.case_id, a.label_id, a.level, a.id AS a, b.id AS b FROM node a, near26, node b
  WHERE a.case_id = b.case_id AND a.label_id = b.label_id AND a.level = b.level
    AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
reach AS (SELECT case_id, label_id, level, id, id AS other FROM node
  UNION SELECT r.case_id, r.label_id, r.level, r.id, l.b FROM reach r JOIN link l
    ON r.case_id = l.case_id AND r.label_id = l.label_id AND r.level = l.level AND r.other = l.a),
root AS (SELECT case_id, label_id, level, id, min(other) AS top FROM reach GROUP BY ALL),
zs AS (SELECT case_id, label_id, level, top, count(*) AS size FROM root GROUP BY ALL),
m AS (SELECT case_id, label_id, 0 AS dir, level, size, count(*) AS n FROM zs GROUP BY ALL)"""


@query("glszm", size_sql(ZONES, "glszm", False))
def _(spark, folder):
    return rounded(texture.glszm(levels(spark, folder), REGION))


DEPS = PAIRS + """, vv AS (
  SELECT a.case_id, a.label_id, a.level, a.z, a.y, a.x, count(*) FILTER (b.level = a.level) AS size
  FROM lev a, cube, lev b WHERE b.case_id = a.case_id AND b.label_id = a.label_id
    AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
m AS (SELECT case_id, label_id, 0 AS dir, level, size, count(*) AS n FROM vv GROUP BY ALL)"""


@query("gldm", size_sql(DEPS, "gldm", False))
def _(spark, folder):
    return rounded(texture.gldm(levels(spark, folder), REGION))


TONE = ["Coarseness", "Contrast", "Busyness", "Complexity", "Strength"]


@query("ngtdm", f"""WITH {PAIRS}, vv AS (
  SELECT a.case_id, a.label_id, a.level, a.z, a.y, a.x, avg(b.level) AS around FROM lev a, near26, lev b
  WHERE b.case_id = a.case_id AND b.label_id = a.label_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
lv AS (SELECT case_id, label_id, level::DOUBLE AS i, count(*) AS n, sum(abs(level - around)) AS s FROM vv GROUP BY ALL),
lp AS (SELECT *, n / sum(n) OVER w AS p, sum(n) OVER w AS t, count(*) OVER w AS gp FROM lv WINDOW w AS (PARTITION BY case_id, label_id)),
one AS (SELECT case_id, label_id, any_value(t) AS t, any_value(gp) AS gp, sum(p * s) AS ps, sum(s) AS ss FROM lp GROUP BY ALL),
two AS (SELECT a.case_id, a.label_id, sum(a.p * b.p * (a.i - b.i) * (a.i - b.i)) AS sp, sum(abs(a.i * a.p - b.i * b.p)) AS bu,
   sum(abs(a.i - b.i) * (a.p * a.s + b.p * b.s) / (a.p + b.p)) AS co, sum((a.p + b.p) * (a.i - b.i) * (a.i - b.i)) AS st
  FROM lp a JOIN lp b USING (case_id, label_id) GROUP BY ALL)
SELECT case_id, label_id, {near('CASE WHEN ps > 0 THEN 1 / ps ELSE 1000000 END', 4)} AS "Coarseness",
  {near('CASE WHEN gp > 1 THEN sp / (gp * (gp - 1)) * ss / t ELSE 0 END', 4)} AS "Contrast",
  {near('CASE WHEN bu > 1e-12 THEN ps / bu ELSE 0 END', 4)} AS "Busyness",
  {near('co / t', 4)} AS "Complexity", {near('CASE WHEN ss > 0 THEN st / ss ELSE 0 END', 4)} AS "Strength"
FROM one JOIN two USING (case_id, label_id)""")
def _(spark, folder):
    return rounded(texture.ngtdm(levels(spark, folder), REGION), 4)
