"""Regions inside one tile, measured where they arrive, against the tables that take regions of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.catalog.base import QUERIES
from voxelframe.operators import bank, compact, copies, intensity, quality
from voxelframe.plans import extraction

KEYS = ["case_id", "label_id"]


@pytest.fixture(scope="module")
def voxels(spark):
    """Regions of many forms: sparse, one voxel, two, flat, a bar over a tile border, voxels that come twice, a missing value."""
    generator, rows = np.random.default_rng(8), []
    for case in range(12):
        corner = generator.integers(0, 9, 3)
        size = generator.integers(1, 8, 3)
        for at in np.ndindex(*size):
            if generator.uniform() < 0.2 + case / 14:
                rows.append((case, 1, *(int(v) for v in corner + at), float(np.round(generator.normal(), 2))))
    rows += [(20, 1, 3, 3, 3, 1.5), (21, 1, 3, 3, 3, 1.5), (21, 1, 9, 3, 4, -1.5), (22, 1, 0, 0, 0, 0.1), (22, 1, 0, 0, 1, 0.1), (22, 2, 5, 5, 5, 0.1)]
    rows += [(23, 1, z, 30, x, float((z * 3 + x) % 5)) for z in range(12, 20) for x in range(3)]
    rows += [(24, 1, 1, 1, x, float(x)) for x in (0, 1, 2, 2)] + [(25, 1, 1, 1, x, None if x == 1 else float(x)) for x in range(5)]
    return spark.createDataFrame(rows, "case_id long, label_id int, z int, y int, x int, intensity double").repartition(3).cache()


def everything_spread(monkeypatch):
    """All regions take the way of those that do not fit."""
    real = compact.split

    def none(rows, keys, *more):
        return real(rows.where("false"), keys, *more)[0], rows

    monkeypatch.setattr(compact, "split", none)


def values(rows, *keys):
    got = {tuple(r[k] for k in (*keys, "feature")): r.value for r in rows.collect()}
    return got, pytest.approx(got, abs=1e-9, rel=1e-9)


@pytest.mark.parametrize("with_shape,families", [(True, tuple(extraction.FAMILIES)), (False, ("glcm", "firstorder")), (False, ("glszm",))])
def test_small_regions_have_the_features_of_large_ones(voxels, monkeypatch, with_shape, families):
    levels = intensity.discretize_width(voxels.where("intensity is not null"), KEYS, 0.5)
    got, _ = values(extraction.region_features(levels, KEYS, families, with_shape), *KEYS)
    everything_spread(monkeypatch)
    _, want = values(extraction.region_features(levels, KEYS, families, with_shape), *KEYS)
    assert got == want and len({k[0] for k in got}) >= 15


def test_image_types_are_a_key(voxels, monkeypatch):
    both = voxels.where("intensity is not null").selectExpr("*", "explode(array('original', 'log-sigma-1')) as image_type").withColumn("intensity", F.expr("if(image_type = 'original', intensity, 2 - intensity)"))
    levels = intensity.discretize_width(both, [*KEYS, "image_type"], 0.5)
    got, _ = values(extraction.region_features(levels, KEYS), *KEYS)
    everything_spread(monkeypatch)
    _, want = values(extraction.region_features(levels, KEYS), *KEYS)
    assert got == want and {k[-1].split("_")[0] for k in got} == {"original", "log-sigma-1"}
    assert not any(k[-1].startswith("log-sigma-1_shape") for k in got)


@pytest.mark.parametrize("bins", [{"width": 0.5}, {"count": 8}])
def test_copies_of_small_regions(voxels, monkeypatch, bins):
    marked = voxels.where("intensity is not null").withColumn("copies", F.expr("1 | if((z + x) % 3 > 0, 2, 0) | if(y % 2 = 0, 8, 0)").cast("long"))
    got, _ = values(copies.features(marked, KEYS, 3, **bins), *KEYS, "repeat")
    chunks = compact.CHUNK
    monkeypatch.setattr(compact, "CHUNK", 40)
    again, _ = values(copies.features(marked, KEYS, 3, **bins), *KEYS, "repeat")
    monkeypatch.setattr(compact, "CHUNK", chunks)
    everything_spread(monkeypatch)
    _, want = values(copies.features(marked, KEYS, 3, **bins), *KEYS, "repeat")
    assert got == want and again == want and {k[2] for k in got} == {0, 1, 3}


def test_features_of_small_regions_are_not_shuffled(spark, voxels):
    """What was packed is measured where it lies: no exchange per family, copy or region."""
    marked = voxels.where("case_id < 12").withColumn("copies", F.lit(7).cast("long"))
    levels = intensity.discretize_width(voxels.where("case_id < 12"), KEYS, 0.5)
    rows = copies.stacked(marked, KEYS, 2, 0.5)
    for frame in (rows, copies.features(marked, KEYS, 2, 0.5), extraction.region_features(levels, KEYS)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    scores = extraction.reproducibility(rows, 3)[0]
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(feature" in plan


def test_icc_of_stacked_values(spark, voxels):
    marked = voxels.where("case_id < 12").withColumn("copies", F.expr("1 | if((z + x) % 3 > 0, 2, 0) | if(y % 4 > 0, 4, 0)").cast("long"))
    rows = copies.stacked(marked, KEYS, 2, 0.5)
    constant = spark.createDataFrame([(c, 1, "flat", [(k, 0.1) for k in range(3)]) for c in range(4)], "case_id long, label_id int, feature string, found array<struct<repeat:int,value:double>>")
    few = spark.createDataFrame([(0, 1, "few", [(0, 1.0), (1, 2.0)])], constant.schema)
    rows = rows.unionByName(constant).unionByName(few)
    want = {r.feature: (r.n, r.icc) for r in extraction.reproducibility(rows.selectExpr(*KEYS, "feature", "inline(found)"), 3)[0].collect()}
    got = {r.feature: (r.n, r.icc) for r in extraction.reproducibility(rows, 3)[0].collect()}
    assert got.keys() == want.keys() and got["flat"] == (4, None) and got["few"] == (0, None)
    assert all(got[f][0] == n and got[f][1] == (icc if icc is None else pytest.approx(icc, abs=1e-9)) for f, (n, icc) in want.items())
    assert quality.icc_stacked(rows, 4).where("n > 0").isEmpty()


def test_image_types_of_small_crops_are_packed(spark, monkeypatch):
    """Crops of two sizes, one of a single voxel row, and one with a gap, which takes the lines."""
    generator, rows = np.random.default_rng(3), []
    for case, size in enumerate([(4, 5, 6), (4, 5, 6), (3, 3, 1), (5, 4, 4)]):
        rows += [(case, *(int(a) for a in at), float(generator.normal()), int(generator.uniform() < 0.7)) for at in np.ndindex(*size) if (case, at) != (3, (2, 2, 2))]
    crops = spark.createDataFrame(rows, "case_id long, z int, y int, x int, intensity double, inside int")
    key = lambda r: (r.case_id, r.z, r.y, r.x, r.image_type)
    got = {key(r): r.intensity for r in extraction.image_types(crops, ["case_id"], (1.0, 2.0)).collect()}
    real = bank.split
    monkeypatch.setattr(bank, "split", lambda r, keys: (real(r.where("false"), keys)[0], r))
    want = {key(r): r.intensity for r in extraction.image_types(crops, ["case_id"], (1.0, 2.0)).collect()}
    assert got == pytest.approx(want, abs=2e-8) and len(got) == 11 * sum(r[-1] for r in rows) and len(want) == len(got)


def test_query_of_copies_leaves_no_feature_out(spark, tmp_path):
    """Second singular value and shape belong to the features of every copy."""
    generator = np.random.default_rng(1)
    rows = [(i, [float(v) for v in generator.normal(0, 0.125, 64)], i % 10) for i in range(3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["perturbed_features"](spark, str(tmp_path)).collect()
    found = {}
    for r in got:
        found.setdefault((r.case_id, r.label_id, r.repeat), set()).add(r.feature)
    assert len(found) == 3 * 2 * 9
    every = {f"original_{family}_{name}" for family, names in compact.NAMES.items() for name in names}
    full = [names for names in found.values() if len(names) == len(every)]
    assert len(every) == 107 and len(full) > 40 and all(names == every for names in full)
    assert all("original_shape_MeshVolume" in names for names in found.values())
