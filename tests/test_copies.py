"""Many masks of a region at once against one mask after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import copies, intensity, morphology
from voxelframe.plans import extraction

KEYS = ["case_id", "label_id"]
SIZE = (20, 36, 36)  # reaches over tile borders on all axes


@pytest.fixture(scope="module")
def ball(spark):
    """Two regions over tile borders, one of them at the edge of the grid, and one of a single voxel."""
    z, y, x = np.mgrid[tuple(slice(0, s) for s in SIZE)]
    rows = []
    for label, (centre, radius) in enumerate([((15, 31, 31), 5), ((0, 33, 0), 3.5), ((10, 10, 10), 0.5)], 1):
        inside = (z - centre[0]) ** 2 + (y - centre[1]) ** 2 + (x - centre[2]) ** 2 <= radius**2
        inside &= (z * 7 + y * 5 + x * 3) % 41 > 0
        rows += [(1, label, int(a), int(b), int(c)) for a, b, c in np.argwhere(inside)]
    mask = spark.createDataFrame(rows, "case_id long, label_id int, z int, y int, x int")
    return mask.selectExpr("case_id", "label_id", f"{SIZE[0]} as sz", f"{SIZE[1]} as sy", f"{SIZE[2]} as sx", "z", "y", "x").repartition(4).cache()


@pytest.fixture(scope="module")
def image(spark):
    grid = spark.range(SIZE[0] * SIZE[1] * SIZE[2]).selectExpr(
        "1L as case_id", f"int(id div {SIZE[1] * SIZE[2]}) as z", f"int((id div {SIZE[2]}) % {SIZE[1]}) as y", f"int(id % {SIZE[2]}) as x"
    )
    return grid.withColumn("intensity", F.expr("double((z * 37 + y * 11 + x * 5 + z * x) % 97)")).cache()


@pytest.mark.parametrize("repeats,seed", [(8, 42), (20, 7)])
def test_copies_are_those_of_the_plain_operator(ball, repeats, seed):
    plain = morphology.perturb(ball, KEYS, repeats, seed).groupBy(*KEYS, "z", "y", "x").agg(F.expr("bit_or(shiftleft(1L, repeat)) as copies"))
    made = copies.perturbed(ball, KEYS, repeats, seed)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect()))


def test_every_change_is_drawn(ball):
    modes = ball.select(*KEYS).distinct().selectExpr(f"explode({copies.changes(KEYS, 20, 7)[0]}) as mode")
    assert {r.mode for r in modes.collect()} == {0, 1, 2, 3, 4}


def test_too_many_copies(ball):
    with pytest.raises(ValueError):
        copies.perturbed(ball, KEYS, 63)


@pytest.mark.parametrize("modality", ["CT", "MR"])
def test_features_are_those_of_each_copy_alone(ball, image, modality):
    """All families, shape and second singular value included, and levels by width or by count."""
    found = extraction.perturbed_features(ball, image, KEYS, modality, repeats=4, seed=7)
    masks = morphology.perturb(ball, KEYS, 4, 7).join(image, ["case_id", "z", "y", "x"])
    groups = [*KEYS, "repeat"]
    want = extraction.region_features(extraction.discretised(masks, groups, modality), groups)
    a = {(r.label_id, r.repeat, r.feature): r.value for r in found.collect()}
    b = {(r.label_id, r.repeat, r.feature): r.value for r in want.collect()}
    assert a.keys() == b.keys() and len(a) > 2 * 5 * 90
    for key, value in b.items():
        assert (a[key] is None) == (value is None) and (value is None or a[key] == pytest.approx(value, rel=1e-6, abs=1e-8)), key


def test_levels_of_a_copy_start_at_its_lowest_value(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, 0, 10.0, 0b11), (1, 1, 0, 0, 1, 60.0, 0b10), (1, 1, 0, 0, 2, 40.0, 0b01)], "case_id long, label_id int, z int, y int, x int, intensity double, copies long")
    leveled, tops = copies.levels(rows, KEYS, 2, width=25.0)
    assert {r.x: r.cell for r in leveled.collect()} == {0: [1, 1, 0], 1: [0, 3, 0], 2: [2, 0, 0]}
    assert {(r.repeat, r.n_levels) for r in tops.collect()} == {(0, 2), (1, 3)}
    assert intensity.discretize_width(rows.where("copies & 2 <> 0"), KEYS, 25.0).agg(F.max("level")).first()[0] == 3


def test_copies_stay_in_their_tiles(spark, monkeypatch):
    """With a constant grid the 27-fold rows are not shuffled again after tiles are dealt out."""
    plans = []
    monkeypatch.setattr(copies, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    rows = spark.range(64).selectExpr("id div 64 as case_id", "int(id div 64) + 1 as label_id", "4 as sz", "4 as sy", "4 as sx", "int(id div 16) as z", "int(id div 4 % 4) as y", "int(id % 4) as x")
    copies.perturbed(rows, ["case_id", "label_id"], 3)
    assert plans and "REPARTITION_BY_NUM" in plans[0] and "ENSURE_REQUIREMENTS" not in plans[0]
