"""Neighbour counts, co-occurrence features and diameters of many regions at once, against brute force."""

from collections import Counter

import numpy as np
import pytest

from conftest import VOXELS, voxel_rows
from voxelframe.operators import shape, texture
from voxelframe.operators.tiles import CUBE_27, FULL_26, HALF_13

KEYS = ["case_id", "label_id"]


def level_at(levels, spot):
    return levels[spot] if all(0 <= c < n for c, n in zip(spot, levels.shape)) else 0


@pytest.mark.parametrize("tile", [(3, 2, 4), (16, 32, 32)])
def test_counts_over_tiles(spark, random_levels, tile):
    rows = spark.createDataFrame(voxel_rows(1, random_levels), VOXELS).selectExpr("*", "3 as n_levels")
    counts = texture.neighbour_counts(rows, KEYS, tile=tile).localCheckpoint()
    pairs, alike, near, gaps = Counter(), Counter(), Counter(), Counter()
    for spot in map(tuple, np.argwhere(random_levels > 0)):
        own = int(random_levels[spot])
        for d in HALF_13:
            other = int(level_at(random_levels, tuple(np.add(spot, d))))
            if other:
                pairs[(d[0] * 9 + d[1] * 3 + d[2], min(own, other), max(own, other))] += 1
        alike[(own, sum(level_at(random_levels, tuple(np.add(spot, d))) == own for d in CUBE_27))] += 1
        around = [o for o in (int(level_at(random_levels, tuple(np.add(spot, d)))) for d in FULL_26) if o]
        if around:
            near[own] += 1
            gaps[own] += abs(own - np.mean(around))
    got = texture.pair_counts(counts, [*KEYS, "n_levels"]).collect()
    assert {(r.direction, r.lo, r.hi): r.n for r in got} == dict(pairs)
    got = counts.selectExpr("inline(alike)").groupBy("level", "size").agg({"n": "sum"}).collect()
    assert {(r.level, r.size): r["sum(n)"] for r in got} == dict(alike)
    got = counts.selectExpr("inline(tones)").groupBy("level").agg({"n": "sum", "s": "sum"}).collect()
    assert {r.level: r["sum(n)"] for r in got} == dict(near)
    assert {r.level: r["sum(s)"] for r in got} == pytest.approx(dict(gaps))


def test_all_matrices_of_a_batch_are_solved_together(spark, monkeypatch):
    """A solver call per region and direction made the second singular values the slowest step of an extraction."""
    rng, calls, solve = np.random.default_rng(3), [], np.linalg.eigvalsh
    row = np.repeat(np.arange(200), 6)
    lo, hi = np.tile([0, 0, 0, 1, 1, 2], 200), np.tile([0, 1, 2, 1, 2, 2], 200)
    w = rng.random(len(row)) + 0.1
    w /= np.bincount(row, weights=w)[row]
    monkeypatch.setattr(np.linalg, "eigvalsh", lambda a: calls.append(a.shape) or solve(a))
    got = texture._second_values(row, lo, hi, w, 201)
    assert calls == [(200, 3, 3)] and got[200] == 1
    for r in (0, 77, 199):
        p = np.zeros((3, 3))
        for i, j, v in zip(lo[row == r], hi[row == r], w[row == r]):
            p[i, j] += v / 2
            p[j, i] += v / 2
        q = (p / p.sum(axis=1)[:, None]) @ (p / p.sum(axis=0)[None, :]).T
        assert got[r] == pytest.approx(np.sqrt(np.sort(np.linalg.eigvals(q).real)[-2]))


def test_pairs_are_joined_by_no_shuffle_join(spark, random_levels):
    rows = spark.createDataFrame(voxel_rows(1, random_levels), VOXELS).selectExpr("*", "3 as n_levels")
    for family in (texture.glcm, texture.gldm, texture.ngtdm):
        plan = family(rows, KEYS)._jdf.queryExecution().executedPlan().toString()
        assert "HashJoin" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("pairs", [64, 1 << 22])
def test_diameters_of_many_regions_are_those_of_the_hulls(monkeypatch, pairs):
    monkeypatch.setattr(shape, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    sizes = [7, 1, 60, 12]
    of = np.repeat(np.arange(4), sizes)
    points = rng.integers(0, 6, (3, len(of)))
    got = shape._all_distances(of, points, 4, (0, 1, 2))
    for r in range(4):
        p = points[:, of == r].T
        gaps = [(a, b, int(((a - b) ** 2).sum())) for a in p for b in p]
        assert got[0][r] == max(g for *_, g in gaps)
        for axis in range(3):
            assert got[1 + axis][r] == max(g for a, b, g in gaps if a[axis] == b[axis])
        both = np.concatenate([np.zeros(len(p), dtype=int), np.ones(len(p), dtype=int)])
        hulls = shape._hull_distances(both, np.concatenate([p, p]).T)
        assert [(2 * h) ** 2 for h in hulls] == pytest.approx([got[k][r] for k in range(4)])
