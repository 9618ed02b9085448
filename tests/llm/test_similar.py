"""The near-copy stage of the pipeline against exact similarity over all pairs."""

import random

import pytest

import corpus_pipeline as cp
from llm.conftest import EDGES, FOLDER
from llm.test_dedup import classes
from voxelframe.llm import simhash, similar


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([b" ".join(words)] if words else [])


def alike(a, b):
    return a == b or 100 * len(a & b) >= 80 * len(a | b)


def planted(seed=4):
    """(doc_id, text): originals, and copies at 0.8 to 0.95 with words changed in one place or in several."""
    rng, rows, word = random.Random(seed), [], iter(range(1 << 30))
    for i in range(40):
        text = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 400))]
        rows.append((10 * i, " ".join(text)))
        for j, share in enumerate((0.02, 0.05, 0.1, 0.11, 0.14)):
            copy = list(text)
            at = rng.randint(0, len(text) - int(share * len(text)) - 1)
            for k in range(at, at + max(int(share * len(text)) - 4, 1)):
                copy[k] = f"new{next(word)}"
            rows.append((10 * i + j + 1, " ".join(copy)))
    return rows


def kept_ids(rows):
    root = classes({shingles(t) for _, t in rows}, alike)
    best = {}
    for i, t in rows:
        r = root[shingles(t)]
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    return sorted(best.values())


@pytest.mark.parametrize("table", ["docs", "edges", "empty", "planted"])
def test_stage_keeps_one_of_each_component(spark, table, request):
    frame = spark.createDataFrame(planted(), "doc_id long, text string").repartition(4) if table == "planted" else request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    stage = dict(cp.STAGES)["near dedup"]
    out = stage(spark, frame, FOLDER)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == kept_ids(rows) and out.columns == frame.columns


def test_planted_copies_cover_the_range():
    by_id = {i: shingles(t) for i, t in planted()}
    found = [len(s & by_id[i - i % 10]) / len(s | by_id[i - i % 10]) for i, s in by_id.items() if i % 10]
    assert sum(0.8 <= s < 0.85 for s in found) > 10 and sum(0.85 <= s < 0.9 for s in found) > 5 and sum(s < 0.8 for s in found) > 10
    assert EDGES


def test_copies_of_copies_meet(spark):
    """A chain whose ends are unlike: members that the smallest node of a band does not reach are compared too."""
    text = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*text[6 * k :], *(f"t{i}" for i in range(6 * k))])) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id for r in similar.groups(frame).select("component_id").distinct().collect()] == [0]


def test_bounds_are_exact():
    """No pair that is similar is excluded by its sketches, whatever the sizes."""
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (1, 5, 60, 900, 6000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for share in (0, 0.05, 0.1, 0.2):
            b = np.unique(np.concatenate([a[int(share * size) :], rng.integers(0, 1 << 63, int(share * size) // 2).astype(np.uint64)]))
            gap = len(np.setxor1d(a, b))
            bits = sum(int(x ^ y).bit_count() for x, y in zip(similar.sketch(a).view(np.uint64).tolist(), similar.sketch(b).view(np.uint64).tolist()))
            assert bits <= gap and (size < 100 or gap > 300 or bits >= gap / 2)


def near_group(n, seed=9):
    """Copies of a text of 150 words with up to 8 changed words each: many pairs are close to the threshold, on both sides."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(n):
        copy = list(base)
        for j in range(rng.randint(1, 8)):
            copy[rng.randrange(150)] = f"x{i}_{j}" if rng.random() < 0.8 else f"y{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    return rows


def test_a_large_group_of_near_copies(spark):
    """All links of the group, from a number of verified pairs that grows with its members."""
    verified = {}
    for n in (300, 600):
        rows = near_group(n)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        seen = []
        real = similar._similar
        similar._similar = lambda pairs, sets, percent: seen.append(pairs.count()) or real(pairs, sets, percent)
        try:
            got = {r.doc_id: r.component_id for r in similar.groups(frame).collect()}
        finally:
            similar._similar = real
        root = classes({shingles(t) for _, t in rows}, alike)
        first = {}
        for i, t in rows:
            first[root[shingles(t)]] = min(i, first.get(root[shingles(t)], i))
        assert got == {i: first[root[shingles(t)]] for i, t in rows}
        verified[n] = sum(seen)
    assert verified[600] < 2.5 * verified[300], verified


def test_ball_hashing_is_a_step_of_the_stage(spark, monkeypatch):
    """Without any band, the stage still drops the near copies whose fingerprints are within three bits, and no other text."""
    rows = planted()
    rng = random.Random(2)
    long = [f"w{rng.randint(0, 3000)}" for _ in range(3000)]
    for i in range(30):
        copy = list(long)
        copy[100 * i] = f"other{i}"
        rows.append((1000 + i, " ".join(copy)))
    # Same fingerprint, unlike sets: a candidate of the ball hashing that the sets refute.
    rows += [(2000, ""), (2001, "a b c d e f")]
    marks = {shingles(t): sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) for _, t in rows for hashes in [similar.shingle_hashes(t.encode()).tolist()]}
    assert all(simhash.fingerprint_of(similar.shingle_hashes(t.encode())) % (1 << 64) == marks[shingles(t)] for _, t in rows)
    root = classes(set(marks), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 3 and alike(a, b))
    first = {}
    for i, t in rows:
        first[root[shingles(t)]] = min(i, first.get(root[shingles(t)], i))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(similar, "_members", lambda nodes: nodes.selectExpr("node", "node AS band").where("false"))
    out = {r.doc_id for r in dict(cp.STAGES)["near dedup"](spark, frame, FOLDER).collect()}
    assert out == set(first.values()) and len(out) < len(rows) - 20


def test_ball_pairs_stay_linear(spark):
    """Nodes of one fingerprint, and of fingerprints one bit apart, are linked to the smallest ones and not to each other."""
    nodes = [(1000 * bit + i, 1 << bit) for bit in range(8) for i in range(200)]
    pairs = similar.ball_pairs(spark.createDataFrame(nodes, "node long, fp long")).collect()
    found = {frozenset((r.a, r.b)) for r in pairs}
    assert len(set(classes({n for n, _ in nodes}, lambda a, b: frozenset((a, b)) in found).values())) == 1
    assert len(pairs) < len(nodes) + 8 * 8
