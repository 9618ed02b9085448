"""Exact top-k against a full product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.llm import topk


def brute(rows, k=5, every=50):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None})
    out = []
    for i, v in rows:
        if i % every == 0:
            scores = sorted((-int(np.dot(np.array(v, object), np.array(w, object))) if v else 0, j) for j, w in rows if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Rows that belong together must also meet where partitions are not merged."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def run(frame, **more):
    return sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 50 == 0, **more).collect()))


@pytest.mark.parametrize("block, query_block", [(8192, 1024), (37, 3), (1, 1)])
def test_embeddings(spark, block, query_block):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    table = table.where("vec_id < 120") if block == 1 else table
    assert run(table, block=block, query_block=query_block) == brute([(r.vec_id, r.v) for r in table.collect()])


def test_ties_lengths_and_large_values(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).tolist()) for i in range(300)] + [(1000 + i, [1, 1, 1, 1]) for i in range(200)]
    rows += [(400 + i * 50, [0, 0, 0, 0]) for i in range(2)] + [(600, [1 << 28, -(1 << 28), 5, 1]), (601, [1 << 28, 7, 7, 7])]
    rows += [(700, [5]), (701, [6]), (750, []), (751, []), (800, [1] * 9), (7, rows[7][1]), (7, rows[7][1]), (None, [1, 2, 3, 4]), (850, None)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert run(frame, block=64) == brute(rows)
    assert run(frame.where("false")) == []


def test_scaled(spark):
    rows = [([0.5, -0.001],), ([float("nan"), 1.0],), ([float("inf")],), ([None, 1.0],), (None,), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "e array<float>").select(topk.scaled(F.col("e"))).collect()]
    assert got == [[128, -1], None, None, None, None, []]


def test_the_bound_stops_early():
    """One dominant direction: few vectors are scored."""
    rows = np.zeros((5000, 8), np.int64)
    rows[:, 0] = np.arange(5000)
    lists = topk.SortedLists(np.arange(5000), rows)
    scored = []
    whole = lists.exact
    lists.exact = type("Seen", (), {"__getitem__": lambda self, i: scored.append(len(i)) or whole[i]})()
    assert lists.top(np.array([3, 0, 0, 0, 0, 0, 0, 0]), -1, 3) == [(3 * 4999, 4999), (3 * 4998, 4998), (3 * 4997, 4997)]
    assert sum(scored) < 200
