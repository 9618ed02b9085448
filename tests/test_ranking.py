import hashlib

import numpy as np
import pandas as pd
import pytest

from voxelframe.functions import ranking
from voxelframe.functions.ranking import average_rank, cell_code, hashed_position, percentiles, row_ranks, running_before, value_cells, value_ranks


@pytest.fixture(scope="module")
def values():
    generator = np.random.default_rng(1)
    wild = np.concatenate([
        generator.lognormal(0, 8, 300), -generator.lognormal(0, 8, 300), np.full(300, 2.5), np.array([0.0, 8.0, 2.0**29, 1e-310, 5e-324, 1e300]),
    ])
    return np.concatenate([wild, 2.0 ** np.arange(-30, 30), np.nextafter(2.0 ** np.arange(-30, 30), 0)])


@pytest.fixture(scope="module")
def frame(spark, values):
    rows = pd.DataFrame({"g": np.where(np.arange(len(values)) % 3 == 0, "a", "b"), "v": values, "i": np.arange(len(values))})
    return rows, spark.createDataFrame(rows)


def test_cell_code_keeps_order(frame):
    codes = frame[1].selectExpr("v", f"{cell_code('v')} as c").toPandas().sort_values("v")
    assert (np.diff(codes["c"].to_numpy()) >= 0).all()


def test_average_rank(frame):
    got = average_rank(frame[1], ["g"], "v").toPandas().set_index("i")["rank"].sort_index()
    assert np.array_equal(got.to_numpy(), frame[0].groupby("g")["v"].rank().to_numpy())


def test_value_ranks_total(frame):
    got = value_ranks(frame[1], ["g"], "v").toPandas().groupby("g").agg(n=("n", "sum"), total=("total", "first"))
    assert (got["n"] == got["total"]).all()


def test_percentiles(frame):
    probs = {"p00": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = percentiles(frame[1], ["g"], "v", probs).toPandas().set_index("g")
    for g, part in frame[0].groupby("g"):
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(np.quantile(part["v"], p), rel=1e-12)


def test_percentiles_without_keys_and_nulls(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "v double")
    assert percentiles(rows, [], "v", {"m": 0.5}).first()["m"] == 2.0


def test_hashed_position(spark):
    rows = spark.range(5000).selectExpr("id", "id % 2 as g")
    got = hashed_position(rows, ["g"], "id", 7).toPandas()
    for _, part in got.groupby("g"):
        order = sorted(part["id"], key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
        assert part.sort_values("position")["id"].tolist() == order
        assert (part["position_of"] == len(part)).all()


def test_running_before(spark):
    rows = spark.range(1000).selectExpr("id % 3 as g", "id as t", "id div 50 as part", "(id * 7919) % 101 as v")
    got = running_before(rows, ["g"], "part", ["t"], {"low": ("min", "v"), "total": ("sum", "v")}).toPandas().sort_values("t")
    for _, part in got.groupby("g"):
        assert part["low"].iloc[1:].tolist() == part["v"].cummin().iloc[:-1].tolist()
        assert part["total"].tolist() == (part["v"].cumsum() - part["v"]).tolist()


def test_rows_are_not_dealt_out_by_group_alone(spark):
    """Without broadcasts, whatever joins raw rows with cells or parts deals them out by cell or part too."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).selectExpr("id % 3 as k", "id", "double(id * 7 % 101) as v")
        for frame, part in ((value_ranks(rows, ["k"], "v"), "_cell"), (hashed_position(rows, ["k"], "id", 1), "_part")):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
            assert any(part in line for line in dealt)
            joins = plan.split("SortMergeJoin")[1:]
            assert joins and all(part in next(line for line in j.splitlines() if "hashpartitioning(" in line) for j in joins)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("crowded", [ranking.CROWDED, 20])
def test_rows_are_ranked_in_their_cells(frame, monkeypatch, crowded):
    """As the average ranks over the whole group, also where a cell is crowded."""
    monkeypatch.setattr(ranking, "CROWDED", crowded)
    rows, data = frame
    got = {r.i: (r.rank, r.total) for r in row_ranks(data, ["g"], "v", value_cells(data, ["g"], "v")).collect()}
    want, sizes = rows.groupby("g")["v"].rank(), rows.groupby("g")["v"].transform("size")
    assert got == {i: (want[i], sizes[i]) for i in range(len(rows))}
