"""Random forests whose trees are grown whole inside tasks, many trees side by side.

Features are cut into at most 32 bins (Spark ML's default), a byte per cell, so a task holds the training rows of a fold in
``MOST_CELLS`` bytes at most and grows its share of the trees over them without a shuffle per level. Trees, votes and models stay
in tables; the driver sees the bin limits only. Training rows beyond that bound are left to Spark ML. Bootstraps are Poisson
draws per tree and features are drawn per node by hash, so a tree does not depend on how trees are dealt out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators.tiles import partitions
from voxelframe.session import cut_lineage, read_if_there

MAX_BINS = 32
MOST_CELLS = 256 << 20  # binned cells (bytes) of a training table that a task may hold
TOGETHER = 1 << 16  # rows of the trees a task grows at once
SLAB = 1 << 16  # rows a task scores at once
TREE = "forest int, chunk int, tree int, feature binary, bin binary, left binary, value binary, gains binary"
PART = "forest int, block long, ids binary, sums binary, n int"


@dataclass(frozen=True)
class Spec:
    trees: int
    depth: int
    seed: int
    subset: str
    least: int = 1


def subset_size(strategy: str, features: int, trees: int, regression: bool) -> int:
    """Features a node looks at, by Spark ML's names."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird" if regression else "sqrt"
    named = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))), "onethird": math.ceil(features / 3)}
    if strategy in named:
        return named[strategy]
    return min(features, int(strategy) if strategy.isdigit() else math.ceil(float(strategy) * features))


def limits_of(values: np.ndarray) -> np.ndarray:
    """Upper limits of all bins but the last: halfway between neighbouring values, at even shares of the rows."""
    seen, n = np.unique(values, return_counts=True)
    at = np.arange(len(seen) - 1)
    if len(seen) > MAX_BINS:
        upto, wanted = np.cumsum(n)[:-1], len(values) * np.arange(1, MAX_BINS) / MAX_BINS
        after = np.minimum(np.searchsorted(upto, wanted), len(upto) - 1)
        before = np.maximum(after - 1, 0)
        at = np.unique(np.where(np.abs(upto[before] - wanted) <= np.abs(upto[after] - wanted), before, after))
    return (seen[at] + seen[at + 1]) / 2


# ---------------------------------------------------------------- growing
def _drawn(seed: int, tree: np.ndarray, heap: np.ndarray, features: int, k: int) -> np.ndarray:
    """k different features per node (tree, place in its tree)."""
    if k >= features:
        return np.broadcast_to(np.arange(features), (len(heap), features))
    with np.errstate(over="ignore"):
        x = (np.uint64(seed % (1 << 32)) * np.uint64(0x9E3779B97F4A7C15) + tree.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + heap * np.uint64(0x8CB92BA72F3D8DD7))[:, None]
        x = x + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0xAEF17502108EF2D9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return np.argpartition(x, k - 1, axis=1)[:, :k]


def _sums(parts: list[np.ndarray], whole: np.ndarray, regression: bool) -> np.ndarray:
    """Sum of squares over the weight: of all classes, the first of which is what the others leave, or of the target."""
    out = sum((p * p for p in parts), np.zeros(len(whole)))
    if not regression:
        rest = whole - sum(parts, np.zeros(len(whole)))
        out += rest * rest
    return out / whole


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, spec: Spec, classes: int, trees: range):
    """Trees as (number, feature, bin, left child, value, gain by feature); a leaf has feature -1. ``classes`` is 0 for a
    number as target, else values are shares of the classes but the first. Rows with a bin up to the node's go left."""
    n, d = bins.shape
    regression, flat = classes == 0, np.ascontiguousarray(bins).ravel()
    k = subset_size(spec.subset, d, spec.trees, regression)
    together = max(1, TOGETHER // max(1, n))
    for first in range(trees.start, trees.stop, together):
        numbers = range(first, min(trees.stop, first + together))
        counts = [np.random.default_rng((spec.seed, t)).poisson(1.0, n) for t in numbers]
        picked = [np.flatnonzero(c) if c.any() else np.zeros(1, dtype=np.int64) for c in counts]
        r = np.concatenate(picked)
        c = np.concatenate([np.maximum(c[p], 1) for c, p in zip(counts, picked)]).astype(np.float64)
        g = np.repeat(np.arange(len(numbers)), [len(p) for p in picked])
        w = weight[r] * c
        parts = [w * y[r]] if regression else [np.where(y[r] == label, w, 0.0) for label in range(1, classes)]
        tree, heap = np.arange(len(numbers)), np.ones(len(numbers), dtype=np.uint64)
        levels, gains, base = [], np.zeros((len(numbers), d)), 0
        for depth in range(spec.depth + 1):
            m = len(tree)
            starts = np.searchsorted(g, np.arange(m))
            total, many = np.add.reduceat(w, starts), np.add.reduceat(c, starts)
            sums = [np.add.reduceat(p, starts) for p in parts]
            score = _sums(sums, total, regression)
            node = {"tree": tree, "feature": np.full(m, -1, dtype=np.int16), "bin": np.zeros(m, dtype=np.uint8), "left": np.zeros(m, dtype=np.int32),
                    "value": np.stack([s / total for s in sums], axis=1) if sums else np.zeros((m, 0))}
            levels.append(node)
            open_ = many >= 2 * spec.least
            if not regression:  # of one class
                open_ &= score < total * (1 - 1e-12)
            open_ = np.flatnonzero(open_)
            if depth == spec.depth or not len(open_):
                break
            number = np.full(m, -1)
            number[open_] = np.arange(len(open_))
            g = number[g]
            stay = g >= 0
            r, c, g, w, parts = r[stay], c[stay], g[stay], w[stay], [p[stay] for p in parts]
            total, sums, score, many = total[open_], [s[open_] for s in sums], score[open_], many[open_]
            starts = np.searchsorted(g, np.arange(len(open_)))
            features = _drawn(spec.seed, tree[open_] + first, heap[open_], d, k)
            best, best_f, best_b = np.zeros(len(open_)), np.full(len(open_), -1), np.zeros(len(open_), dtype=np.int64)
            spots = np.arange(len(r))
            for j in range(features.shape[1]):
                packed = (((g << 5) | flat[r * d + features[g, j]]) << 32) | spots
                packed.sort()
                at, key = packed & 0xFFFFFFFF, packed >> 32
                cut = np.flatnonzero(key[1:] != key[:-1])
                mine = key[cut] >> 5
                same = (key[cut + 1] >> 5) == mine
                cut, mine = cut[same], mine[same]
                if not len(cut):
                    continue

                def upto(values):
                    added = np.cumsum(values[at])
                    return added[cut] - np.concatenate([[0.0], added])[starts[mine]]

                few = upto(c)
                left, lefts = upto(w), [upto(p) for p in parts]
                right, rights = total[mine] - left, [s[mine] - part for s, part in zip(sums, lefts)]
                fits = (few >= spec.least) & (many[mine] - few >= spec.least) & (left > 0) & (right > 0)
                left, right = np.where(fits, left, 1.0), np.where(fits, right, 1.0)
                gain = np.where(fits, _sums(lefts, left, regression) + _sums(rights, right, regression) - score[mine], 0.0)
                heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                top, owner = np.maximum.reduceat(gain, heads), mine[heads]
                hits = np.flatnonzero(gain == np.repeat(top, np.diff(np.concatenate([heads, [len(mine)]]))))
                hits = hits[np.concatenate([[True], mine[hits][1:] != mine[hits][:-1]])]
                better = top > best[owner]
                owner, hits = owner[better], hits[better]
                best[owner], best_f[owner], best_b[owner] = top[better], features[owner, j], key[cut[hits]] & 31
            divided = np.flatnonzero(best > 1e-10 * total)
            if not len(divided):
                break
            base += m
            here = open_[divided]
            node["feature"][here], node["bin"][here], node["left"][here] = best_f[divided], best_b[divided], base + 2 * np.arange(len(divided))
            np.add.at(gains, (tree[here], best_f[divided]), best[divided])
            number = np.full(len(open_), -1)
            number[divided] = 2 * np.arange(len(divided))
            right = flat[r * d + best_f[g]] > best_b[g]
            g = np.where(number[g] >= 0, number[g] + right, -1)
            order = (g << 32) | spots
            order = order[g >= 0]
            order.sort()
            keep = order & 0xFFFFFFFF
            r, c, g, w, parts = r[keep], c[keep], order >> 32, w[keep], [p[keep] for p in parts]
            tree = np.repeat(tree[here], 2)
            heap = np.repeat(heap[here] * np.uint64(2), 2)
            heap[1::2] += np.uint64(1)
        whole = {name: np.concatenate([level[name] for level in levels]) for name in levels[0]}
        for i, t in enumerate(numbers):
            own = whole["tree"] == i
            place = np.cumsum(own) - 1
            left = np.where(whole["feature"][own] >= 0, place[whole["left"][own]], 0).astype(np.int32)
            yield t, whole["feature"][own], whole["bin"][own], left, whole["value"][own], gains[i]


def votes(bins: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the leaves' values over trees (feature, bin, left, value), per row."""
    n, d = bins.shape
    flat, out = np.ascontiguousarray(bins).ravel(), np.zeros((n, trees[0][3].shape[1]))
    for feature, bin_, left, value in trees:
        node, going = np.zeros(n, dtype=np.int64), np.arange(n if feature[0] >= 0 else 0)
        while len(going):
            here = node[going]
            here = left[here] + (flat[going * d + feature[here]] > bin_[here])
            node[going] = here
            going = going[feature[here] >= 0]
        out += value[node]
    return out


# ---------------------------------------------------------------- tables
def too_large(rows: DataFrame) -> bool:
    cells = rows.select(vector_to_array("features").alias("v")).agg(F.expr("sum(size(v))")).first()[0]
    if not cells:
        raise ValueError("a forest needs rows with features")
    return cells > MOST_CELLS


def _columns(rows: DataFrame) -> DataFrame:
    """Rows (features, y, weight) as columns of blocks: feature, part, block, cells; y is feature -1, the weight -2."""

    def work(batches):
        part = TaskContext.get().partitionId()
        for block, batch in enumerate(b for b in batches if b.num_rows):
            cells = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = {-2: batch.column("weight").to_numpy(zero_copy_only=False), -1: batch.column("y").to_numpy(zero_copy_only=False), **dict(enumerate(cells.T))}
            packed = [np.ascontiguousarray(v, dtype=np.float64).tobytes() for v in found.values()]
            places = [pa.array([v] * len(packed), pa.int32()) for v in (part, block)]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *places, pa.array(packed, pa.binary())], names=["feature", "part", "block", "cells"])

    long = rows.select(vector_to_array("features").alias("v"), F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"))
    return cut_lineage(long.mapInArrow(work, "feature int, part int, block int, cells binary"))


def _binned(rows: DataFrame) -> DataFrame:
    """One row per feature: feature, cells (a byte per row; y and weight as they are), limits (of y its largest value)."""

    def work(table):
        table = table.sort_by([("part", "ascending"), ("block", "ascending")])
        feature, values = table["feature"][0].as_py(), np.concatenate([np.frombuffer(b) for b in table["cells"].to_pylist()])
        limits = limits_of(values) if feature >= 0 else np.array([values.max()])
        cells = np.searchsorted(limits, values).astype(np.uint8) if feature >= 0 else values
        return pa.table({"feature": pa.array([feature], pa.int32()), "cells": [cells.tobytes()], "limits": pa.array([limits.tolist()], pa.list_(pa.float64()))})

    return cut_lineage(_columns(rows).groupBy("feature").applyInArrow(work, "feature int, cells binary, limits array<double>"))


def _names(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(", ")]


def fit(rows: DataFrame, specs: list[Spec], regression: bool) -> list[Forest]:
    """A forest per spec over the same rows (features, y, weight); the trees of all are dealt out at once."""
    spark, binned = rows.sparkSession, _binned(rows)
    limits = {r.feature: r.limits for r in binned.select("feature", "limits").collect()}  # 31 numbers a feature at most
    classes = 0 if regression else int(limits[-1][0]) + 1
    slots = 4 * max(partitions(rows), spark.sparkContext.defaultParallelism)
    share = max(1, -(-sum(s.trees for s in specs) // slots))
    chunks = [(number, first, min(s.trees, first + share)) for number, s in enumerate(specs) for first in range(0, s.trees, share)]

    def work(key, table):
        chunk = key[0].as_py()
        number, first, last = chunks[chunk]
        found = dict(zip(table["feature"].to_pylist(), table["cells"].to_pylist()))
        weight, y = np.frombuffer(found.pop(-2)), np.frombuffer(found.pop(-1))
        bins = np.stack([np.frombuffer(found[f], dtype=np.uint8) for f in sorted(found)], axis=1)
        out = [(number, chunk, t, *(a.tobytes() for a in grown)) for t, *grown in grow(bins, y, weight, specs[number], classes, range(first, last))]
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*out), [pa.int32()] * 3 + [pa.binary()] * 5)], names=_names(TREE))

    dealt = binned.select("feature", "cells").crossJoin(spark.range(len(chunks)).selectExpr("int(id) as chunk")).repartition(len(chunks), "chunk")
    trees = cut_lineage(dealt.groupBy("chunk").applyInArrow(work, TREE))
    return [Forest(trees.where(F.col("forest") == number), [limits[f] for f in sorted(limits) if f >= 0], classes) for number in range(len(specs))]


def vote(trees: DataFrame, limits: list[list[float]], classes: int, rows: DataFrame) -> DataFrame:
    """Rows with the vote of every forest among the trees, which share limits: all columns of ``rows``, forest, prediction,
    probability (of classes). Blocks of rows meet shares of the trees, a slab of rows in a task."""
    tagged = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    slabs, cuts, width = -(-max(1, tagged.count()) // SLAB), [np.array(v) for v in limits], max(0, classes - 1) if classes else 1

    def packed(batches):
        for batch in batches:
            if batch.num_rows:
                cells = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                ids = batch.column("_row").to_numpy(zero_copy_only=False)
                bins = np.stack([np.searchsorted(cut, cells[:, f]) for f, cut in enumerate(cuts)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:1]), pa.array([ids.tobytes()]), pa.array([bins.tobytes()])], names=["block", "ids", "cells"])

    def work(blocks, found):
        out, by = [], {}
        for row in found.to_pylist() if blocks.num_rows else []:
            value = np.frombuffer(row["value"])
            tree = np.frombuffer(row["feature"], np.int16), np.frombuffer(row["bin"], np.uint8), np.frombuffer(row["left"], np.int32)
            by.setdefault(row["forest"], []).append((*tree, value.reshape(len(tree[0]), width)))
        for row in blocks.to_pylist():
            bins = np.frombuffer(row["cells"], np.uint8).reshape(-1, len(cuts))
            out += [(forest, row["block"], row["ids"], votes(bins, own).tobytes(), len(own)) for forest, own in by.items()]
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate([pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()])], names=_names(PART))

    def mean(table):
        ids, n = np.frombuffer(table["ids"][0].as_py(), np.int64), sum(table["n"].to_pylist())
        value = sum(np.frombuffer(b).reshape(len(ids), width) for b in table["sums"].to_pylist()) / n
        if classes:
            value = np.concatenate([1 - value.sum(axis=1, keepdims=True), value], axis=1)
        best = value.argmax(axis=1).astype(np.float64) if classes else value[:, 0]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * value.shape[1], pa.int32()), pa.array(value.ravel()))
        return pa.table([pa.array([table["forest"][0].as_py()] * len(ids), pa.int32()), pa.array(ids), pa.array(best), lists], names=["forest", "_row", "prediction", "_value"])

    blocks = tagged.select("_row", vector_to_array("features").alias("v")).mapInArrow(packed, "block long, ids binary, cells binary")
    blocks = cut_lineage(blocks).selectExpr("*", f"int(pmod(xxhash64(block), {slabs})) as slab")
    chunks = cut_lineage(trees.select("chunk").distinct())
    tasks = min(4 * max(partitions(rows), rows.sparkSession.sparkContext.defaultParallelism), slabs * max(1, chunks.count()))
    left = blocks.crossJoin(chunks).repartition(tasks, "chunk", "slab")
    right = trees.drop("gains").crossJoin(rows.sparkSession.range(slabs).selectExpr("int(id) as slab")).repartition(tasks, "chunk", "slab")
    parts = left.groupBy("chunk", "slab").cogroup(right.groupBy("chunk", "slab")).applyInArrow(work, PART)
    found = cut_lineage(parts.groupBy("forest", "block").applyInArrow(mean, "forest int, _row long, prediction double, _value array<double>"))
    out = tagged.join(found, "_row").drop("_row")
    return out.withColumn("probability", array_to_vector("_value")).drop("_value") if classes else out.drop("_value")


@dataclass
class Forest:
    """A fitted forest with the methods of Spark ML's models that training uses."""

    trees: DataFrame
    limits: list[list[float]]
    classes: int

    def transform(self, rows: DataFrame) -> DataFrame:
        return vote(self.trees, self.limits, self.classes, rows).drop("forest")

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (Spark ML's name)
        """Gain by feature as a share of its tree's, over all trees."""

        def work(batches):
            for batch in batches:
                gains = [np.frombuffer(b) for b in batch.column("gains").to_pylist()]
                shares = [g / g.sum() for g in gains if g.sum() > 0]
                if shares:
                    yield pa.RecordBatch.from_arrays([pa.array([sum(shares).tolist()], pa.list_(pa.float64()))], names=["s"])

        total = sum((np.array(r.s) for r in self.trees.select("gains").mapInArrow(work, "s array<double>").collect()), np.zeros(len(self.limits)))
        return DenseVector(total / (total.sum() or 1.0))

    def write(self) -> Forest:
        return self

    def overwrite(self) -> Forest:
        return self

    def save(self, path: str) -> None:
        rows = [(self.classes, i, [float(x) for x in v]) for i, v in enumerate(self.limits)]
        self.trees.sparkSession.createDataFrame(rows, "classes int, feature int, limits array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/limits")
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest | None:
        """The forest at the path, None if there is no such one."""
        trees = read_if_there(spark, f"{path}/trees")
        if trees is None:
            return None
        rows = spark.read.parquet(f"{path}/limits").orderBy("feature").collect()
        return Forest(trees, [r.limits for r in rows], rows[0].classes)
