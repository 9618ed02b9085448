"""Exact top-k inner products by the threshold algorithm.

Vectors lie in blocks of bounded size. A block has one sorted list per dimension; a query walks all lists in parallel,
from the end its sign prefers, scores every vector it meets on any list in full, and stops once the bound (the sum of the
contributions at the current depth of each list, which no vector below can exceed) is under the k-th best score. The best
of all blocks are merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelframe.session import cut_lineage

BLOCK = 4096
QUERY_BLOCK = 1024
STEP = 32


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component; null for vectors that are null or hold a null or non-finite component."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double"))))


class SortedLists:
    """A block of vectors with one ascending list of row numbers per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]  # smaller ids first, so ties need no second key
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.largest = int(np.abs(self.rows).max(initial=0))
        self.exact = self.rows.astype(np.float64)

    def top(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, vec_id), ties to the smaller id, without the query's own rows."""
        n, width = self.rows.shape
        floats = self.largest * int(np.abs(query).max(initial=0)) * max(width, 1) < 2**53
        dims = np.flatnonzero(query)
        seen = np.zeros(n, bool)
        own = self.ids == query_id
        seen[own] = True
        best_scores, best_rows = np.array([], np.int64), np.array([], np.int64)
        flipped = query[dims] < 0
        depth, step = 0, STEP
        while depth < n and not seen.all():
            if len(dims):
                stop = min(depth + step, n)
                block = np.where(flipped, self.order[depth:stop, dims], self.order[n - stop : n - depth, dims])
                met = np.zeros(n, bool)
                met[block.ravel()] = True
                new = np.flatnonzero(met & ~seen)
            else:  # every score is 0
                stop, new = n, np.flatnonzero(~seen)
            seen[new] = True
            scores = (self.exact[new] @ query.astype(np.float64)).astype(np.int64) if floats else self.rows[new] @ query
            best_scores, best_rows = np.concatenate([best_scores, scores]), np.concatenate([best_rows, new])
            order = np.lexsort((best_rows, -best_scores))[:k]
            best_scores, best_rows = best_scores[order], best_rows[order]
            depth, step = stop, step * 2
            if len(best_scores) == k and depth < n:
                edge = np.where(flipped, self.order[depth - 1, dims], self.order[n - depth, dims])
                bound = int((self.rows[edge, dims].astype(object) * query[dims].astype(object)).sum())
                if bound < best_scores[-1]:
                    break
        return [(int(s), int(self.ids[r])) for s, r in zip(best_scores, best_rows, strict=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the ``k`` best partners of every query among all other vectors.

    ``vectors`` has vec_id (long) and v (array<long>); ``is_query`` is a condition on them. Rows with a null id or vector
    take no part, repeated rows (same id and vector) count once, and vectors pair only with vectors of their length. An id
    with two different vectors is two queries under one id. Ties go to the smaller vec_id. An empty table gives no rows.
    """
    rows = cut_lineage(vectors.where("vec_id is not null and v is not null").select("vec_id", "v").distinct().withColumn("width", F.size("v")))
    queries = rows.where(is_query)
    blocks = max(1, -(-rows.count() // block))
    query_blocks = max(1, -(-queries.count() // query_block))
    # Both sides of a cogroup must have keys of one type: they are hashed, not compared, when rows are dealt out.
    spread = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("long")
    spread_q = F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks)).cast("long")
    left = rows.select("vec_id", "v", "width", spread.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("query_block"))
    right = queries.select("vec_id", "v", "width", spread_q.alias("query_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    keys = ["block", "query_block", "width"]

    def work(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(asked):
            lists = SortedLists(here["vec_id"].to_numpy(np.int64), np.array(here["v"].tolist(), np.int64).reshape(len(here), -1))
            for number, (query_id, vector) in enumerate(zip(asked["vec_id"], asked["v"], strict=True)):
                found = lists.top(np.asarray(vector, np.int64), query_id, k)
                out += [(query_id, asked["mark"].iloc[number], vec_id, score) for score, vec_id in found]
        return pd.DataFrame(out, columns=["query_id", "mark", "vec_id", "score"])

    right = right.withColumn("mark", F.xxhash64("v"))
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, "query_id long, mark long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
