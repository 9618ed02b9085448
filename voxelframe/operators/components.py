"""Connected components of a graph given as edges, by alternating star operations with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.session import cut_lineage


def _stars(edges: DataFrame, keys: list[str], only_smaller: bool) -> DataFrame:
    both = edges if only_smaller else edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy(*keys, "a").agg(F.min("b").alias("_low"))
    lowest = lowest.withColumn("_low", F.least("_low", "a"))
    linked = both.join(lowest, [*keys, "a"])
    if only_smaller:
        hooks = linked.select(*keys, F.col("b").alias("a"), F.col("_low").alias("b"))
        hooks = hooks.unionByName(lowest.select(*keys, "a", F.col("_low").alias("b")))
    else:
        hooks = linked.where("b > a").select(*keys, F.col("b").alias("a"), F.col("_low").alias("b"))
    return hooks.where("a <> b").distinct()


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``node``, ``root`` (smallest node of its component) for every node that has an edge (columns a, b).

    The number of rounds grows with the logarithm of the component size; every round is checkpointed.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = cut_lineage(edges.where("a <> b").select(*keys, high, low).distinct())

    def fingerprint(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*keys, "a", "b"))).first()

    seen = fingerprint(current)
    while seen[0]:
        current = cut_lineage(_stars(_stars(current, keys, False), keys, True))
        now = fingerprint(current)
        if now == seen:
            break
        seen = now
    return current.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
