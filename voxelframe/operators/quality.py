"""Feature quality on long tables (sample_id, feature, value): validity, variance, rank correlation, ICC, scaling.

Every statistic is a group-by on ``keys + feature``; with ``fold`` among the keys all folds share one shuffle. Every
sample must have a row for every feature; a missing value is NULL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.ranking import percentiles, row_ranks, value_cells, value_ranks
from voxelframe.functions.single import one_row
from voxelframe.operators.tiles import partitions

ICC_THRESHOLD = 0.75
GLOBAL_VARIANCE = 1e-8
FOLD_VARIANCE = 1e-6
FOLD_CORRELATION = 0.9


def valid_features(features: DataFrame) -> DataFrame:
    """Features that have a value and are not constant."""
    return features.groupBy("feature").agg(
        F.count("value").alias("n_values"), (F.min("value") < F.max("value")).alias("varies")
    ).selectExpr("feature", "n_values", "n_values > 0 as any_value", "coalesce(varies, false) as varies")


def medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    return percentiles(rows, [*keys, "feature"], "value", {"median": 0.5})


def fill_median(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Replace missing values by the medians in ``stats``; a feature without a median drops out.

    Write the medians with ``cut_lineage`` where several statistics follow, or each of them finds the medians again.
    """
    return rows.join(stats, [*keys, "feature"]).withColumn("value", F.coalesce("value", "median")).drop("median")


def complete(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add a row without a value for every feature of a group (keys) that a sample of it lacks.

    The other columns must belong to the sample; a feature it has twice is an error.
    """
    others = [c for c in rows.columns if c not in ("feature", "value")]
    cells = rows.groupBy(*others).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_cells"))
    # A map is searched entry by entry, so a sample that lacks nothing is left as it is.
    whole = "if(size(_cells) = size(_all), map_entries(_cells), transform(_all, n -> struct(n as key, _cells[n] as value)))"
    each = cells.select("*", _names(rows, keys).alias("_all")).selectExpr(*[f"`{c}`" for c in others], f"inline({whole}) as (feature, value)")
    return each.select(*rows.columns)


def _names(rows: DataFrame, keys: list[str]) -> Column:
    """Sorted feature names of a row's group (keys), from a one-row table that has an entry per group and feature.

    A join on the keys would gather all samples of a group in one task.
    """
    group = F.struct(F.lit(0).alias("_"), *keys)
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("feature")).alias("names")).select(group.alias("group"), "names")
    return one_row(lists.agg(F.map_from_entries(F.collect_list(F.struct("group", "names"))).alias("all")))["all"][group]


def variance_filter(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, feature) whose population variance exceeds the threshold."""
    spread = rows.groupBy(*keys, "feature").agg(F.var_pop("value").alias("variance"))
    return spread.where(F.col("variance") > threshold)


def scale_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation per feature; a deviation of 0 counts as 1."""
    stats = rows.groupBy(*keys, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def standardize(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    scaled = rows.join(stats, [*keys, "feature"])
    return scaled.withColumn("value", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")


def spearman(rows: DataFrame, keys: list[str] = (), tile: int = 1024) -> DataFrame:
    """Rank correlation of every feature pair a < b: keys, a, b, r (0 where undefined).

    Ranks come from value counts. Columns are cut into tiles, and a sample travels once per pair of tiles; a task adds up
    the products of all its samples before it emits a pair of tiles, which is what its memory holds. So partial sums of
    features x features travel, once per task. Values must be complete (see ``fill_median``).
    """
    keys = list(keys)
    ranks = value_ranks(rows.withColumn("_set", F.lit(0)), [*keys, "_set", "feature"], "value").selectExpr(*keys, "feature", "value", "rank - (total + 1) / 2D as rank")
    ranked = rows.join(ranks, [*keys, "feature", "value"])
    spread = ranked.repartition(partitions(rows), *keys, "sample_id")
    vectors = spread.groupBy(*keys, "sample_id").agg(F.expr("map_from_entries(collect_list(struct(feature, rank))) as cells"))
    # A place is a feature, not a position in the sample's own list; a feature the sample lacks stands at the middle rank.
    vectors = vectors.select(*keys, "cells", _names(rows, keys).alias("names")).selectExpr(*keys, "transform(names, n -> coalesce(cells[n], 0D)) as ranks")
    last = f"int(ceil(size(ranks) / {tile}D)) - 1"
    tiles = vectors.selectExpr("*", f"explode(sequence(0, {last})) as ti").selectExpr("*", f"explode(sequence(ti, {last})) as tj")
    tiles = tiles.selectExpr(*keys, "ti", "tj", f"slice(ranks, ti * {tile} + 1, {tile}) as rows", f"slice(ranks, tj * {tile} + 1, {tile}) as cols")
    tiles = tiles.sortWithinPartitions(*keys, "ti", "tj")
    groups = [*keys, "ti", "tj"]

    def long(key, sums):
        i, j = np.nonzero(np.arange(sums.shape[0])[:, None] + key[-2] * tile <= np.arange(sums.shape[1]) + key[-1] * tile)
        out = pd.DataFrame({"i": i + key[-2] * tile, "j": j + key[-1] * tile, "s": sums[i, j]})
        for name, value in zip(keys, key):
            out[name] = value
        return out

    def partial_products(batches):
        current, sums = None, None
        for batch in batches:
            for key, part in batch.groupby(groups, sort=False, dropna=False):
                product = np.stack(part["rows"].to_numpy()).T @ np.stack(part["cols"].to_numpy())
                if key == current:
                    sums += product
                    continue
                if current is not None:
                    yield long(current, sums)
                current, sums = key, product
        if current is not None:
            yield long(current, sums)

    kinds = dict(rows.dtypes)
    schema = ", ".join(["i int", "j int", "s double", *[f"{k} {kinds[k]}" for k in keys]])
    products = tiles.mapInPandas(partial_products, schema).groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))
    products = products.withColumn("names", _names(rows, keys)).selectExpr(*keys, "i", "j", "s", "names[i] as a", "names[j] as b")
    own = products.where("i = j").selectExpr(*keys, "a", "s as size")
    pairs = products.where("i < j").join(own.withColumnRenamed("size", "size_a"), [*keys, "a"])
    pairs = pairs.join(own.withColumnsRenamed({"a": "b", "size": "size_b"}), [*keys, "b"])
    return pairs.selectExpr(*keys, "a", "b", "if(size_a > 0 and size_b > 0, s / sqrt(size_a * size_b), 0D) as r")


def strong_pairs(rows: DataFrame, threshold: float, keys: list[str] = (), tile: int = 512, slab: int = 1 << 15) -> DataFrame:
    """Feature pairs a < b with a rank correlation beyond ``threshold`` in size: keys, a, b, r.

    As ``correlated_pairs(spearman(rows, keys), threshold)``, without a row per pair of features. A row travels to its cell,
    where it is ranked, and to its sample. A task streams the samples of one pair of tiles and one slab of samples through a
    sum of tile x tile numbers, with the squares of both sides beside it; the sums travel as binary blocks, one per slab, and
    where they are added up the threshold is applied, so only strong pairs become rows. Values must be complete.
    """
    keys = list(keys)
    cells = value_cells(rows, [*keys, "feature"], "value")
    slabs = max(1, -(-(cells.agg(F.max("total")).first()[0] or 0) // slab))
    ranked = row_ranks(rows.select(*keys, "sample_id", "feature", "value"), [*keys, "feature"], "value", cells)
    spread = ranked.selectExpr(*keys, "sample_id", "feature", "rank - (total + 1) / 2D as u").repartition(partitions(rows), *keys, "sample_id")
    vectors = spread.groupBy(*keys, "sample_id").agg(F.expr("map_from_entries(collect_list(struct(feature, u))) as cells"))
    vectors = vectors.select(*keys, "sample_id", "cells", _names(cells, keys).alias("names"))
    ordered = "if(size(cells) = size(names), transform(array_sort(map_entries(cells)), c -> c.value), transform(names, n -> coalesce(cells[n], 0D)))"
    vectors = vectors.selectExpr(*keys, "sample_id", f"{ordered} as units")  # a map is searched entry by entry
    last = f"int(ceil(size(units) / {tile}D)) - 1"
    tiles = vectors.selectExpr("*", f"int(pmod(xxhash64(sample_id), {slabs})) as slab", f"explode(sequence(0, {last})) as ti").selectExpr("*", f"explode(sequence(ti, {last})) as tj")
    tiles = tiles.selectExpr(*keys, "ti", "tj", "slab", f"slice(units, ti * {tile} + 1, {tile}) as rows", f"slice(units, tj * {tile} + 1, {tile}) as cols")
    groups, kinds = [*keys, "ti", "tj"], dict(rows.dtypes)
    typed = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "ti int", "tj int"])

    def sums(batches, by, value):
        """(key, sum of ``value(part)``) of every run of rows with one key."""
        current, total = None, None
        for batch in batches:
            for key, part in batch.groupby(by, sort=False, dropna=False):
                if key != current:
                    if current is not None:
                        yield current, total
                    current, total = key, 0.0
                total = total + value(part)
        if current is not None:
            yield current, total

    def product(part):
        """Sums of products; the last column has the squares of the rows, the last row those of the columns."""
        a, b = np.stack(part["rows"].to_numpy()), np.stack(part["cols"].to_numpy())
        return np.block([[a.T @ b, (a * a).sum(axis=0)[:, None]], [(b * b).sum(axis=0)[None], np.zeros((1, 1))]])

    def products(batches):
        for key, block in sums(batches, [*groups, "slab"], product):
            yield pd.DataFrame({**{n: [v] for n, v in zip(groups, key)}, "width": [block.shape[1]], "block": [block.tobytes()]})

    def beyond(batches):
        def added(part):
            return sum(np.frombuffer(b).reshape(-1, w) for b, w in zip(part["block"], part["width"]))

        for key, block in sums(batches, groups, added):
            size = np.sqrt(np.outer(block[:-1, -1], block[-1, :-1]))
            block = np.divide(block[:-1, :-1], size, out=np.zeros(size.shape), where=size > 0)
            i, j = np.nonzero(np.abs(block) > threshold)
            ahead = i + key[-2] * tile < j + key[-1] * tile
            i, j = i[ahead], j[ahead]
            yield pd.DataFrame({**{n: v for n, v in zip(keys, key)}, "i": i + key[-2] * tile, "j": j + key[-1] * tile, "r": block[i, j]}, index=range(len(i)))

    dealt = tiles.repartition(partitions(rows), *groups, "slab").sortWithinPartitions(*groups, "slab")
    blocks = dealt.mapInPandas(products, f"{typed}, width int, block binary")
    found = blocks.repartition(partitions(rows), *groups).sortWithinPartitions(*groups)
    strong = found.mapInPandas(beyond, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "i int", "j int", "r double"]))
    return strong.withColumn("names", _names(cells, keys)).selectExpr(*keys, "names[i] as a", "names[j] as b", "r")


def correlated_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.abs("r") > threshold)


def correlation_prune(names: DataFrame, pairs: DataFrame, threshold: float, keys: list[str] = ()) -> DataFrame:
    """Keep a feature unless an earlier one (kept or not) is correlated with it beyond the threshold."""
    later = correlated_pairs(pairs, threshold).select(*keys, F.col("b").alias("feature"))
    return names.join(later, [*keys, "feature"], "left_anti")


def icc(rows: DataFrame, repeats: int) -> DataFrame:
    """ICC(1,1) per feature from (feature, case_id, repeat, value); only cases with all repeats present count."""
    cases = rows.groupBy("feature", "case_id").agg(
        F.count("value").alias("k"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("within"),
        F.count(F.lit(1)).alias("rows"),
    )
    return _icc(cases.withColumn("whole", (F.col("k") == repeats) & (F.col("rows") == repeats)), repeats)


def icc_stacked(rows: DataFrame, repeats: int) -> DataFrame:
    """The same from rows with all values of a case and feature in ``found`` (repeat, value): only sums by feature travel."""
    known = rows.selectExpr("feature", "transform(found, c -> c.value) as v").selectExpr("*", f"size(v) = {repeats} and not exists(v, x -> x is null) as whole")
    # Gaps from the first value are exactly 0 where all values agree.
    known = known.selectExpr("*", f"v[0] + aggregate(v, 0D, (s, x) -> s + (x - v[0])) / {repeats} as mean")
    return _icc(known.selectExpr("feature", "whole", "mean", "aggregate(v, 0D, (s, x) -> s + (x - mean) * (x - mean)) as within"), repeats)


def _icc(cases: DataFrame, repeats: int) -> DataFrame:
    sums = cases.groupBy("feature").agg(
        F.expr("count_if(whole) as n"), F.expr("var_samp(mean) filter (where whole) as vb"), F.expr("sum(within) filter (where whole) as sw")
    )
    k = repeats
    parts = sums.selectExpr("feature", "n", f"{k} * vb as msb", f"sw / (n * {k - 1}D) as msw")
    denominator = f"msb + {k - 1} * msw"
    return parts.selectExpr("feature", "n", f"if(n >= 2 and {denominator} > 0, (msb - msw) / ({denominator}), null) as icc")


def icc_summary(scores: DataFrame, repeats: int) -> DataFrame:
    return scores.agg(
        F.max("n").alias("n_cases"), F.lit(repeats).alias("repeats"), F.count(F.lit(1)).alias("n_features"),
        F.expr(f"count_if(icc >= {ICC_THRESHOLD}D) as n_stable"),
    )


def icc_filter(names: DataFrame, scores: DataFrame, threshold: float = ICC_THRESHOLD) -> DataFrame:
    """Look a feature up by name, then by name without its ``labelNNN_`` prefix, else -1; keep what reaches the threshold."""
    exact = scores.selectExpr("feature", "icc as exact")
    bare = scores.selectExpr("feature as bare", "icc as fallback")
    found = names.withColumn("bare", F.regexp_replace("feature", "^label[0-9]+_", "")).join(exact, "feature", "left").join(bare, "bare", "left")
    return found.selectExpr("feature", "coalesce(exact, fallback, -1D) as icc").where(F.col("icc") >= threshold)


def global_filter(features: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Filter chain before cross-validation with the stage each feature reached: one row per feature.

    Stages: ``invalid``, ``constant``, ``low_variance``, ``unstable``, ``kept``.
    """
    stats = valid_features(features)
    filled = fill_median(features, medians(features, []), [])
    spread = filled.groupBy("feature").agg(F.var_pop("value").alias("variance"))
    staged = stats.join(spread, "feature", "left")
    stable = "true"
    if scores is not None:
        kept = icc_filter(features.select("feature").distinct(), scores).selectExpr("feature", "true as stable")
        staged, stable = staged.join(kept, "feature", "left"), "coalesce(stable, false)"
    return staged.selectExpr(
        "feature",
        f"""case when not any_value then 'invalid' when not varies then 'constant'
            when coalesce(variance, 0D) <= {GLOBAL_VARIANCE!r}D then 'low_variance' when not {stable} then 'unstable'
            else 'kept' end as stage""",
    )


def filter_audit(staged: DataFrame) -> DataFrame:
    """How many features remain after each stage."""
    return staged.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.expr("count_if(stage <> 'invalid') as n_valid"),
        F.expr("count_if(stage not in ('invalid', 'constant')) as n_varying"),
        F.expr("count_if(stage in ('unstable', 'kept')) as n_variance"),
        F.expr("count_if(stage = 'kept') as n_kept"),
    )


def anova_f(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One-way F of value by class ``y`` per feature; NULL where a feature is flat."""
    classes = rows.where("value is not null").groupBy(*keys, "feature", "y").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    sums = classes.groupBy(*keys, "feature").agg(
        F.expr("sum(n) as total"), F.expr("count(1) as classes"), F.expr("sum(n * v) as ssw"),
        F.expr("sum(n * m * m) - power(sum(n * m), 2) / sum(n) as ssb"),
    )
    return sums.selectExpr(*keys, "feature", "if(ssw > 1e-300D, (ssb / (classes - 1)) / (ssw / (total - classes)), null) as f")


def f_regression(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """F of the linear correlation with ``y``: r2 / (1 - r2) * (n - 2)."""
    sums = rows.where("value is not null and y is not null").groupBy(*keys, "feature").agg(
        F.corr("value", "y").alias("r"), F.count(F.lit(1)).alias("n")
    )
    return sums.selectExpr(*keys, "feature", "r * r / (1 - r * r) * (n - 2) as f")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best scores, ties by feature name; NULL ranks last."""
    return scores.orderBy(F.col("f").desc_nulls_last(), "feature").limit(k)


def align(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Values in a model's feature order (position, feature); a feature the data lacks becomes NULL."""
    samples = rows.select("sample_id").distinct()
    wanted = order.agg(F.expr("collect_list(struct(position, feature)) as wanted"))  # as many entries as the model has features
    grid = samples.withColumn("wanted", wanted.scalar()).selectExpr("sample_id", "inline(wanted)")
    return grid.join(rows.select("sample_id", "feature", "value"), ["sample_id", "feature"], "left")
