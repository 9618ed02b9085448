"""Leakage-safe splits on cases: strata, folds, hold-out, balancing and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.ranking import hashed_position, percentiles, value_ranks
from voxelframe.functions.scalar import uniform
from voxelframe.functions.single import one_row


def class_shift(values: DataFrame, num_classes: int) -> DataFrame:
    """One row: 1 if the integer class values run from at least 1 up to the class count, else 0."""
    return values.where("value is not null").selectExpr("int(value) as v").agg(
        F.expr(f"if(min(v) >= 1 and max(v) = {num_classes}, 1, 0) as shift")
    )


def canonical_class(values: DataFrame, shift: DataFrame, num_classes: int) -> DataFrame:
    """Subtract the shift where the result is a class; other values stay as they are."""
    rows = values.withColumn("shift", one_row(shift)["shift"])
    moved = f"if(int(value) - shift between 0 and {num_classes - 1}, double(int(value) - shift), value)"
    return rows.withColumn("value", F.expr(moved)).drop("shift")


def canonical_targets(targets: DataFrame, specs: DataFrame) -> DataFrame:
    """Long targets (case_id, target, label_id, value) of all classifications in one pass, their classes counted from 0.

    A target of ``specs`` (target, type, num_classes; two classes if not stated) is shifted by one if its whole values run
    from at least 1 up to the class count; values that do not become a class, and regressions, stay as they are.

    A target has one row in ``specs`` and a share of all rows in ``targets``, so the specs go to the rows: dealt out by
    target, the rows of one would meet in one task.
    """
    kinds = F.broadcast(specs.selectExpr("target", "type", "coalesce(num_classes, 2) as num_classes"))
    rows = targets.join(kinds, "target")
    ends = rows.where("type = 'classification' and value is not null").groupBy("target", "num_classes").agg(
        F.expr("min(int(value)) as low"), F.expr("max(int(value)) as high")
    )
    shifts = ends.selectExpr("target", "int(low >= 1 and high = num_classes) as shift")
    moved = "if(int(value) - shift between 0 and num_classes - 1, double(int(value) - shift), value)"
    shifted = f"if(type = 'classification' and shift is not null, {moved}, value)"
    return rows.join(F.broadcast(shifts), "target", "left").selectExpr("case_id", "target", "label_id", f"{shifted} as value")


def strata(targets: DataFrame, specs: DataFrame, target: str) -> DataFrame:
    """case_id, stratum of the cases with a value of the target: its class, or the quartile of a regression."""
    spec = specs.where(F.col("target") == target).select("type", "scope", "num_classes").first()
    rows = targets.where(F.col("target") == target)
    cases = targets.select("case_id").distinct()
    if spec["scope"] == "per_label":
        values = strat_value(rows, cases, spec["type"] == "classification" and (spec["num_classes"] or 2) == 2)
    else:
        values = cases.join(rows.select("case_id", "value"), "case_id", "left").selectExpr("case_id", "coalesce(value, -1D) as value")
    if spec["type"] == "regression":
        return quartile_bin(values).select("case_id", "stratum")
    return values.selectExpr("case_id", "int(value) as stratum")


def strat_value(targets: DataFrame, cases: DataFrame, binary: bool) -> DataFrame:
    """Per-label targets to one value per case: any above 0.5 for two classes, else the mean (-1 without values)."""
    known = targets.where("value is not null").groupBy("case_id").agg(
        F.expr("max(int(value > 0.5D)) as hit"), F.avg("value").alias("mean")
    )
    value = "double(coalesce(hit, 0))" if binary else "coalesce(mean, -1D)"
    return cases.join(known, "case_id", "left").selectExpr("case_id", f"{value} as value")


def quartile_bin(rows: DataFrame, value: str = "value") -> DataFrame:
    """Number of quartiles strictly below the value (0-3)."""
    cuts = percentiles(rows, [], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return rows.withColumn("cut", one_row(cuts)).selectExpr(
        *rows.columns, f"int({value} > cut.q25) + int({value} > cut.q50) + int({value} > cut.q75) as stratum"
    )


def kfold(cases: DataFrame, n_folds: int = 5, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """case_id, fold. Cases go round the folds in hashed order; each stratum starts where the one before it stopped."""
    if n_folds < 2:
        raise ValueError("n_folds must be at least 2")
    if stratum is None:
        return hashed_position(cases, [], "case_id", seed).selectExpr("case_id", f"int(position % {n_folds}) as fold")
    sizes = cases.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.selectExpr(
        stratum, f"coalesce(sum(n) over (order by {stratum} rows between unbounded preceding and 1 preceding), 0) as start"
    )
    placed = hashed_position(cases, [stratum], "case_id", seed).join(starts, stratum)
    return placed.selectExpr("case_id", f"int((position + start) % {n_folds}) as fold")


def holdout(cases: DataFrame, fraction: float = 0.2, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """case_id, split. Stratified by largest remainder if every stratum between the least and the greatest has two cases."""
    if stratum is None:
        placed = hashed_position(cases, [], "case_id", seed)
        size = f"greatest(1, least(position_of - 1, bround(position_of * {float(fraction)}D)))"
        return placed.selectExpr("case_id", f"if(position < {size}, 'holdout', 'train') as split")
    sizes = cases.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    every = "over ()"  # one row per stratum
    sized = sizes.selectExpr(
        stratum, "n", f"sum(n) {every} as total", f"min(n) {every} as least_n", f"count(1) {every} as strata",
        f"max({stratum}) {every} - min({stratum}) {every} + 1 as span",
    ).selectExpr("*", f"cast(greatest(1, least(total - 1, bround(total * {float(fraction)}D))) as bigint) as wanted")
    usable = "least_n >= 2 and strata = span and wanted >= strata and total - wanted >= strata"
    shares = sized.selectExpr("*", "wanted * n div total as base", "wanted * n % total as rest", f"{usable} as usable")
    quotas = shares.selectExpr(
        stratum, "usable", "wanted", f"base + int(row_number() over (order by rest desc, {stratum}) <= wanted - sum(base) {every}) as quota"
    )
    inner = hashed_position(cases, [stratum], "case_id", seed)
    both = hashed_position(inner, [], "case_id", seed, "overall").join(quotas, stratum)
    return both.selectExpr(
        "case_id", "if(if(usable, position < quota, overall < wanted), 'holdout', 'train') as split"
    )


def pick_target(specs: DataFrame) -> DataFrame:
    """First per-case classification, else any classification, else regression, by position: one row per dataset."""
    rank = "case when type = 'classification' and scope = 'per_case' then 0 when type = 'classification' then 1 when type = 'regression' then 2 end"
    return specs.selectExpr("dataset", "target", "position", f"{rank} as priority").where("priority is not null").groupBy("dataset").agg(
        F.expr("min_by(target, struct(priority, position)) as target")
    )


def class_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """Inverse class frequency per row, summing to 1 over all rows."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    counts = counts.selectExpr(label, "n_class", "1D / n_class / count(1) over () as weight")  # one row per class
    return samples.join(counts, label)


def balanced_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes * n_class) per class."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    return counts.selectExpr(label, "n_class", "sum(n_class) over () / (count(1) over () * n_class) as weight")


def oversample(samples: DataFrame, ident: str = "sample_id", label: str = "label", seed: int = 42) -> DataFrame:
    """Every class repeated up to the size of the largest; the rows that get one copy more are the first in hashed order."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    counts = counts.selectExpr(label, "n_class", "max(n_class) over () as n_max")
    placed = hashed_position(samples, [label], ident, seed).join(counts, label)
    copies = "n_max div n_class + int(position < n_max % n_class)"
    return placed.selectExpr(*samples.columns, f"explode(sequence(1, int({copies}))) as copy")


def weighted_sample(samples: DataFrame, draws: DataFrame, ident: str = "sample_id", label: str = "label", seed: int = 42) -> DataFrame:
    """Sampling with replacement by inverse class frequency: draw a class, then a place inside the class.

    ``draws`` has one row per draw (column ``draw``). All rows of a class weigh the same, so the two uniform draws
    replace a cumulative sum over all samples.
    """
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    packed = counts.agg(F.expr(f"array_sort(collect_list(struct({label}, n_class))) as classes"))  # one entry per class
    first, second = uniform(f"concat('{seed}:class:', draw)"), uniform(f"concat('{seed}:place:', draw)")
    drawn = draws.withColumn("classes", packed.scalar()).selectExpr("draw", f"classes[int(floor(({first}) * size(classes)))] as c", f"{second} as u")
    drawn = drawn.selectExpr("draw", f"c.{label} as {label}", "cast(floor(u * c.n_class) as bigint) as position")
    placed = hashed_position(samples, [label], ident, seed).select(label, "position", ident)
    return drawn.join(placed, [label, "position"]).select("draw", ident, label)


def sample_voxels(voxels: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """At most ``count`` foreground voxels per case in hashed order (the reduced input of the intensity plan)."""
    named = voxels.where("label_id > 0").withColumn("spot", F.concat_ws(":", "case_id", "z", "y", "x"))
    placed = hashed_position(named, ["case_id"], "spot", seed)
    return placed.where(F.col("position") < count).select(*voxels.columns)


def limit_cases(cases: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """First cases by key with their run seed (seed + 1009 * index)."""
    first = cases.select("case_id").distinct().orderBy("case_id").limit(count)
    return first.selectExpr("case_id", f"{seed} + 1009 * (row_number() over (order by case_id) - 1) as run_seed")


def even_pick(samples: DataFrame, count: int, ident: str = "sample_id") -> DataFrame:
    """``count`` rows spread evenly over the ordered samples, both ends included."""
    ranked = value_ranks(samples.select(ident), [], ident).selectExpr(ident, "cast(rank as bigint) - 1 as place")
    total = samples.agg(F.count(F.lit(1)).alias("n"))
    last = max(count - 1, 1)
    spots = f"if(n <= {count}, sequence(0L, n - 1), array_distinct(transform(sequence(0, {count - 1}), i -> cast(floor(i * ((n - 1) / {float(last)}D)) as bigint))))"
    places = total.selectExpr(f"explode({spots}) as place")
    return ranked.join(F.broadcast(places), "place").select(ident, "place")  # at most ``count`` places


def holdout_audit(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Counts of expected files by group and outcome: moved, skipped because the target exists, or missing at the source."""
    joined = expected.join(present, ["case_id", "file_group"], "left")
    outcome = "case when at_source is null or not at_source then 'missing_source' when at_target then 'skipped_exists' else 'moved' end"
    return joined.selectExpr("file_group", f"{outcome} as outcome").groupBy("file_group", "outcome").agg(F.count(F.lit(1)).alias("files"))
