"""User-level jobs: each reads tables or folders, composes the operators and writes its results."""

from __future__ import annotations

from dataclasses import asdict
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators import copies, matrix, quality, rollup, splits, training
from voxelframe.operators.tiles import AXES
from voxelframe.plans import extraction, maps, planning
from voxelframe.plans.ledger import Ledger, digest
from voxelframe.plans.preprocess import preprocess_regions, write_crops
from voxelframe.session import cut_lineage
from voxelframe.sources import dictionary, records
from voxelframe.sources.volumes import crop_rows


def validate(dataset_docs: DataFrame, schema_docs: DataFrame) -> DataFrame:
    """All rule violations of a dataset; an empty result means it is valid."""
    labels = dictionary.label_dim(dataset_docs)
    known = labels.groupBy("dataset").agg(F.expr("collect_list(label_id) as labels"))
    broken = dictionary.target_violations(dictionary.target_specs(schema_docs), known)
    empty = dataset_docs.join(labels, "dataset", "left_anti").selectExpr("dataset", "cast(null as string) as target", "'no_labels_or_modality' as violation")
    return broken.unionByName(empty)


def plan(volumes: DataFrame, labels: DataFrame, dataset: str, modality: str, path: str) -> DataFrame:
    records.write_plan(planning.make_plan(volumes, labels, dataset, modality), path)
    return records.read_plan(volumes.sparkSession, path)


def prepare(volumes: DataFrame, stored_plan: DataFrame, crops: str) -> DataFrame:
    """Crops of all regions on the plan's grid, written to ``crops``; the plan row only supplies parameters."""
    row = stored_plan.select("modality", "target_spacing", "intensity_clip").first()
    stats = stored_plan.selectExpr("intensity_mean as mean", "intensity_std as std") if row["modality"] == "CT" else None
    clip = tuple(row["intensity_clip"]) if row["intensity_clip"] else (-1000.0, 1000.0)
    write_crops(preprocess_regions(volumes, tuple(row["target_spacing"]), row["modality"], stats, clip), crops)
    return volumes.sparkSession.read.parquet(crops)


def make_folds(cases: DataFrame, path: str, n_folds: int = 5, seed: int = 42, stratum: str | None = None) -> DataFrame:
    splits.kfold(cases, n_folds, seed, stratum).write.mode("overwrite").parquet(path)
    return cases.sparkSession.read.parquet(path)


def make_holdout(cases: DataFrame, path: str, fraction: float = 0.2, seed: int = 42, stratum: str | None = None) -> DataFrame:
    splits.holdout(cases, fraction, seed, stratum).write.mode("overwrite").parquet(path)
    return cases.sparkSession.read.parquet(path)


def modes_of(planner: str | None) -> tuple[bool, bool]:
    """Which caches a planner asks for by its name: region features, filter maps."""
    name = (planner or "").strip().lower()
    if "all" in name or "both" in name:
        return True, True
    return "radiomics" in name, "scatter" in name or "wave" in name


def preprocess(
    volumes: DataFrame, labels: DataFrame, targets: DataFrame, specs: DataFrame, dataset: str, modality: str, path: str, planner: str = "all",
    inputs: str = "", n_folds: int = 5, seed: int = 42, repeats: int = extraction.REPEATS, variants: int = 0, width: float = extraction.CT_BIN_WIDTH,
) -> Ledger:
    """The whole job from volumes to what training needs, below ``path``; steps that are done are not repeated.

    Steps: plan, crops, targets with classes from 0, folds by the first classification, and, as the planner's name asks,
    features with errors, stability under perturbed masks and correlation, or filter maps. ``inputs`` names the state of
    the inputs (see ``ledger.files_digest``): with another one everything is made anew.
    """
    spark, ledger = volumes.sparkSession, Ledger(volumes.sparkSession, path)
    features_wanted, maps_wanted = modes_of(planner)
    planned, plan_hash = ledger.table("plan", lambda: planning.make_plan(volumes, labels, dataset, modality), [dataset, modality], (inputs,))
    row = planned.select("modality", "target_spacing", "intensity_clip").first()
    stats = planned.selectExpr("intensity_mean as mean", "intensity_std as std") if modality == "CT" else None
    clip = tuple(row["intensity_clip"]) if row["intensity_clip"] else planning.CT_CLIP
    crops, crops_hash = ledger.table(
        "crops", lambda: crop_rows(preprocess_regions(volumes, tuple(row["target_spacing"]), modality, stats, clip)), None, (plan_hash,)
    )
    shifted, targets_hash = ledger.table("targets", lambda: splits.canonical_targets(targets, specs), None, (inputs,))
    first = specs.where("type = 'classification'").orderBy("position").select("target").first()
    ledger.table("folds", lambda: _folds(shifted, volumes, specs, first[0] if first else None, n_folds, seed), [n_folds, seed], (targets_hash,))
    keys = ["case_id", "label_id"]
    if features_wanted:
        settings = {"modality": modality, "width": width, "repeats": repeats}
        store = f"{path}/feature-store"
        levels = partial(extraction.typed_levels, keys=keys, modality=modality, width=width)
        config = digest(settings, crops_hash)
        ledger.table("feature_errors", lambda: extraction.extract_safely(crops, store, config, levels, keys), settings, (crops_hash,))
        features, features_hash = ledger.table("features", lambda: records.read_features(spark, store, config), settings, (crops_hash,))
        cells = maps.crop_voxels(crops, keys)
        ledger.table("icc", lambda: _stability(cells, crops, keys, modality, repeats, width, seed), settings, (crops_hash,))
        rows = features.selectExpr("concat_ws(':', case_id, label_id) as sample_id", "feature", "value")
        strong, strong_hash = ledger.table("high_pairs", lambda: extraction.strong_correlations(rows), 0.9, (features_hash,))
        ledger.table("correlation_summary", lambda: extraction.intercorrelation_summary(rows, strong), 0.9, (features_hash, strong_hash))
    if maps_wanted:
        store = f"{path}/map-store"
        ledger.table("maps", lambda: maps.cache_filter_maps(crops, store, digest(crops_hash), variants), variants, (crops_hash,))
    return ledger


def _folds(targets: DataFrame, volumes: DataFrame, specs: DataFrame, target: str | None, n_folds: int, seed: int) -> DataFrame:
    cases = volumes.select("case_id").distinct()
    if target is None:
        return splits.kfold(cases, n_folds, seed)
    known = cases.join(splits.strata(targets, specs, target), "case_id", "left").selectExpr("case_id", "coalesce(stratum, -1) as stratum")
    return splits.kfold(known, n_folds, seed, "stratum")


def _stability(cells: DataFrame, crops: DataFrame, keys: list[str], modality: str, repeats: int, width: float, seed: int) -> DataFrame:
    """ICC per feature over masks of the crops and their copies."""
    sizes = crops.selectExpr(*keys, "shape[0] as sz", "shape[1] as sy", "shape[2] as sx")
    cells = cut_lineage(extraction.normalised(cells, keys, modality))
    masks = cells.where("inside = 1").join(sizes, keys).select(*keys, "sz", "sy", "sx", *AXES)
    marked = copies.perturbed(masks, keys, repeats, seed).join(cells.select(*keys, *AXES, "intensity"), [*keys, *AXES])
    bins = {"width": width} if modality == "CT" else {"count": extraction.MR_BIN_COUNT}
    return extraction.reproducibility(copies.stacked(marked, keys, repeats, **bins), repeats + 1)[0]


def holdout_manifest(targets: DataFrame, specs: DataFrame, path: str, dataset: str = "", fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Hold-out by the best target for strata: (case_id, split) and the one-row manifest, both written below ``path``.

    The target is the first per-case classification, else any classification, else a regression; with a stratum of fewer
    than two cases, or no such target, the split is random. Cases are those with a target document.
    """
    if not 0 < fraction < 1:
        raise ValueError("the fraction has to be between 0 and 1")
    cases = targets.select("case_id").distinct()
    if len(cases.limit(2).collect()) < 2:
        raise ValueError("a hold-out needs at least two cases")
    picked = splits.pick_target(specs.withColumn("dataset", F.lit(dataset))).select("target").first()
    target, stratum = picked[0] if picked else None, None
    if target is not None:
        cases = cases.join(splits.strata(targets, specs, target), "case_id", "left").selectExpr("case_id", "coalesce(stratum, -1) as stratum")
        cases = cut_lineage(cases)
        least = cases.groupBy("stratum").count().agg(F.min("count")).first()[0]
        stratum = "stratum" if least >= 2 else None
    make_holdout(cases, f"{path}/holdout", fraction, seed, stratum)
    split = cases.sparkSession.read.parquet(f"{path}/holdout")
    manifest = split.groupBy().agg(
        F.lit(seed).alias("seed"), F.lit("targets").alias("source"), F.lit(float(fraction)).alias("holdout_fraction"),
        F.lit("stratified_shuffle" if stratum else "random_shuffle").alias("strategy"), F.lit(target).cast("string").alias("stratification_key"),
        F.count(F.lit(1)).alias("n_cases"), F.expr("count_if(split = 'train') as n_train"), F.expr("count_if(split = 'holdout') as n_holdout"),
    )
    manifest.write.mode("overwrite").json(f"{path}/manifest")  # the cases themselves are the split's table
    return split, split.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")


def intercorrelation(features: DataFrame, path: str, threshold: float = 0.9) -> DataFrame:
    """Write the correlation table, the strong pairs and the summary; returns the summary."""
    pairs, strong = extraction.intercorrelation(features, threshold)
    pairs.write.mode("overwrite").option("header", True).csv(f"{path}/correlation")
    strong.write.mode("overwrite").option("header", True).csv(f"{path}/high_pairs")
    stored = features.sparkSession.read.schema(strong.schema).option("header", True).csv(f"{path}/high_pairs")
    summary = cut_lineage(extraction.intercorrelation_summary(features, stored, threshold))
    summary.write.mode("overwrite").json(f"{path}/summary")
    return summary


def train(
    features: DataFrame, targets: DataFrame, folds: DataFrame, n_folds: int, path: str, settings: training.Settings, num_classes: int = 2,
    scope: str = "per_label", icc: DataFrame | None = None, inputs: str = "",
) -> DataFrame:
    """Training: matrix, global filter, folds, models, metrics, importances and run times under ``path``.

    A fold is recorded in the ledger as soon as all of it is written, so a stopped job goes on with the next one; a job
    with other settings, or another name of its ``inputs``, starts anew.

    ``scope`` is ``per_label`` (a sample per region) or ``per_case`` (a sample per case, targets case_id and value).
    Features that ``icc`` (feature, icc) calls unstable are left out.
    """
    rows = matrix.matrix_per_label(features, targets) if scope == "per_label" else matrix.matrix_per_case_long(features, targets)
    kept = quality.global_filter(rows, icc).where("stage = 'kept'").select("feature")
    if kept.isEmpty():
        raise ValueError("no feature passed the global filter")
    spread = cut_lineage(matrix.fold_roles(rows.join(kept, "feature", "left_semi"), folds, n_folds).select("fold", "role", "sample_id", "feature", "value", "y"))
    ledger, hash_ = Ledger(features.sparkSession, path), digest(asdict(settings), scope, num_classes, n_folds, inputs)
    done = {int(r.note) for (step, h), r in ledger.rows.items() if h.startswith(hash_)}

    def prepared(out: training.Trained) -> None:
        training.save_bundle(out, f"{path}/bundle")

    def finished(item: training.FoldModel, predictions: DataFrame, importances: DataFrame, started: float) -> None:
        """All a fold leaves; the ledger's row comes last, so a fold without it is fitted again over what is there."""
        where = f"{path}/folds/fold={item.fold}"
        item.model.write().overwrite().save(f"{path}/bundle/model/fold={item.fold}")
        predictions.drop("fold").write.mode("overwrite").parquet(f"{where}/predictions")
        importances.drop("fold").orderBy(F.desc("importance"), "feature").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{where}/importances")
        stored = predictions.sparkSession.read.parquet(f"{where}/predictions").withColumn("fold", F.lit(item.fold))
        training.fold_metrics(stored, settings, num_classes).drop("fold").write.mode("overwrite").parquet(f"{where}/metrics")
        ledger.record(f"fold-{item.fold}", f"{hash_}-{item.fold}", where, started, note=str(item.fold))

    if done != set(range(n_folds)):
        training.train_folds(spread, settings, done, prepared, finished)
    mine = [r for (_, h), r in ledger.rows.items() if h.startswith(hash_)]
    for name, reader in (("predictions", _parquet), ("metrics", _parquet)):
        _all_folds(mine, name, reader).write.mode("overwrite").parquet(f"{path}/{name}")
    importances = _all_folds(mine, "importances", _importances)
    rollup.importance_summary(importances).orderBy(F.desc("mean")).write.mode("overwrite").option("header", True).csv(f"{path}/importances")
    times = features.sparkSession.createDataFrame([(int(r.note), r.seconds) for r in mine], "fold int, seconds double")
    times.coalesce(1).write.mode("overwrite").parquet(f"{path}/run_times")
    return features.sparkSession.read.parquet(f"{path}/metrics")


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, importance double").option("header", True).csv(path)


def _all_folds(rows: list, name: str, reader) -> DataFrame:
    """One of the tables of the folds in the ledger's rows, with the fold as a column; there are a handful of folds."""
    spark = SparkSession.getActiveSession()
    parts = [reader(spark, f"{r.folder}/{name}").withColumn("fold", F.lit(int(r.note))) for r in rows]
    if not parts:
        raise ValueError("no fold has both training and validation samples")
    return reduce(DataFrame.unionByName, parts)


def test(
    features: DataFrame, targets: DataFrame, holdout: DataFrame, path: str, settings: training.Settings, num_classes: int = 2, scope: str = "per_label",
) -> DataFrame:
    """Vote of all stored fold models on the held-out cases: predictions and metrics below ``path``; returns the metrics.

    Only folds whose model is stored take part; without one the job fails, as it does without a held-out sample.
    """
    spark = features.sparkSession
    make = matrix.matrix_test if scope == "per_label" else matrix.matrix_test_per_case
    rows = cut_lineage(make(features, targets, holdout).select("sample_id", "feature", "value", "y"))
    if rows.isEmpty():
        raise ValueError("no held-out sample has features and a target")
    trained = sorted(int(r.note) for r in Ledger(spark, path).rows.values() if r.step.startswith("fold-"))
    if not trained:
        raise ValueError(f"no trained fold below {path}")
    bundle = training.load_bundle(spark, f"{path}/bundle", sorted(set(trained)), settings)
    votes = training.ensemble_predict(bundle, rows.select("sample_id", "feature", "value"), settings)
    truth = rows.select("sample_id", "y").distinct()
    scored = cut_lineage(votes.join(truth, "sample_id"))
    scored.write.mode("overwrite").parquet(f"{path}/test_predictions")
    metrics = training.fold_metrics(scored.withColumn("fold", F.lit(-1)), settings, num_classes).drop("fold")
    counts = scored.agg(F.expr("double(count(1)) as n")).selectExpr("'n_test' as metric", "n as value")
    counts = counts.unionByName(spark.createDataFrame([("n_folds_ensemble", float(len(bundle.models)))], "metric string, value double"))
    metrics.unionByName(counts).write.mode("overwrite").parquet(f"{path}/test_metrics")
    return spark.read.parquet(f"{path}/test_metrics")


def predict(spark: SparkSession, features: DataFrame, path: str, folds: list[int], settings: training.Settings) -> DataFrame:
    """Vote of all fold models on new samples (sample_id, feature, value)."""
    return training.ensemble_predict(training.load_bundle(spark, f"{path}/bundle", folds, settings), features, settings)


def report(task: str, model: str, path: str, attention: DataFrame | None = None) -> DataFrame:
    """The report of a trained task, written to ``path``/report; returns its rows."""
    spark = SparkSession.getActiveSession()
    rows = rollup.report_document(task, model, spark.read.parquet(f"{path}/metrics"), spark.read.parquet(f"{path}/run_times"), attention)
    rollup.write_document(rows, f"{path}/report")
    return rows
