"""Random-forest training on fold tables: selection, search, bundles, ensembles.

Forests have the parameters of Spark ML's estimators; many trees are grown whole in tasks (``forest.py``) where the training rows
fit into one; few trees, and larger tables, are left to Spark ML.

Rows are long (fold, role, sample_id, feature, value, y). Statistics and selections of all folds are tables; only the
choice of parameters, a few numbers, is made on the driver.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators import forest, metrics, quality, rollup, selection, splits
from voxelframe.session import cut_lineage

# The random-search grid. A depth of 30 is Spark's deepest tree and stands for no limit.
GRID = {
    "numTrees": [100, 200, 300],
    "maxDepth": [30, 8, 12, 16, 24],
    "min_split": [2, 4, 8, 16],
    "min_leaf": [1, 2, 4, 8],
    "featureSubsetStrategy": ["sqrt", "log2", "0.3", "0.5", "0.8"],
}


# Other names a configuration may use.
IMBALANCE_NAMES = {"balanced": "class_weight", "balanced_subsample": "class_weight", "random_oversample": "oversample", "off": "none"}


@dataclass
class Settings:
    regression: bool = False
    trees: int = 500
    depth: int = 30
    seed: int = 42
    k: int = selection.DEFAULT_K
    variance: float = quality.FOLD_VARIANCE
    correlation: float = quality.FOLD_CORRELATION
    method: str = "univariate"
    imbalance: str = "class_weight"
    tune: bool = True
    draws: int = 20
    inner_folds: int = 3
    parallel: int = 8  # fits that run side by side
    grid: dict = field(default_factory=lambda: dict(GRID))

    def __post_init__(self):
        if self.method not in ("univariate", "rf_importance", "rfe", "none", "off", "false"):
            raise ValueError(f"unknown selection method: {self.method}")
        self.imbalance = IMBALANCE_NAMES.get(self.imbalance, self.imbalance)
        if self.imbalance not in ("class_weight", "oversample", "none"):
            raise ValueError(f"unknown imbalance method: {self.imbalance}")


def estimator(settings: Settings, **params):
    kind = RandomForestRegressor if settings.regression else RandomForestClassifier
    options = {"numTrees": settings.trees, "maxDepth": settings.depth, "seed": settings.seed, "featureSubsetStrategy": "auto", **params}
    # Without the cache every tree is walked from its root for every row and level; the memory is what one pass over the rows may count.
    made = kind(featuresCol="features", labelCol="y", cacheNodeIds=True, maxMemoryInMB=512, **options)
    if not settings.regression and settings.imbalance == "class_weight":
        made = made.setWeightCol("weight")
    return made


FEWEST = 50  # trees from which a forest is grown in tasks; Spark ML's jobs per level are cheap for fewer


def _in_tasks(estimators: list, rows: DataFrame) -> bool:
    return all(made.getNumTrees() >= FEWEST for made in estimators) and not forest.too_large(rows)


def _spec(made) -> forest.Spec:
    return forest.Spec(made.getNumTrees(), made.getMaxDepth(), made.getSeed(), made.getFeatureSubsetStrategy(), made.getMinInstancesPerNode())


def fit(made, rows: DataFrame, settings: Settings):
    """The estimator fitted to rows (features, y, weight)."""
    return forest.fit(rows, [_spec(made)], settings.regression)[0] if _in_tasks([made], rows) else made.fit(rows)


def vectors(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, sample): chosen features as a vector in order of place. Long rows are packed, never pivoted."""
    picked = rows.join(chosen.select("fold", "feature", "place"), ["fold", "feature"])
    packed = picked.groupBy(*keys).agg(F.expr("transform(array_sort(collect_list(struct(place, value))), c -> c.value) as v"))
    return packed.withColumn("features", array_to_vector("v")).drop("v")


def balanced(train: DataFrame, settings: Settings) -> DataFrame:
    """Training rows with a ``weight`` column, or with minority classes repeated."""
    if settings.regression or settings.imbalance == "none":
        return train.withColumn("weight", F.lit(1.0))
    if settings.imbalance == "oversample":
        return splits.oversample(train, label="y", seed=settings.seed).drop("copy").withColumn("weight", F.lit(1.0))
    return train.join(splits.balanced_weights(train, "y").select("y", "weight"), "y")


def importances(model, chosen: DataFrame) -> DataFrame:
    """feature, importance of a fitted forest; as many rows as the model has features."""
    spark = chosen.sparkSession
    scores = [(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    ordered = chosen.selectExpr("feature", "row_number() over (partition by fold order by place) - 1 as position")
    return ordered.join(spark.createDataFrame(scores, "position int, importance double"), "position").select("feature", "importance")


def _ranked(scores: DataFrame, fold: int, k: int) -> DataFrame:
    top = scores.orderBy(F.desc("importance"), "feature").limit(k)
    return top.selectExpr(f"{fold} as fold", "feature", "importance as f", "int(row_number() over (order by importance desc, feature)) as place")


def importance_selection(train: DataFrame, candidates: DataFrame, fold: int, settings: Settings) -> DataFrame:
    """The k features a forest ranks highest."""
    rows = balanced(vectors(train, candidates, ["sample_id", "y"]), settings)
    return _ranked(importances(fit(estimator(settings), rows, settings), candidates), fold, settings.k)


def recursive_selection(train: DataFrame, candidates: DataFrame, fold: int, settings: Settings, trees: int = 300) -> DataFrame:
    """Drop the worst tenth of the features, at least one, after every fit until k remain."""
    left = cut_lineage(candidates)
    count = left.count()
    while True:
        rows = balanced(vectors(train, left, ["sample_id", "y"]), settings)
        keep = max(settings.k, count - max(1, int(0.1 * count)))
        scores = importances(fit(estimator(settings, numTrees=min(trees, settings.trees)), rows, settings), left)
        left = cut_lineage(_ranked(scores, fold, min(keep, count)))
        if keep >= count or keep == settings.k:
            return left
        count = keep


def choose(scaled: DataFrame, settings: Settings) -> DataFrame:
    """Chosen features per fold: fold, feature, f, place."""
    if settings.method == "univariate":
        return selection.rank_train(scaled, settings.k, settings.variance, settings.correlation, settings.regression)
    everything = selection.rank_train(scaled, 2**31 - 1, settings.variance, settings.correlation, settings.regression)
    if settings.method in ("none", "off", "false"):
        return everything
    everything = cut_lineage(everything)
    pick = importance_selection if settings.method == "rf_importance" else recursive_selection
    out = None
    for (fold,) in sorted(everything.select("fold").distinct().collect()):  # a handful of folds
        train = scaled.where((F.col("fold") == fold) & (F.col("role") == "train"))
        part = pick(train, everything.where(F.col("fold") == fold), fold, settings)
        out = part if out is None else out.unionByName(part)
    return out


def _search_score(scored: DataFrame, settings: Settings) -> float | None:
    if settings.regression:
        return scored.agg(F.expr("-avg(abs(y - prediction))")).first()[0]
    rows = scored.selectExpr("int(y) as y_true", "probability")
    rows = rows.select("y_true", vector_to_array("probability").alias("proba"))
    return metrics.roc_auc_ovr(rows, weighted=True).first()[0]


def _search_scores(voted: DataFrame, settings: Settings) -> DataFrame:
    """forest, score."""
    if settings.regression:
        return voted.groupBy("forest").agg(F.expr("-avg(abs(y - prediction)) as score"))
    rows = voted.select("forest", F.expr("int(y) as y_true"), vector_to_array("probability").alias("proba"))
    return metrics.roc_auc_ovr(rows, ["forest"], weighted=True)


def random_search(train: DataFrame, settings: Settings) -> dict:
    """Best of ``draws`` random parameter sets over inner folds; an empty dict where the data cannot carry a search."""
    # Copies that oversampling made go where their sample goes: folds are drawn over samples.
    samples = train.select("sample_id", "y").distinct()
    n = samples.count()
    inner = settings.inner_folds
    if settings.regression:
        inner = min(inner, n // 4)
    else:
        sizes = [row["count"] for row in samples.groupBy("y").count().collect()]  # one number per class
        if len(sizes) < 2 or min(sizes) < 2:
            return {}
        inner = min(inner, min(sizes))
    if n < 8 or inner < 2:
        return {}
    cases = samples.selectExpr("sample_id as case_id", "int(y) as stratum")
    folds = splits.kfold(cases, inner, settings.seed, None if settings.regression else "stratum").withColumnRenamed("fold", "inner")
    rows = cut_lineage(train.join(folds.withColumnRenamed("case_id", "sample_id"), "sample_id"))
    generator = random.Random(settings.seed)
    drawn = []
    for _ in range(settings.draws):
        draw = {name: generator.choice(values) for name, values in settings.grid.items()}
        leaf = max(draw.pop("min_leaf"), draw.pop("min_split") // 2)
        drawn.append({**draw, "minInstancesPerNode": leaf})

    # Every fit is a small job; side by side they fill the executors. Scores come back in order, so ties go to the first draw.
    different = [dict(d) for d in dict.fromkeys(tuple(sorted(d.items())) for d in drawn)]
    whole = _in_tasks([estimator(settings, **params) for params in different], rows)

    def scores_of(wanted: list[dict], k: int) -> list[float | None]:
        fitting, held = rows.where(F.col("inner") != k), rows.where(F.col("inner") == k)
        made = [estimator(settings, **params) for params in wanted]
        if not whole:
            return [_search_score(each.fit(fitting).transform(held), settings) for each in made]
        models = forest.fit(fitting, [_spec(each) for each in made], settings.regression)
        voted = forest.vote(reduce(DataFrame.unionByName, [m.trees for m in models]), models[0].limits, models[0].classes, held)
        found = {r.forest: r[1] for r in _search_scores(voted, settings).collect()}  # one number per draw
        return [found.get(i) for i in range(len(made))]

    groups = [different] if whole else [[params] for params in different]
    with ThreadPoolExecutor(settings.parallel) as pool:
        running = [[pool.submit(inheritable_thread_target(train.sparkSession)(scores_of), group, k) for k in range(inner)] for group in groups]
        scores = [list(each) for fits in running for each in zip(*[f.result() for f in fits])]
    known = [[s for s in each if s is not None] for each in scores]
    means = [sum(each) / len(each) if each else float("-inf") for each in known]
    return different[max(range(len(different)), key=lambda i: (means[i], -i))]


@dataclass
class FoldModel:
    fold: int
    model: object
    params: dict


@dataclass
class Trained:
    models: list[FoldModel]
    medians: DataFrame
    scale: DataFrame
    chosen: DataFrame
    predictions: DataFrame
    importances: DataFrame


def predictions_of(model, rows: DataFrame, settings: Settings, fold: int) -> DataFrame:
    scored = model.transform(rows)
    columns = [F.lit(fold).alias("fold"), "sample_id"] + (["y"] if "y" in rows.columns else [])
    if settings.regression:
        return scored.select(*columns, F.col("prediction").alias("y_pred"))
    return scored.select(*columns, F.col("prediction").cast("int").alias("y_pred"), vector_to_array("probability").alias("proba"))


def train_folds(
    rows: DataFrame, settings: Settings, done: set[int] = frozenset(), prepared: Callable[[Trained], None] | None = None,
    finished: Callable[[FoldModel, DataFrame, DataFrame, float], None] | None = None,
) -> Trained:
    """Fit one forest per fold on its training rows and predict its validation rows.

    Preparation runs once for all folds; a fold that is done already or has an empty side is skipped. ``prepared`` gets the
    tables of the preparation before the first fit, ``finished`` every model with its predictions, importances and the time
    it started, in the order of the folds. Folds are fitted side by side.
    """
    keys = ["fold"]
    rows = cut_lineage(quality.complete(rows, keys))
    train = rows.where("role = 'train'")
    medians = cut_lineage(quality.medians(train, keys))
    full = quality.fill_median(rows, medians, keys)
    scale = cut_lineage(quality.scale_stats(full.where("role = 'train'"), keys))
    scaled = quality.standardize(full, scale, keys)
    chosen = cut_lineage(choose(scaled, settings))
    packed = cut_lineage(vectors(scaled, chosen, ["fold", "role", "sample_id", "y"]))
    sides = {(r["fold"], r["role"]) for r in packed.select("fold", "role").distinct().collect()}  # two per fold
    models, predicted, ranked = [], None, None
    if prepared is not None:
        prepared(Trained([], medians, scale, chosen, None, None))
    wanted = [f for f in sorted({f for f, _ in sides}) if f not in done and (f, "train") in sides and (f, "val") in sides]
    # Folds share nothing; a search inside a fold takes its share of the fits that run side by side.
    workers = max(1, min(len(wanted), settings.parallel // 2))
    inner = replace(settings, parallel=max(1, settings.parallel // workers))

    def fitted(fold: int) -> tuple[FoldModel, float]:
        started = time.time()
        fit_rows = balanced(packed.where((F.col("fold") == fold) & (F.col("role") == "train")).drop("fold", "role"), settings)
        params = random_search(fit_rows, inner) if settings.tune else {}
        return FoldModel(fold, fit(estimator(settings, **params), fit_rows, settings), params), started

    with ThreadPoolExecutor(workers) as pool:
        running = [pool.submit(inheritable_thread_target(rows.sparkSession)(fitted), fold) for fold in wanted]
        try:
            for each in running:  # in order: a stopped job has finished the folds before the one it stopped in
                item, started = each.result()
                mine = packed.where((F.col("fold") == item.fold) & (F.col("role") == "val")).drop("fold", "role")
                part = predictions_of(item.model, mine, settings, item.fold)
                scores = importances(item.model, chosen.where(F.col("fold") == item.fold)).selectExpr(f"{item.fold} as fold", "feature", "importance")
                if finished is not None:
                    finished(item, part, scores, started)
                models.append(item)
                predicted = part if predicted is None else predicted.unionByName(part)
                ranked = scores if ranked is None else ranked.unionByName(scores)
        finally:
            for each in running:  # after an error no further fold is begun
                each.cancel()
    return Trained(models, medians, scale, chosen, predicted, ranked)


def fold_metrics(predictions: DataFrame, settings: Settings, num_classes: int = 2) -> DataFrame:
    """Long metrics: fold, metric, value."""
    keys = ["fold"]
    rows = predictions.withColumnRenamed("y", "y_true")
    if settings.regression:
        wide = metrics.regression_metrics(rows, keys)
    else:
        rows = rows.withColumn("y_true", F.col("y_true").cast("int"))
        if num_classes == 2:
            one = rows.selectExpr("fold", "y_true", "proba[1] as proba")
            wide = metrics.binary_metrics(rows, keys).join(metrics.roc_auc(one, keys).drop("positives"), "fold").join(metrics.brier(one, keys), "fold")
        else:
            wide = metrics.multiclass_f1(rows, keys).join(metrics.roc_auc_ovr(rows, keys), "fold")
    names = [c for c in wide.columns if c != "fold"]
    return wide.selectExpr("fold", f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in names)}) as (metric, value)")


def save_bundle(trained: Trained, path: str) -> None:
    """Models and the tables needed to prepare new rows."""
    for item in trained.models:
        item.model.write().overwrite().save(f"{path}/model/fold={item.fold}")
    for name in ("medians", "scale", "chosen"):
        getattr(trained, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, folds: list[int], settings: Settings) -> Trained:
    kind = RandomForestRegressionModel if settings.regression else RandomForestClassificationModel
    paths = {fold: f"{path}/model/fold={fold}" for fold in folds}
    models = [FoldModel(fold, forest.Forest.load(spark, where) or kind.load(where), {}) for fold, where in paths.items()]
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("medians", "scale", "chosen")}
    return Trained(models, predictions=None, importances=None, **tables)


def score(bundle: Trained, features: DataFrame, settings: Settings) -> DataFrame:
    """Predictions of every fold model on new long rows (sample_id, feature, value[, y]).

    A feature the new data lacks takes the training median; features the model does not know are ignored.
    """
    keys = ["fold"]
    needed = bundle.chosen.join(bundle.medians, [*keys, "feature"]).join(bundle.scale, [*keys, "feature"])
    wanted = needed.agg(F.expr("collect_list(struct(fold, feature, place, median, mean, std)) as wanted"))  # folds x chosen features
    target = ["y"] if "y" in features.columns else []
    samples = features.select("sample_id", *target).distinct()
    every = samples.withColumn("wanted", wanted.scalar()).selectExpr("sample_id", *target, "inline(wanted)")
    filled = every.join(features.select("sample_id", "feature", "value"), ["sample_id", "feature"], "left")
    scaled = filled.selectExpr("fold", "sample_id", *target, "place", "(coalesce(value, median) - mean) / std as value")
    packed = scaled.groupBy("fold", "sample_id", *target).agg(
        F.expr("transform(array_sort(collect_list(struct(place, value))), c -> c.value) as v")
    ).withColumn("features", array_to_vector("v")).drop("v")
    out = None
    for item in bundle.models:
        part = predictions_of(item.model, packed.where(F.col("fold") == item.fold).drop("fold"), settings, item.fold)
        out = part if out is None else out.unionByName(part)
    return out


def ensemble_predict(bundle: Trained, features: DataFrame, settings: Settings) -> DataFrame:
    """One prediction per sample: mean over folds, classes rounded half to even."""
    return rollup.ensemble_vote(score(bundle, features, settings), classes=not settings.regression)
