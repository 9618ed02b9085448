"""Whole jobs: the ledger's steps, going on after a stop, broken regions, hold-out, test and report."""

import pytest
from pyspark.sql import functions as F

from voxelframe.operators import intensity, rollup, splits, training
from voxelframe.plans import extraction, isolate, jobs
from voxelframe.plans.ledger import Ledger, digest, files_digest
from voxelframe.sources import records

KEYS = ["case_id", "label_id"]


def test_a_step_is_made_once(spark, tmp_path):
    calls = []

    def make(n):
        calls.append(n)
        return spark.range(n)

    def run(n, inputs="x"):
        ledger = Ledger(spark, str(tmp_path))
        first, hash_ = ledger.table("first", lambda: make(n), n, (inputs,))
        second, _ = ledger.table("second", lambda: make(first.count() + 1), None, (hash_,))
        return second.count()

    assert run(5) == 6 and run(5) == 6 and calls == [5, 6]
    assert run(7) == 8 and calls == [5, 6, 7, 8]  # other parameters
    assert run(7, "y") == 8 and len(calls) == 6  # other inputs
    assert run(5) == 6 and len(calls) == 6  # an earlier state is still there
    times = {(r.step, r.seconds > 0) for r in Ledger(spark, str(tmp_path)).run_times().collect()}
    assert times == {("first", True), ("second", True)}


def test_a_stopped_step_is_repeated(spark, tmp_path):
    stop = F.raise_error(F.lit("stopped")).cast("long")
    for _ in range(2):
        ledger = Ledger(spark, str(tmp_path))
        ledger.table("good", lambda: spark.range(3))
        with pytest.raises(Exception, match="stopped"):
            ledger.table("bad", lambda: spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, stop).otherwise(F.col("id")).alias("id")))
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.table("bad", lambda: spark.range(100))[0].count() == 100 and ledger.made == ["bad"]


def test_hashes(spark, tmp_path):
    assert digest({"a": 1, "b": 2}) == digest({"b": 2, "a": 1}) != digest({"a": 1, "b": 3})
    spark.range(3).write.parquet(str(tmp_path / "t"))
    before = files_digest(spark.read.parquet(str(tmp_path / "t")))
    assert before == files_digest(spark.read.parquet(str(tmp_path / "t")))
    spark.range(3).write.mode("append").parquet(str(tmp_path / "t"))
    assert before != files_digest(spark.read.parquet(str(tmp_path / "t")))


SPECS = [("fracture", "classification", "per_label", 2, 0), ("source_level", "classification", "per_case", 5, 1), ("age", "regression", "per_case", None, 2)]
SPEC = "target string, type string, scope string, num_classes int, position int"


@pytest.fixture()
def toy_targets(spark):
    rows = []
    for i in range(5):
        case = f"case{i + 1:03d}"
        rows += [(case, "fracture", 20, float(i % 2)), (case, "fracture", 21, float((i + 1) % 2)), (case, "source_level", None, float(i + 1)), (case, "age", None, 40.0 + i)]
    return spark.createDataFrame(rows, "case_id string, target string, label_id int, value double")


def test_preprocess_job(spark, toy, toy_targets, tmp_path, monkeypatch):
    """A job that is stopped in the middle makes only what is left; afterwards nothing."""
    specs, labels = spark.createDataFrame(SPECS, SPEC), spark.createDataFrame([(20,), (21,)], "label_id int")
    run = lambda: jobs.preprocess(toy, labels, toy_targets, specs, "toy", "CT", str(tmp_path), "radiomics", n_folds=5, repeats=2)
    real = extraction.reproducibility
    monkeypatch.setattr(extraction, "reproducibility", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.setattr(extraction, "reproducibility", real)
    ledger = run()
    assert ledger.made == ["icc", "high_pairs", "correlation_summary"]
    steps = {step: row.folder for (step, _), row in ledger.rows.items()}
    read = {name: spark.read.parquet(folder) for name, folder in steps.items()}
    assert set(steps) == {"plan", "crops", "targets", "folds", "feature_errors", "features", "icc", "high_pairs", "correlation_summary"}
    assert read["crops"].count() == 9 and read["feature_errors"].count() == 0
    assert read["targets"].where("case_id = 'case001' and target = 'source_level'").first()["value"] == 0.0
    assert sorted(r.fold for r in read["folds"].collect()) == [0, 1, 2, 3, 4]
    assert read["features"].select("case_id", "label_id").distinct().count() == 9
    names = {r.feature for r in read["features"].select("feature").distinct().collect()}
    assert {"original_shape_MeshVolume", "wavelet-LLL_glcm_MCC", "log-sigma-3_ngtdm_Busyness"} <= names
    assert {r.feature for r in read["icc"].collect()} >= {n for n in names if n.startswith("original_")}
    summary = read["correlation_summary"].first()
    assert summary.n_samples == 9 and summary.n_high_corr_pairs == read["high_pairs"].count() > 0
    assert run().made == []


def test_modes_of_planners():
    assert [jobs.modes_of(n) for n in (None, "", "default", "radiomicsPlanner", "ScatterOnly", "wavelets", "all", "both")] == [
        (False, False), (False, False), (False, False), (True, False), (False, True), (False, True), (True, True), (True, True),
    ]


def crop(case, broken=""):
    n = 4 * 5 * 6
    image, mask = [float((i * 37 + case) % 101) for i in range(n)], [int(i % 4 > 0) for i in range(n)]
    if broken == "short":
        image = image[:-1]
    if broken == "nan":
        image[1] = float("nan")
    if broken == "empty":
        mask = [0] * n
    return (case, 1, [4, 5, 6] if broken != "shape" else [4, 5], None if broken == "null" else image, mask)


CROP = "case_id long, label_id int, shape array<int>, image array<double>, mask array<int>"


def test_broken_crops_do_not_stop_the_others(spark, tmp_path):
    """Named faults and one that only shows while it runs: all others have their features, and a second run tries the broken
    ones again."""
    broken = {3: "short", 5: "nan", 7: "empty", 9: "shape", 11: "null"}
    crops = spark.createDataFrame([crop(i, broken.get(i, "")) for i in range(24)], CROP).repartition(3)
    store = str(tmp_path / "store")

    def levels(rows, bad=13):
        fails = F.raise_error(F.lit("odd region")).cast("double")
        rows = rows.where("inside = 1").withColumn("intensity", F.when(F.col("case_id") == bad, fails).otherwise(F.col("intensity")))
        return intensity.discretize_width(rows, KEYS, 25.0)

    errors = {r.key: r.error for r in extraction.extract_safely(crops, store, "h", levels, KEYS, ("firstorder", "gldm")).collect()}
    assert set(errors) == {f"{i}:1" for i in (*broken, 13)} and "odd region" in errors["13:1"]
    assert errors["3:1"] == "image does not fill its shape" and errors["7:1"] == "empty mask" and errors["5:1"] == "region holds a value that is no number"
    have = records.read_features(spark, store, "h")
    assert have.select("case_id").distinct().count() == 18
    assert have.groupBy("case_id", "feature").count().where("count > 1").isEmpty()
    again = extraction.extract_safely(crops, store, "h", lambda rows: levels(rows, -1), KEYS, ("firstorder", "gldm"))
    assert {r.key for r in again.collect()} == {f"{i}:1" for i in broken}
    assert records.read_features(spark, store, "h").select("case_id").distinct().count() == 19


def test_bisection_takes_few_runs(spark):
    runs = []

    def work(part):
        runs.append(1)
        part.select(F.when(F.col("k") == 517, F.raise_error(F.lit("bad"))).otherwise(F.lit(""))).write.format("noop").mode("overwrite").save()

    failed = isolate.attempt(spark.range(1000).withColumnRenamed("id", "k"), ["k"], work).collect()
    assert [(r.key, "bad" in r.error) for r in failed] == [("517", True)] and len(runs) <= 41


def samples(spark, n=120):
    rows = spark.range(n).selectExpr("id as case_id", "int(id % 2) as label_id", "(id * 37 % 101) / 10D as a", "double(id % 2) + (id * 53 % 97) / 97D as b")
    return rows.selectExpr("case_id", "label_id", "stack(2, 'a', a, 'b', b) as (feature, value)"), rows.selectExpr("case_id", "label_id", "double(label_id) as value")


def test_training_goes_on_and_is_tested_and_reported(spark, tmp_path, monkeypatch):
    features, targets = samples(spark)
    cases = targets.select("case_id")
    holdout = jobs.make_holdout(cases, str(tmp_path / "holdout"), 0.25)
    train_cases = holdout.where("split = 'train'").select("case_id")
    folds = jobs.make_folds(train_cases, str(tmp_path / "folds"), 3)
    settings, out = training.Settings(trees=5, depth=3, k=2, tune=False), str(tmp_path / "out")
    run = lambda: jobs.train(features, targets, folds, 3, out, settings)
    fitted, real = [], training.predictions_of

    def stopping(model, rows, settings, fold):
        fitted.append(fold)
        if len(fitted) == 2:
            raise RuntimeError("stopped")
        return real(model, rows, settings, fold)

    monkeypatch.setattr(training, "predictions_of", stopping)
    with pytest.raises(RuntimeError):
        run()
    metrics = run().collect()
    assert fitted == [0, 1, 1, 2] and {r.fold for r in metrics} == {0, 1, 2}
    assert spark.read.parquet(f"{out}/predictions").count() == 90
    assert run().count() == len(metrics) and fitted == [0, 1, 1, 2]
    monkeypatch.undo()
    for fold in range(3):
        assert spark.read.option("header", True).csv(f"{out}/folds/fold={fold}/importances").columns == ["feature", "importance"]

    tested = {r.metric: r.value for r in jobs.test(features, targets, holdout, out, settings).collect()}
    assert tested["n_test"] == 30 and tested["n_folds_ensemble"] == 3 and tested["auc"] > 0.9
    assert spark.read.parquet(f"{out}/test_predictions").count() == 30
    with pytest.raises(ValueError):
        jobs.test(features, targets, holdout.where("false"), out, settings)
    with pytest.raises(ValueError):
        jobs.test(features, targets, holdout, str(tmp_path / "nothing"), settings)

    jobs.report("task", "forest", out)
    lines = [r.value for r in spark.read.text(f"{out}/report").collect()]
    assert lines[:4] == ["# Report: task", "", "- Model: `forest`", "- Folds: 3"] and lines[4].startswith("- Runtime (s): ")
    assert lines[8] == "| Metric | Mean | Std | Min | Max |" and any(line.startswith("| auc | ") for line in lines[10:])
    assert float(lines[4].split(": ")[1]) > 0


def test_per_case_test_matrix(spark):
    from voxelframe.operators import matrix

    features, targets = samples(spark, 8)
    holdout = spark.createDataFrame([(i, "holdout" if i < 3 else "train") for i in range(8)], "case_id long, split string")
    rows = matrix.matrix_test_per_case(features, targets.drop("label_id"), holdout).collect()
    assert {r.case_id for r in rows} == {0, 1, 2} and {r.feature for r in rows} == {"label000_a", "label000_b", "label001_a", "label001_b"}


def test_report_with_weights(spark):
    metrics = spark.createDataFrame([(0, "auc", 0.5), (1, "auc", 1.0)], "fold int, metric string, value double")
    times = spark.createDataFrame([(0, 1.25), (1, 2.5)], "fold int, seconds double")
    weights = spark.createDataFrame([("20", 0.25), ("21", 0.75)], "label string, weight double")
    rows = rollup.report_document("t", "m", metrics, times, weights).orderBy("part", "name").collect()
    assert [r.line for r in rows][4] == "- Runtime (s): 3.75" and [r.line for r in rows][10] == "| auc | 0.7500 | 0.2500 | 0.5000 | 1.0000 |"
    assert [r.line for r in rows][11:] == ["", "## Mean Attention Weights", "", "- Label 20: 0.250 `#####`", "- Label 21: 0.750 `###############`"]


def test_holdout_with_manifest(spark, toy_targets, tmp_path):
    specs = spark.createDataFrame(SPECS, SPEC)
    split, manifest = jobs.holdout_manifest(toy_targets, specs, str(tmp_path))
    row = manifest.first()
    assert split.where("split = 'holdout'").count() == 1 == row.n_holdout and row.n_train == 4 and row.n_cases == 5
    assert row.stratification_key == "source_level" and row.strategy == "random_shuffle"  # five classes of one case each
    fracture = specs.where("target = 'fracture'")
    row = jobs.holdout_manifest(toy_targets, fracture, str(tmp_path / "b"), fraction=0.4)[1].first()
    assert (row.stratification_key, row.n_holdout) == ("fracture", 2)
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            jobs.holdout_manifest(toy_targets, specs, str(tmp_path), fraction=bad)
    with pytest.raises(ValueError):
        jobs.holdout_manifest(toy_targets.where("case_id = 'case001'"), specs, str(tmp_path))


def test_classes_of_all_targets(spark, toy_targets):
    specs = spark.createDataFrame(SPECS, SPEC)
    got = {(r.case_id, r.target, r.label_id): r.value for r in splits.canonical_targets(toy_targets, specs).collect()}
    assert len(got) == 20 and got["case001", "source_level", None] == 0.0 and got["case005", "source_level", None] == 4.0
    assert got["case002", "fracture", 20] == 1.0 and got["case003", "age", None] == 42.0


def test_mr_crops_are_normalised(spark):
    rows = spark.createDataFrame([(1, 1, i, float(v)) for i, v in enumerate([1, 2, 3, 4])] + [(2, 1, 0, 5.0)], "case_id int, label_id int, x int, intensity double")
    got = [round(r.intensity, 6) for r in extraction.normalised(rows, KEYS, "MR").orderBy("case_id", "x").collect()]
    assert got == [-116.189500, -38.729833, 38.729833, 116.189500, 0.0]
    assert extraction.normalised(rows, KEYS, "CT") is rows
