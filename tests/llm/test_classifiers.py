"""Language and toxicity: held-out accuracy, and every edge row gets a result."""

import zlib

import pytest
from pyspark.sql import functions as F

from voxelframe.llm import language, queries, toxicity

LARGER = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = queries.op5(spark, LARGER).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def model_of(spark):
    rows = [(i, "the cat and the dog ran", "en") for i in range(9)] + [(i, "le chat et la maison été", "fr") for i in range(9, 18)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_words_then_shorter_grams(spark):
    model = model_of(spark)
    assert model.predict("cat dog")[0] == "en" and model.predict("Été CHAT")[0] == "fr"
    assert "dogs" not in model.words and model.predict("dogs")[0] == "en"  # unseen word, known n-grams
    assert model.predict("мир")[0] in ("en", "fr")  # nothing known: the floor, first language
    assert model.predict("12 ²! \n")[0] == model.predict("")[0] == model.predict(None)[0] == "und"


def test_language_edges(spark, edges, empty):
    out = language.predict(edges, model_of(spark))
    assert out.count() == edges.count()
    assert {r.lang_pred for r in out.where("doc_id in (1, 2, 3)").collect()} == {"und"}
    assert language.predict(empty, model_of(spark)).count() == 0
    nothing = language.fit(edges.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(edges, nothing).collect()} == {"und"}


@pytest.fixture(scope="module")
def chain(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return docs, labels, toxicity.fit(docs.where("doc_id % 3 <> 0"), labels, ["low_quality", "toxic"])


def test_toxicity_held_out(chain):
    docs, labels, model = chain
    scored = model.score(docs.where("doc_id % 3 = 0")).join(labels, "doc_id").collect()
    hits = sum((r["__p_toxic"] >= 0.5) == (r.toxic == 1) for r in scored)
    assert len(scored) > 100 and hits / len(scored) > 0.93
    assert all(0 <= r["__p_low_quality"] <= 1 for r in scored)


def test_later_models_read_earlier_probabilities(chain):
    assert chain[2].models[1].numFeatures == chain[2].models[0].numFeatures + 1


def test_toxicity_edges(spark, edges, empty, chain):
    out = chain[2].score(edges)
    assert out.count() == edges.count() and out.columns == [*edges.columns, "__p_low_quality", "__p_toxic"]
    assert out.where("`__p_toxic` is null").count() == 0
    assert chain[2].score(empty).count() == 0


def test_few_labels(spark, edges):
    none = toxicity.fit(edges, spark.createDataFrame([], "doc_id long, toxic int"), ["toxic"])
    assert none.score(edges).where("`__p_toxic` is not null").count() == 0
    one = toxicity.fit(edges, spark.createDataFrame([(4, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int"), ["toxic"])
    assert {r[0] for r in one.score(edges).select("__p_toxic").collect()} == {0.25}
