"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic regression over the words of the text and the
probabilities of the categories before it. For training, those probabilities are out-of-fold predictions, made by models
that have not seen the document, so later models learn from errors as they will meet them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.session import cut_lineage

#: Documented bound: the chain is fitted on about this many labelled documents, chosen by a hash of the doc_id.
TRAINING_DOCUMENTS = 8000
#: Words per category with the largest chi-square between presence and label.
VOCABULARY = 1500
FOLDS = 3
THRESHOLD = 0.5


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))


def _shares(text: Column, words: Column) -> list[Column]:
    """Marks of junk that words do not show: distinct words per character, and characters that are no letters or spaces."""
    length = F.greatest(F.length(text), F.lit(1)).cast("double")
    return [(F.size(words) / length).alias("__variety"), (F.length(F.translate(text, "#$%&*!|{}<>[]~^_=", "")) / length).alias("__plain")]


@dataclass
class Chain:
    """A fitted chain: vocabulary and, per category, a model or (with one class only) a constant probability."""

    categories: list[str]
    vocabulary: list[str]
    models: list = field(default_factory=list)

    def features(self, docs: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = docs.withColumn("__words", _words(F.col("text")))
        rows = rows.withColumns(dict(zip(["__variety", "__plain"], _shares(text, F.col("__words")), strict=True)))
        counts = CountVectorizerModel.from_vocabulary(self.vocabulary or [""], inputCol="__words", outputCol="__counts", minTF=1.0, binary=True)
        return VectorAssembler(inputCols=["__counts", "__variety", "__plain"], outputCol="__features").transform(counts.transform(rows)).drop("__words", "__counts", "__variety", "__plain")

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with a column __p_<category> per category: the probability that it applies, null without a model.

        A null text counts as empty; all rows are kept, repeated ones too, and no other column is read or changed.
        """
        rows = self.features(docs)
        for i in range(len(self.categories)):
            rows = _predict(rows, self.models[i], self.categories[:i], f"__p_{self.categories[i]}")
        return rows.drop("__features")


def _inputs(rows: DataFrame, earlier: list[str]) -> DataFrame:
    columns = ["__features", *[f"__p_{c}" for c in earlier]]
    filled = rows.fillna(0.0, subset=columns[1:]) if earlier else rows
    return VectorAssembler(inputCols=columns, outputCol="__inputs").transform(filled)


def _predict(rows: DataFrame, model, earlier: list[str], name: str) -> DataFrame:
    if model is None or isinstance(model, float):
        return rows.withColumn(name, F.lit(model).cast("double"))
    made = model.transform(_inputs(rows, earlier))
    return made.withColumn(name, F.round(vector_to_array("__probability")[1], 6)).drop("__inputs", "__raw", "__probability", "__predicted")


def _fit_one(rows: DataFrame, category: str, earlier: list[str]):
    known = rows.where(F.col(category).isNotNull())
    number, positive = known.agg(F.count(F.lit(1)), F.sum(F.col(category).cast("double"))).first()
    if not number:
        return None
    if positive in (0, number):
        return float((positive + 1) / (number + 2))
    learner = LogisticRegression(featuresCol="__inputs", labelCol="__label", rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__predicted", maxIter=30, regParam=0.001, elasticNetParam=1.0)
    return learner.fit(_inputs(known, earlier).withColumn("__label", F.col(category).cast("double")))


def _vocabulary(rows: DataFrame, categories: list[str]) -> list[str]:
    """Words with the largest chi-square for some category. The table has one row per word of the bounded sample."""
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in categories]
    words = rows.select("doc_id", *categories, F.explode(_words(F.col("text"))).alias("word"))
    table = cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums).where("n >= 3"))
    total = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), *sums).first()
    chosen: set[str] = set()
    for c in categories:
        share = float(total[c] or 0.0) / max(total["n"], 1.0)
        if 0 < share < 1:
            gap = F.coalesce(F.col(c), F.lit(0.0)) - F.col("n") * share
            chi = gap * gap / (F.col("n") * share * (1 - share))
            chosen |= {r[0] for r in table.orderBy(chi.desc(), "word").limit(VOCABULARY).select("word").collect()}
    return sorted(chosen)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], limit: int = TRAINING_DOCUMENTS) -> Chain:
    """Fit a chain over ``categories`` (0/1 columns of ``labels``, null where unknown) in the order given.

    ``labels`` has doc_id; rows without a partner in ``docs`` and null ids take no part; of several labels of an id the
    largest counts, so an id that fills the table is one row. At most about ``limit`` labelled
    rows are used, so the label side of the join has a bound and is broadcast. Without any row, probabilities are null.
    """
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    share = limit / max(marked.count(), 1)
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    sample = cut_lineage(rows)
    chain = Chain(list(categories), _vocabulary(sample, categories))
    table = chain.features(sample).withColumn("__fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))).drop("text")
    table = cut_lineage(table.coalesce(4))
    for i, category in enumerate(categories):
        chain.models.append(_fit_one(table, category, categories[:i]))
        if i + 1 < len(categories):
            parts = []
            for fold in range(FOLDS):
                unseen = _fit_one(table.where(F.col("__fold") != fold), category, categories[:i])
                parts.append(_predict(table.where(F.col("__fold") == fold), unseen, categories[:i], f"__p_{category}"))
            joined = parts[0]
            for part in parts[1:]:
                joined = joined.unionByName(part)
            table = cut_lineage(joined.coalesce(4))
    return chain
