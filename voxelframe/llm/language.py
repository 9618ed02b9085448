"""Language identification by words first, then shorter and shorter character n-grams.

Each language has log frequencies of its words and of character n-grams within words. A known word scores its log
frequency in every language. A word no language knows is scored by its n-grams of the greatest length, as far as these are
known; an unknown n-gram falls back to the shorter one that ends it, down to single characters and a floor.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import small_batches
from voxelframe.session import cut_lineage

#: Documented bound: the classifier is fitted on about this many labelled documents, chosen by a hash of the doc_id.
TRAINING_DOCUMENTS = 6000
#: A word or n-gram is known if the training documents have it at least so often.
KNOWN_FROM = 3
LONGEST = 4
PENALTY = math.log(0.4)
CACHE_WORDS = 150_000
WORDS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


class Model:
    """Log frequencies as rows of one matrix (a column per language); ``words`` and ``grams`` give the row."""

    def __init__(self, languages: list[str], words: dict[str, list[int]], grams: dict[str, list[int]]):
        self.languages = languages
        n = len(languages)
        self.words = {w: i for i, w in enumerate(words)}
        counts = np.array([*words.values()], np.float64).reshape(len(words), n)
        self.word_scores = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * (len(counts) + 1)))
        self.grams = {g: i for i, g in enumerate(grams)}
        counts = np.array([*grams.values()], np.float64).reshape(len(grams), n)
        sizes = np.array([len(g) for g in grams], np.int64)
        self.gram_scores = np.zeros_like(counts)
        for size in range(1, LONGEST + 1):
            rows = sizes == size
            part = counts[rows]
            self.gram_scores[rows] = np.log((part + 0.1) / (part.sum(axis=0) + 0.1 * (len(part) + 1)))
        self.floor = np.full(n, self.gram_scores.min(initial=-12.0))
        self.seen: dict[str, np.ndarray] = {}

    def by_grams(self, word: str) -> np.ndarray:
        """Mean log frequency of the n-grams that end at each character, longest known one first."""
        padded = f"^{word}$"
        total = np.zeros(len(self.languages))
        for end in range(2, len(padded) + 1):
            for size in range(min(LONGEST, end), 0, -1):
                row = self.grams.get(padded[end - size : end])
                if row is not None:
                    total += self.gram_scores[row] + PENALTY * (LONGEST - size)
                    break
            else:
                total += self.floor
        return total / (len(padded) - 1)

    def score(self, word: str) -> np.ndarray:
        known = self.seen.get(word)
        if known is None:
            row = self.words.get(word)
            known = self.by_grams(word) if row is None else self.word_scores[row]
            if len(self.seen) > CACHE_WORDS:
                self.seen.clear()
            self.seen[word] = known
        return known

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and share of the posterior (a uniform prior); ``und`` and 0 without a letter or a model."""
        words = WORDS.findall(text.lower()) if text and self.languages else []
        if not words or not (words[0].isalpha() or any(map(str.isalpha, text))):
            return UNDETERMINED, 0.0
        counts: dict[str, int] = {}
        for word in words:
            counts[word] = counts.get(word, 0) + 1
        score = self.score
        total = np.array(list(counts.values()), np.float64) @ np.array([score(w) for w in counts])
        weights = np.exp(total - total.max())
        best = int(weights.argmax())  # ties: the language that comes first by name
        return self.languages[best], float(weights[best] / weights.sum())


def bounded_sample(rows: DataFrame, limit: int, salt: int = 0) -> DataFrame:
    """About ``limit`` rows, or all if there are fewer, chosen by a hash of doc_id."""
    share = limit / max(rows.count(), 1)
    if share >= 1:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000))


def counts_by_language(rows: DataFrame, item: str) -> dict[str, list[int]]:
    """item -> counts in the order of the languages, for items seen at least KNOWN_FROM times (bounded by the sample)."""
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    sums = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).cast("long").alias(f"l{i}") for i, name in enumerate(languages)]
    table = rows.groupBy(item).agg(*sums, F.sum("n").alias("total")).where(F.col("total") >= KNOWN_FROM)
    return {r[0]: list(r[1:-1]) for r in table.orderBy(item).toLocalIterator()}


def fit(labelled: DataFrame, limit: int = TRAINING_DOCUMENTS) -> Model:
    """Fit on a bounded sample of labelled documents (doc_id, text, lang). Null texts, null languages and documents
    without letters add nothing; repeated rows count again; without any row the model knows no language."""
    sample = bounded_sample(labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang"), limit)
    small_batches(labelled.sparkSession)

    def count(batches):
        for batch in batches:
            out: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for word in WORDS.findall(text.as_py().lower()):
                    out[lang, word] = out.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "word", "n"])

    words = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words)
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    sizes = [F.transform(F.sequence(F.lit(1), F.length(padded) - size + 1), _cut(padded, size)) for size in range(1, LONGEST + 1)]
    usable = [F.when(F.length(padded) >= size, s).otherwise(F.array().cast("array<string>")) for size, s in enumerate(sizes, 1)]
    grams = words.select("lang", "n", F.explode(reduce(F.concat, usable)).alias("gram"))
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    return Model(languages, counts_by_language(words, "word"), counts_by_language(grams, "gram"))


def _cut(text: Column, size: int):
    return lambda i: F.substring(text, i, F.lit(size))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text alone. Null or letterless texts give ``und`` and score 0."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def work(batches):
        known = shared.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
