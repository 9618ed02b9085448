"""Thin queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import bpe, exact_dedup, language, merkle, packing, pii, runs, secrets, simhash, token_counts, topk, toxicity, wrappers
from voxelframe.llm.common import documents
from voxelframe.llm.merkle_sql import manifest_sql
from voxelframe.llm.registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]


@query("op1_simhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.groups(documents(spark, folder))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_rows")


@query("op2_topk", """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
c AS (SELECT vec_id, v, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, o.vec_id AS vec_id, CAST(sum(q.x * o.x) AS BIGINT) AS score
  FROM c AS q JOIN c AS o ON q.d = o.d AND q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, o.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), topk.scaled(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


@query("op3_secrets")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(documents(spark, folder), by_window=True)


def toxicity_chain(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.Chain:
    """Low quality first, as junk explains part of the words of toxic texts."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.fit(docs, labels, ["low_quality", "toxic"])


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    rows = toxicity_chain(spark, folder, docs).score(docs)
    flagged = F.coalesce(F.col("__p_toxic") >= toxicity.THRESHOLD, F.lit(False))
    return rows.select("doc_id", F.col("__p_low_quality").alias("p_low_quality"), F.col("__p_toxic").alias("p_toxic"), flagged.alias("toxic"))


@query("op5_language")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = language.fit(docs.where(~held_out))
    found = language.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_exact_dedup", """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, folder)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op8_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op9_pii")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(documents(spark, folder), whole=True)


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, file_start of every document: texts are written to flat token files, which are then scanned."""
    path = token_counts.write_token_files(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = token_counts.count_tokens(spark, path, head=token_counts.ID_DIGITS)
    digits = [F.element_at("head", i + 1).cast("long") for i in range(token_counts.ID_DIGITS)]
    number = digits[0]
    for i, digit in enumerate(digits[1:], 1):
        number = number.bitwiseOR(F.shiftleft(digit, 15 * i))
    return found.select(number.alias("doc_id"), (F.col("n_ids") - token_counts.ID_DIGITS).alias("n_tokens"), F.col("start").alias("file_start"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return runs.report(documents(spark, folder), change=runs.with_planted_tail)


@query("op12_merkle", manifest_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest_of_documents(documents(spark, folder))


@query("op13_html")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(spark.read.parquet(f"{folder}/pages.parquet"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
