"""Corpus preparation: toxic documents go, copies go, near copies go, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import exact_dedup, packing, secrets, simhash, similar, toxicity
from voxelframe.llm.common import documents, select_rows
from voxelframe.llm.queries import toxicity_chain
from voxelframe.session import new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold, or unknown for want of labels."""
    scored = toxicity_chain(spark, sf_dir, docs).score(docs)
    kept = scored.where(F.coalesce(F.col("__p_toxic") < toxicity.THRESHOLD, F.lit(True)))
    return kept.select(*[F.col(f"`{n}`") for n in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat even that id, one."""
    kept = exact_dedup.duplicates(docs).where("kept")
    # Texts of one id that are equal but for their case are one group: a single spelling stays.
    one = kept.groupBy("doc_id", "text_sha256").agg(F.min(F.struct("text_key", "copies")).alias("row"))
    return select_rows(docs, one.select("doc_id", "row.text_key", "row.copies"))


def _first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component (columns doc_id, text_key, root, component_id) the row with the smallest doc_id; of several with
    that id, one."""
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counted = found.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    one = counted.groupBy("root", "doc_id").agg(F.min(F.struct("text_key", "copies")).alias("row"))
    return select_rows(docs, one.select("doc_id", "row.text_key", "row.copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of operator 1, with the parameters of its query. Not a stage of the pipeline."""
    return _first_of_each(docs, simhash.groups(docs))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose shingles of five words have a similarity of at least 0.8.

    Operator 1's ball hashing over the fingerprints of the shingles comes first; MinHash bands find what it leaves apart.
    """
    return _first_of_each(docs, similar.groups(docs, radius=simhash.RADIUS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows the text."""
    masked = secrets.redact(secrets.scan(docs, by_window=True)).select(*[F.col(f"`{n}`") for n in docs.columns])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return masked


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length: their token ids, and the ids' checksum."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_similar),
    ("secret scan", mask_secrets),
    ("packing", pack_documents),
]

#: A fitted classifier decides the first stage, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; tables between them lie in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
