"""Helpers several operators share: table access, row selection, ASCII lower case, match positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes handed to a Python worker at once. Texts may be long, so batches are bounded by size and not only by rows.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound the bytes of an Arrow batch for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of single-byte characters take the built-in lower(), which does the same there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_key(text: Column) -> Column:
    """64-bit hash of a text; a null text has another key than an empty one."""
    return F.when(text.isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(text))


def select_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text_key(text)) is in ``kept`` (columns doc_id, text_key, copies).

    All columns of ``docs`` are returned. ``copies`` counts the rows of ``docs`` with that id and text; where it is over
    one, a single row of them stays (the smallest by the other columns).
    """
    names = docs.columns
    rows = docs.withColumn("__key", text_key(F.col("text")))
    keys = kept.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key"), F.col("copies").alias("__copies"))
    joined = rows.join(keys, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text_key")))
    if kept.where("copies > 1").isEmpty():
        return joined.select(*[F.col(f"`{n}`") for n in names])
    single = joined.where("__copies = 1").select(*[F.col(f"`{n}`") for n in names])
    rest = [F.col(f"`{n}`") for n in names]
    folded = joined.where("__copies > 1").groupBy("doc_id", "__key").agg(F.min(F.struct(*rest)).alias("__row"))
    return single.unionByName(folded.select(*[F.col("__row").getField(n).alias(n) for n in names]))


def find_spans(text: Column, found: Column, pattern: str | Column, passes, kind: str, order: int) -> Column:
    """Spans of the matches that pass, as array<struct<start, place, end, kind>>; positions are code points, end exclusive.

    ``found`` must be ``regexp_extract_all(text, pattern, 0)``: the matches and the pieces between them alternate, so their
    lengths add up to the positions. ``passes`` maps a match (column) to a condition.
    """
    empty = F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    steps = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))

    def step(state, x):
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("place"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(passes(x["m"]), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(steps, start, step)["out"]).otherwise(empty)


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replace_spans(text: Column, spans: Column, mark) -> Column:
    """The text with every span (in order of start) replaced by ``mark(span)``; spans that overlap become one mark.

    ``spans`` has start and end in code points, end exclusive. Without spans the text stays as it is.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], gap, mark(s))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(state):
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
