"""Token counts of documents in flat token files, by a separator scan.

A token file is a plain run of little-endian 16-bit ids in which every document ends with the end-of-document id. Files
have no index. They are cut into blocks; a task searches a block for the separator in one vector comparison and keeps,
per block, the documents that lie wholly inside and the open pieces at both ends. A prefix scan over the blocks of a file
then adds up the open pieces: a document that crosses borders is the last piece of one block, whole blocks without a
separator, and the first piece of another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelframe.llm.common import small_batches
from voxelframe.session import cut_lineage, new_folder

SEPARATOR = 50256
BLOCK_BYTES = 1 << 18
ID_DIGITS = 5  # base 32768: 75 bits hold any 64-bit id

_FOUND = "file string, block long, slot int, start long, n_ids long, head array<int>, opens boolean, closes boolean"


def write_token_files(docs: DataFrame, ranks: str, pattern: str, separator: int = SEPARATOR) -> str:
    """Encode the texts and write flat token files to a new folder below the shared one; its path is returned.

    ``ranks`` is a vocabulary file of byte-level BPE ranks with fewer than 2**16 ids, of which ``separator`` is not one. A
    document starts with its doc_id as five digits to the base 32768, which are never the separator. A null text counts as
    empty, a null doc_id as -1. The files are written by Spark's text writer: the line separator is the separator id.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def work(batches):
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            made = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode_ordinary(text.as_py() or "")
                number = doc_id % (1 << 64)
                digits = [number >> 15 * i & 0x7FFF for i in range(ID_DIGITS)]
                made.append(np.array(digits + ids, dtype="<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("doc_id"), "text")
    lines = rows.mapInArrow(work, "value binary").select(F.col("value").cast("string").alias("value"))
    path = new_folder(spark, "tokens")
    mark = separator.to_bytes(2, "little").decode("latin-1")
    lines.write.option("lineSep", mark).option("encoding", "ISO-8859-1").text(path)
    return path


_ENCODERS: dict = {}


def _encoder(ranks: str, pattern: str):
    if ranks not in _ENCODERS:
        import base64

        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODERS[ranks] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[ranks]


def scan_block(data: bytes, separator: int, head: int) -> list[tuple[int, int, list[int], bool, bool]]:
    """Pieces of a block between separators: (start, n_ids, first ids, open at the left, closed at the right)."""
    ids = np.frombuffer(data, dtype="<u2")
    ends = np.flatnonzero(ids == separator)
    starts = np.concatenate([[0], ends + 1])
    stops = np.concatenate([ends, [len(ids)]])
    pieces = []
    for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        closes = i < len(ends)
        if closes or b > a:
            pieces.append((a, b - a, ids[a : min(b, a + head)].tolist(), i == 0, closes))
    return pieces


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES, head: int = 0) -> DataFrame:
    """file, start, n_ids, head for every document of the token files below ``path``.

    ``start`` is the position of the document's first id in its file, ``n_ids`` its length without the separator, ``head``
    its first ids. An empty document (two separators in a row) has length 0; ids after the last separator are a document
    too; an empty file gives no rows. A file of odd length is an error. Files are read whole by one task each (Spark's
    binary source, up to 2 GiB); blocks are what Python sees.
    """
    if block_bytes % 2 or block_bytes < 2:
        raise ValueError("a block must hold whole ids")
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    odd = F.when(F.col("length") % 2 == 1, F.raise_error(F.concat(F.lit("odd length: "), F.col("path")))).otherwise(F.lit(0))
    count = F.ceil(F.col("length") / F.lit(block_bytes))
    files = files.select("path", "content", (count + odd).alias("blocks"))
    blocks = files.select("path", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    piece = F.expr(f"substring(content, cast(block * {block_bytes} + 1 as int), {block_bytes})")
    blocks = blocks.select(F.col("path").alias("file"), "block", piece.alias("data"))

    def work(batches):
        for batch in batches:
            out: list[tuple] = []
            for file, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                base = block * block_bytes // 2
                for slot, (start, n, first, opens, closes) in enumerate(scan_block(data.as_py(), separator, head)):
                    out.append((file, block, slot, base + start, n, first, opens, closes))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_(), pa.bool_()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

    # Documents between two separators of a block are whole. The others are pieces at the ends of blocks, at most two a
    # block; a prefix scan over these numbers the documents of a file, and pieces of one number are one document.
    pieces = cut_lineage(blocks.mapInArrow(work, _FOUND))
    whole = pieces.where("closes and not opens").select("file", "start", "n_ids", "head")
    before = Window.partitionBy("file").orderBy("block", "slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.where("opens or not closes").withColumn("number", F.coalesce(F.sum(F.col("closes").cast("long")).over(before), F.lit(0)))
    heads = F.transform(F.array_sort(F.collect_list(F.struct("start", "head"))), lambda p: p["head"])
    stitched = ends.groupBy("file", "number").agg(
        F.min("start").alias("start"), F.sum("n_ids").alias("n_ids"), F.slice(F.flatten(heads), 1, max(head, 1)).alias("head")
    )
    return whole.unionByName(stitched.select("file", "start", "n_ids", "head"))
