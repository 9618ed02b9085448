"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits have a common variant half way: the one with an even number of set bits flips at most one
bit, the other at most two. So a fingerprint emits all variants within half the radius, variants are shuffled, and
fingerprints that meet at a variant are linked. Of three differing bits two lie in the same half of the fingerprint, so
double flips need only be made within a half: 65 or 1,057 variants a fingerprint.

All fingerprints that meet at a variant are within the radius of one of them (the centre), so a star of links, one per
member, keeps them connected: no pairs of a group are ever listed, and a variant has at most 1,057 members, whatever the
number of documents. Before that, fingerprints are deduplicated (copies of a document are one fingerprint), and those
with no near fingerprint in either half are put aside by the same method at the smaller size: two fingerprints within 3
bits agree in one half up to one bit, which is half the radius rounded down, so halves with an even number of bits emit
themselves and the others also their 32 single flips.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelframe.llm.common import small_batches, text_key
from voxelframe.operators.components import components
from voxelframe.session import cut_lineage

WIDTH = 3
SEED = 42
RADIUS = 3
CHUNK = 1 << 15
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, total: int) -> int:
    return int(np.bitwise_or.reduce(_WEIGHTS[2 * ones > total], initial=np.uint64(0)).view(np.int64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit fingerprint (signed) of shingle hashes: bit i is set if it is set in over half of them; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += _ones(hashes[at : at + CHUNK])
    return _majority(ones, len(hashes))


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64-bit fingerprint (signed) of a UTF-8 text: bit i is set if it is set in over half the shingle hashes."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    ones, total = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, total, CHUNK):
        part = words[at : at + min(CHUNK, total - at) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += _ones(hashes)
    return _majority(ones, total)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, fp of every row; a text without words (null, empty, white space) has fingerprint 0."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def work(batches):
        for batch in batches:
            made = [fingerprint(t.as_py() or b"", width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, text_key long, fp long")


def _flips(first: int, size: int) -> list[int]:
    return [1 << (first + i) if first + i < 63 else -(1 << 63) for i in range(size)]


def _double_flips(first: int, size: int) -> list[int]:
    single = _flips(first, size)
    return [single[i] ^ single[j] for i in range(size) for j in range(i)]


def _odd(bits: Column) -> Column:
    return F.bit_count(bits) % 2 == 1


def _array(masks: list[int]) -> Column:
    return F.lit(masks).cast("array<long>")


def _near_in_a_half(fps: DataFrame) -> DataFrame:
    """Fingerprints (column fp) with another one at most one bit away in the lower or in the upper half."""
    parts = []
    for place in (0, 1):
        half = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32 * place)).bitwiseAND(F.lit((1 << 32) - 1))
        masks = F.when(_odd(half), _array([0, *_flips(0, 32)])).otherwise(_array([0]))
        parts.append(fps.select("fp", half.alias("half"), F.explode(masks).alias("mask")).select("fp", (F.col("half").bitwiseXOR(F.col("mask")) + F.lit(place << 32)).alias("variant")))
    variants = reduce(DataFrame.unionByName, parts)
    met = variants.groupBy("variant").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("variant")
    return variants.join(met, "variant", "left_semi").select("fp").distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) within ``radius`` (at most 3) bits, enough to connect every
    pair within the radius through links that are themselves within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("the radius must be 0 to 3")
    near = cut_lineage(_near_in_a_half(fps))
    even = [0, *(_flips(0, 64) if radius >= 2 else [])]
    odd = [0, *(_flips(0, 64) if radius >= 1 else []), *(_double_flips(0, 32) + _double_flips(32, 32) if radius == 3 else [])]
    masks = F.when(_odd(F.col("fp")), _array(odd)).otherwise(_array(even))
    variants = near.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    # At an even variant all members are at most one bit away. At an odd one, members with an even number of bits are one
    # bit away and the others none or two: an even member is near to all; else the variant itself is. Two odd ones that
    # are two bits apart also meet at an even variant.
    at = Window.partitionBy("variant")
    any_member, even_member = F.min("fp").over(at), F.min(F.when(~_odd(F.col("fp")), F.col("fp"))).over(at)
    itself = F.min(F.when(F.col("fp") == F.col("variant"), F.col("fp"))).over(at)
    centre = F.when(_odd(F.col("variant")), F.coalesce(even_member, itself)).otherwise(F.coalesce(itself, any_member) if radius == 1 else any_member)
    stars = variants.select("fp", centre.alias("centre")).where("centre <> fp")
    pairs = stars.select(F.greatest("fp", "centre").alias("a"), F.least("fp", "centre").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, fp, root (a fingerprint that names the
    component), component_id, n_rows (rows of that fingerprint).

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` bits, itself included; ids that are
    null count as larger than all others, and a component of null ids has a null component_id. Repeated rows are in one
    component. Texts without words share fingerprint 0. An empty table gives no rows; other columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, width))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")))
    roots = components(links(fps.select("fp"), radius), []).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "root", "component_id", "n_rows")
    return rows.join(classes, "fp").select("doc_id", "text_key", "fp", "root", "component_id", "n_rows")
