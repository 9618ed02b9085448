"""Batches that survive a broken region: the good ones get their results, the broken one an error row.

Faults that can be named beforehand are looked for in the rows. What fails nevertheless, in Python or in the JVM, fails the
whole batch of Spark's; the batch is then halved by a hash of its keys until the failing key stands alone, so one broken
region among n costs twice log2(n) further runs and none when all is well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERRORS = "key string, error string"
DEPTH = 64  # bits of the hash that halves a batch


def named_faults(crops: DataFrame, keys: list[str]) -> DataFrame:
    """Faults of crop rows (keys, shape, image, mask): keys, error; crops without one are left out."""
    fault = """case when shape is null or image is null or mask is null then 'missing array'
        when size(shape) <> 3 or exists(shape, s -> s is null or s < 1) then 'shape is not three positive sizes'
        when size(image) <> aggregate(shape, 1L, (a, s) -> a * s) then 'image does not fill its shape'
        when size(mask) <> size(image) then 'mask does not fill its shape'
        when exists(zip_with(image, mask, (v, m) -> m > 0 and (v is null or isnan(v) or abs(v) = double('infinity'))), b -> b) then 'region holds a value that is no number'
        when not exists(mask, m -> m > 0) then 'empty mask' end"""
    return crops.selectExpr(*keys, f"{fault} as error").where("error is not null")


def _first_line(error: Exception) -> str:
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    named = [line for line in lines if "Error" in line or "Exception" in line]
    return (named[-1] if named else lines[0] if lines else type(error).__name__)[:500]


def attempt(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], None]) -> DataFrame:
    """Run ``work`` over all rows; returns the keys it cannot do: keys as text joined by a colon, error.

    ``work`` has to write what it makes, and to write nothing where it fails (Spark's committers see to that). It is called
    with all rows, after a failure with the two halves of what failed.
    """
    spark = rows.sparkSession
    name = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    bits = F.xxhash64(name)
    failed: list[tuple[str, str]] = []
    waiting = [(0, 0)]  # the lowest bits of the hash, and how many of them count
    while waiting:
        value, depth = waiting.pop()
        part = rows.where(bits.bitwiseAND(F.lit((1 << depth) - 1)) == value) if depth else rows
        try:
            work(part)
        except PySparkException as error:
            names = [r[0] for r in part.select(name.alias("key")).distinct().limit(2).collect()]
            if not names:
                raise
            if len(names) == 1 or depth == DEPTH - 1:
                failed += [(n, _first_line(error)) for n in names]
            else:
                waiting += [(value, depth + 1), (value | 1 << depth, depth + 1)]
    return spark.createDataFrame(failed, ERRORS)
