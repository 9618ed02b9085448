"""Registry of queries and their independent SQL, plus SQL fragments that mirror the table bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Voxel table: embeddings as 4x4x4 volumes.
VOX = """vox AS (
  SELECT vec_id AS case_id, CAST(p // 16 AS INTEGER) AS z, CAST((p // 4) % 4 AS INTEGER) AS y, CAST(p % 4 AS INTEGER) AS x,
         CAST(v AS DOUBLE) AS intensity,
         CASE WHEN CAST(v AS DOUBLE) > 0.1 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END AS label_id
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""
REG = VOX + ", reg AS (SELECT * FROM vox WHERE label_id > 0)"
# Region voxels with fixed-width levels (width 0.05).
LEV = REG + """, ends AS (
  SELECT case_id, label_id, min(floor(intensity / 0.05::DOUBLE)) AS lo, max(floor(intensity / 0.05::DOUBLE)) AS hi
  FROM reg GROUP BY ALL),
lev AS (SELECT reg.*, CAST(floor(intensity / 0.05::DOUBLE) - lo + 1 AS INTEGER) AS level, CAST(hi - lo + 1 AS INTEGER) AS n_levels
  FROM reg JOIN ends USING (case_id, label_id))"""
# Offsets: the 26 neighbours, half of them, and with the voxel itself.
OFF = """ax AS (SELECT unnest([-1, 0, 1]) AS d),
cube AS (SELECT a.d AS dz, b.d AS dy, c.d AS dx FROM ax a, ax b, ax c),
near26 AS (SELECT * FROM cube WHERE NOT (dz = 0 AND dy = 0 AND dx = 0)),
half13 AS (SELECT * FROM cube WHERE dz > 0 OR (dz = 0 AND dy > 0) OR (dz = 0 AND dy = 0 AND dx > 0))"""
# Long features with missing cells.
MAT = """mat AS (
  SELECT vec_id AS sample_id, label, printf('f%02d', p) AS feature,
         CASE WHEN (vec_id + p) % 17 <> 0 THEN CAST(v AS DOUBLE) END AS value
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""
RTAB = """rtab AS (
  SELECT l_orderkey AS case_id, l_linenumber AS label_id, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price,
         max(l_discount) AS discount, max(l_tax) AS tax,
         max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS flag
  FROM lineitem GROUP BY ALL)"""
RFEAT = RTAB + """, rfeat AS (
  SELECT case_id, label_id, 'discount' AS feature, discount AS value FROM rtab UNION ALL
  SELECT case_id, label_id, 'price', price FROM rtab UNION ALL
  SELECT case_id, label_id, 'quantity', quantity FROM rtab UNION ALL
  SELECT case_id, label_id, 'tax', tax FROM rtab)"""
RTARGET = RTAB + """, rtarget AS (
  SELECT case_id, label_id, CASE WHEN case_id % 7 = 0 AND label_id = 1 THEN NULL ELSE CAST(flag AS DOUBLE) END AS value FROM rtab)"""
CASES = """cases AS (
  SELECT o_orderkey AS case_id,
         CASE WHEN o_orderkey % 11 <> 0 THEN CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END AS source_level,
         o_totalprice AS age FROM orders)"""
SCORED = """scored AS (
  SELECT doc_id AS sample_id, CAST(quality AS INTEGER) AS y_true,
         CAST(n_chars / (n_chars + 1000.0::DOUBLE) >= 0.5 AS INTEGER) AS y_pred, n_chars / (n_chars + 1000.0::DOUBLE) AS proba
  FROM labels JOIN documents USING (doc_id))"""
EPOCHS = """epochs AS (
  SELECT user_id AS fold, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS val_loss,
         event_type AS metric FROM events)"""


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with the SQL that must give the same rows."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def nudge(digits: int) -> float:
    """A shift far below the rounding step: exact ties (0.5490625) otherwise round by the last bit of the sum."""
    return 10.0 ** -(digits + 3)


def near(expression: str, digits: int = 6) -> str:
    """SQL: rounded, with negative zero turned into zero."""
    moved = f"round(CAST({expression} AS DOUBLE) + CAST({nudge(digits)!r} AS DOUBLE), {digits})"
    return f"(CASE WHEN {moved} = 0 THEN CAST(0 AS DOUBLE) ELSE {moved} END)"


def near_all(keys: list[str], names: list[str], digits: int = 6) -> str:
    """SQL select list: the keys, and every named column rounded."""
    return ", ".join([*keys, *[f'{near(chr(34) + n + chr(34), digits)} AS "{n}"' for n in names]])


def near_col(column, digits: int = 6):
    """Column: the same rounding as ``near``."""
    return F.round(column.cast("double") + F.lit(nudge(digits)), digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[near_col(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )
