"""Use of one-row tables as values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Column:
    """The only row of a table as a struct value (a scalar subquery; more than one row is an error)."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()
