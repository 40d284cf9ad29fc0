"""One-row tables as columns of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table through a scalar subquery: no join, no cross product."""
    row = one.select(F.struct("*").alias("_one")).scalar()
    return df.withColumns({c: row[c] for c in one.columns})
