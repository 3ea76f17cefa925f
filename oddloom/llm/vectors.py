"""What the operators on embeddings share: which vectors take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def usable(column: str) -> Column:
    """Whether a vector is there, has no null or non-finite component, and is not all zero."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    fine = F.col(column).isNotNull() & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def doubles(df: DataFrame, column: str) -> Column:
    return F.col(column).cast("array<double>").alias(column)
