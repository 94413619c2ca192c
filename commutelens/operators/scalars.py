"""One-row tables used as scalars.

``table.scalar()`` is Spark's uncorrelated scalar subquery: it runs once, its
value is folded into the outer plan as a literal, and no join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(table: DataFrame | float | int, column: str | None = None) -> Column:
    """A one-row, one-column table (or a plain number) as a column."""
    if not isinstance(table, DataFrame):
        return F.lit(table)
    return table.select(column or table.columns[0]).scalar()


def record(table: DataFrame) -> Column:
    """A one-row table as one struct column: several scalars from one subquery."""
    return table.select(F.struct(*table.columns)).scalar()


def total(df: DataFrame, column: str | Column, name: str) -> DataFrame:
    return df.agg(F.sum(column).alias(name))
