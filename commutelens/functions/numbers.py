"""Division as floating point defines it, whatever the session's ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; over zero it is infinite, and 0 / 0 is not a number."""
    over, under = a.cast("double"), b.cast("double")
    return (
        F.when(under != 0, F.try_divide(over, under))
        .when(over > 0, F.lit(float("inf")))
        .when(over < 0, F.lit(float("-inf")))
        .when(over == 0, F.lit(float("nan")))
    )
