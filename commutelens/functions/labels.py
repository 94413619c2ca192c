"""Codes, labels and number formats used in result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scenario codes, their labels and display order.
SCENARIOS = {
    "baseline": "Baseline",
    "donothing": "Do nothing",
    "optimal": "Optimal",
    "pasfor": "Pasfor",
}
BASELINE = "baseline"

# States of a zone against the baseline.
CRITICAL = "critical"
NOT_CRITICAL = "not critical"
NEW_CRITICAL = "new critical"
NEW_NOT_CRITICAL = "new not critical"

# Status of a route in the official plan, and of trip cuts.
ELIMINATED = "Eliminada"
CUT = "Seccionada"
NEW = "Nova"
KEPT = "Mantida"
REDUCED = "Reduzida"


def choose(key: Column, values: dict) -> Column:
    """Look ``key`` up in a short literal dictionary; NULL when absent."""
    out = F.lit(None)
    for code, value in reversed(list(values.items())):
        out = F.when(key == F.lit(code), F.lit(value)).otherwise(out)
    return out


def scenario_label(code: Column) -> Column:
    return F.coalesce(choose(code, SCENARIOS), code)


def scenario_rank(code: Column) -> Column:
    ranks = {name: position for position, name in enumerate(SCENARIOS, start=1)}
    return choose(code, ranks).cast("long")


def thousands(number: Column, mark: str = ".") -> Column:
    """``1234567`` -> ``1.234.567``."""
    return F.translate(F.format_number(number, 0), ",", mark)


def percent(share: Column, digits: int = 1) -> Column:
    """``12.3`` -> ``12.3%``."""
    return F.concat(F.round(share, digits).cast("string"), F.lit("%"))
