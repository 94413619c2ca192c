"""Feed clock times as seconds after midnight; hours may pass 24."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_seconds(text: str) -> int:
    """``'06:30:00'`` -> 23400."""
    hours, minutes, seconds = (int(part) for part in text.split(":"))
    return hours * 3600 + minutes * 60 + seconds


def seconds_of(text: Column) -> Column:
    """The same for a column of text; NULL for a blank or broken clock time."""
    parts = F.split(text, ":")

    def part(n: int) -> Column:
        return F.get(parts, F.lit(n)).try_cast("long")

    return part(0) * 3600 + part(1) * 60 + part(2)


def departure_timestamp(text: Column) -> Column:
    """``'13/12/2021 06:30:00'`` -> timestamp."""
    return F.to_timestamp(text, "dd/MM/yyyy HH:mm:ss")


def hour_of(seconds: Column) -> Column:
    return F.floor(seconds / 3600).cast("long")


def clock_text(seconds: Column) -> Column:
    """87000 -> ``'24:10:00'``."""
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(seconds / 3600),
        F.floor(seconds % 3600 / 60),
        seconds % 60,
    )
