"""Text helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[ \t-\r]+"
"""What stands between words: U+0020 and U+0009 to U+000D, as ``bytes.split()`` has it."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_az(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text that is not null."""
    return F.array_remove(F.split(text, SPACES), "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def held_out(doc_id: str | Column, folds: int) -> Column:
    """Whether a document is in fold 0 of ``folds`` by the CRC-32 of its id (a null id: no)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % folds == 0, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df``, whatever their names hold, but those ``without``."""
    quoted = [c.replace("`", "``") for c in df.columns if c not in without]
    return [F.col(f"`{c}`") for c in quoted]


def blocks_of_text(df: DataFrame, name: str = "text") -> DataFrame:
    """``df`` with a text column as UTF-8 bytes, which Python reads without decoding."""
    return df.withColumn(name, text_of(name).cast("binary"))
