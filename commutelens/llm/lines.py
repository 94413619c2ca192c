"""Line dedup by distinct-site spread.

A line is boilerplate if it stands on ``min_sites`` different sites or more.  Sites are
counted by a HyperLogLog sketch for each line hash; sketches of tasks merge by aggregation.
Only for lines whose estimate is so near the threshold that its error could decide are the
sites counted exactly.  Of each boilerplate line the first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.llm.common import columns_of, fresh, text_of
from commutelens.session import cut

MIN_SITES = 10
LG_K = 9
"""Sketches of 2^9 registers: a standard error of 4.6 %, and a few bytes while a line has few sites."""
BAND = 0.25
"""Estimates within this share of the threshold (over five standard errors) are counted exactly."""

BLANKS = " \t\r\x0b\f"


def line_key(line: Column) -> Column:
    """What makes lines equal: the line without blanks at its ends, as a 64-bit hash."""
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """One row for each line with a visible character: ``doc_id, _text, site, at, line``.

    ``_text`` hashes the text, so that documents that share an id stay apart.
    """
    parts = docs.select(
        "doc_id",
        F.xxhash64("text").alias("_text"),
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("site"),
        F.posexplode(F.split(text_of("text"), "\n")).alias("at", "_line"),
    )
    return parts.where(F.btrim(F.col("_line"), F.lit(BLANKS)) != "").select(
        "doc_id", "_text", "site", "at", line_key(F.col("_line")).alias("line")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """``line, first_doc, first_text, first_at`` of the lines on ``min_sites`` sites or more."""
    sketched = lines.groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("_sketch"),
        F.count("*").alias("_lines"),
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_text", "at")).alias("_first"),
    )
    # fewer occurrences than min_sites can't be on min_sites sites
    spread = cut(
        sketched.where(F.col("_lines") >= min_sites)
        .withColumn("_sites", F.hll_sketch_estimate("_sketch"))
        .where(F.col("_sites") >= F.lit(min_sites * (1 - band)))
        .drop("_sketch"),
        "lines-spread",
    )
    sure = F.col("_sites") > F.lit(min_sites * (1 + band))
    exact = (
        lines.join(spread.where(~sure).select("line"), "line", "left_semi")
        .groupBy("line", "site")
        .agg(F.lit(1).alias("_one"))
        .groupBy("line")
        .agg(F.count("*").alias("_exact"))
        .where(F.col("_exact") >= min_sites)
        .select("line")
    )
    found = spread.where(sure).unionByName(spread.join(exact, "line", "left_semi"))
    return found.select(
        "line",
        F.col("_first.doc_id").alias("first_doc"),
        F.col("_first._text").alias("first_text"),
        F.col("_first.at").alias("first_at"),
    )


def dedup(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    site: str = "source",
    lines_in: str = "n_lines",
    removed: str = "n_removed",
) -> DataFrame:
    """``docs`` without boilerplate lines, and ``n_lines``, ``n_removed`` by the names given.

    ``text`` holds the lines that stay; ``n_lines`` counts lines with a visible character.
    A null text stays null and has no lines; a null site is a site of its own; blank lines
    always stay.  Rows that repeat an id and a text keep the same lines.  Columns of
    ``docs`` that have the names of the two counts are replaced.
    """
    own, side = fresh(docs, "_own"), fresh(docs, "_gone")
    lines = lines_of(docs, site)
    found = cut(boilerplate(lines, min_sites), "lines-boilerplate")
    is_first = (
        F.col("doc_id").eqNullSafe(F.col("first_doc"))
        & (F.col("_text") == F.col("first_text"))
        & (F.col("at") == F.col("first_at"))
    )
    gone = (
        lines.select("doc_id", "_text", "at", "line")
        .join(found, "line")
        .where(~is_first)
        .groupBy("doc_id", "_text")
        .agg(F.collect_set("at").alias("at"))
        .select(F.struct("doc_id", "_text", "at").alias(side))
    )
    base = docs.drop(lines_in, removed).withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{side}.doc_id")) & (F.col(own) == F.col(f"{side}._text"))
    joined = base.join(gone, same, "left")
    every, gone_at = F.split("text", "\n"), F.col(f"{side}.at")
    visible = F.filter(F.split(text_of("text"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    stay = F.filter(every, lambda x, i: ~F.array_contains(gone_at, i))
    return joined.select(
        *columns_of(base, own, "text"),
        F.when(gone_at.isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
        F.size(visible).cast("long").alias(lines_in),
        F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias(removed),
    )
