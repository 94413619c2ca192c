"""Filter interaction audit: what each of five filters removes, in every order of them.

Four filters look at a text alone; the fifth fails a text that a smaller ``doc_id`` has, too.
That one is an existential self-join: a left-semi join on hash, exact text and smaller id, of
which only texts whose hash occurs under two ids take part.  Its ids are put together with
those of the other failures, and a document's failures become one number of five bits.  Whatever
the order of the filters, all counts follow from how many documents have which number.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.llm.common import UPPER, bind, text_of, words
from commutelens.session import cut

FILTERS = "ABCDE"
MIN_WORDS = 200
SYMBOLS = r"[#$%&*|]"
_COPY = 1 << FILTERS.index("E")


def alone(text: Column) -> Column:
    """The failures among A to D of a text that is not null, as bits."""

    def bits(w):
        n, distinct = F.size(w), F.size(F.array_distinct(w))
        return F.when(n < MIN_WORDS, 1).otherwise(0) + F.when(100 * distinct < 50 * n, 2).otherwise(0)

    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return (
        bind(words(text), bits)
        + F.when(100 * upper.cast("long") > 3 * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike(SYMBOLS), 8).otherwise(0)
    )


def copies(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``doc_id, part, h`` of the documents whose text a smaller ``doc_id`` has.

    ``docs`` have ``doc_id, part, h, text``; ``marked`` is the same without the text.  The side
    that is searched has one row for each text, so the copies of a text are never paired.
    """
    # both small sides are stored: a join of two plain shuffles can be split where a text is frequent
    ids = marked.groupBy("h").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"))
    again = cut(ids.where("_least < _most").select("h"), "audit-again")
    # texts are dealt out by hash at every size; a broadcast would only fit small inputs
    several = docs.join(again.hint("merge"), "h", "left_semi")
    several = cut(several.select("doc_id", "part", "h", "text"), "audit-several")
    first = cut(several.groupBy("h", "text").agg(F.min("doc_id").alias("_least")), "audit-first")
    later, first = several.alias("l"), first.alias("r")
    same = (F.col("l.h") == F.col("r.h")) & (F.col("l.text") == F.col("r.text"))
    return later.join(first, same & (F.col("l.doc_id") > F.col("r._least")), "left_semi").select("doc_id", "part", "h")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, bits, n, good, toxic``: how many documents of a part fail which filters."""
    text = text_of("text")
    rows = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("h"), text.alias("text")
    )
    marked = cut(rows.select("doc_id", "part", "h", alone(F.col("text")).alias("bits")), "audit-marked")
    failed = marked.select("*", F.lit(1).cast("long").alias("n")).unionByName(
        copies(rows, marked).distinct().select("*", F.lit(_COPY).alias("bits"), F.lit(0).cast("long").alias("n"))
    )
    each = failed.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    judged = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"),
    )
    return (
        each.join(judged, "doc_id", "left")
        .groupBy("part", "bits")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(FILTERS), letter) - 1)


def _total(cells: str, of, where) -> Column:
    return F.aggregate(
        cells, F.lit(0).cast("long"), lambda total, c: total + F.when(where(c), of(c)).otherwise(F.lit(0)).cast("long")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step.

    ``docs`` have ``doc_id, text, lang``; other columns are ignored.  A part is a value of ``lang``,
    null counts as the empty string, and so does a null text.  Repeated rows count as often as
    they occur; rows of one ``doc_id`` are not copies of each other, and a null ``doc_id`` is
    neither smaller nor larger than any.  A document is good (toxic) if one of its rows in
    ``labels`` says so; labels of a null id are of no document.  An empty table has no parts.
    """
    factorial = 120  # orders of five filters; in 1 of k orders a filter comes first of k
    cells = (
        combinations(docs, labels)
        .groupBy("part")
        .agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))  # at most 32
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    steps = (
        cells.select("part", "cells", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
        .withColumn("_own", _bit(letter))
        .withColumn(
            "_before",
            F.aggregate(
                F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1),
                F.lit(0),
                lambda bits, x: bits + _bit(x),
            ),
        )
    )

    def hit(c, mask):
        return c["bits"].bitwiseAND(F.col(mask)) != 0

    def gone_here(c):
        return hit(c, "_own") & ~hit(c, "_before")

    return steps.select(
        "part",
        "filter_order",
        "step",
        _total("cells", lambda c: c["n"], lambda c: ~hit(c, "_own") & ~hit(c, "_before")).alias("kept"),
        _total("cells", lambda c: c["n"], gone_here).alias("removed"),
        _total("cells", lambda c: c["n"], lambda c: hit(c, "_own") & hit(c, "_before")).alias("redundant"),
        _total("cells", lambda c: c["n"], lambda c: c["bits"] == F.col("_own")).alias("unique_fails"),
        _total("cells", lambda c: c["good"], gone_here).alias("good_lost"),
        _total("cells", lambda c: c["toxic"], gone_here).alias("toxic_lost"),
        _total(
            "cells", lambda c: c["n"] * F.floor(F.lit(factorial) / F.bit_count(c["bits"])), lambda c: hit(c, "_own")
        ).alias("shapley"),
    )
