"""Mixing sources to target weights by systematic sampling.

A source that shall give ``target`` of its ``source_size`` words takes each of its
documents ``target / source_size`` times on average.  Documents are put in order of
size; the expected copies are summed up along that order, one offset for the source is
added, and a document is emitted once for each whole number that the sum passes.
Neighbours in the order have about the same size, so what one misses the next one gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commutelens.llm.common import SPACES, columns_of, fresh, text_of
from commutelens.operators.running import running_total
from commutelens.session import cut

WEIGHTS = (1, 2, 3)
MOST = 3


def word_count(text: str) -> Column:
    """Number of words; null and empty texts have none."""
    spread = F.trim(F.regexp_replace(text_of(text), SPACES, " "))
    return F.when(spread == "", 0).otherwise(
        F.length(spread) - F.length(F.translate(spread, " ", "")) + 1
    ).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to a table of ``source, source_size`` with one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes.  None gets more than ``most`` times its size; what is over is shared again by
    weight among the others.  The end of that sharing is found at once: with the
    sources in order of limit to weight, those before the first that stays below its
    limit are full, and the rest share what is left.  The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1
    )
    ranked = sources.withColumn("_weight", weight.cast("long")).withColumn(
        "_limit", F.lit(most).cast("long") * F.col("source_size")
    )
    by_room = Window.orderBy(
        F.col("_limit").cast("double") / F.col("_weight"), F.col("source").asc_nulls_last()
    )
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    ).cast("double") / F.sum("_weight").over(onwards)
    leveled = ranked.select("*", level.alias("_level"), F.row_number().over(by_room).alias("_at"))
    full = F.col("_limit").cast("double") / F.col("_weight") < F.col("_level")
    shared = F.min(F.when(~full, F.struct("_at", "_level"))).over(every)["_level"]
    return leveled.select(
        "source",
        "source_size",
        F.least(F.col("_limit").cast("double"), shared * F.col("_weight")).alias("target"),
    )


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def offset(key: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1), the same in each run."""
    digest = F.md5(F.concat(key, F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: int = 0,
) -> DataFrame:
    """How often the mix takes each document.

    ``docs`` has ``doc_id, source, size`` (other columns are ignored).  One row for each
    row of it: ``doc_id, source, size, source_size, target, copies``.  A null size counts as
    0; a null source is a source of its own.  Rows that agree in id, source and size share
    one decision.  An empty table gives an empty one.  Ranks are made over ranges of the order, so
    that a source with most of the rows is spread over all tasks.
    """
    folded = cut(
        docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("_times")),
        "mix-sizes",
    )
    sources = cut(
        targets(
            folded.groupBy("source").agg(F.sum(F.col("size") * F.col("_times")).alias("source_size")),
            weights,
            most,
        ).withColumn("_source", _source_key(F.col("source"))),
        "mix-targets",
    )
    keyed = folded.select(
        "*",
        _source_key(F.col("source")).alias("_source"),
        F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("_shuffled"),
        F.lit(1).cast("long").alias("_one"),
    )
    ranked = running_total(keyed, ["_source"], ["size", "_shuffled"], {"_rank": "_one"})
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = F.floor(offset(F.col("_source"), seed) + rate * F.col("_rank"))
    before = F.floor(offset(F.col("_source"), seed) + rate * (F.col("_rank") - 1))
    return ranked.join(sources.drop("source"), "_source").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.least(upto - before, F.lit(most)).cast("long").alias("copies"),
        F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_row"),
    ).drop("_row")


def emit(docs: DataFrame, plan: DataFrame, size: Column) -> DataFrame:
    """The rows of ``docs`` as often as ``plan`` (of :func:`mix`) says, numbered by ``copy``.

    ``size`` is the expression the plan's sizes were made with.  A column of ``docs``
    called ``copy`` is replaced.
    """
    words, side = fresh(docs, "_words"), fresh(docs, "_plan")
    a = docs.drop("copy").withColumn(words, size)
    b = (
        plan.where("copies > 0")
        .dropDuplicates(["doc_id", "source", "size"])
        .select(F.struct("doc_id", "source", "size", "copies").alias(side))
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col(f"{side}.doc_id"))
        & F.col("source").eqNullSafe(F.col(f"{side}.source"))
        & (F.col(words) == F.col(f"{side}.size"))
    )
    return a.join(b, same).select(
        *columns_of(a, words),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{side}.copies"))).alias("copy"),
    )
