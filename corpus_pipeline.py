"""From raw documents to a training mix: five stages, each written and read again.

A stage is ``(name, function)``; the function takes ``(spark, docs, sf_dir)`` and returns what
stays of ``docs``, whose columns are those of ``documents``.  The last one adds ``copy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commutelens.llm import decon, lines, mix, rules, simhash
from commutelens.llm.common import columns_of, fresh, table, text_of
from commutelens.session import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects.

    Rules are learned from the labelled ones among ``docs``; without any, the base rule alone holds.
    Null and empty texts have no words and go; rows that repeat a text are judged alike; an empty table
    gives an empty one.  Columns stay as they are.
    """
    held = fresh(docs, "_stats")
    judged = cut(rules.statistics(docs, held), "pipeline-stats")  # with the texts, so that they are counted once
    learned = rules.learn(judged.select("doc_id", F.col(held).alias("_stats")), table(spark, sf_dir, "labels"))
    return judged.where(rules.keeps(learned, held)).select(*columns_of(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; documents that consisted of such lines go.

    ``n_chars`` is counted anew.
    """
    removed = fresh(docs, "_removed")
    out = lines.dedup(docs, lines_in=fresh(docs, "_lines"), removed=removed)
    blank = F.btrim(text_of("text"), F.lit(f"{lines.BLANKS}\n")) == ""
    return (
        out.where((F.col(removed) == 0) | ~blank)
        .withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
        .select(*columns_of(docs))
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link (four-word shingles, four bits): the smallest id."""
    return simhash.one_of_each(docs, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, repeated rows all stay or all go; without items all stay.
    """
    return decon.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered by ``copy``.

    A text without words is taken at its source's rate like any other, unless the whole source has
    none; a null source is one of its own; rows that repeat an id, a source and a size are
    taken alike; an empty table gives an empty one.  A column ``copy`` is replaced.
    """
    sized = docs.select("doc_id", "source", mix.word_count("text").alias("size"))
    return mix.emit(docs, mix.mix(sized), mix.word_count("text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mix", source_mix),
]

ORACLE_SQL = None  # learned rules and fingerprints are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
