"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commutelens.llm import audit as AU
from commutelens.llm import covertree as CT
from commutelens.llm import decon as DC
from commutelens.llm import lines as LN
from commutelens.llm import lpf as LP
from commutelens.llm import maxent as MA
from commutelens.llm import merkle as ME
from commutelens.llm import mix as MX
from commutelens.llm import qda as QD
from commutelens.llm import rules as RU
from commutelens.llm import secret_scan as SE
from commutelens.llm import simhash as SH
from commutelens.llm import urls as UR
from commutelens.llm.common import table
from commutelens.session import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix(spark, sf):
    docs = table(spark, sf, "documents")
    plan = MX.mix(docs.select("doc_id", "source", MX.word_count("text").alias("size")))
    return plan.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


@query
def op2_lines(spark, sf):
    return LN.dedup(table(spark, sf, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "n_lines", "n_removed", "text"
    )


@query
def op3_maxent(spark, sf):
    return MA.score(table(spark, sf, "documents"))


@query
def op4_urls(spark, sf):
    return UR.judge(table(spark, sf, "pages"))


@query
def op5_lpf(spark, sf):
    return LP.dedup(table(spark, sf, "documents")).drop("kept")


@query
def op6_simhash(spark, sf):
    return SH.near_dedup(table(spark, sf, "documents"))


@query
def op7_secrets(spark, sf):
    return SE.find(table(spark, sf, "documents"))


@query
def op8_rules(spark, sf):
    stats = cut(RU.statistics(table(spark, sf, "documents").select("doc_id", "text")).drop("text"), "rules-stats")
    rules = RU.learn(stats, table(spark, sf, "labels"))
    return RU.judge(stats, rules).select(
        "doc_id", *[F.col(f"_stats.{c}") for c in RU.BASE], "base_failed", "kept", "rule"
    )


@query
def op9_decon(spark, sf):
    return DC.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op10_qda(spark, sf):
    return QD.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op11_merkle(spark, sf):
    docs = table(spark, sf, "documents")
    one_more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = ME.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), one_more, F.col("text"))
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered)
    proven = ME.manifest(docs, also={"tampered": shown})
    folded = ME.fold(F.coalesce("tampered", "leaf"), F.col("siblings"))
    return proven.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("siblings.digest", ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_covertree(spark, sf):
    return CT.near_dedup(table(spark, sf, "embeddings"))


@query
def op13_audit(spark, sf):
    return AU.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))
