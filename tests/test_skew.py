"""One key holding a third of the rows: same results, work still split."""

import pytest
from pyspark.sql import functions as F

from commutelens.operators import access as A
from commutelens.operators import equity as Q
from commutelens.operators import inequality as N
from commutelens.operators.running import weighted_quantiles

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of 300,000 pairs end at one zone and another third start at one."""
    zones = spark.range(2000).select(
        F.concat(F.lit("z"), "id").alias("id"),
        (1 + F.col("id") % 7).alias("pop"),
        (1 + F.col("id") % 6).alias("R003"),
        (1 + F.col("id") % 50).alias("jobs"),
    )
    pairs = spark.range(0, 300_000, 1, 12).select(
        F.lit("baseline").alias("scenario"),
        F.concat(F.lit("z"), F.when(F.col("id") % 3 == 1, 7).otherwise(F.xxhash64("id") % 1000 + 999)).alias("from_id"),
        F.concat(F.lit("z"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.xxhash64("id", F.lit(1)) % 1000 + 999)).alias("to_id"),
        (1 + F.col("id") % 120).alias("travel_time"),
    )
    return zones, pairs


def test_hot_destination_is_split(spark, small_partitions, hot):
    zones, pairs = hot
    got = A.accessibility(pairs, zones, zones, ["baseline"])
    rows = {r.id_hex: r.cum_jobs for r in got.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "skew=true" in plan
    width = 2 * 50.95931**2
    want = (
        pairs.where("from_id <> to_id")
        .join(F.broadcast(zones.select(F.col("id").alias("to_id"), "jobs")), "to_id")
        .groupBy("from_id")
        .agg(F.sum(F.col("jobs") * F.exp(-F.col("travel_time") * F.col("travel_time") / width)).alias("v"))
        .collect()
    )
    for r in want:
        if r.from_id in rows:
            assert rows[r.from_id] == pytest.approx(r.v, rel=1e-9, abs=1e-5)
    assert len(rows) == 2000


def test_hot_value_in_quantiles_and_curves(spark, small_partitions):
    """A third of the zones reach nothing at all."""
    access = spark.range(6000).select(
        F.lit("baseline").alias("scenario"),
        F.concat(F.lit("z"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id_hex"),
        (1 + F.col("id") % 3).alias("pop"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") % 997 + 0.5).alias("cum_jobs"),
    )
    built_in = access.agg(F.percentile("cum_jobs", 0.5, F.col("pop"))).first()[0]
    assert Q.critical_threshold(access).first().critical_access == built_in
    thirds = weighted_quantiles(access, ["scenario"], "cum_jobs", "pop", {"a": 1 / 3, "b": 0.9}).first()
    both = access.agg(F.percentile("cum_jobs", [1 / 3, 0.9], F.col("pop"))).first()[0]
    assert [thirds.a, thirds.b] == pytest.approx(both)
    last = N.lorenz_curve(access).orderBy(F.desc("lorenz_pop")).first()
    assert (last.lorenz_access, last.lorenz_pop) == (pytest.approx(1), 1)
