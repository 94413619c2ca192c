"""Example inputs derived from the driver's tables (rules in FIXTURES.md).

Everything is a narrow projection, an equi-join or a grouping of whole tables, so
inputs grow linearly with them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commutelens import schemas
from commutelens.functions.labels import CUT, ELIMINATED, NEW, SCENARIOS
from commutelens.operators import zones as Z
from commutelens.operators.feed import Feed

CODES: Sequence[str] = list(SCENARIOS)
ZONE_ID = "concat('z', lpad(cast({key} as string), 9, '0'))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- zones and travel times --------------------------------------------------------


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = 0.002
    return (
        table(spark, sf_dir, "customer")
        .selectExpr(
            ZONE_ID.format(key="c_custkey") + " AS id_hex",
            "CASE WHEN c_custkey % 17 = 0 THEN 0L ELSE (c_custkey * 7) % 40 END AS P013",
            "CASE WHEN c_custkey % 17 = 0 THEN 0L ELSE (c_custkey * 11) % 60 END AS P014",
            "CASE WHEN c_custkey % 17 = 0 THEN 0L ELSE (c_custkey * 13) % 25 END AS P015",
            "1 + c_custkey % 10 AS R003",
            "CASE WHEN c_custkey % 3 = 0 THEN 0L ELSE (c_custkey * 31) % 700 END AS T002",
            "CASE WHEN c_custkey % 3 = 0 THEN 0L ELSE (c_custkey * 17) % 90 END AS T003",
            # 60 zones a row, 250 rows a block, blocks side by side
            "(-38600 + (c_custkey % 60) * 4 + (c_custkey div 15000) * 240) / 1000D AS lon",
            "(-3900 + ((c_custkey div 60) % 250) * 4) / 1000D AS lat",
        )
        .withColumn(
            "ring",
            F.array(
                *[
                    F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
                    for dx, dy in ((-half, -half), (half, -half), (half, half), (-half, half), (-half, -half))
                ]
            ),
        )
    )


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.origins(zones(spark, sf_dir))


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.destinations(zones(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (customer, part) pair that was ever ordered, as zones."""
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", F.col("l_partkey").alias("d"))
        .join(
            table(spark, sf_dir, "orders").select(
                F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("f")
            ),
            "l_orderkey",
        )
        .where("f <> d")
        .select("f", "d")
        .distinct()
        .selectExpr(
            "f",
            "d",
            ZONE_ID.format(key="f") + " AS from_id",
            ZONE_ID.format(key="d") + " AS to_id",
            "5 + (f * 37 + d * 101) % (40 + 20 * (f % 8)) AS t0",
        )
    )


def _per_scenario(pairs: DataFrame) -> DataFrame:
    numbered = [
        F.struct(F.lit(code).alias("scenario"), F.lit(k).cast("long").alias("k"))
        for k, code in enumerate(CODES)
    ]
    minutes = "CASE WHEN k = 0 THEN t0 ELSE greatest(1L, t0 + (f + d + 3 * k) % 11 - 5) END"
    return (
        pairs.select("*", F.inline(F.array(*numbered)))
        .withColumn("travel_time", F.expr(minutes))
        .where("travel_time <= 120")
        .select(*schemas.TTM.names)
    )


def times_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Travel times of all pairs, whether or not their ends are zones of interest."""
    return _per_scenario(_pairs(spark, sf_dir))


def ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The travel times that start at an origin and end at a destination."""
    starts = origins(spark, sf_dir).select(F.col("id").alias("from_id"))
    ends = destinations(spark, sf_dir).select(F.col("id").alias("to_id"))
    return _per_scenario(
        _pairs(spark, sf_dir)
        .join(starts, "from_id", "left_semi")
        .join(ends, "to_id", "left_semi")
    )


# -- feeds -----------------------------------------------------------------------------


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS trip_id",
        "o_custkey % 60 AS route_id",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'we' ELSE 'wd' END AS service_id",
        "concat(o_custkey % 60, '-', o_orderkey % 2) AS shape_id",
        "o_orderkey % 2 AS direction_id",
    )


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrival = "14400 + (l_orderkey * 97) % 64800 + 240 * l_linenumber"
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_suppkey").alias("stop_id"))
        .selectExpr(
            "l_orderkey AS trip_id",
            "cast(l_linenumber AS bigint) AS stop_sequence",
            "stop_id",
            f"{arrival} AS arrival_time",
            f"{arrival} + 20 AS departure_time",
        )
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS stop_id",
        # a stop for each place: 10 in a row, rows and blocks as those of the zones
        "(-38600 + (s_suppkey * 24) % 240 + (s_suppkey div 2500) * 240) / 1000D AS lon",
        "(-3900 + ((s_suppkey div 10) % 250) * 4) / 1000D AS lat",
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven points for each route and direction that some trip takes."""
    return (
        trips(spark, sf_dir)
        .select("shape_id", "route_id", "direction_id")
        .distinct()
        .withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(7))))
        .selectExpr("*", "CASE WHEN direction_id = 0 THEN q ELSE 8 - q END AS e")
        .selectExpr(
            "shape_id",
            "cast(q AS bigint) AS shape_pt_sequence",
            "(-38600 + (route_id * 24 + e * 12) % 240) / 1000D AS lon",
            "(-3900 + (route_id * 4 + e * 8) % 40) / 1000D AS lat",
        )
    )


def calendar(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT service_id, DATE'2021-12-01' AS start_date, DATE'2021-12-31' AS end_date,
               wd AS monday, wd AS tuesday, wd AS wednesday, wd AS thursday, wd AS friday,
               1L - wd AS saturday, 1L - wd AS sunday
        FROM VALUES ('wd', 1L), ('we', 0L) AS t(service_id, wd)
        """
    )


def calendar_dates(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT * FROM VALUES ('wd', DATE'2021-12-24', 2L), ('we', DATE'2021-12-24', 1L)
        AS t(service_id, date, exception_type)
        """
    )


def feed(spark: SparkSession, sf_dir: str) -> Feed:
    runs = trips(spark, sf_dir)
    return Feed(
        trips=runs,
        stop_times=stop_times(spark, sf_dir),
        stops=stops(spark, sf_dir),
        routes=runs.select("route_id").distinct(),
        shapes=shapes(spark, sf_dir),
        calendar=calendar(spark),
        calendar_dates=calendar_dates(spark),
    )


def half_drawn_feed(spark: SparkSession, sf_dir: str) -> Feed:
    """The feed without shape points for the three metro routes."""
    full = feed(spark, sf_dir)
    metro = full.trips.where("route_id < 3").select("shape_id").distinct()
    return replace(full, shapes=full.shapes.join(metro, "shape_id", "left_anti"))


def _part(full: Feed, rule: str) -> Feed:
    from commutelens.operators.feed import with_trips

    return with_trips(full, full.trips.where(rule))


def bus_feed(spark: SparkSession, sf_dir: str) -> Feed:
    return _part(feed(spark, sf_dir), "route_id >= 3")


def metro_feed(spark: SparkSession, sf_dir: str) -> Feed:
    return _part(feed(spark, sf_dir), "route_id < 3")


def reduced_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimal plan: route 59 is gone, most routes lose some trips."""
    return trips(spark, sf_dir).where(
        "route_id <> 59 AND (route_id % 7 = 0 OR (trip_id * 31) % 10 <> 0)"
    )


def plan_trips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trips before the official plan (no new routes) and under it (none eliminated)."""
    runs = trips(spark, sf_dir)
    return runs.where("route_id % 10 <> 8"), runs.where("route_id % 10 >= 3")


def scenario_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trips with the set of scenarios they run in, as an array column ``scenario``."""
    runs = F.expr(
        """
        filter(array('baseline', 'donothing', 'optimal', 'pasfor'), s -> CASE
            WHEN route_id < 3 THEN s <> 'baseline' OR route_id = 0
            WHEN s = 'optimal' THEN route_id <> 59 AND (route_id % 7 = 0 OR (trip_id * 31) % 10 <> 0)
            WHEN s = 'pasfor' THEN route_id % 10 >= 3
            ELSE true END)
        """
    )
    return trips(spark, sf_dir).withColumn("scenario", runs)


def interventions(spark: SparkSession) -> DataFrame:
    """Status of routes in the official plan: ``(route_id DOUBLE, parecer)``."""
    status = (
        F.when(F.col("id") % 10 < 3, F.lit(ELIMINATED))
        .when(F.col("id") % 10 < 5, F.lit(CUT))
        .when(F.col("id") % 10 == 8, F.lit(NEW))
    )
    return (
        spark.range(60)
        .select(F.col("id").cast("double").alias("route_id"), status.alias("parecer"))
        .where(F.col("parecer").isNotNull())
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as candidates; each of their events keeps up to four trips."""
    kept = (
        table(spark, sf_dir, "events")
        .select("user_id", "event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
        .select(
            F.lit(1).cast("long").alias("generation"),
            F.col("user_id").alias("cand_id"),
            (F.col("event_id") + 1009 * F.col("q")).alias("trip_id"),
        )
        .distinct()
    )
    return kept.join(trips(spark, sf_dir).select("trip_id"), "trip_id", "left_semi").select(
        *schemas.CANDIDATES.names
    )
