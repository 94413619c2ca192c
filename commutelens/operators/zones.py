"""Zones: population, origins, destinations, pairs and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.functions.geo import ring_centroid
from commutelens.operators.scalars import record, total


def population() -> Column:
    return F.col("P013") + F.col("P014") + F.col("P015")


def jobs() -> Column:
    return F.col("T002") + F.col("T003")


def with_population(zones: DataFrame) -> DataFrame:
    return zones.withColumn("pop", population())


def origins(zones: DataFrame, last_decile: int = 6) -> DataFrame:
    """Zones of the lower income deciles that somebody lives in."""
    kept = with_population(zones).where((F.col("R003") <= last_decile) & (F.col("pop") != 0))
    return kept.select(F.col("id_hex").alias("id"), "lon", "lat", "pop", "R003")


def destinations(zones: DataFrame) -> DataFrame:
    """Zones with any low or medium education job."""
    kept = zones.withColumn("jobs", jobs()).where("jobs > 0")
    return kept.select(F.col("id_hex").alias("id"), "lon", "lat", "jobs")


def centroids(zones: DataFrame) -> DataFrame:
    """Replace the polygon of each zone by its centroid."""
    return zones.withColumn("_c", ring_centroid(F.col("ring"))).select(
        "id_hex", F.col("_c.lon").alias("lon"), F.col("_c.lat").alias("lat")
    )


def located(zones: DataFrame, places: int = 9) -> DataFrame:
    """Zones with ``lon, lat``: their own, or the centroid of their ``ring``.

    Centroids are kept to a tenth of a millimetre, so that a place is the same place
    whichever way it was computed.
    """
    if {"lon", "lat"} <= set(zones.columns):
        return zones
    centre = zones.withColumn("_c", ring_centroid(F.col("ring")))
    return centre.withColumns({c: F.round(F.col(f"_c.{c}"), places) for c in ("lon", "lat")}).drop("_c")


def od_pairs(origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """Origins x destinations without the diagonal, one row per origin.

    The product itself is never built: all an origin's row of it says is how many
    destinations there are besides itself and how many jobs they hold.
    """
    here = destinations.select("id", F.col("jobs").alias("_own"))
    everywhere = record(destinations.agg(F.count("*").alias("n"), F.sum("jobs").alias("jobs")))
    is_end = F.col("_own").isNotNull()
    return origins.join(here, "id", "left").select(
        F.col("id").alias("from_id"),
        (everywhere["n"] - is_end.cast("long")).alias("pairs"),
        (F.coalesce(everywhere["jobs"], F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("jobs"),
    )


def in_set(zones: DataFrame, other: DataFrame, column: str = "id_hex") -> DataFrame:
    """Zones that occur in another table."""
    ids = other.select(F.col(column).alias("id_hex")).distinct()
    return zones.join(ids, "id_hex", "left_semi")


def total_jobs(destinations: DataFrame) -> DataFrame:
    return total(destinations, "jobs", "total_jobs")


def total_population(access: DataFrame) -> DataFrame:
    return total(access, "pop", "total_population")


def uncovered_origins(origins: DataFrame, ttm: DataFrame) -> DataFrame:
    """Origins that no row of the travel times starts from."""
    seen = ttm.select(F.col("from_id").alias("id")).distinct()
    return origins.select("id").join(seen, "id", "left_anti")


def origin_coverage(origins: DataFrame, ttm: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """Per scenario, how many origins some travel time starts from, and how many none does."""
    every = record(origins.agg(F.count("*").alias("n")))["n"]
    seen = ttm.select("scenario", F.col("from_id").alias("id")).distinct().join(origins.select("id"), "id", "left_semi")
    named = origins.sparkSession.createDataFrame([(s,) for s in scenarios], "scenario string")
    counted = seen.groupBy("scenario").agg(F.count("*").alias("covered"))
    return named.join(counted, "scenario", "left").select(
        "scenario",
        F.coalesce("covered", F.lit(0)).alias("covered"),
        (every - F.coalesce("covered", F.lit(0))).alias("uncovered"),
    )


def attach(df: DataFrame, zones: DataFrame, *columns: str) -> DataFrame:
    """Left join of zone columns on ``id_hex``."""
    return df.join(zones.select("id_hex", *columns), "id_hex", "left")
