"""Shapes and distances: path lengths, lines, shapes made from stops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commutelens.functions.geo import haversine
from commutelens.operators.feed import Feed

# Points handled in one sorted group; a longer path is cut into blocks.
BLOCK = 1000


def path_length(points: DataFrame, key: str, order: str, block: int = BLOCK) -> DataFrame:
    """Metres along the points of each ``key``, taken in ``order``.

    ``order`` is an integer, unique within ``key``.  Paths are measured in blocks
    of ``block`` order values; the gaps between blocks are added from each block's
    first and last point, so no group grows with the length of the path.
    """
    legs = points.select(
        key, order, "lon", "lat", F.floor(F.col(order) / block).alias("_block")
    )
    step = Window.partitionBy(key, "_block").orderBy(order)
    point = F.struct("lon", "lat")
    blocks = (
        legs.withColumn("_from", F.lag(point).over(step))
        .groupBy(key, "_block")
        .agg(
            F.sum(
                haversine(F.col("_from.lon"), F.col("_from.lat"), F.col("lon"), F.col("lat"))
            ).alias("_inside"),
            F.min_by(point, order).alias("_first"),
            F.max_by(point, order).alias("_last"),
        )
    )
    before = F.lag("_last").over(Window.partitionBy(key).orderBy("_block"))
    gap = haversine(
        F.col("_before.lon"), F.col("_before.lat"), F.col("_first.lon"), F.col("_first.lat")
    )
    return (
        blocks.withColumn("_before", before)
        .groupBy(key)
        .agg(
            F.sum(F.coalesce("_inside", F.lit(0.0)) + F.coalesce(gap, F.lit(0.0))).alias("distance")
        )
    )


def shape_lengths(shapes: DataFrame) -> DataFrame:
    return path_length(shapes, "shape_id", "shape_pt_sequence")


def _stop_points(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    return stop_times.select("trip_id", "stop_sequence", "stop_id").join(
        stops.select("stop_id", "lon", "lat"), "stop_id"
    )


def _without_shape(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    return trips.join(shapes.select("shape_id").distinct(), "shape_id", "left_anti")


def _lengths_by_stops(feed: Feed) -> DataFrame:
    """``(trip_id, distance)`` from stop to stop, for trips without shape points."""
    bare = _without_shape(feed.trips, feed.shapes).select("trip_id")
    visits = feed.stop_times.join(bare, "trip_id", "left_semi")
    return path_length(_stop_points(visits, feed.stops), "trip_id", "stop_sequence")


def distance_by_trip(feed: Feed) -> DataFrame:
    """``(route_id, trip_id, distance)`` in metres: along the shape, else by stops."""
    along_shape = feed.trips.join(shape_lengths(feed.shapes), "shape_id")
    by_stops = feed.trips.join(_lengths_by_stops(feed), "trip_id")
    columns = ["route_id", "trip_id", "distance"]
    return along_shape.select(*columns).unionByName(by_stops.select(*columns))


def distance_by_route(feed: Feed, keys: Sequence[str] = (), each: str | None = None) -> DataFrame:
    """Trips and their mean length per route (and per extra key of ``trips``).

    Trips on a shape are counted before the length is joined: the join sees one
    row per route and shape however many trips run on it.  ``each`` names an array
    column of ``trips``: a trip counts for each of its values.  They are unfolded after
    the counting.
    """
    group = [*keys, *([each] if each else []), "route_id"]
    along_shape = (
        feed.trips.groupBy(*group, "shape_id")
        .agg(F.count("*").alias("n"))
        .join(shape_lengths(feed.shapes), "shape_id")
        .select(*group, "n", (F.col("n") * F.col("distance")).alias("metres"))
    )
    by_stops = (
        feed.trips.select("trip_id", *group)
        .join(_lengths_by_stops(feed), "trip_id")
        .groupBy(*group)
        .agg(F.count("*").alias("n"), F.sum("distance").alias("metres"))
    )
    counted = along_shape.unionByName(by_stops)
    if each:
        counted = counted.withColumn(each, F.explode(each))
    return (
        counted.groupBy(*group)
        .agg(
            F.sum("n").alias("trips"), (F.sum("metres") / F.sum("n")).alias("average_distance")
        )
    )


def distance_total(feed: Feed, keys: Sequence[str] = (), each: str | None = None) -> DataFrame:
    """Metres driven by all trips: trips x mean length, over the routes."""
    routes = distance_by_route(feed, keys, each)
    return routes.groupBy(*keys, *([each] if each else [])).agg(
        F.sum(F.col("trips") * F.col("average_distance")).alias("total_distance")
    )


# -- shapes ----------------------------------------------------------------------


def patterns(stop_times: DataFrame) -> DataFrame:
    """``(trip_id, pattern)``: trips with the same stops in the same order share one.

    The fingerprint is two order-free 64-bit hashes and the number of stops, which
    map tasks can pre-aggregate; the stop list itself is never collected.
    """
    position = F.xxhash64("stop_sequence", "stop_id")
    other = F.xxhash64(F.lit("pattern"), "stop_id", "stop_sequence")
    return stop_times.groupBy("trip_id").agg(
        F.struct(
            F.count("*").alias("n"), F.bit_xor(position).alias("h1"), F.bit_xor(other).alias("h2")
        ).alias("pattern")
    )


def shapes_from_stops(feed: Feed, prefix: str = "stops-") -> tuple[DataFrame, DataFrame]:
    """Shapes for trips that have none: one per stop pattern.

    Returns the shape points and ``(trip_id, shape_id)``.  A pattern is named after
    its smallest trip, whose stops become the points.
    """
    bare = _without_shape(feed.trips, feed.shapes).select("trip_id")
    visits = feed.stop_times.join(bare, "trip_id", "left_semi")
    per_trip = patterns(visits)
    leaders = per_trip.groupBy("pattern").agg(F.min("trip_id").alias("leader"))
    shape_id = F.concat(F.lit(prefix), F.col("leader").cast("string"))
    assigned = per_trip.join(leaders, "pattern").select("trip_id", shape_id.alias("shape_id"))
    points = _stop_points(
        visits.join(leaders.select(F.col("leader").alias("trip_id")), "trip_id", "left_semi"),
        feed.stops,
    ).select(
        F.concat(F.lit(prefix), F.col("trip_id").cast("string")).alias("shape_id"),
        F.col("stop_sequence").alias("shape_pt_sequence"),
        "lon",
        "lat",
    )
    return points, assigned


def with_shapes(feed: Feed) -> Feed:
    """The feed with shapes made from stops where they were missing."""
    points, assigned = shapes_from_stops(feed)
    made = assigned.withColumnRenamed("shape_id", "_made")
    trips = (
        feed.trips.join(made, "trip_id", "left")
        .withColumn("shape_id", F.coalesce("_made", "shape_id"))
        .drop("_made")
        .select(*feed.trips.columns)
    )
    return Feed(**{**feed.tables(), "trips": trips, "shapes": feed.shapes.unionByName(points)})


def shapes_to_lines(shapes: DataFrame) -> DataFrame:
    """``(shape_id, line)``: the points of each shape in order, one line however many they are.

    A line is one value, so its points come together; points are first put together
    where they are read.
    """
    point = F.struct("shape_pt_sequence", "lon", "lat")
    return (
        shapes.groupBy("shape_id")
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
        .select(
            "shape_id",
            F.transform(
                "points", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))
            ).alias("line"),
        )
    )


def exclude_shapes(shapes: DataFrame, names: Sequence[str]) -> DataFrame:
    return shapes.where(~F.col("shape_id").isin(list(names)))


def shapes_by_scenario(
    shapes: DataFrame, scenarios: Sequence[str], absent: Mapping[str, Sequence[str]]
) -> DataFrame:
    """One row per shape and scenario; ``absent`` names the scenarios a shape lacks."""
    present = F.array(*[F.lit(s) for s in scenarios])
    for shape, missing in absent.items():
        kept = F.array(*[F.lit(s) for s in scenarios if s not in missing])
        present = F.when(F.col("shape_id") == shape, kept).otherwise(present)
    return shapes.withColumn("scenario", F.explode(present))


def route_shape(trips: DataFrame) -> DataFrame:
    """One shape per route: that of its smallest trip."""
    return trips.groupBy("route_id").agg(F.min_by("shape_id", "trip_id").alias("shape_id"))
