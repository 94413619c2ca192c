"""What a plan does to routes: status, cuts in frequency, clusters of cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.functions.labels import ELIMINATED, KEPT, REDUCED
from commutelens.operators.feed import daily_frequency
from commutelens.operators.shapes import route_shape
from commutelens.operators.scalars import scalar
from commutelens.session import cut


def route_status(
    old_trips: DataFrame, new_trips: DataFrame, interventions: DataFrame
) -> DataFrame:
    """Routes the plan eliminates, and the routes it runs with their status."""

    def rated(trips: DataFrame) -> DataFrame:
        return (
            route_shape(trips)
            .withColumn("route_id", F.col("route_id").cast("double"))
            .join(interventions, "route_id", "left")
        )

    gone = rated(old_trips).where(F.col("parecer") == ELIMINATED)
    running = rated(new_trips).withColumn("parecer", F.coalesce("parecer", F.lit(KEPT)))
    return gone.unionByName(running)


def with_line(routes: DataFrame, lines: DataFrame) -> DataFrame:
    """The line of each route's ``shape_id``; routes without shape points stay."""
    return routes.join(lines.select("shape_id", "line"), "shape_id", "left")


def frequency_reduction(old_trips: DataFrame, new_trips: DataFrame) -> DataFrame:
    """Share of each route's trips that is cut; NULL when the route is gone."""
    before = daily_frequency(old_trips).withColumnRenamed("daily_frequency", "bl_freq")
    after = daily_frequency(new_trips).withColumnRenamed("daily_frequency", "opt_freq")
    return before.join(after, "route_id", "left").withColumn(
        "reduction", F.expr("try_divide(bl_freq - opt_freq, bl_freq)")
    )


def reduction_label(reductions: DataFrame) -> DataFrame:
    label = F.when(F.col("reduction") == 0, F.lit(KEPT)).when(
        F.col("reduction").isNotNull(), F.lit(REDUCED)
    )
    return reductions.withColumn("label", label)


def reduction_histogram(
    reductions: DataFrame, bins: int = 30, low: float = 0.01, high: float = 1.0
) -> DataFrame:
    """Routes per bin of reduction in ``(low, high]``, and the mean of all of these."""
    kept = reductions.where((F.col("reduction") > low) & (F.col("reduction") <= high))
    width = (high - low) / bins
    place = F.least(F.floor((F.col("reduction") - low) / width), F.lit(bins - 1)).cast("long")
    mean = kept.agg(F.avg("reduction").alias("mean"))
    return (
        kept.groupBy(place.alias("bin"))
        .agg(F.count("*").alias("routes"))
        .withColumn("mean_reduction", scalar(mean))
    )


def reduction_clusters(
    reductions: DataFrame, k: int = 3, seed: int = 2, tries: int = 8
) -> DataFrame:
    """k-means on the one column ``reduction``, clusters numbered by their centre.

    Of ``tries`` starts the clustering of least cost is kept.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = reductions.where(F.col("reduction").isNotNull())
    points = cut(known).withColumn("_point", array_to_vector(F.array("reduction")))
    fits = [
        KMeans(k=k, seed=seed + i, featuresCol="_point", predictionCol="_cluster").fit(points)
        for i in range(tries)
    ]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    # k numbers, whatever the data: the only values that come to the driver
    centres = [float(c[0]) for c in model.clusterCenters()]
    rank = F.lit(None)
    for position, index in enumerate(sorted(range(len(centres)), key=centres.__getitem__), 1):
        rank = F.when(F.col("_cluster") == index, F.lit(position).cast("long")).otherwise(rank)
    return model.transform(points).withColumn("cluster", rank).drop("_point", "_cluster")


def reduction_summary(reductions: DataFrame, *keys: str) -> DataFrame:
    """Trips before and after, trips cut, routes, and the span of the reduction."""
    return reductions.groupBy(*keys).agg(
        F.sum("bl_freq").alias("bl_freq"),
        F.sum("opt_freq").alias("opt_freq"),
        (F.sum("bl_freq") - F.sum("opt_freq")).alias("trip_red"),
        F.count("*").alias("n"),
        F.min("reduction").alias("min_red"),
        F.avg("reduction").alias("mean_red"),
        F.max("reduction").alias("max_red"),
    )


def cluster_summary(clusters: DataFrame, unchanged: bool = True) -> DataFrame:
    """The summary per cluster, of the routes that keep (or lose) trips."""
    kept = F.col("reduction") == 0
    return reduction_summary(clusters.where(kept if unchanged else ~kept), "cluster")
