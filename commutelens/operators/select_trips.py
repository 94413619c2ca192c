"""Choosing trips under a distance budget, and removing single trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commutelens.functions.decay import Kernel, gaussian, weighted
from commutelens.operators.access import PLACES
from commutelens.operators.feed import fleet_profile, trip_spans
from commutelens.operators.running import running_total
from commutelens.operators.scalars import record, scalar


def candidate_select(distances: DataFrame, candidates: DataFrame) -> DataFrame:
    """The trips (with route and length) each candidate keeps."""
    return candidates.select("cand_id", "trip_id").join(distances, "trip_id")


def candidate_cost(
    distances: DataFrame, candidates: DataFrame, budget: DataFrame | float
) -> DataFrame:
    """Metres per candidate and whether they fit the budget."""
    return (
        candidate_select(distances, candidates)
        .groupBy("cand_id")
        .agg(F.sum("distance").alias("distance"), F.count("*").alias("trips"))
        .withColumn("feasible", F.col("distance") <= scalar(budget))
    )


def candidate_fitness(
    costs: DataFrame,
    rides: DataFrame,
    walked: DataFrame,
    origins: DataFrame,
    destinations: DataFrame,
    threshold: DataFrame | float,
    kernel: Kernel = gaussian(),
) -> DataFrame:
    """Minus the people at or below the threshold; minus infinity over the budget.

    ``rides`` are the candidates' times with a ride (``cand_id, from_id, to_id,
    travel_time``), ``walked`` the times on foot, the same for all.  What walking
    gives is computed once; a candidate only adds the pairs it makes faster, and is
    credited with the people of the zones it lifts over the line.  Nothing is
    built for zones a candidate does not change.
    """
    jobs = destinations.select(F.col("id").alias("to_id"), "jobs")
    on_foot = (
        walked.join(jobs, "to_id")
        .groupBy(F.col("from_id").alias("id"))
        .agg(F.sum(weighted(F.col("jobs"), kernel, F.col("travel_time"))).alias("_base"))
    )
    line = scalar(threshold)
    poor = (
        origins.join(on_foot, "id", "left")
        .select(F.col("id").alias("from_id"), "pop", F.coalesce("_base", F.lit(0.0)).alias("_base"))
        .where(F.round("_base", PLACES) <= line)
    )
    faster = (
        rides.join(
            walked.withColumnRenamed("travel_time", "_walk"), ["from_id", "to_id"], "left"
        )
        .where(F.col("_walk").isNull() | (F.col("travel_time") < F.col("_walk")))
        .join(jobs, "to_id")
    )
    gain = weighted(F.col("jobs"), kernel, F.col("travel_time")) - F.coalesce(
        weighted(F.col("jobs"), kernel, F.col("_walk")), F.lit(0.0)
    )
    lifted = (
        faster.groupBy("cand_id", "from_id")
        .agg(F.sum(gain).alias("_gain"))
        .join(poor, "from_id")
        .where(F.round(F.col("_base") + F.col("_gain"), PLACES) > line)
        .groupBy("cand_id")
        .agg(F.sum("pop").alias("_lifted"))
    )
    people = scalar(poor.agg(F.sum("pop"))) - F.coalesce("_lifted", F.lit(0))
    return costs.join(lifted, "cand_id", "left").select(
        "cand_id",
        "trips",
        "distance",
        "feasible",
        F.when(F.col("feasible"), -people.cast("double"))
        .otherwise(F.lit(float("-inf")))
        .alias("fitness"),
    )


def candidate_elite(scored: DataFrame, n: int = 11) -> DataFrame:
    """The best candidates, ties broken by id."""
    return scored.orderBy(F.desc("fitness"), "cand_id").limit(n)


def candidate_add(candidates: DataFrame, trips: DataFrame, cand_id: int) -> DataFrame:
    """Append a hand-made candidate that keeps the listed trips."""
    made = trips.select(F.lit(cand_id).cast("long").alias("cand_id"), "trip_id")
    return candidates.select("cand_id", "trip_id").unionByName(made)


def min_service(distances: DataFrame, n: int = 2) -> DataFrame:
    """The first trips of each route.

    Spark limits each group before the shuffle, so a busy route sends no more rows
    per map task than it may keep.
    """
    first = Window.partitionBy("route_id").orderBy("trip_id")
    return distances.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_n")


def budget_left(served: DataFrame, budget: DataFrame | float) -> DataFrame:
    """What is left of the budget after a minimum service."""
    return served.agg((scalar(budget) - F.sum("distance")).alias("budget_left"))


def greedy_fill(
    distances: DataFrame, budget: DataFrame | float, n: int = 2
) -> DataFrame:
    """Minimum service, plus the longest other trips while their sum fits."""
    served = min_service(distances, n)
    others = distances.join(served.select("trip_id"), "trip_id", "left_anti")
    ranked = running_total(others, [], [F.desc("distance"), F.col("trip_id")], {"cost": "distance"})
    added = ranked.where(F.col("cost") <= scalar(budget_left(served, budget)))
    columns = ["trip_id", "route_id", "distance"]
    return (
        served.select(*columns, F.lit(True).alias("minimum"))
        .unionByName(added.select(*columns, F.lit(False).alias("minimum")))
    )


def loo_distance(distances: DataFrame) -> DataFrame:
    """Total distance without each single trip: the total less its own length."""
    everything = distances.agg(F.sum("distance").alias("total"))
    return distances.select(
        "trip_id", (scalar(everything) - F.col("distance")).alias("total_distance")
    )


def loo_fleet(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Peak fleet without each single trip.

    The peak falls by one exactly when the trip is under way at every second at
    which the peak is reached, so two seconds of the profile decide.
    """
    profile = fleet_profile(trips, stop_times)
    peak = profile.groupBy("running").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    top = peak.agg(
        F.max("running").alias("peak"),
        F.max_by("first", "running").alias("first"),
        F.max_by("last", "running").alias("last"),
    )
    peaks = record(top)
    covers = (F.col("start") <= peaks["first"]) & (F.col("end") > peaks["last"])
    lowers = F.when(F.coalesce(covers, F.lit(False)), 1).otherwise(0)
    return trips.select("trip_id").join(trip_spans(stop_times), "trip_id", "left").select(
        "trip_id", (peaks["peak"] - lowers).cast("long").alias("max_fleet")
    )


def remaining_work(work: DataFrame, done: DataFrame, key: str = "trip_id") -> DataFrame:
    """Work items without a result yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def flat_list_to_table(flat: DataFrame) -> DataFrame:
    """A flat list ``(pos, value)`` of repeating name, fleet and length, as rows."""
    place = F.col("pos") % 3

    def field(k: int):
        return F.max(F.when(place == k, F.col("value")))

    return (
        flat.groupBy(F.floor(F.col("pos") / 3).alias("_row"))
        .agg(
            field(0).alias("name"),
            field(1).cast("double").alias("fleet"),
            field(2).cast("double").alias("length"),
        )
        .drop("_row")
    )
