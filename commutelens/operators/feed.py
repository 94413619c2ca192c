"""Timetable feeds: filters that cascade, merge, service dates, frequencies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commutelens.functions.clock import hour_of, to_seconds
from commutelens.schemas import WEEKDAYS


@dataclass(frozen=True)
class Feed:
    """One DataFrame per feed table (schemas in :mod:`commutelens.schemas`)."""

    trips: DataFrame
    stop_times: DataFrame
    stops: DataFrame
    routes: DataFrame
    shapes: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def _semi(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` occurs in ``ids``; ids are made distinct
    first, so a heavily used id travels once per map task."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def with_trips(feed: Feed, trips: DataFrame) -> Feed:
    """The feed cut down to ``trips`` and to what these trips use."""
    stop_times = feed.stop_times.join(trips.select("trip_id"), "trip_id", "left_semi")
    return Feed(
        trips=trips,
        stop_times=stop_times,
        stops=_semi(feed.stops, stop_times, "stop_id"),
        routes=_semi(feed.routes, trips, "route_id"),
        shapes=_semi(feed.shapes, trips, "shape_id"),
        calendar=_semi(feed.calendar, trips, "service_id"),
        calendar_dates=_semi(feed.calendar_dates, trips, "service_id"),
    )


# -- service dates ----------------------------------------------------------


def _runs_on(date: Column) -> Column:
    """Whether the weekday flag of ``date`` is set (dayofweek: 1 = Sunday)."""
    numbers = dict(zip(WEEKDAYS, (2, 3, 4, 5, 6, 7, 1)))
    hit = F.lit(False)
    for day, number in numbers.items():
        hit = hit | ((F.dayofweek(date) == number) & (F.col(day) == 1))
    return hit


def service_dates(feed: Feed) -> DataFrame:
    """``(service_id, date)`` of every day a service runs."""
    regular = (
        feed.calendar.withColumn("date", F.explode(F.sequence("start_date", "end_date")))
        .where(_runs_on(F.col("date")))
        .select("service_id", "date")
    )
    added = feed.calendar_dates.where("exception_type = 1").select("service_id", "date")
    removed = feed.calendar_dates.where("exception_type = 2").select("service_id", "date")
    return (
        regular.unionByName(added).distinct().join(removed, ["service_id", "date"], "left_anti")
    )


def filter_date(feed: Feed, date: str | None = None) -> Feed:
    """Trips that run on ``date``; without one, on the last day with any trip."""
    dates = service_dates(feed).join(
        feed.trips.select("service_id").distinct(), "service_id", "left_semi"
    )
    day = F.lit(date).cast("date") if date else dates.agg(F.max("date").alias("date")).scalar()
    active = dates.where(F.col("date") == day).select("service_id")
    return with_trips(feed, feed.trips.join(active, "service_id", "left_semi"))


def trips_per_date(feed: Feed) -> DataFrame:
    """Number of trips on each service day.

    Trips are counted per service before the dates are attached, so the join works
    on one row per service, not on one per trip and day.
    """
    per_service = feed.trips.groupBy("service_id").agg(F.count("*").alias("n"))
    return (
        service_dates(feed)
        .join(per_service, "service_id")
        .groupBy("date")
        .agg(F.sum("n").alias("trips"))
    )


# -- time of day and trip lists ----------------------------------------------


def filter_time(feed: Feed, start: str, end: str) -> Feed:
    """Stop events inside ``[start, end]``; trips left without any are dropped."""
    inside = feed.stop_times.where(
        (F.col("arrival_time") >= to_seconds(start)) & (F.col("departure_time") <= to_seconds(end))
    )
    trips = feed.trips.join(inside.select("trip_id").distinct(), "trip_id", "left_semi")
    return with_trips(replace(feed, stop_times=inside), trips)


def filter_trips(feed: Feed, listed: DataFrame, keep: bool = True) -> Feed:
    """Keep (or drop) the trips listed in a table with a ``trip_id`` column."""
    how = "left_semi" if keep else "left_anti"
    return with_trips(feed, feed.trips.join(listed.select("trip_id"), "trip_id", how))


def merge(first: Feed, second: Feed, names: tuple[str, str] = ("a", "b")) -> Feed:
    """Union of two feeds; every id becomes text led by the name of its feed."""

    def prefixed(df: DataFrame, name: str) -> DataFrame:
        ids = {
            c: F.concat(F.lit(name + ":"), F.col(c).cast("string"))
            for c in df.columns
            if c in ("trip_id", "route_id", "service_id", "shape_id", "stop_id")
        }
        return df.withColumns(ids)

    left, right = first.tables(), second.tables()
    return Feed(
        **{
            table: prefixed(left[table], names[0]).unionByName(
                prefixed(right[table], names[1]), allowMissingColumns=True
            )
            for table in left
        }
    )


# -- summaries and frequency --------------------------------------------------


def summary(feed: Feed) -> DataFrame:
    """Rows, distinct ids and the span of values for each feed table."""

    def line(name: str, df: DataFrame, key: str, low: Column, high: Column) -> DataFrame:
        return df.agg(
            F.lit(name).alias("item"),
            F.count("*").alias("n_rows"),
            F.count_distinct(key).alias("n_ids"),
            low.cast("long").alias("first_value"),
            high.cast("long").alias("last_value"),
        )

    def day_number(column: str) -> Column:
        return F.date_format(column, "yyyyMMdd")

    none = F.lit(None)
    lines = [
        line("trips", feed.trips, "trip_id", none, none),
        line("routes", feed.routes, "route_id", none, none),
        line("stops", feed.stops, "stop_id", none, none),
        line("shapes", feed.shapes, "shape_id", F.min("shape_pt_sequence"), F.max("shape_pt_sequence")),
        line("stop_times", feed.stop_times, "trip_id", F.min("arrival_time"), F.max("departure_time")),
        line(
            "calendar",
            feed.calendar,
            "service_id",
            F.min(day_number("start_date")),
            F.max(day_number("end_date")),
        ),
    ]
    out = lines[0]
    for other in lines[1:]:
        out = out.unionByName(other)
    return out


def hourly_frequency(feed: Feed) -> DataFrame:
    """Trips per route, direction and hour of first departure."""
    first = feed.stop_times.groupBy("trip_id").agg(F.min("departure_time").alias("start"))
    return (
        feed.trips.select("trip_id", "route_id", "direction_id")
        .join(first, "trip_id")
        .groupBy("route_id", "direction_id", hour_of(F.col("start")).alias("hour"))
        .agg(F.count("*").alias("frequency"))
    )


def mean_frequency_by_hour(feed: Feed, last_hour: int = 10) -> DataFrame:
    """Mean of the hourly frequencies, busiest hour first."""
    return (
        hourly_frequency(feed)
        .where(F.col("hour") <= last_hour)
        .groupBy("hour")
        .agg(F.avg("frequency").alias("average_frequency"))
        .orderBy(F.desc("average_frequency"), "hour")
    )


def daily_frequency(trips: DataFrame) -> DataFrame:
    return trips.groupBy("route_id").agg(F.count("*").alias("daily_frequency"))


# -- fleet ---------------------------------------------------------------------


def trip_spans(stop_times: DataFrame) -> DataFrame:
    """First departure and last arrival of trips that take any time."""
    return (
        stop_times.groupBy("trip_id")
        .agg(
            F.count("*").alias("n_stops"),
            F.min("departure_time").alias("start"),
            F.max("arrival_time").alias("end"),
        )
        .where("n_stops >= 2 AND `end` > start")
        .select("trip_id", "start", "end")
    )


def fleet_profile(
    trips: DataFrame, stop_times: DataFrame, keys: Sequence[str] = (), each: str | None = None
) -> DataFrame:
    """Vehicles in service from each second at which their number may change.

    Events are netted per second before the running sum, so a key has no more rows
    than seconds in a service day, whatever the number of trips.  ``each`` names an array
    column of ``trips``: a trip counts for each of its values, which become a key.  They
    are unfolded after the netting.
    """
    held = [*keys, *([each] if each else [])]
    spans = trip_spans(stop_times)
    if held:
        spans = spans.join(trips.select("trip_id", *held), "trip_id")
    event = F.explode(
        F.array(
            F.struct(F.col("start").alias("at"), F.lit(1).cast("long").alias("delta")),
            F.struct(F.col("end").alias("at"), F.lit(-1).cast("long").alias("delta")),
        )
    )
    net = (
        spans.select(*held, event.alias("e"))
        .groupBy(*held, F.col("e.at").alias("at"))
        .agg(F.sum("e.delta").alias("delta"))
    )
    keys = held
    if each:
        net = net.withColumn(each, F.explode(each)).groupBy(*keys, "at").agg(F.sum("delta").alias("delta"))
    so_far = (
        Window.partitionBy(*keys)
        .orderBy("at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return net.withColumn("running", F.sum("delta").over(so_far))


def fleet_by_hour(
    trips: DataFrame, stop_times: DataFrame, keys: Sequence[str] = (), each: str | None = None
) -> DataFrame:
    """Most vehicles in service at once in each hour, those carried in included."""
    profile = fleet_profile(trips, stop_times, keys, each)
    keys = [*keys, *([each] if each else [])]
    hours = (
        profile
        .groupBy(*keys, hour_of(F.col("at")).alias("from_hour"))
        .agg(F.max("running").alias("peak"), F.max_by("running", "at").alias("left"))
    )
    by_hour = Window.partitionBy(*keys).orderBy("from_hour")
    spread = (
        hours.withColumn("carried", F.coalesce(F.lag("left").over(by_hour), F.lit(0)))
        .withColumn("next_hour", F.coalesce(F.lead("from_hour").over(by_hour), F.col("from_hour") + 1))
        .select(
            *keys,
            "from_hour",
            F.greatest("peak", "carried").alias("busy"),
            "left",
            F.explode(F.sequence(F.col("from_hour"), F.col("next_hour") - 1)).alias("hour"),
        )
    )
    fleet = F.when(F.col("hour") == F.col("from_hour"), F.col("busy")).otherwise(F.col("left"))
    return spread.select(*keys, "hour", fleet.alias("fleet"))


def fleet_max(
    trips: DataFrame, stop_times: DataFrame, keys: Sequence[str] = (), each: str | None = None
) -> DataFrame:
    """Peak number of vehicles in service, per key."""
    peaks = fleet_by_hour(trips, stop_times, keys, each)
    return peaks.groupBy(*keys, *([each] if each else [])).agg(F.max("fleet").alias("max_fleet"))
