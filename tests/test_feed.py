from datetime import date

import pytest
from pyspark.sql import functions as F

from commutelens import schemas
from commutelens.functions.clock import departure_timestamp, seconds_of, to_seconds
from commutelens.operators import feed as FD
from commutelens.operators import shapes as SH
from commutelens.operators.intervene import frequency_reduction, reduction_label


def make_feed(spark, trips, visits, stops=None, shapes=()):
    stops = stops or [(s, -38.5 + s / 100, -3.7) for s in sorted({v[2] for v in visits})]
    flags = {"wd": [1] * 5 + [0] * 2, "we": [0] * 5 + [1] * 2}
    calendar = [(s, date(2021, 12, 1), date(2021, 12, 31), *f) for s, f in flags.items()]
    exceptions = [("wd", date(2021, 12, 31), 2), ("we", date(2021, 12, 31), 1)]
    return FD.Feed(
        trips=spark.createDataFrame(trips, schemas.TRIPS),
        stop_times=spark.createDataFrame(visits, schemas.STOP_TIMES),
        stops=spark.createDataFrame(stops, schemas.STOPS),
        routes=spark.createDataFrame(sorted({(t[1],) for t in trips}), schemas.ROUTES),
        shapes=spark.createDataFrame(list(shapes), schemas.SHAPES),
        calendar=spark.createDataFrame(calendar, schemas.CALENDAR),
        calendar_dates=spark.createDataFrame(exceptions, schemas.CALENDAR_DATES),
    )


@pytest.fixture(scope="module")
def feed(spark):
    """Trip 1: a plain one; 2: passes midnight; 3: one stop; 4: weekend."""
    trips = [(1, 10, "wd", "a", 0), (2, 10, "wd", "a", 1), (3, 11, "wd", "b", 0), (4, 12, "we", "c", 0)]
    visits = [
        (1, 1, 1, 21600, 21600), (1, 2, 2, 25200, 25200), (1, 3, 3, 28800, 28800),
        (2, 1, 3, 85800, 85800), (2, 2, 1, 87000, 87000),
        (3, 1, 2, 30000, 30020),
        (4, 1, 1, 25000, 25000), (4, 2, 3, 26000, 26000),
    ]
    shapes = [("a", 1, -38.50, -3.70), ("a", 5, -38.49, -3.70), ("a", 9, -38.48, -3.70)]
    return make_feed(spark, trips, visits, shapes=shapes)


def ids(df, column="trip_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_filter_date_default_is_last_day_with_trips(feed):
    # on the 31st the weekday service is off and the weekend service on
    assert ids(FD.filter_date(feed).trips) == [4]


def test_filter_date_cascades(feed):
    monday = FD.filter_date(feed, "2021-12-13")
    assert ids(monday.trips) == [1, 2, 3]
    assert ids(monday.stop_times.distinct()) == [1, 1, 1, 2, 2, 3]
    assert ids(monday.routes, "route_id") == [10, 11]
    assert ids(monday.calendar, "service_id") == ["wd"]


def test_trips_per_date_counts_exceptions(feed):
    per_day = {r.date: r.trips for r in FD.trips_per_date(feed).collect()}
    assert per_day[date(2021, 12, 30)] == 3 and per_day[date(2021, 12, 31)] == 1
    assert len(per_day) == 31


def test_filter_time_bounds_are_inclusive(feed):
    kept = FD.filter_time(feed, "07:00:00", "08:00:00")
    assert ids(kept.stop_times) == [1, 1, 4]
    assert ids(kept.trips) == [1, 4]


def test_filter_trips_keep_and_drop(spark, feed):
    listed = spark.createDataFrame([(1,), (3,)], "trip_id long")
    assert ids(FD.filter_trips(feed, listed, True).trips) == [1, 3]
    assert ids(FD.filter_trips(feed, listed, False).trips) == [2, 4]


def test_merge_keeps_equal_ids_apart(feed):
    both = FD.merge(feed, feed, ("bus", "metro"))
    assert both.trips.count() == 8
    assert both.trips.select("trip_id").distinct().count() == 8


def test_fleet_carries_over_hours_and_midnight(feed):
    fleet = {r.hour: r.fleet for r in FD.fleet_by_hour(feed.trips, feed.stop_times).collect()}
    # trip 1 runs 6:00-8:00, trip 4 inside hour 6 and 7; trip 3 has no vehicle time
    assert fleet[6] == 2 and fleet[7] == 2
    assert fleet[23] == 1 and fleet[24] == 1
    assert fleet[12] == 0
    assert FD.fleet_max(feed.trips, feed.stop_times).first().max_fleet == 2


def test_distance_along_shape_and_by_stops(feed):
    got = {r.trip_id: r.distance for r in SH.distance_by_trip(feed).collect()}
    assert got[1] == got[2] == pytest.approx(2219.2, abs=2)
    assert got[3] == 0.0
    assert got[4] == pytest.approx(2219.2, abs=2)
    routes = {r.route_id: (r.trips, r.average_distance) for r in SH.distance_by_route(feed).collect()}
    assert routes[10] == (2, pytest.approx(got[1]))
    assert SH.distance_total(feed).first().total_distance == pytest.approx(sum(got.values()))


def test_path_length_in_blocks_is_the_same(spark):
    points = spark.range(200).selectExpr(
        "'p' AS shape_id", "id * 3 AS shape_pt_sequence",
        "-38.5 + (id * id % 17) / 1000D AS lon", "-3.7 + id / 1000D AS lat",
    )
    whole = SH.path_length(points, "shape_id", "shape_pt_sequence").first().distance
    split = SH.path_length(points, "shape_id", "shape_pt_sequence", block=7).first().distance
    assert split == pytest.approx(whole, rel=1e-12)


def test_lines_keep_all_points_in_order(spark):
    points = spark.range(0, 2500, 1, 7).selectExpr(
        "'p' AS shape_id", "id * 3 AS shape_pt_sequence", "cast(id AS double) AS lon", "0D AS lat"
    )
    (line,) = SH.shapes_to_lines(points).collect()
    assert [p.lon for p in line.line] == [float(i) for i in range(2500)]


def test_shapes_from_stops_one_per_pattern(feed):
    points, assigned = SH.shapes_from_stops(feed)
    assert {r.trip_id: r.shape_id for r in assigned.collect()} == {3: "stops-3", 4: "stops-4"}
    assert points.count() == 3
    drawn = SH.with_shapes(feed)
    assert drawn.trips.join(drawn.shapes, "shape_id", "left_anti").count() == 0


def test_route_gone_has_no_reduction(spark, feed):
    left = feed.trips.where("route_id <> 12 AND trip_id <> 2")
    got = {r.route_id: (r.reduction, r.label) for r in reduction_label(frequency_reduction(feed.trips, left)).collect()}
    assert got == {10: (0.5, "Reduzida"), 11: (0.0, "Mantida"), 12: (None, None)}


def test_clock(spark):
    assert to_seconds("24:10:00") == 87000
    blank = spark.createDataFrame([("",), (" ",), ("07:30",), ("x:1:2",), (None,)], "a string")
    assert {r.a for r in blank.select(seconds_of(F.col("a")).alias("a")).collect()} == {None}
    row = spark.createDataFrame([("25:00:01", "13/12/2021 06:30:00")], "a string, b string").select(
        seconds_of(F.col("a")).alias("a"), departure_timestamp(F.col("b")).cast("string").alias("b")
    ).first()
    assert row.a == 90001 and row.b == "2021-12-13 06:30:00"


def test_kept_trips_are_stored_before_they_are_counted(spark, tmp_path):
    """Joins, and what they sort, are over when the visits of a stop are counted."""
    from commutelens.plans.queries import QUERIES

    rows = {
        "orders": ([(k, k) for k in range(1, 9)], "o_orderkey long, o_custkey long"),
        "lineitem": (
            [(k, n, 1 + (k + n) % 3) for k in range(1, 9) for n in (1, 2)],
            "l_orderkey long, l_linenumber int, l_suppkey long",
        ),
        "supplier": ([(s,) for s in range(1, 4)], "s_suppkey long"),
        "events": ([(1, 7), (3, 7), (3, 8), (99, 9)], "event_id long, user_id long"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    counted = QUERIES["feed_filter_trip_keep"](spark, str(tmp_path))
    # trips 1 and 3 visit stops 3, 1 and 2, 3
    assert sorted(map(tuple, counted.collect())) == [(1, 1, 1), (2, 1, 1), (3, 2, 2)]
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()
