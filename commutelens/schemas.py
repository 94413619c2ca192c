"""Fixed schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LONG, DOUBLE, STRING, DATE = T.LongType(), T.DoubleType(), T.StringType(), T.DateType()
POINT = _struct(lon=DOUBLE, lat=DOUBLE)

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

TRIPS = _struct(trip_id=LONG, route_id=LONG, service_id=STRING, shape_id=STRING, direction_id=LONG)
# arrival and departure are seconds after midnight; they may pass 24:00:00
STOP_TIMES = _struct(
    trip_id=LONG, stop_sequence=LONG, stop_id=LONG, arrival_time=LONG, departure_time=LONG
)
STOPS = _struct(stop_id=LONG, lon=DOUBLE, lat=DOUBLE)
ROUTES = _struct(route_id=LONG)
SHAPES = _struct(shape_id=STRING, shape_pt_sequence=LONG, lon=DOUBLE, lat=DOUBLE)
CALENDAR = _struct(
    service_id=STRING, start_date=DATE, end_date=DATE, **{day: LONG for day in WEEKDAYS}
)
CALENDAR_DATES = _struct(service_id=STRING, date=DATE, exception_type=LONG)

FEED = {
    "trips": TRIPS,
    "stop_times": STOP_TIMES,
    "stops": STOPS,
    "routes": ROUTES,
    "shapes": SHAPES,
    "calendar": CALENDAR,
    "calendar_dates": CALENDAR_DATES,
}

# the polygon of a cell as well-known text
GRID = _struct(id_hex=STRING, polygon=STRING)
LANDUSE = _struct(
    id_hex=STRING, P013=LONG, P014=LONG, P015=LONG, R003=LONG, T002=LONG, T003=LONG
)
TTM = _struct(scenario=STRING, from_id=STRING, to_id=STRING, travel_time=LONG)
PERFORMANCE = _struct(
    scenario=STRING,
    people_critical=LONG,
    max_bus_fleet=LONG,
    total_bus_distance=DOUBLE,
    max_metro_fleet=LONG,
    total_metro_distance=DOUBLE,
)
REMOVAL_COST = _struct(scenario=STRING, max_fleet=LONG, total_distance=DOUBLE)
CANDIDATES = _struct(generation=LONG, cand_id=LONG, trip_id=LONG)
