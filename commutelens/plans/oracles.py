"""SQL for each registered query, written for DuckDB over the same tables.

Shared views are common table expressions; a query names those it needs and gets
them with everything they build on.  The SQL takes the plain road where Spark
takes a scalable one: full OD products, replicated rows, unsplit windows.
"""

from __future__ import annotations

import re

from commutelens.functions.decay import SIGMAS
from commutelens.functions.geo import EARTH_RADIUS_M

ORACLES: dict[str, str] = {}


def _haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"(2 * {EARTH_RADIUS_M}::DOUBLE * asin(sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def _zone(key: str) -> str:
    return f"'z' || lpad({key}::VARCHAR, 9, '0')"


def _gauss(t: str, sigma: str = "50.95931::DOUBLE") -> str:
    return f"exp(-({t}::DOUBLE * {t}) / (2::DOUBLE * {sigma} * {sigma}))"


SIGMA_ROWS = ", ".join(
    f"('{name}', {value}::DOUBLE, {rank}::BIGINT)"
    for rank, (name, value) in enumerate(SIGMAS.items(), start=1)
)
REDUCED = "route_id <> 59 AND (route_id % 7 = 0 OR (trip_id * 31) % 10 <> 0)"
BASE = "scenario = 'baseline'"

VIEWS: dict[str, str] = {
    "scen": """SELECT * FROM (VALUES ('baseline', 0::BIGINT, 'Baseline', 1::BIGINT),
        ('donothing', 1, 'Do nothing', 2), ('optimal', 2, 'Optimal', 3), ('pasfor', 3, 'Pasfor', 4))
        AS t(scenario, k, label, rank)""",
    "zones": f"""SELECT {_zone('c_custkey')} AS id_hex,
        CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE (c_custkey * 7) % 40 END AS P013,
        CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE (c_custkey * 11) % 60 END AS P014,
        CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE (c_custkey * 13) % 25 END AS P015,
        1 + c_custkey % 10 AS R003,
        CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE (c_custkey * 31) % 700 END AS T002,
        CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE (c_custkey * 17) % 90 END AS T003,
        (-38600 + (c_custkey % 60) * 4 + (c_custkey // 15000) * 240)::DOUBLE / 1000 AS lon,
        (-3900 + ((c_custkey // 60) % 250) * 4)::DOUBLE / 1000 AS lat
        FROM customer""",
    "origins": """SELECT id_hex AS id, lon, lat, P013 + P014 + P015 AS pop, R003 FROM zones
        WHERE R003 <= 6 AND P013 + P014 + P015 <> 0""",
    "dests": "SELECT id_hex AS id, lon, lat, T002 + T003 AS jobs FROM zones WHERE T002 + T003 > 0",
    "tj": "SELECT sum(jobs)::BIGINT AS total_jobs FROM dests",
    "times": f"""SELECT scenario, {_zone('f')} AS from_id, {_zone('d')} AS to_id,
            CASE WHEN k = 0 THEN t0 ELSE greatest(1, t0 + (f + d + 3 * k) % 11 - 5) END AS travel_time
        FROM (SELECT DISTINCT o_custkey AS f, l_partkey AS d,
                5 + (o_custkey * 37 + l_partkey * 101) % (40 + 20 * (o_custkey % 8)) AS t0
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey <> l_partkey) p
        CROSS JOIN scen
        WHERE CASE WHEN k = 0 THEN t0 ELSE greatest(1, t0 + (f + d + 3 * k) % 11 - 5) END <= 120""",
    "ttm": """SELECT t.scenario, t.from_id, t.to_id, t.travel_time FROM times t
        JOIN origins o ON o.id = t.from_id JOIN dests d ON d.id = t.to_id""",
    "od": """SELECT s.scenario, o.id AS from_id, d.id AS to_id, d.jobs
        FROM scen s CROSS JOIN origins o CROSS JOIN dests d WHERE o.id <> d.id""",
    "odt": """SELECT od.scenario, od.from_id, od.to_id, od.jobs, t.travel_time
        FROM od LEFT JOIN ttm t USING (scenario, from_id, to_id)""",
    "by_time": """SELECT scenario, from_id, travel_time, count(*) AS pairs, sum(jobs)::BIGINT AS jobs
        FROM odt GROUP BY ALL""",
    "access": f"""SELECT s.scenario, o.id AS id_hex, o.pop, o.R003, round(coalesce(g.v, 0::DOUBLE), 6) AS cum_jobs
        FROM origins o CROSS JOIN scen s LEFT JOIN (
            SELECT scenario, from_id, sum(jobs * {_gauss('travel_time')}) AS v
            FROM by_time WHERE travel_time IS NOT NULL GROUP BY ALL) g
        ON g.scenario = s.scenario AND g.from_id = o.id""",
    "sigmas": f"SELECT * FROM (VALUES {SIGMA_ROWS}) AS t(sigma_scenario, sigma, sigma_rank)",
    "fan": f"""SELECT s.scenario, z.sigma_scenario, z.sigma, o.id AS id_hex, o.pop, o.R003,
            round(coalesce(g.v, 0::DOUBLE), 6) AS cum_jobs
        FROM origins o CROSS JOIN scen s CROSS JOIN sigmas z LEFT JOIN (
            SELECT scenario, from_id, sigma_scenario, sum(jobs * {_gauss('travel_time', 'sigma')}) AS v
            FROM by_time CROSS JOIN sigmas WHERE travel_time IS NOT NULL GROUP BY ALL) g
        ON g.scenario = s.scenario AND g.from_id = o.id AND g.sigma_scenario = z.sigma_scenario""",
    "thr": f"""SELECT quantile_cont(cum_jobs, 0.5) AS critical_access FROM (
        SELECT cum_jobs, unnest(range(pop)) FROM access WHERE {BASE})""",
    "sthr": f"""SELECT sigma_scenario, quantile_cont(cum_jobs, 0.5) AS critical_access FROM (
        SELECT sigma_scenario, cum_jobs, unnest(range(pop)) FROM fan WHERE {BASE}) GROUP BY ALL""",
    "vs": f"""SELECT a.*, b.cum_jobs AS cum_jobs_bl, a.cum_jobs - b.cum_jobs AS diff
        FROM access a JOIN access b ON a.id_hex = b.id_hex AND b.{BASE}""",
    "trans": f"""SELECT scenario, id_hex, pop, R003, CASE
            WHEN {BASE} THEN CASE WHEN cum_jobs_bl < critical_access THEN 'critical' ELSE 'not critical' END
            WHEN cum_jobs < critical_access AND cum_jobs_bl < critical_access THEN 'critical'
            WHEN cum_jobs < critical_access THEN 'new critical'
            WHEN cum_jobs > critical_access AND cum_jobs_bl < critical_access THEN 'new not critical'
            ELSE 'not critical' END AS state
        FROM vs, thr""",
    "deciles": """SELECT R003, scenario, replace(state, 'new ', '') AS state, sum(pop)::BIGINT AS pop
        FROM trans GROUP BY ALL""",
    "trips": """SELECT o_orderkey AS trip_id, o_custkey % 60 AS route_id,
        CASE WHEN o_orderkey % 5 = 0 THEN 'we' ELSE 'wd' END AS service_id,
        (o_custkey % 60) || '-' || (o_orderkey % 2) AS shape_id, o_orderkey % 2 AS direction_id
        FROM orders""",
    "st": """SELECT l_orderkey AS trip_id, l_linenumber::BIGINT AS stop_sequence, min(l_suppkey) AS stop_id,
        14400 + (l_orderkey * 97) % 64800 + 240 * l_linenumber::BIGINT AS arrival_time,
        14420 + (l_orderkey * 97) % 64800 + 240 * l_linenumber::BIGINT AS departure_time
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "stops": """SELECT s_suppkey AS stop_id,
        (-38600 + (s_suppkey * 24) % 240 + (s_suppkey // 2500) * 240)::DOUBLE / 1000 AS lon,
        (-3900 + ((s_suppkey // 10) % 250) * 4)::DOUBLE / 1000 AS lat FROM supplier""",
    "shapes": """SELECT shape_id, q AS shape_pt_sequence,
            (-38600 + (route_id * 24 + e * 12) % 240)::DOUBLE / 1000 AS lon,
            (-3900 + (route_id * 4 + e * 8) % 40)::DOUBLE / 1000 AS lat
        FROM (SELECT shape_id, route_id, q, CASE WHEN direction_id = 0 THEN q ELSE 8 - q END AS e
            FROM (SELECT DISTINCT shape_id, route_id, direction_id FROM trips)
            CROSS JOIN (SELECT unnest(range(1, 8)) AS q))""",
    "lens": f"""SELECT shape_id, sum(leg) AS distance FROM (SELECT shape_id, {_haversine(
            'lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS leg
        FROM shapes WINDOW w AS (PARTITION BY shape_id ORDER BY shape_pt_sequence)) GROUP BY ALL""",
    "tripdist": "SELECT route_id, trip_id, distance FROM trips JOIN lens USING (shape_id)",
    "stoplens": f"""SELECT trip_id, coalesce(sum(leg), 0) AS distance FROM (SELECT trip_id, {_haversine(
            'lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS leg
        FROM st JOIN stops USING (stop_id)
        WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) GROUP BY ALL""",
    "halfdist": """SELECT route_id, trip_id, distance FROM tripdist WHERE route_id >= 3
        UNION ALL SELECT route_id, trip_id, distance FROM trips JOIN stoplens USING (trip_id)
        WHERE route_id < 3""",
    "dates": """SELECT * FROM (
            SELECT s.service_id, d::DATE AS date FROM (VALUES ('wd'), ('we')) AS s(service_id)
            CROSS JOIN generate_series(DATE '2021-12-01', DATE '2021-12-31', INTERVAL 1 DAY) AS g(d)
            WHERE (service_id = 'wd') = (isodow(d) <= 5)
            UNION SELECT 'we', DATE '2021-12-24')
        WHERE NOT (service_id = 'wd' AND date = DATE '2021-12-24')""",
    "strips": f"""SELECT trips.*, scenario FROM trips CROSS JOIN scen WHERE CASE
        WHEN route_id < 3 THEN scenario <> 'baseline' OR route_id = 0
        WHEN scenario = 'optimal' THEN {REDUCED}
        WHEN scenario = 'pasfor' THEN route_id % 10 >= 3 ELSE true END""",
    "spans": """SELECT trip_id, min(departure_time) AS s, max(arrival_time) AS e FROM st
        GROUP BY trip_id HAVING count(*) >= 2 AND max(arrival_time) > min(departure_time)""",
    "events2": """SELECT scenario, route_id < 3 AS metro, s AS tick, 1 AS delta FROM spans JOIN strips USING (trip_id)
        UNION ALL SELECT scenario, route_id < 3, e, -1 FROM spans JOIN strips USING (trip_id)""",
    "cands": """SELECT DISTINCT 1::BIGINT AS generation, user_id AS cand_id, event_id + 1009 * q AS trip_id
        FROM events CROSS JOIN (SELECT unnest(range(0, 4)) AS q)
        WHERE event_id + 1009 * q IN (SELECT o_orderkey FROM orders)""",
    "picked": "SELECT cand_id, trip_id, route_id, distance FROM cands JOIN tripdist USING (trip_id)",
    "costs": """SELECT cand_id, sum(distance) AS distance, count(*) AS trips, sum(distance) <=
            (SELECT sum(distance) / count(DISTINCT cand_id) FROM picked) AS feasible
        FROM picked GROUP BY cand_id""",
    "red": f"""SELECT route_id, bl_freq, opt_freq, (bl_freq - opt_freq)::DOUBLE / bl_freq AS reduction
        FROM (SELECT route_id, count(*) AS bl_freq FROM trips GROUP BY ALL)
        LEFT JOIN (SELECT route_id, count(*) AS opt_freq FROM trips WHERE {REDUCED} GROUP BY ALL)
        USING (route_id)""",
    "peaks": """SELECT scenario, metro, max(running) AS peak FROM (
            SELECT scenario, metro, tick, sum(sum(delta)) OVER (PARTITION BY scenario, metro ORDER BY tick) AS running
            FROM events2 GROUP BY scenario, metro, tick) GROUP BY ALL""",
    "metres": """SELECT scenario, route_id < 3 AS metro, sum(distance) AS total FROM strips
        JOIN tripdist USING (trip_id, route_id) GROUP BY ALL""",
    "people": """SELECT scenario, sum(CASE WHEN cum_jobs <= critical_access THEN pop ELSE 0 END)::BIGINT
        AS people_critical FROM access, thr GROUP BY ALL""",
    "perf": """SELECT p.scenario, people_critical, bf.peak::BIGINT AS max_bus_fleet,
            bd.total AS total_bus_distance, mf.peak::BIGINT AS max_metro_fleet,
            md.total AS total_metro_distance
        FROM people p JOIN peaks bf ON bf.scenario = p.scenario AND NOT bf.metro
        JOIN peaks mf ON mf.scenario = p.scenario AND mf.metro
        JOIN metres bd ON bd.scenario = p.scenario AND NOT bd.metro
        JOIN metres md ON md.scenario = p.scenario AND md.metro""",
    "ranked": """SELECT *, sum(pop) OVER w AS cum_pop, sum(pop) OVER (PARTITION BY scenario) AS all_pop,
            sum(pop * cum_jobs) OVER w AS cum_access,
            sum(pop * cum_jobs) OVER (PARTITION BY scenario) AS all_access
        FROM access WINDOW w AS (PARTITION BY scenario ORDER BY cum_jobs, id_hex ROWS UNBOUNDED PRECEDING)""",
    "curve": """SELECT scenario, id_hex, cum_access / all_access AS y, cum_pop::DOUBLE / all_pop AS x
        FROM ranked""",
    "served": """SELECT trip_id, route_id, distance FROM (SELECT *, row_number() OVER
        (PARTITION BY route_id ORDER BY trip_id) AS n FROM tripdist) WHERE n <= 2""",
}


# views that SQL computes once instead of merging them into the query
STORED: set[str] = set()


def _needs(sql: str, found: dict[str, str]) -> None:
    for name, body in VIEWS.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needs(body, found)
            found[name] = body


def oracle(name: str, sql: str, stored: set[str] = STORED) -> None:
    found: dict[str, str] = {}
    _needs(sql, found)
    views = ",\n".join(
        f"{view} AS {'MATERIALIZED ' if view in stored else ''}({body})" for view, body in found.items()
    )
    # a query that opens with a comma goes on with views of its own
    ORACLES[name] = f"WITH {views}\n{sql}"


def _summary_of(trips: str, by_date: bool) -> str:
    """The summary of a feed cut down to some trips and what they need."""
    days = f"WHERE service_id IN (SELECT service_id FROM {trips})"
    return f"""SELECT 'trips' AS item, count(*) AS n_rows, count(DISTINCT trip_id) AS n_ids,
        NULL::BIGINT AS first_value, NULL::BIGINT AS last_value FROM {trips}
    UNION ALL SELECT 'routes', count(DISTINCT route_id), count(DISTINCT route_id), NULL, NULL FROM {trips}
    UNION ALL SELECT 'stops', count(*), count(DISTINCT stop_id), NULL, NULL FROM stops
        WHERE stop_id IN (SELECT stop_id FROM st WHERE trip_id IN (SELECT trip_id FROM {trips}))
    UNION ALL SELECT 'shapes', count(*), count(DISTINCT shape_id), min(shape_pt_sequence),
        max(shape_pt_sequence) FROM shapes WHERE shape_id IN (SELECT shape_id FROM {trips})
    UNION ALL SELECT 'stop_times', count(*), count(DISTINCT trip_id), min(arrival_time),
        max(departure_time) FROM st WHERE trip_id IN (SELECT trip_id FROM {trips})
    UNION ALL SELECT 'calendar', count(*), count(*), 20211201, 20211231
        FROM (SELECT DISTINCT service_id FROM trips {days})"""


def _loo_fleet(sql: str) -> str:
    """``sql`` after a view ``loo`` of the fleet without each trip."""
    return f""", ev AS (SELECT s AS tick, 1 AS delta FROM spans UNION ALL SELECT e, -1 FROM spans),
    prof AS (SELECT tick, sum(sum(delta)) OVER (ORDER BY tick) AS running FROM ev GROUP BY tick),
    top AS (SELECT running AS peak, count(*) AS times FROM prof
        WHERE running = (SELECT max(running) FROM prof) GROUP BY running),
    hits AS (SELECT spans.trip_id, count(*) AS n FROM spans JOIN prof ON prof.tick >= s AND prof.tick < e
        JOIN top ON top.peak = prof.running GROUP BY ALL),
    loo AS (SELECT trip_id, (peak - CASE WHEN n = times THEN 1 ELSE 0 END)::BIGINT AS max_fleet
        FROM trips CROSS JOIN top LEFT JOIN hits USING (trip_id)) {sql}"""


PERF = """scenario, people_critical, max_bus_fleet, round(total_bus_distance, 1) AS total_bus_distance,
    max_metro_fleet, round(total_metro_distance, 1) AS total_metro_distance"""

# -- sources and sinks ----------------------------------------------------------------
oracle(
    "src_feed",
    """SELECT trip_id, stop_sequence, stop_id, arrival_time, route_id, service_id, shape_id
    FROM st JOIN trips USING (trip_id)""",
)
SUMMARY = """SELECT 'trips' AS item, count(*) AS n_rows, count(DISTINCT trip_id) AS n_ids,
        NULL::BIGINT AS first_value, NULL::BIGINT AS last_value FROM trips
    UNION ALL SELECT 'routes', count(DISTINCT route_id), count(DISTINCT route_id), NULL, NULL FROM trips
    UNION ALL SELECT 'stops', count(*), count(DISTINCT stop_id), NULL, NULL FROM stops
    UNION ALL SELECT 'shapes', count(*), count(DISTINCT shape_id), min(shape_pt_sequence),
        max(shape_pt_sequence) FROM shapes
    UNION ALL SELECT 'stop_times', count(*), count(DISTINCT trip_id), min(arrival_time),
        max(departure_time) FROM st
    UNION ALL SELECT 'calendar', 2, 2, 20211201, 20211231"""
oracle("sink_feed", SUMMARY)
oracle(
    "src_zones",
    """, drawn AS (SELECT *, 'POLYGON((' || array_to_string(list_transform(
            [[-1, -1], [1, -1], [1, 1], [-1, 1], [-1, -1]],
            lambda d: printf('%.6f %.6f', lon + d[1] * 0.002::DOUBLE, lat + d[2] * 0.002::DOUBLE)), ',') || '))' AS polygon
        FROM zones)
    SELECT id_hex, round(lon, 6) AS lon, round(lat, 6) AS lat, polygon, P013, P014, P015, R003, T002, T003
    FROM drawn WHERE T002 + T003 > 0
    UNION ALL SELECT id_hex, round(lon, 6), round(lat, 6), polygon, NULL, NULL, NULL, NULL, NULL, NULL
    FROM drawn WHERE T002 + T003 = 0""",
)
TTM = "SELECT scenario, from_id, to_id, travel_time FROM ttm"
oracle("src_csv_inferred", TTM)
oracle("src_multi_csv", f"SELECT {PERF} FROM perf")
oracle(
    "src_file_lineage",
    _loo_fleet("""SELECT route_id::VARCHAR AS model, count(*) AS n, round(avg(total - distance), 1) AS mean_distance,
        max(max_fleet) AS max_fleet
    FROM tripdist JOIN loo USING (trip_id), (SELECT sum(distance) AS total FROM tripdist) GROUP BY route_id"""),
)
oracle(
    "src_bad_rows",
    """SELECT trip_id, stop_sequence, stop_id, arrival_time, departure_time FROM st
    WHERE trip_id % 50 <> 7""",
)
oracle(
    "src_file_manifest",
    """SELECT trip_id % 16 AS part, 'whole' AS state, count(*) FILTER (trip_id % 50 <> 7) AS rows,
    count(*) FILTER (trip_id % 50 = 7) AS bad_lines FROM st GROUP BY ALL""",
)
oracle("sink_ttm", TTM)
oracle("sink_performance", f"SELECT {PERF} FROM perf")
oracle(
    "scalar_threshold_io",
    "SELECT scenario, people_critical, round(critical_access, 7) AS critical_access FROM people, thr",
)
oracle(
    "src_inline_table",
    "SELECT id_hex, P013 + P014 + P015 AS pop, sigma_scenario, sigma FROM zones CROSS JOIN sigmas",
)
oracle("sink_units", "SELECT scenario AS unit, from_id, to_id, travel_time, scenario FROM ttm")
oracle("sink_candidates", "SELECT generation, cand_id, trip_id FROM cands")

# -- timetable --------------------------------------------------------------------------
oracle(
    "feed_filter_date",
    ", kept AS (SELECT * FROM trips WHERE service_id IN (SELECT service_id FROM dates"
    " WHERE date = (SELECT max(date) FROM dates))) " + _summary_of("kept", True),
)
oracle(
    "feed_filter_time",
    """SELECT trip_id, route_id, stop_sequence, arrival_time FROM st JOIN trips USING (trip_id)
    WHERE arrival_time >= 21600 AND departure_time <= 39599""",
)
oracle(
    "feed_filter_trip_keep",
    """SELECT stop_id, count(*) AS n, count(DISTINCT trip_id) AS trips FROM st
    WHERE trip_id IN (SELECT trip_id FROM cands) GROUP BY ALL""",
)
oracle(
    "feed_filter_trip_drop",
    ", kept AS (SELECT * FROM trips WHERE trip_id NOT IN (SELECT trip_id FROM cands)) "
    + _summary_of("kept", False),
)
oracle(
    "feed_merge",
    """SELECT feed || route_id AS route_id, feed || shape_id AS shape_id, feed || service_id AS service_id,
        count(*) AS n, count(DISTINCT stop_id) AS stops
    FROM (SELECT *, CASE WHEN route_id < 3 THEN 'metro:' ELSE 'bus:' END AS feed FROM trips)
    JOIN st USING (trip_id) GROUP BY ALL""",
)
oracle(
    "feed_service_calendar",
    "SELECT date, count(*) AS trips FROM dates JOIN trips USING (service_id) GROUP BY ALL",
)
oracle("feed_summary", SUMMARY)
oracle(
    "freq_hourly",
    """SELECT hour, round(avg(frequency), 6) AS average_frequency FROM (
        SELECT route_id, direction_id, start // 3600 AS hour, count(*) AS frequency
        FROM trips JOIN (SELECT trip_id, min(departure_time) AS start FROM st GROUP BY ALL) USING (trip_id)
        GROUP BY ALL) WHERE hour <= 10 GROUP BY hour""",
)
oracle("freq_daily_route", "SELECT route_id, count(*) AS daily_frequency FROM trips GROUP BY ALL")
oracle(
    "fleet_by_hour",
    """SELECT scenario, hour, max(running)::BIGINT AS fleet FROM (
        SELECT h.scenario, h.hour, p.tick,
            (SELECT count(*) FROM spans JOIN strips USING (trip_id)
             WHERE strips.scenario = h.scenario AND s <= p.tick AND e > p.tick) AS running
        FROM (SELECT scenario, unnest(range(min(tick) // 3600, max(tick) // 3600 + 1)) AS hour
              FROM events2 GROUP BY scenario) h
        JOIN (SELECT DISTINCT scenario, tick, tick // 3600 AS hour FROM events2
              UNION SELECT scenario, hour * 3600 - 1, hour FROM (
                SELECT scenario, unnest(range(min(tick) // 3600, max(tick) // 3600 + 1)) AS hour
                FROM events2 GROUP BY scenario)) p
        ON p.scenario = h.scenario AND p.hour = h.hour) GROUP BY ALL""",
)
oracle(
    "fleet_max",
    """SELECT scenario, max(running)::BIGINT AS max_fleet FROM (
        SELECT scenario, tick, sum(sum(delta)) OVER (PARTITION BY scenario ORDER BY tick) AS running
        FROM events2 GROUP BY scenario, tick) GROUP BY ALL""",
)
oracle("dist_by_trip", "SELECT route_id, trip_id, round(distance, 3) AS distance FROM halfdist")
oracle(
    "dist_by_route",
    """SELECT route_id, count(*) AS trips, round(avg(distance), 2) AS average_distance
    FROM halfdist GROUP BY ALL""",
)
oracle("dist_total", "SELECT round(sum(distance), 1) AS total_distance FROM halfdist")
oracle(
    "shapes_from_stops",
    """SELECT 'stops-' || leader AS shape_id, stop_sequence AS shape_pt_sequence, round(lon, 6) AS lon,
        round(lat, 6) AS lat, n AS trips
    FROM (SELECT min(trip_id) AS leader, count(*) AS n FROM (
            SELECT trip_id, string_agg(stop_sequence || ':' || stop_id, ',' ORDER BY stop_sequence) AS pattern
            FROM st JOIN trips USING (trip_id) WHERE route_id < 3 GROUP BY trip_id) GROUP BY pattern)
    JOIN st ON st.trip_id = leader JOIN stops USING (stop_id)""",
)
LINE_TEXT = """string_agg(round(lon * 1000)::BIGINT || ' ' || round(lat * 1000)::BIGINT, ', '
    ORDER BY shape_pt_sequence)"""
oracle(
    "shapes_to_lines",
    f"SELECT shape_id, {LINE_TEXT} AS line FROM shapes GROUP BY shape_id",
)
oracle(
    "shapes_exclude",
    """SELECT shape_id, shape_pt_sequence, round(lon, 6) AS lon, round(lat, 6) AS lat FROM shapes
    WHERE shape_id NOT IN ('0-0', '1-1', '2-0')""",
)
oracle(
    "shapes_by_scenario",
    f"""SELECT shape_id, {LINE_TEXT} AS line, scenario FROM shapes CROSS JOIN scen
    WHERE NOT (scenario = 'baseline' AND shape_id IN ('1-0', '2-0')) GROUP BY shape_id, scenario""",
)
oracle("route_shape", "SELECT route_id, arg_min(shape_id, trip_id) AS shape_id FROM trips GROUP BY ALL")

# -- zones ---------------------------------------------------------------------------------
oracle("zone_population", "SELECT id_hex, P013 + P014 + P015 AS pop FROM zones")
oracle("origins", "SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, pop, R003 FROM origins")
oracle("destinations", "SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, jobs FROM dests")
oracle("zone_centroid", "SELECT id_hex, round(lon, 6) AS lon, round(lat, 6) AS lat FROM zones")
oracle(
    "od_pairs",
    """SELECT from_id, count(*) AS pairs, sum(jobs)::BIGINT AS jobs FROM od
    WHERE scenario = 'baseline' GROUP BY ALL""",
)
oracle(
    "zone_in_set",
    "SELECT id_hex, R003, T002, T003 FROM zones WHERE id_hex IN (SELECT to_id FROM ttm)",
)
oracle("total_jobs", "SELECT total_jobs FROM tj")
oracle("total_population", "SELECT sum(pop)::BIGINT AS total_population FROM origins")
oracle(
    "origin_coverage",
    """SELECT s.scenario, count(t.from_id) AS covered, count(*) - count(t.from_id) AS uncovered
    FROM scen s CROSS JOIN origins o LEFT JOIN (SELECT DISTINCT scenario, from_id FROM ttm) t
    ON t.scenario = s.scenario AND t.from_id = o.id GROUP BY s.scenario""",
)

# -- travel times -----------------------------------------------------------------------------
WALK = 900
VIEWS["access_walk"] = f"""SELECT o.id AS from_id, s.stop_id,
        ceil({_haversine('o.lon', 'o.lat', 's.lon', 's.lat')})::BIGINT AS walk
    FROM origins o CROSS JOIN stops s WHERE {_haversine('o.lon', 'o.lat', 's.lon', 's.lat')} <= {WALK}"""
VIEWS["egress_walk"] = f"""SELECT d.id AS to_id, s.stop_id,
        ceil({_haversine('d.lon', 'd.lat', 's.lon', 's.lat')})::BIGINT AS walk
    FROM dests d CROSS JOIN stops s WHERE {_haversine('d.lon', 'd.lat', 's.lon', 's.lat')} <= {WALK}"""
VIEWS["foot"] = f"""SELECT o.id AS from_id, d.id AS to_id,
        ceil(ceil({_haversine('o.lon', 'o.lat', 'd.lon', 'd.lat')}) / 60)::BIGINT AS travel_time
    FROM origins o CROSS JOIN dests d
    WHERE o.id <> d.id AND {_haversine('o.lon', 'o.lat', 'd.lon', 'd.lat')} <= {WALK}"""
VIEWS["paths"] = f"""SELECT a.stop_id, b.stop_id AS other,
        ceil({_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')})::BIGINT AS walk
    FROM stops a CROSS JOIN stops b WHERE {_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= {WALK}"""
HORIZON = 23400 + 59 * 60 + 7200
DEADLINE = "30600 + 60 *"
ROUNDS = 9
"""More rides than help anybody on these tables; a further round changes nothing."""


def _undominated(source: str, place: str) -> str:
    """Arrivals that no later start beats; ``until`` is when the next later start gets there."""
    return f"""SELECT * FROM (SELECT *, min(arr) OVER (PARTITION BY {place} ORDER BY m DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM ({source}))
        WHERE until IS NULL OR arr < until"""


def _search(tag: str, st: str, who: str = "from_id", run: str = "trip_id") -> str:
    """Views of a search on the stop times ``st``; the name of the one with the minutes.

    ``m`` is the last minute of the hour at which one may leave.  Every round goes on from all
    arrivals of the round before.
    """
    VIEWS[f"dep_{tag}"] = f"""SELECT {run}, stop_sequence AS seq, stop_id, departure_time AS dep FROM {st}
        WHERE departure_time BETWEEN 23400 AND {HORIZON}"""
    VIEWS[f"alight_{tag}"] = f"""SELECT {run}, stop_sequence AS seq, stop_id, arrival_time AS arr FROM {st}
        WHERE arrival_time BETWEEN 23400 AND {HORIZON}"""
    keys = [k for k in run.split(", ") if k != "trip_id"]
    same_run = " AND ".join(f"a.{k} = b.{k}" for k in run.split(", "))

    def ride(boarded: str) -> str:
        return f"""SELECT {who}, stop_id, m, min(arr) AS arr FROM (
            SELECT {', '.join('b.' + k for k in who.split(', '))}, a.stop_id, a.arr, max(b.m) AS m
            FROM ({boarded}) b JOIN alight_{tag} a ON {same_run} AND a.seq > b.seq
            GROUP BY {', '.join('b.' + k for k in who.split(', '))}, a.trip_id, a.seq, a.stop_id, a.arr)
            WHERE arr <= {DEADLINE} m GROUP BY {who}, stop_id, m"""

    at = f"{who}, stop_id"
    own = "".join(f"d.{k}, " for k in keys)
    draw = "least(59, (d.dep - x.walk - 23400) // 60)"
    first = f"""SELECT {own}x.from_id, d.trip_id, d.seq, {draw} AS m
        FROM access_walk x JOIN dep_{tag} d USING (stop_id)
        WHERE d.dep - x.walk >= 23400 AND d.dep <= {DEADLINE} {draw}"""
    VIEWS[f"rides_{tag}_1"] = _undominated(ride(first), at)
    STORED.update({f"dep_{tag}", f"alight_{tag}", f"rides_{tag}_1"})
    for n in range(2, ROUNDS + 1):
        before = f"rides_{tag}_{n - 1}"
        wait = _undominated(
            f"""SELECT {who}, p.other AS stop_id, m, min(arr + p.walk) AS arr FROM {before}
            JOIN paths p USING (stop_id) GROUP BY ALL""",
            at,
        )
        same = "".join(f" AND d.{k} = w.{k}" for k in keys)
        board = f"""SELECT {', '.join('w.' + k for k in who.split(', '))}, d.trip_id, d.seq, w.m
            FROM ({wait}) w JOIN dep_{tag} d ON d.stop_id = w.stop_id{same} AND d.dep >= w.arr
            AND (w.until IS NULL OR d.dep < w.until) AND d.dep <= {DEADLINE} w.m"""
        both = f"""SELECT {at}, m, min(arr) AS arr FROM (SELECT {at}, m, arr FROM {before}
            UNION ALL {ride(board)}) GROUP BY ALL"""
        VIEWS[f"rides_{tag}_{n}"] = _undominated(both, at)
        STORED.add(f"rides_{tag}_{n}")
    ends = _undominated(
        f"""SELECT {who}, to_id, m, min(arr + walk) AS arr FROM rides_{tag}_{ROUNDS} JOIN egress_walk USING (stop_id)
        WHERE from_id <> to_id AND arr + walk <= {DEADLINE} m GROUP BY ALL""",
        f"{who}, to_id",
    )
    # the 30th of the 60 draws, each of which takes the next later arrival
    VIEWS[f"rode_{tag}"] = f"""SELECT {who}, to_id, t AS travel_time FROM (
        SELECT {who}, to_id, t, row_number() OVER (PARTITION BY {who}, to_id ORDER BY t) AS n FROM (
            SELECT {who}, to_id, ceil((arr - 23400 - 60 * draw) / 60)::BIGINT AS t FROM (
                SELECT {who}, to_id, arr, unnest(range(coalesce(lag(m) OVER (
                    PARTITION BY {who}, to_id ORDER BY m), -1) + 1, m + 1)) AS draw FROM ({ends})))
        WHERE t <= 120) WHERE n = 30"""
    return f"rode_{tag}"


RODE = _search("all", "st")
oracle(
    "ttm_timetable",
    """SELECT from_id, to_id, min(travel_time) AS travel_time FROM (
        SELECT * FROM rode_all UNION ALL SELECT * FROM foot) GROUP BY ALL""",
)
oracle("ttm_rename", TTM)
oracle(
    "od_join_ttm",
    """SELECT scenario, from_id, to_id, travel_time, 1::BIGINT AS pairs, jobs FROM odt
    WHERE travel_time IS NOT NULL
    UNION ALL SELECT scenario, from_id, NULL, NULL, count(*), sum(jobs)::BIGINT FROM odt
    WHERE travel_time IS NULL GROUP BY scenario, from_id""",
)
oracle(
    "od_full_join_ttm",
    """SELECT t.scenario, t.from_id, t.to_id, t.travel_time, 1::BIGINT AS pairs,
        coalesce(d.jobs, 0) AS jobs, d.id IS NOT NULL AND o.id IS NOT NULL AS in_od
    FROM times t LEFT JOIN dests d ON d.id = t.to_id LEFT JOIN origins o ON o.id = t.from_id
    WHERE t.from_id <> t.to_id
    UNION ALL SELECT scenario, from_id, NULL, NULL, count(*), sum(jobs)::BIGINT, true FROM odt
    WHERE travel_time IS NULL GROUP BY scenario, from_id""",
)
oracle(
    "ttm_diff",
    """SELECT t.scenario, from_id, to_id, t.travel_time, b.travel_time AS baseline_time,
        t.travel_time - b.travel_time AS diff
    FROM ttm t JOIN (SELECT * FROM ttm WHERE scenario = 'baseline') b USING (from_id, to_id)
    WHERE t.travel_time <> b.travel_time""",
    {"ttm"},
)

# -- accessibility -----------------------------------------------------------------------------
oracle("jobs_by_time", "SELECT scenario, from_id, travel_time, pairs, jobs FROM by_time")
oracle(
    "decay_gaussian",
    f"""SELECT scenario, from_id, travel_time, pairs, jobs,
        round(coalesce(jobs * {_gauss('travel_time')}, 0), 6) AS dec_jobs FROM by_time""",
)
oracle(
    "decay_inverse",
    """SELECT scenario, from_id, travel_time, pairs, jobs,
        round(coalesce(jobs / travel_time::DOUBLE, 0), 6) AS dec_jobs FROM by_time""",
)
oracle(
    "decay_sigma_halflife",
    """SELECT travel_time, count(*) AS pairs, round(travel_time / sqrt(2 * ln(2::DOUBLE)), 6) AS sigma,
        0.5::DOUBLE AS share_at_half_life FROM ttm GROUP BY travel_time""",
)
ACCESS = "cum_jobs"
oracle("accessibility", f"SELECT scenario, id_hex, pop, {ACCESS} FROM access")
oracle(
    "attach_zone_attr",
    f"""SELECT a.scenario, a.id_hex, {ACCESS}, z.R003, round(z.lon, 6) AS lon, round(z.lat, 6) AS lat
    FROM access a LEFT JOIN zones z USING (id_hex)""",
)
oracle(
    "scenario_wide",
    "SELECT id_hex, pop, "
    + ", ".join(
        f"max(cum_jobs) FILTER (WHERE scenario = '{s}') AS {s}"
        for s in ("baseline", "donothing", "optimal", "pasfor")
    )
    + " FROM access GROUP BY ALL",
)
oracle("scenario_long", f"SELECT id_hex, pop, scenario, {ACCESS} FROM access")
oracle(
    "scenario_label",
    """SELECT label, rank, round(avg(cum_jobs), 4) AS mean_access FROM access JOIN scen USING (scenario)
    GROUP BY ALL""",
)
oracle(
    "diff_to_baseline",
    f"SELECT scenario, id_hex, round(diff / total_jobs, 8) AS diff FROM vs, tj WHERE NOT {BASE}",
)
oracle(
    "share_of_jobs",
    "SELECT scenario, id_hex, round(cum_jobs / total_jobs, 8) AS share FROM access, tj",
)
oracle("sigma_fanout", f"SELECT scenario, sigma_scenario, id_hex, {ACCESS} FROM fan")
oracle(
    "sigma_label",
    """SELECT sigma_scenario AS sigma_label, sigma_rank, round(sum(cum_jobs), 1) AS sum_jobs
    FROM fan JOIN sigmas USING (sigma_scenario) GROUP BY ALL""",
)
oracle(
    "sigma_stack",
    f"SELECT scenario, id_hex, sigma, {ACCESS} FROM fan",
)

# -- equity ---------------------------------------------------------------------------------------
LINE = "round(critical_access, 7) AS critical_access"
oracle("critical_threshold", f"SELECT {LINE} FROM thr")
oracle("sigma_thresholds", f"SELECT sigma_scenario, {LINE} FROM sthr")
oracle("critical_population", "SELECT scenario, people_critical FROM people")
oracle(
    "critical_zones",
    f"SELECT scenario, id_hex, pop, {ACCESS} FROM access, thr WHERE cum_jobs <= critical_access",
)
oracle("performance_row", f"SELECT {PERF} FROM perf")
oracle("critical_transition", "SELECT scenario, id_hex, pop, state FROM trans")
oracle(
    "transition_per_sigma",
    f"""SELECT a.scenario, a.sigma_scenario, a.id_hex, CASE
        WHEN a.{BASE} THEN CASE WHEN b.cum_jobs < critical_access THEN 'critical' ELSE 'not critical' END
        WHEN a.cum_jobs < critical_access AND b.cum_jobs < critical_access THEN 'critical'
        WHEN a.cum_jobs < critical_access THEN 'new critical'
        WHEN a.cum_jobs > critical_access AND b.cum_jobs < critical_access THEN 'new not critical'
        ELSE 'not critical' END AS state
    FROM fan a JOIN fan b ON a.id_hex = b.id_hex AND a.sigma_scenario = b.sigma_scenario AND b.{BASE}
    JOIN sthr ON sthr.sigma_scenario = a.sigma_scenario""",
)
oracle(
    "state_collapse",
    """SELECT scenario, state, replace(state, 'new ', '') AS collapsed, count(*) AS zones,
        sum(pop)::BIGINT AS pop FROM trans GROUP BY ALL""",
)
oracle("critical_by_decile", "SELECT R003, scenario, state, pop FROM deciles")
oracle(
    "critical_share_decile",
    """SELECT R003, scenario, state, pop,
        round(pop / sum(pop) OVER (PARTITION BY R003, scenario) * 100, 1)::VARCHAR || '%' AS perc_pop,
        CASE WHEN state = 'not critical' THEN pop / 2
             ELSE pop / 2 + lead(pop) OVER (PARTITION BY R003, scenario ORDER BY state) END AS label_y
    FROM deciles""",
)
oracle(
    "critical_diff_decile",
    f"""SELECT b.R003, s.scenario, d.pop - b.pop AS diff_pop,
        round((d.pop - b.pop) / b.pop * 100, 1) AS diff_perc
    FROM (SELECT R003, max(pop) FILTER (WHERE {BASE}) AS pop FROM deciles
          WHERE state = 'critical' GROUP BY R003) b
    CROSS JOIN (SELECT scenario FROM scen WHERE NOT {BASE}) s
    LEFT JOIN (SELECT * FROM deciles WHERE state = 'critical') d
    ON d.R003 = b.R003 AND d.scenario = s.scenario""",
)
oracle(
    "poverty_curve",
    """SELECT scenario, round(q / 20, 6) AS poverty_threshold,
        round(sum(pop) / (SELECT sum(pop) FROM origins), 6) AS share
    FROM access, tj, (SELECT unnest(range(21)) AS q)
    WHERE cum_jobs - q / 20 * total_jobs <= 0 GROUP BY ALL""",
)
oracle(
    "sigma_performance",
    f"""SELECT scenario, sigma_scenario, {LINE}, sum(pop)::BIGINT AS critical_pop,
        round(sum(pop) / (SELECT sum(pop) FROM origins), 7) AS perc_critical_pop
    FROM fan JOIN sthr USING (sigma_scenario) WHERE cum_jobs <= critical_access
    GROUP BY scenario, sigma_scenario, critical_access""",
)
oracle(
    "palma_ratio",
    """SELECT scenario, round(avg(cum_jobs) FILTER (WHERE cum_pop::DOUBLE / all_pop >= 0.9::DOUBLE)
        / avg(cum_jobs) FILTER (WHERE cum_pop::DOUBLE / all_pop <= 0.4::DOUBLE), 6) AS palma_ratio
    FROM ranked GROUP BY scenario""",
)
oracle(
    "lorenz_curve",
    "SELECT scenario, id_hex, round(y, 6) AS lorenz_access, round(x, 6) AS lorenz_pop FROM curve",
)
oracle(
    "gini_severity",
    """, merged AS (SELECT scenario, y, max(x) AS x FROM curve GROUP BY ALL),
    steps AS (SELECT scenario, x <= 0.5::DOUBLE AS low,
            (lead(x) OVER w - x) * (lead(y) OVER w + y) / 2 AS area
        FROM merged WINDOW w AS (PARTITION BY scenario, x <= 0.5::DOUBLE ORDER BY x)),
    halves AS (SELECT scenario,
            CASE WHEN count(*) FILTER (WHERE low) > 0 THEN coalesce(sum(area) FILTER (WHERE low), 0) END AS bs,
            CASE WHEN count(*) FILTER (WHERE NOT low) > 0
                THEN coalesce(sum(area) FILTER (WHERE NOT low), 0) END AS bns
        FROM steps GROUP BY ALL),
    parts AS (SELECT scenario, bs + bns AS b, 0.125::DOUBLE - bs AS as_, 0.375::DOUBLE - bns AS asn FROM halves)
    SELECT scenario, round(b, 6) AS "B", round(as_, 6) AS "As", round(asn, 6) AS "Asn",
        round(as_ + asn, 6) AS "A", round((as_ + asn) / (as_ + asn + b), 6) AS gini,
        round(as_ / (as_ + asn + b), 6) AS severity, round(as_ / (as_ + asn), 6) AS severity_perc
    FROM parts""",
)
oracle(
    "gini_exact",
    """SELECT scenario, round(1 - 2 * sum((x - x0) * (y + y0) / 2), 6) AS gini FROM (
        SELECT scenario, x, y, lag(x, 1, 0) OVER w AS x0, lag(y, 1, 0) OVER w AS y0 FROM curve
        WINDOW w AS (PARTITION BY scenario ORDER BY x, y)) GROUP BY scenario""",
)
VALUES_ = """(SELECT scenario, cum_jobs, sum(pop)::BIGINT AS pop FROM access GROUP BY scenario, cum_jobs)"""
oracle(
    "access_cdf",
    f"""SELECT scenario, cum_jobs, pop, round(sum(pop) OVER (PARTITION BY scenario ORDER BY cum_jobs)
        / sum(pop) OVER (PARTITION BY scenario), 6) AS cum_pop FROM {VALUES_}""",
)
oracle(
    "access_cum_cdf",
    f"""SELECT scenario, cum_jobs, round(sum(pop) OVER w / sum(pop) OVER (PARTITION BY scenario), 6) AS cum_pop,
        round(sum(cum_jobs) OVER w / sum(cum_jobs) OVER (PARTITION BY scenario), 6) AS cum_cum_jobs
    FROM {VALUES_} WINDOW w AS (PARTITION BY scenario ORDER BY cum_jobs)""",
)
oracle(
    "weighted_histogram",
    """SELECT scenario, least(floor((cum_jobs - low) / ((high - low) / 60)), 59)::BIGINT AS bin,
        sum(pop)::BIGINT AS pop,
        sum(CASE WHEN cum_jobs < critical_access THEN pop ELSE 0 END)::BIGINT AS pop_critical
    FROM access, thr, (SELECT min(cum_jobs) AS low, max(cum_jobs) AS high FROM access) GROUP BY ALL""",
)
oracle(
    "weighted_histogram_sigma",
    """SELECT scenario, sigma_scenario, least(floor((cum_jobs - low) / ((high - low) / 60)), 59)::BIGINT AS bin,
        sum(pop)::BIGINT AS pop,
        sum(CASE WHEN cum_jobs < critical_access THEN pop ELSE 0 END)::BIGINT AS pop_critical
    FROM fan JOIN sthr USING (sigma_scenario)
    JOIN (SELECT scenario, sigma_scenario, min(cum_jobs) AS low, max(cum_jobs) AS high FROM fan GROUP BY ALL)
    USING (scenario, sigma_scenario) GROUP BY scenario, sigma_scenario, bin""",
)


def _boxes(keys: str, rows: str, repeated: str) -> str:
    return f"""SELECT {keys}, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3,
        round(min(diff) FILTER (WHERE ok), 8) AS low, round(max(diff) FILTER (WHERE ok), 8) AS high,
        count(*) AS n
    FROM (SELECT *, diff BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM {rows} JOIN (
        SELECT {keys}, quantile_cont(diff, 0.25) AS q1, quantile_cont(diff, 0.5) AS median,
            quantile_cont(diff, 0.75) AS q3 FROM {repeated} GROUP BY {keys}) USING ({keys}))
    GROUP BY {keys}, q1, median, q3"""


DIFFS = f"(SELECT scenario, R003, pop, round(diff, 6) AS diff FROM vs WHERE NOT {BASE})"
oracle("boxplot_stats", _boxes("scenario, R003", DIFFS, DIFFS))
STATES = f"""(SELECT scenario, R003, pop, round(diff / total_jobs, 8) AS diff,
    CASE WHEN cum_jobs <= critical_access THEN 'critical' ELSE 'not critical' END AS state
    FROM vs, thr, tj WHERE NOT {BASE})"""
oracle(
    "boxplot_stats_weighted",
    _boxes("scenario, R003, state", STATES, f"(SELECT *, unnest(range(pop)) FROM {STATES})"),
)


def _fit(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, round(regr_slope(y, x), 6) AS slope,
        round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2
    FROM (SELECT scenario, R003, diff / total_jobs AS y, cum_jobs_bl / total_jobs AS x
          FROM vs, tj WHERE NOT {BASE}) GROUP BY {keys}"""


oracle("impact_regression", _fit("scenario"))
oracle("impact_regression_decile", _fit("scenario, R003"))
oracle(
    "total_impact",
    f"SELECT scenario, id_hex, round(diff * pop, 6) AS tot_access FROM vs WHERE NOT {BASE}",
)
oracle(
    "clamp",
    f"""SELECT scenario, id_hex, round(greatest(-5000::DOUBLE, least(5000::DOUBLE, diff * pop)), 6) AS tot_access
    FROM vs WHERE NOT {BASE}""",
)
oracle(
    "total_impact_sigma",
    f"""SELECT a.scenario, a.sigma_scenario, a.id_hex, round(greatest(-10000::DOUBLE, least(10000::DOUBLE,
        (a.cum_jobs - b.cum_jobs) * a.pop)), 6) AS tot_access
    FROM fan a JOIN fan b ON a.id_hex = b.id_hex AND a.sigma_scenario = b.sigma_scenario AND b.{BASE}
    WHERE NOT a.{BASE}""",
)
oracle(
    "size_share",
    """SELECT scenario, id_hex, round(pop / (SELECT max(pop) FROM origins), 6) AS size FROM access""",
)
oracle(
    "performance_labels",
    """SELECT label AS scenario, round(people_critical / (SELECT sum(pop) FROM origins) * 100, 1)::VARCHAR
            || '%' || chr(10) || replace(format('{:,}', people_critical), ',', '.') || ' ind.'
            AS people_critical_perc,
        round(max_bus_fleet / max(max_bus_fleet) OVER (), 6) AS fleet_norm,
        round(total_bus_distance / max(total_bus_distance) OVER (), 6) AS distance_norm
    FROM perf JOIN scen USING (scenario)""",
)
oracle(
    "scenario_tradeoff",
    """SELECT label AS scenario, people_critical, round(total_bus_distance / 1000, 3) AS bus_km,
        round(total_metro_distance / 1000, 3) AS metro_km FROM perf JOIN scen USING (scenario)""",
)

# The same road on the trips of the last service day inside the time band.
VIEWS["st_band"] = """SELECT st.* FROM st JOIN trips USING (trip_id)
    WHERE service_id IN (SELECT service_id FROM dates WHERE date = (SELECT max(date) FROM dates))
        AND arrival_time >= 21600 AND departure_time <= 39599"""
VIEWS["spans_band"] = re.sub(r"\bFROM st\b", "FROM st_band", VIEWS["spans"])
_search("band", "st_band")
VIEWS["access_band"] = f"""SELECT o.id, o.pop, round(coalesce(sum(d.jobs * {_gauss('t.travel_time')}), 0), 6) AS v
    FROM origins o LEFT JOIN (SELECT from_id, to_id, min(travel_time) AS travel_time FROM (
        SELECT * FROM rode_band UNION ALL SELECT * FROM foot) GROUP BY ALL) t ON t.from_id = o.id
    LEFT JOIN dests d ON d.id = t.to_id GROUP BY o.id, o.pop"""
VIEWS["line_band"] = """SELECT quantile_cont(v, 0.5) AS line FROM (
    SELECT v, unnest(range(pop)) FROM access_band)"""
VIEWS["fleet_band"] = """SELECT metro, max(running) AS peak FROM (
        SELECT metro, tick, sum(sum(delta)) OVER (PARTITION BY metro ORDER BY tick) AS running FROM (
            SELECT route_id < 3 AS metro, s AS tick, 1 AS delta FROM spans_band JOIN trips USING (trip_id)
            UNION ALL SELECT route_id < 3, e, -1 FROM spans_band JOIN trips USING (trip_id))
        GROUP BY metro, tick) GROUP BY ALL"""
VIEWS["metres_band"] = """SELECT route_id < 3 AS metro, sum(distance) AS total FROM tripdist
    WHERE trip_id IN (SELECT trip_id FROM st_band) GROUP BY ALL"""
oracle(
    "scenario_run",
    """SELECT 'baseline' AS scenario,
        (SELECT sum(pop)::BIGINT FROM access_band, line_band WHERE v <= line) AS people_critical,
        (SELECT peak::BIGINT FROM fleet_band WHERE NOT metro) AS max_bus_fleet,
        (SELECT round(total, 1) FROM metres_band WHERE NOT metro) AS total_bus_distance,
        (SELECT peak::BIGINT FROM fleet_band WHERE metro) AS max_metro_fleet,
        (SELECT round(total, 1) FROM metres_band WHERE metro) AS total_metro_distance,
        round(line, 7) AS critical_access
    FROM line_band""",
)

# -- interventions -----------------------------------------------------------------------------------
STATUS = """CASE WHEN route_id % 10 < 3 THEN 'Eliminada' WHEN route_id % 10 < 5 THEN 'Seccionada'
    WHEN route_id % 10 = 8 THEN 'Nova' ELSE 'Mantida' END"""
oracle(
    "route_status",
    f"""SELECT route_id, shape_id, parecer, line FROM (
        SELECT route_id::DOUBLE AS route_id, arg_min(shape_id, trip_id) AS shape_id, {STATUS} AS parecer
        FROM trips GROUP BY route_id)
    LEFT JOIN (SELECT shape_id, {LINE_TEXT} AS line FROM shapes GROUP BY shape_id) USING (shape_id)""",
)
oracle(
    "freq_reduction",
    f"""SELECT route_id, bl_freq, opt_freq, round(reduction, 6) AS reduction, shape_id, line FROM red
    LEFT JOIN (SELECT route_id, arg_min(shape_id, trip_id) AS shape_id FROM trips GROUP BY ALL) USING (route_id)
    LEFT JOIN (SELECT shape_id, {LINE_TEXT} AS line FROM shapes GROUP BY shape_id) USING (shape_id)""",
)
oracle(
    "freq_reduction_label",
    """SELECT route_id, CASE WHEN reduction = 0 THEN 'Mantida' WHEN reduction IS NOT NULL THEN 'Reduzida'
        END AS label FROM red""",
)
oracle(
    "freq_reduction_hist",
    """SELECT least(floor((reduction - 0.01::DOUBLE) / (0.99::DOUBLE / 30)), 29)::BIGINT AS bin,
        count(*) AS routes, round((SELECT avg(reduction) FROM red
            WHERE reduction > 0.01::DOUBLE AND reduction <= 1), 6) AS mean_reduction
    FROM red WHERE reduction > 0.01::DOUBLE AND reduction <= 1 GROUP BY bin""",
)
oracle(
    "reduction_summary",
    """SELECT sum(bl_freq)::BIGINT AS bl_freq, sum(opt_freq)::BIGINT AS opt_freq,
        (sum(bl_freq) - sum(opt_freq))::BIGINT AS trip_red, count(*) AS n,
        round(min(reduction), 6) AS min_red, round(avg(reduction), 6) AS mean_red,
        round(max(reduction), 6) AS max_red FROM red""",
)

# The best three clusters of one column: both cut points between the sorted values.
VIEWS["steps"] = """SELECT v, row_number() OVER (ORDER BY v) AS i, sum(k) OVER w AS n, sum(k * v) OVER w AS s1,
        sum(k * v * v) OVER w AS s2 FROM (
        SELECT reduction AS v, count(*) AS k FROM red WHERE reduction IS NOT NULL GROUP BY reduction)
    WINDOW w AS (ORDER BY v)"""
VIEWS["cuts"] = """SELECT a.v AS low, b.v AS high FROM steps a JOIN steps b ON a.i < b.i
    CROSS JOIN (SELECT max(n) AS n, max_by(s1, i) AS s1, max_by(s2, i) AS s2, max(i) AS i FROM steps) z
    WHERE b.i < z.i
    ORDER BY a.s2 - a.s1 * a.s1 / a.n + (b.s2 - a.s2) - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.n - a.n)
        + (z.s2 - b.s2) - (z.s1 - b.s1) * (z.s1 - b.s1) / (z.n - b.n) LIMIT 1"""
VIEWS["clustered"] = """SELECT red.*, CASE WHEN reduction <= low THEN 1 WHEN reduction <= high THEN 2 ELSE 3
    END::BIGINT AS cluster FROM red, cuts WHERE reduction IS NOT NULL"""
oracle(
    "reduction_clusters",
    "SELECT route_id, bl_freq, opt_freq, round(reduction, 6) AS reduction, cluster FROM clustered",
)
oracle(
    "cluster_summary",
    """SELECT cluster, sum(bl_freq)::BIGINT AS bl_freq, sum(opt_freq)::BIGINT AS opt_freq,
        (sum(bl_freq) - sum(opt_freq))::BIGINT AS trip_red, count(*) AS n,
        round(min(reduction), 6) AS min_red, round(avg(reduction), 6) AS mean_red,
        round(max(reduction), 6) AS max_red, reduction = 0 AS unchanged
    FROM clustered GROUP BY cluster, reduction = 0""",
)

# -- choosing trips -------------------------------------------------------------------------------------
oracle(
    "candidate_select",
    "SELECT cand_id, trip_id, route_id, round(distance, 3) AS distance FROM picked",
)
oracle(
    "candidate_cost",
    "SELECT cand_id, round(distance, 2) AS distance, trips, feasible FROM costs",
)
# The same search with the trips of each affordable candidate only.
VIEWS["affordable"] = "SELECT cand_id FROM costs WHERE feasible"
VIEWS["st_cand"] = """SELECT cand_id, st.* FROM st JOIN cands USING (trip_id)
    WHERE cand_id IN (SELECT cand_id FROM affordable)"""
_search("cand", "st_cand", "cand_id, from_id", "cand_id, trip_id")
VIEWS["inv_line"] = """SELECT quantile_cont(v, 0.5) AS line FROM (
    SELECT v, unnest(range(pop)) FROM (
        SELECT o.id, o.pop, round(coalesce(sum(d.jobs / t.travel_time::DOUBLE), 0), 6) AS v
        FROM origins o LEFT JOIN (
            SELECT from_id, to_id, min(travel_time) AS travel_time FROM (
                SELECT * FROM rode_all UNION ALL SELECT * FROM foot) GROUP BY ALL) t ON t.from_id = o.id
        LEFT JOIN dests d ON d.id = t.to_id GROUP BY o.id, o.pop))"""
VIEWS["cand_reach"] = """SELECT cand_id, from_id, round(sum(jobs / travel_time::DOUBLE), 6) AS v FROM (
        SELECT cand_id, from_id, to_id, min(travel_time) AS travel_time FROM (
            SELECT * FROM rode_cand
            UNION ALL SELECT a.cand_id, foot.* FROM affordable a CROSS JOIN foot) GROUP BY ALL)
    JOIN dests ON dests.id = to_id GROUP BY ALL"""
VIEWS["cand_people"] = """SELECT a.cand_id, sum(o.pop)::DOUBLE AS people
    FROM affordable a CROSS JOIN origins o
    LEFT JOIN cand_reach r ON r.cand_id = a.cand_id AND r.from_id = o.id
    WHERE coalesce(r.v, 0) <= (SELECT line FROM inv_line) GROUP BY ALL"""
oracle(
    "candidate_fitness",
    "SELECT cand_id, feasible, -people AS fitness FROM costs LEFT JOIN cand_people USING (cand_id)",
)
oracle(
    "candidate_batch",
    """SELECT cand_id, trips, round(distance, 2) AS distance, feasible, -people AS fitness
    FROM costs LEFT JOIN cand_people USING (cand_id)""",
)
oracle(
    "candidate_elite",
    """SELECT cand_id, -people AS fitness FROM costs LEFT JOIN cand_people USING (cand_id)
    ORDER BY people NULLS LAST, cand_id LIMIT 11""",
)
oracle(
    "candidate_add",
    """SELECT cand_id, trip_id FROM cands UNION ALL SELECT -1, trip_id FROM served""",
)
oracle("min_service", "SELECT trip_id, route_id, round(distance, 3) AS distance FROM served")
oracle(
    "budget_left",
    """SELECT round((SELECT 0.9::DOUBLE * sum(distance) FROM tripdist) - sum(distance), 1) AS budget_left
    FROM served""",
)
oracle(
    "greedy_fill",
    """, mm AS (SELECT route_id, trip_id, round(distance, 3) AS distance FROM tripdist),
    first2 AS (SELECT route_id, trip_id, distance FROM (SELECT *, row_number() OVER
        (PARTITION BY route_id ORDER BY trip_id) AS n FROM mm) WHERE n <= 2)
    SELECT trip_id, route_id, distance, true AS minimum FROM first2
    UNION ALL SELECT trip_id, route_id, distance, false FROM (
        SELECT *, sum(distance) OVER (ORDER BY distance DESC, trip_id ROWS UNBOUNDED PRECEDING) AS cost
        FROM mm WHERE trip_id NOT IN (SELECT trip_id FROM first2))
    WHERE cost <= (SELECT 0.9::DOUBLE * sum(distance) FROM mm) - (SELECT sum(distance) FROM first2)""",
)
oracle(
    "loo_distance",
    """SELECT trip_id, round((SELECT sum(distance) FROM tripdist) - distance, 1) AS total_distance
    FROM tripdist""",
)
oracle("loo_fleet", _loo_fleet("SELECT trip_id, max_fleet FROM loo"))
oracle(
    "remaining_work",
    "SELECT trip_id FROM trips WHERE trip_id NOT IN (SELECT trip_id FROM cands)",
)
oracle(
    "flat_list_to_table",
    "SELECT trip_id || '.gtfs' AS name, s::DOUBLE AS fleet, e::DOUBLE AS length FROM spans",
)
