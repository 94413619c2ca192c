"""Registered queries: each operator run over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commutelens import schemas
from commutelens.functions.decay import DEFAULT_SIGMA, SIGMAS, gaussian, inverse, sigma_for_half_life
from commutelens.functions.geo import ring_text
from commutelens.functions.labels import scenario_label, scenario_rank
from commutelens.operators import access as A
from commutelens.operators import equity as Q
from commutelens.operators import feed as FD
from commutelens.operators import inequality as N
from commutelens.operators import intervene as V
from commutelens.operators import select_trips as S
from commutelens.operators import shapes as SH
from commutelens.operators import travel as T
from commutelens.operators import zones as Z
from commutelens.operators.scalars import scalar
from commutelens.plans import inputs as I
from commutelens.plans.run import scenario_run as run_scenario
from commutelens.plans.scenario import Study
from commutelens.session import cut, new_folder
from commutelens.sources import files as IO
from commutelens.sources import units

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- sources and sinks ------------------------------------------------------------


@query
def src_feed(spark, sf):
    folder = new_folder(spark, "feed-text")
    IO.write_text_feed(I.feed(spark, sf), folder)
    feed = IO.read_text_feed(spark, folder)
    return feed.stop_times.join(feed.trips, "trip_id").select(
        F.col("trip_id").cast("long").alias("trip_id"),
        "stop_sequence",
        F.col("stop_id").cast("long").alias("stop_id"),
        "arrival_time",
        F.col("route_id").cast("long").alias("route_id"),
        "service_id",
        "shape_id",
    )


@query
def sink_feed(spark, sf):
    folder = new_folder(spark, "feed")
    IO.write_feed(I.feed(spark, sf), folder)
    return FD.summary(IO.read_feed(spark, folder))


@query
def src_zones(spark, sf):
    whole = I.zones(spark, sf)
    folder = new_folder(spark, "zones")
    IO.write_csv(whole.select("id_hex", ring_text(F.col("ring")).alias("polygon")), f"{folder}/grid")
    IO.write_csv(whole.where("T002 + T003 > 0").select(*schemas.LANDUSE.names), f"{folder}/landuse")
    read = IO.read_zones(
        IO.read_csv(spark, f"{folder}/grid", schemas.GRID),
        IO.read_csv(spark, f"{folder}/landuse", schemas.LANDUSE),
    )
    kept = Z.located(read).withColumn("polygon", ring_text(F.col("ring"))).drop("ring")
    return rounded(kept, 6, "lon", "lat")


@query
def src_csv_inferred(spark, sf):
    folder = new_folder(spark, "ttm-csv")
    IO.write_csv(I.ttm(spark, sf), folder)
    return IO.read_csv(spark, folder).select(
        "scenario", "from_id", "to_id", F.col("travel_time").cast("long").alias("travel_time")
    )


@query
def src_multi_csv(spark, sf):
    folder = new_folder(spark, "performance")
    rows = cut(Study(spark, sf).performance())
    for code in I.CODES:
        IO.write_csv(
            rows.where(F.col("scenario") == code), f"{folder}/{code}.scenario.performance.csv"
        )
    found = IO.read_matching(spark, folder, "*.csv", schemas.PERFORMANCE)
    return rounded(found, 1, "total_bus_distance", "total_metro_distance")


@query
def src_file_lineage(spark, sf):
    folder = new_folder(spark, "removal-costs")
    feed = I.feed(spark, sf)
    lengths = cut(SH.distance_by_trip(feed))
    costs = (
        S.loo_distance(lengths)
        .join(lengths.select("trip_id", "route_id"), "trip_id")
        .join(S.loo_fleet(feed.trips, feed.stop_times), "trip_id")
        .select(
            F.col("trip_id").cast("string").alias("scenario"),
            "max_fleet",
            "total_distance",
            F.concat(F.col("route_id").cast("string"), F.lit(".removal.csv")).alias("file"),
        )
    )
    # together by file, but a route with very many trips is split
    IO.write_csv(costs.hint("rebalance", "file"), folder, by=["file"])
    read = IO.read_matching(spark, folder, "*.csv", schemas.REMOVAL_COST)
    return (
        IO.with_model(read, r"file=([^/]+)\.removal\.csv/")
        .groupBy("model")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("total_distance"), 1).alias("mean_distance"),
            F.max("max_fleet").alias("max_fleet"),
        )
    )


@query
def src_bad_rows(spark, sf):
    folder = new_folder(spark, "untidy")
    line = F.when(
        F.col("trip_id") % 50 == 7, F.concat(F.lit("broken,"), F.col("trip_id").cast("string"))
    ).otherwise(F.concat_ws(",", "trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"))
    I.stop_times(spark, sf).select(line.alias("value")).write.text(folder)
    good, _, _ = IO.read_tolerant(spark, folder, schemas.STOP_TIMES, header=False)
    return good


@query
def src_file_manifest(spark, sf):
    """Packed files by trip, some lines broken: what the manifest finds in each part."""
    folder = new_folder(spark, "untidy-packed")
    line = F.when(
        F.col("trip_id") % 50 == 7, F.concat(F.lit("broken,"), F.col("trip_id").cast("string"))
    ).otherwise(F.concat_ws(",", "trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"))
    lines = I.stop_times(spark, sf).select(line.alias("value"), (F.col("trip_id") % 16).alias("part"))
    lines.write.partitionBy("part").option("compression", "gzip").text(folder)
    return (
        IO.file_manifest(spark, folder, schemas.STOP_TIMES, header=False)
        .withColumn("part", F.regexp_extract("file", r"part=([^/]+)/", 1).cast("long"))
        .groupBy("part", "state")
        .agg(F.sum("rows").alias("rows"), F.sum("bad_lines").alias("bad_lines"))
    )


@query
def sink_ttm(spark, sf):
    folder = new_folder(spark, "ttm")
    IO.write_ttm(I.ttm(spark, sf), folder)
    return IO.read_ttm(spark, folder)


@query
def sink_performance(spark, sf):
    folder = new_folder(spark, "performance")
    IO.write_csv(Study(spark, sf).performance(), folder)
    return rounded(
        IO.read_csv(spark, folder, schemas.PERFORMANCE), 1, "total_bus_distance", "total_metro_distance"
    )


@query
def scalar_threshold_io(spark, sf):
    study = Study(spark, sf)
    folder = new_folder(spark, "threshold")
    IO.write_scalar(study.threshold(), folder)
    saved = IO.read_scalar(spark, folder, "critical_access")
    return Q.critical_population(study.access(), saved).withColumn(
        "critical_access", F.round(scalar(saved), 7)
    )


@query
def src_inline_table(spark, sf):
    by_zone = Z.with_population(I.zones(spark, sf)).select("id_hex", "pop")
    return IO.inline_table(by_zone, SIGMAS, "sigma_scenario", "sigma")


@query
def sink_candidates(spark, sf):
    folder = new_folder(spark, "candidates")
    IO.write_candidates(I.candidates(spark, sf), folder)
    return IO.read_candidates(spark, folder)


@query
def sink_units(spark, sf):
    folder = new_folder(spark, "units")
    ttm = I.ttm(spark, sf)
    work = {s: lambda s=s: ttm.where(F.col("scenario") == s) for s in I.CODES}
    units.run_open(spark, folder, work)
    return units.read_units(spark, folder, schemas.TTM)


# -- timetable -----------------------------------------------------------------------


@query
def feed_filter_date(spark, sf):
    return FD.summary(FD.filter_date(I.feed(spark, sf)))


@query
def feed_filter_time(spark, sf):
    kept = FD.filter_time(I.feed(spark, sf), "06:00:00", "10:59:59")
    return kept.stop_times.join(kept.trips.select("trip_id", "route_id"), "trip_id").select(
        "trip_id", "route_id", "stop_sequence", "arrival_time"
    )


def _listed(spark, sf):
    """Trips that some candidate keeps."""
    return I.candidates(spark, sf).select("trip_id").distinct()


@query
def feed_filter_trip_keep(spark, sf):
    # stored in between: in one stage, a task would hold the sorts and groups of all steps at once
    kept = FD.filter_trips(I.feed(spark, sf), cut(_listed(spark, sf)), keep=True)
    return cut(kept.stop_times.select("trip_id", "stop_id")).groupBy("stop_id").agg(
        F.count("*").alias("n"), F.count_distinct("trip_id").alias("trips")
    )


@query
def feed_filter_trip_drop(spark, sf):
    return FD.summary(FD.filter_trips(I.feed(spark, sf), cut(_listed(spark, sf)), keep=False))


@query
def feed_merge(spark, sf):
    both = FD.merge(I.bus_feed(spark, sf), I.metro_feed(spark, sf), ("bus", "metro"))
    return (
        both.stop_times.join(both.trips, "trip_id")
        .groupBy("route_id", "shape_id", "service_id")
        .agg(F.count("*").alias("n"), F.count_distinct("stop_id").alias("stops"))
    )


@query
def feed_service_calendar(spark, sf):
    return FD.trips_per_date(I.feed(spark, sf))


@query
def feed_summary(spark, sf):
    return FD.summary(I.feed(spark, sf))


@query
def freq_hourly(spark, sf):
    return rounded(FD.mean_frequency_by_hour(I.feed(spark, sf)), 6, "average_frequency")


@query
def freq_daily_route(spark, sf):
    return FD.daily_frequency(I.trips(spark, sf))


@query
def fleet_by_hour(spark, sf):
    return FD.fleet_by_hour(I.scenario_trips(spark, sf), I.stop_times(spark, sf), each="scenario")


@query
def fleet_max(spark, sf):
    return FD.fleet_max(I.scenario_trips(spark, sf), I.stop_times(spark, sf), each="scenario")


@query
def dist_by_trip(spark, sf):
    return rounded(SH.distance_by_trip(I.half_drawn_feed(spark, sf)), 3, "distance")


@query
def dist_by_route(spark, sf):
    return rounded(SH.distance_by_route(I.half_drawn_feed(spark, sf)), 2, "average_distance")


@query
def dist_total(spark, sf):
    return rounded(SH.distance_total(I.half_drawn_feed(spark, sf)), 1, "total_distance")


@query
def shapes_from_stops(spark, sf):
    points, assigned = SH.shapes_from_stops(I.half_drawn_feed(spark, sf))
    uses = assigned.groupBy("shape_id").agg(F.count("*").alias("trips"))
    return rounded(points.join(uses, "shape_id"), 6, "lon", "lat")


def _line_text(lines: DataFrame) -> DataFrame:
    """Lines as text of whole thousandths of degrees, for comparison."""

    def thousandths(degrees):
        return F.round(degrees * 1000).cast("long").cast("string")

    point = F.transform(
        "line", lambda p: F.concat(thousandths(p["lon"]), F.lit(" "), thousandths(p["lat"]))
    )
    return lines.withColumn("line", F.array_join(point, ", "))


@query
def shapes_to_lines(spark, sf):
    return _line_text(SH.shapes_to_lines(I.shapes(spark, sf)))


@query
def shapes_exclude(spark, sf):
    left = SH.exclude_shapes(I.shapes(spark, sf), ["0-0", "1-1", "2-0"])
    return rounded(left, 6, "lon", "lat")


@query
def shapes_by_scenario(spark, sf):
    lines = SH.shapes_to_lines(I.shapes(spark, sf))
    return _line_text(SH.shapes_by_scenario(lines, I.CODES, {"1-0": ["baseline"], "2-0": ["baseline"]}))


@query
def route_shape(spark, sf):
    return SH.route_shape(I.trips(spark, sf))


# -- zones ---------------------------------------------------------------------------


@query
def zone_population(spark, sf):
    return Z.with_population(I.zones(spark, sf)).select("id_hex", "pop")


@query
def origins(spark, sf):
    return rounded(I.origins(spark, sf), 6, "lon", "lat")


@query
def destinations(spark, sf):
    return rounded(I.destinations(spark, sf), 6, "lon", "lat")


@query
def zone_centroid(spark, sf):
    return rounded(Z.centroids(I.zones(spark, sf)), 6, "lon", "lat")


@query
def od_pairs(spark, sf):
    return Z.od_pairs(I.origins(spark, sf), I.destinations(spark, sf))


@query
def zone_in_set(spark, sf):
    kept = Z.in_set(I.zones(spark, sf), I.ttm(spark, sf), "to_id")
    return kept.select("id_hex", "R003", "T002", "T003")


@query
def total_jobs(spark, sf):
    return Z.total_jobs(I.destinations(spark, sf))


@query
def total_population(spark, sf):
    return Study(spark, sf).population()


@query
def origin_coverage(spark, sf):
    """Origins with and without any travel time in the whole matrix."""
    return Z.origin_coverage(I.origins(spark, sf), I.ttm(spark, sf), I.CODES)


# -- travel times ----------------------------------------------------------------------


@query
def ttm_timetable(spark, sf):
    return T.timetable_times(
        I.origins(spark, sf),
        I.destinations(spark, sf),
        I.trips(spark, sf),
        I.stop_times(spark, sf),
        I.stops(spark, sf),
    )


@query
def ttm_rename(spark, sf):
    raw = I.ttm(spark, sf).select(
        F.col("from_id").alias("fromId"),
        F.col("to_id").alias("toId"),
        F.col("travel_time").alias("travel_time_p50"),
        "scenario",
    )
    return T.rename_ttm(raw, ["scenario"])


def _finite(df: DataFrame) -> DataFrame:
    """Infinity as NULL, so that results compare alike in every engine."""
    return df.withColumn(
        "travel_time",
        F.when(F.col("travel_time") < F.lit(float("inf")), F.col("travel_time").cast("long")),
    )


@query
def od_join_ttm(spark, sf):
    return _finite(
        T.od_left_ttm(I.ttm(spark, sf), I.origins(spark, sf), I.destinations(spark, sf), I.CODES)
    )


@query
def od_full_join_ttm(spark, sf):
    return _finite(
        T.od_full_ttm(
            I.times_everywhere(spark, sf), I.origins(spark, sf), I.destinations(spark, sf), I.CODES
        )
    )


@query
def ttm_diff(spark, sf):
    return T.ttm_diff(I.ttm(spark, sf), I.CODES)


# -- accessibility -----------------------------------------------------------------------


def _by_time(spark, sf):
    return A.jobs_by_time(
        I.ttm(spark, sf), I.origins(spark, sf), I.destinations(spark, sf), I.CODES
    )


@query
def jobs_by_time(spark, sf):
    return _finite(_by_time(spark, sf))


@query
def decay_gaussian(spark, sf):
    return rounded(_finite(A.decayed(_by_time(spark, sf), gaussian(DEFAULT_SIGMA))), 6, "dec_jobs")


@query
def decay_inverse(spark, sf):
    return rounded(_finite(A.decayed(_by_time(spark, sf), inverse())), 6, "dec_jobs")


@query
def decay_sigma_halflife(spark, sf):
    half_life = F.col("travel_time").cast("double")
    return (
        I.ttm(spark, sf)
        .groupBy("travel_time")
        .agg(F.count("*").alias("pairs"))
        .select(
            "travel_time",
            "pairs",
            F.round(sigma_for_half_life(half_life), 6).alias("sigma"),
            F.round(gaussian(sigma_for_half_life(half_life))(half_life), 6).alias("share_at_half_life"),
        )
    )


@query
def accessibility(spark, sf):
    return rounded(Study(spark, sf).plain_access().drop("R003"), 6, "cum_jobs")


@query
def attach_zone_attr(spark, sf):
    study = Study(spark, sf)
    bare = study.plain_access().select("scenario", "id_hex", "cum_jobs")
    return rounded(Z.attach(bare, study.zones, "R003", "lon", "lat"), 6, "cum_jobs", "lon", "lat")


@query
def scenario_wide(spark, sf):
    return rounded(A.scenario_wide(Study(spark, sf).plain_access(), I.CODES), 6, *I.CODES)


@query
def scenario_long(spark, sf):
    wide = A.scenario_wide(Study(spark, sf).plain_access(), I.CODES)
    return rounded(A.scenario_long(wide, I.CODES), 6, "cum_jobs")


@query
def scenario_label_rank(spark, sf):
    return rounded(
        Study(spark, sf)
        .plain_access()
        .groupBy("scenario")
        .agg(F.avg("cum_jobs").alias("mean_access"))
        .select(
            scenario_label(F.col("scenario")).alias("label"),
            scenario_rank(F.col("scenario")).alias("rank"),
            "mean_access",
        ),
        4,
        "mean_access",
    )


QUERIES["scenario_label"] = QUERIES.pop("scenario_label_rank")


@query
def diff_to_baseline(spark, sf):
    study = Study(spark, sf)
    diffs = A.diff_to_baseline(study.plain_access(), (), study.jobs())
    return rounded(diffs.select("scenario", "id_hex", "diff"), 8, "diff")


@query
def share_of_jobs(spark, sf):
    study = Study(spark, sf)
    shares = A.share_of_jobs(study.plain_access(), study.jobs())
    return rounded(shares.select("scenario", "id_hex", "share"), 8, "share")


@query
def sigma_fanout(spark, sf):
    fan = Study(spark, sf).plain_sigma_access()
    return rounded(fan.select("scenario", "sigma_scenario", "id_hex", "cum_jobs"), 6, "cum_jobs")


@query
def sigma_label(spark, sf):
    name, rank = A.sigma_label(F.col("sigma"))
    return (
        Study(spark, sf)
        .plain_sigma_access()
        .select(name.alias("sigma_label"), rank.alias("sigma_rank"), "cum_jobs")
        .groupBy("sigma_label", "sigma_rank")
        .agg(F.round(F.sum("cum_jobs"), 1).alias("sum_jobs"))
    )


@query
def sigma_stack(spark, sf):
    study = Study(spark, sf)
    times = cut(study.ttm)
    parts = [
        A.accessibility(times, study.origins, study.destinations, I.CODES, gaussian(sigma), A.PLACES).withColumn(
            "sigma", F.lit(sigma)
        )
        for sigma in SIGMAS.values()
    ]
    return rounded(A.stack(parts).select("scenario", "id_hex", "sigma", "cum_jobs"), 6, "cum_jobs")


# -- equity --------------------------------------------------------------------------------


@query
def critical_threshold(spark, sf):
    return rounded(Study(spark, sf).threshold(), 7, "critical_access")


@query
def sigma_thresholds(spark, sf):
    return rounded(Study(spark, sf).sigma_thresholds(), 7, "critical_access")


@query
def critical_population(spark, sf):
    study = Study(spark, sf)
    return Q.critical_population(study.access(), study.threshold())


@query
def critical_zones(spark, sf):
    study = Study(spark, sf)
    zones = Q.critical_zones(study.access(), study.threshold())
    return rounded(zones.select("scenario", "id_hex", "pop", "cum_jobs"), 6, "cum_jobs")


@query
def performance_row(spark, sf):
    return rounded(Study(spark, sf).performance(), 1, "total_bus_distance", "total_metro_distance")


@query
def critical_transition(spark, sf):
    return Study(spark, sf).transitions().select("scenario", "id_hex", "pop", "state")


@query
def transition_per_sigma(spark, sf):
    study = Study(spark, sf)
    moves = Q.transition_per_sigma(study.sigma_access(), study.sigma_thresholds())
    return moves.select("scenario", "sigma_scenario", "id_hex", "state")


@query
def state_collapse(spark, sf):
    return (
        Study(spark, sf)
        .transitions()
        .groupBy("scenario", "state", Q.collapse_state(F.col("state")).alias("collapsed"))
        .agg(F.count("*").alias("zones"), F.sum("pop").alias("pop"))
    )


@query
def critical_by_decile(spark, sf):
    return Q.critical_by_decile(Study(spark, sf).transitions())


@query
def critical_share_decile(spark, sf):
    return Q.critical_share_decile(Q.critical_by_decile(Study(spark, sf).transitions()))


@query
def critical_diff_decile(spark, sf):
    by_decile = Q.critical_by_decile(Study(spark, sf).transitions())
    return Q.critical_diff_decile(by_decile, I.CODES)


@query
def poverty_curve(spark, sf):
    study = Study(spark, sf)
    return rounded(
        Q.poverty_curve(study.access(), study.jobs()), 6, "share", "poverty_threshold"
    )


@query
def sigma_performance(spark, sf):
    study = Study(spark, sf)
    rows = Q.sigma_performance(study.sigma_access(), study.sigma_thresholds())
    return rounded(rows, 7, "critical_access", "perc_critical_pop")


@query
def palma_ratio(spark, sf):
    return rounded(N.palma_ratio(Study(spark, sf).plain_access()), 6, "palma_ratio")


@query
def lorenz_curve(spark, sf):
    curve = N.lorenz_curve(Study(spark, sf).plain_access())
    return rounded(
        curve.select("scenario", "id_hex", "lorenz_access", "lorenz_pop"),
        6,
        "lorenz_access",
        "lorenz_pop",
    )


@query
def gini_severity(spark, sf):
    curve = N.lorenz_curve(Study(spark, sf).plain_access())
    out = N.gini_severity(curve)
    return rounded(out, 6, *[c for c in out.columns if c != "scenario"])


@query
def gini_exact(spark, sf):
    return rounded(N.gini_exact(N.lorenz_curve(Study(spark, sf).plain_access())), 6, "gini")


@query
def access_cdf(spark, sf):
    return rounded(N.access_cdf(Study(spark, sf).plain_access()), 6, "cum_jobs", "cum_pop")


@query
def access_cum_cdf(spark, sf):
    return rounded(
        N.access_cum_cdf(Study(spark, sf).plain_access()),
        6,
        "cum_jobs",
        "cum_pop",
        "cum_cum_jobs",
    )


@query
def weighted_histogram(spark, sf):
    study = Study(spark, sf)
    return N.weighted_histogram(study.access(), study.threshold())


@query
def weighted_histogram_sigma(spark, sf):
    study = Study(spark, sf)
    return N.weighted_histogram_sigma(study.sigma_access(), study.sigma_thresholds())


BOX = ("q1", "median", "q3", "low", "high")


@query
def boxplot_stats(spark, sf):
    diffs = cut(rounded(A.diff_to_baseline(Study(spark, sf).access()), 6, "diff"))
    return rounded(N.boxplot_stats(diffs, ["scenario", "R003"], "diff"), 8, *BOX)


@query
def boxplot_stats_weighted(spark, sf):
    study = Study(spark, sf)
    state = F.when(F.col("cum_jobs") <= scalar(study.threshold()), "critical").otherwise("not critical")
    shares = A.diff_to_baseline(study.access()).withColumns(
        {"state": state, "diff": F.col("diff") / scalar(study.jobs())}
    )
    diffs = rounded(shares, 8, "diff")
    boxes = N.boxplot_stats(cut(diffs), ["scenario", "R003", "state"], "diff", "pop")
    return rounded(boxes, 8, *BOX)


LINE = ("slope", "intercept", "r2")


@query
def impact_regression(spark, sf):
    study = Study(spark, sf)
    return rounded(Q.impact_regression(study.plain_access(), study.jobs()), 6, *LINE)


@query
def impact_regression_decile(spark, sf):
    study = Study(spark, sf)
    fits = Q.impact_regression(study.plain_access(), study.jobs(), ("scenario", "R003"))
    return rounded(fits, 6, *LINE)


@query
def total_impact(spark, sf):
    moved = Q.total_impact(Study(spark, sf).plain_access())
    return rounded(moved.select("scenario", "id_hex", "tot_access"), 6, "tot_access")


@query
def clamp(spark, sf):
    moved = Q.total_impact(Study(spark, sf).plain_access())
    return rounded(
        moved.select("scenario", "id_hex", Q.clamp(F.col("tot_access"), 5000.0).alias("tot_access")),
        6,
        "tot_access",
    )


@query
def total_impact_sigma(spark, sf):
    moved = Q.total_impact(Study(spark, sf).plain_sigma_access(), ["sigma_scenario"])
    return rounded(
        moved.select(
            "scenario",
            "sigma_scenario",
            "id_hex",
            Q.clamp(F.col("tot_access"), 10000.0).alias("tot_access"),
        ),
        6,
        "tot_access",
    )


@query
def size_share(spark, sf):
    shares = Q.size_share(Study(spark, sf).plain_access())
    return rounded(shares.select("scenario", "id_hex", "size"), 6, "size")


@query
def performance_labels(spark, sf):
    study = Study(spark, sf)
    labels = Q.performance_labels(cut(study.performance()), study.population())
    return rounded(labels, 6, "fleet_norm", "distance_norm")


@query
def scenario_tradeoff(spark, sf):
    return rounded(Q.scenario_tradeoff(Study(spark, sf).performance()), 3, "bus_km", "metro_km")


@query
def scenario_run(spark, sf):
    """From feeds to the result row, on routed times."""
    zones = I.zones(spark, sf).drop("lon", "lat")  # origins and destinations are the centroids
    done = run_scenario("baseline", I.bus_feed(spark, sf), I.metro_feed(spark, sf), zones)
    return rounded(
        done.performance.withColumn("critical_access", scalar(done.threshold)),
        1,
        "total_bus_distance",
        "total_metro_distance",
    ).withColumn("critical_access", F.round("critical_access", 7))


# -- interventions ---------------------------------------------------------------------------


def _drawn(spark, sf, routes):
    """Routes with the line of their shape."""
    return _line_text(V.with_line(routes, SH.shapes_to_lines(I.shapes(spark, sf))))


@query
def route_status(spark, sf):
    old, new = I.plan_trips(spark, sf)
    return _drawn(spark, sf, V.route_status(old, new, I.interventions(spark)))


def _reductions(spark, sf):
    return V.frequency_reduction(I.trips(spark, sf), I.reduced_trips(spark, sf))


@query
def freq_reduction(spark, sf):
    shaped = _reductions(spark, sf).join(SH.route_shape(I.trips(spark, sf)), "route_id", "left")
    return rounded(_drawn(spark, sf, shaped), 6, "reduction")


@query
def freq_reduction_label(spark, sf):
    return V.reduction_label(_reductions(spark, sf)).select("route_id", "label")


@query
def freq_reduction_hist(spark, sf):
    return rounded(V.reduction_histogram(_reductions(spark, sf)), 6, "mean_reduction")


@query
def reduction_clusters(spark, sf):
    return rounded(V.reduction_clusters(_reductions(spark, sf)), 6, "reduction")


@query
def cluster_summary(spark, sf):
    clusters = cut(V.reduction_clusters(_reductions(spark, sf)))
    both = V.cluster_summary(clusters).withColumn("unchanged", F.lit(True)).unionByName(
        V.cluster_summary(clusters, unchanged=False).withColumn("unchanged", F.lit(False))
    )
    return rounded(both, 6, "min_red", "mean_red", "max_red")


@query
def reduction_summary(spark, sf):
    return rounded(
        V.reduction_summary(_reductions(spark, sf)), 6, "min_red", "mean_red", "max_red"
    )


# -- choosing trips ----------------------------------------------------------------------------


def _lengths(spark, sf):
    return SH.distance_by_trip(I.feed(spark, sf))


def _mean_cost(picked: DataFrame) -> DataFrame:
    return picked.agg((F.sum("distance") / F.count_distinct("cand_id")).alias("budget"))


def _share_of_total(lengths: DataFrame) -> DataFrame:
    return lengths.agg((F.sum("distance") * 0.9).alias("budget"))


def _costs(lengths, listed):
    return S.candidate_cost(lengths, listed, _mean_cost(S.candidate_select(lengths, listed)))


@query
def candidate_select(spark, sf):
    picked = S.candidate_select(_lengths(spark, sf), I.candidates(spark, sf))
    return rounded(picked, 3, "distance")


@query
def candidate_cost(spark, sf):
    return rounded(_costs(_lengths(spark, sf), I.candidates(spark, sf)), 2, "distance")


def _scored(spark, sf):
    """All candidates scored in one job, by the search that routes the scenarios."""
    study = Study(spark, sf)
    search = T.Search()
    lengths, listed = cut(_lengths(spark, sf)), cut(I.candidates(spark, sf))
    stop_times, stops = I.stop_times(spark, sf), I.stops(spark, sf)
    costs = cut(_costs(lengths, listed))
    # the cheap test comes first: candidates over budget are never routed
    affordable = costs.where("feasible").select("cand_id")
    kept = listed.join(affordable, "cand_id", "left_semi").select("cand_id", "trip_id")
    full = T.timetable_times(
        study.origins, study.destinations, I.trips(spark, sf), stop_times, stops, search
    ).withColumn("scenario", F.lit("baseline"))
    kernel = inverse()
    reach = A.accessibility(full, study.origins, study.destinations, ["baseline"], kernel, A.PLACES)
    rides = T.ride_times(
        study.origins, study.destinations, kept, stop_times, stops, search, ["cand_id"]
    )
    walked = cut(T.walk_times(study.origins, study.destinations, search))
    line = Q.critical_threshold(reach)
    return S.candidate_fitness(
        costs, rides, walked, study.origins, study.destinations, line, kernel
    )


@query
def candidate_fitness(spark, sf):
    scored = _scored(spark, sf).select("cand_id", "feasible", "fitness")
    return scored.withColumn("fitness", F.when(F.col("feasible"), F.col("fitness")))


@query
def candidate_batch(spark, sf):
    fitness = F.when(F.col("feasible"), F.col("fitness"))
    return rounded(_scored(spark, sf).withColumn("fitness", fitness), 2, "distance")


@query
def candidate_elite(spark, sf):
    best = S.candidate_elite(_scored(spark, sf), 11)
    return best.select("cand_id", F.when(F.col("feasible"), F.col("fitness")).alias("fitness"))


@query
def candidate_add(spark, sf):
    served = S.min_service(_lengths(spark, sf))
    return S.candidate_add(I.candidates(spark, sf), served, -1)


@query
def min_service(spark, sf):
    return rounded(S.min_service(_lengths(spark, sf), 2), 3, "distance")


@query
def budget_left(spark, sf):
    lengths = _lengths(spark, sf)
    left = S.budget_left(S.min_service(lengths, 2), _share_of_total(lengths))
    return rounded(left, 1, "budget_left")


@query
def greedy_fill(spark, sf):
    # lengths to the millimetre, so that ties are ties in every engine
    lengths = cut(rounded(_lengths(spark, sf), 3, "distance"))
    return S.greedy_fill(lengths, _share_of_total(lengths), 2)


@query
def loo_distance(spark, sf):
    return rounded(S.loo_distance(_lengths(spark, sf)), 1, "total_distance")


@query
def loo_fleet(spark, sf):
    return S.loo_fleet(I.trips(spark, sf), I.stop_times(spark, sf))


@query
def remaining_work(spark, sf):
    return S.remaining_work(I.trips(spark, sf).select("trip_id"), I.candidates(spark, sf))


@query
def flat_list_to_table(spark, sf):
    spans = FD.trip_spans(I.stop_times(spark, sf))
    fields = F.array(
        F.concat(F.col("trip_id").cast("string"), F.lit(".gtfs")),
        F.col("start").cast("string"),
        F.col("end").cast("string"),
    )
    flat = spans.select("trip_id", F.posexplode(fields).alias("k", "value")).select(
        (F.col("trip_id") * 3 + F.col("k")).alias("pos"), "value"
    )
    return S.flat_list_to_table(flat)
