"""The accessibility poverty line, who is below it, and what plans change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commutelens.functions.labels import (
    BASELINE,
    CRITICAL,
    NEW_CRITICAL,
    NEW_NOT_CRITICAL,
    NOT_CRITICAL,
    percent,
    scenario_label,
    thousands,
)
from commutelens.functions.numbers import ratio
from commutelens.operators.access import diff_to_baseline, with_baseline
from commutelens.operators.running import weighted_quantiles
from commutelens.operators.scalars import record, scalar


def critical_threshold(access: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """The population-weighted median of the baseline, as a one-row table."""
    people = access.where(F.col("scenario") == baseline)
    return weighted_quantiles(people, [], "cum_jobs", "pop", {"critical_access": 0.5})


def sigma_thresholds(access: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """The same for each sigma: as many rows as sigmas were named in the fan-out.

    That is a handful by construction; Spark chooses how to join with it.
    """
    people = access.where(F.col("scenario") == baseline)
    return weighted_quantiles(
        people, ["sigma_scenario"], "cum_jobs", "pop", {"critical_access": 0.5}
    )


def critical_population(access: DataFrame, threshold: DataFrame) -> DataFrame:
    """People in zones at or below the threshold, per scenario."""
    below = F.col("cum_jobs") <= scalar(threshold)
    return access.groupBy("scenario").agg(
        F.sum(F.when(below, F.col("pop")).otherwise(0)).alias("people_critical")
    )


def critical_zones(access: DataFrame, threshold: DataFrame) -> DataFrame:
    return access.where(F.col("cum_jobs") <= scalar(threshold))


def _state(value: Column, base: Column, line: Column, is_baseline: Column) -> Column:
    """State against the baseline; strictly below and above the line."""
    was_critical = base < line
    return (
        F.when(is_baseline, F.when(was_critical, F.lit(CRITICAL)).otherwise(NOT_CRITICAL))
        .when((value < line) & was_critical, F.lit(CRITICAL))
        .when((value < line) & ~was_critical, F.lit(NEW_CRITICAL))
        .when((value > line) & was_critical, F.lit(NEW_NOT_CRITICAL))
        .otherwise(F.lit(NOT_CRITICAL))
    )


def critical_transition(
    access: DataFrame, threshold: DataFrame, baseline: str = BASELINE
) -> DataFrame:
    """State of each zone in each scenario."""
    state = _state(
        F.col("cum_jobs"),
        F.col("cum_jobs_bl"),
        scalar(threshold),
        F.col("scenario") == baseline,
    )
    return with_baseline(access, (), baseline).withColumn("state", state)


def transition_per_sigma(
    access: DataFrame, thresholds: DataFrame, baseline: str = BASELINE
) -> DataFrame:
    """The same, each sigma against its own threshold."""
    state = _state(
        F.col("cum_jobs"),
        F.col("cum_jobs_bl"),
        F.col("critical_access"),
        F.col("scenario") == baseline,
    )
    return (
        with_baseline(access, ["sigma_scenario"], baseline)
        .join(thresholds, "sigma_scenario")
        .withColumn("state", state)
    )


def collapse_state(state: Column) -> Column:
    """``new critical`` -> ``critical``, ``new not critical`` -> ``not critical``."""
    return F.regexp_replace(state, "^new ", "")


def critical_by_decile(transitions: DataFrame) -> DataFrame:
    """People by income decile, scenario and (collapsed) state."""
    return (
        transitions.groupBy("R003", "scenario", collapse_state(F.col("state")).alias("state"))
        .agg(F.sum("pop").alias("pop"))
        .withColumn("pop", F.coalesce("pop", F.lit(0)))
    )


def critical_share_decile(by_decile: DataFrame) -> DataFrame:
    """Share within decile and scenario, its label, and where to draw the label."""
    group = Window.partitionBy("R003", "scenario")
    following = F.lead("pop").over(group.orderBy("state"))
    half = F.col("pop") / 2
    return by_decile.select(
        "R003",
        "scenario",
        "state",
        "pop",
        percent(ratio(F.col("pop"), F.sum("pop").over(group)) * 100).alias("perc_pop"),
        F.when(F.col("state") == NOT_CRITICAL, half).otherwise(half + following).alias("label_y"),
    )


def critical_diff_decile(
    by_decile: DataFrame, scenarios: Sequence[str], baseline: str = BASELINE
) -> DataFrame:
    """Change of critical people against the baseline, per decile and scenario."""
    others = [s for s in scenarios if s != baseline]
    wide = (
        by_decile.where(F.col("state") == CRITICAL)
        .groupBy("R003")
        .pivot("scenario", list(scenarios))
        .agg(F.sum("pop"))
    )
    return wide.unpivot(
        ["R003", F.col(baseline).alias("pop_bl")], others, "scenario", "_pop"
    ).select(
        "R003",
        "scenario",
        (F.col("_pop") - F.col("pop_bl")).alias("diff_pop"),
        F.expr("round(try_divide(_pop - pop_bl, pop_bl) * 100, 1)").alias("diff_perc"),
    )


def poverty_curve(
    access: DataFrame, total_jobs: DataFrame, steps: int = 20, baseline: str = BASELINE
) -> DataFrame:
    """Share of people reaching at most a share ``p`` of all jobs, p = 0 .. 1.

    A zone counts from the first step that reaches its value.  That step is computed from the
    value, zones are summed up by it, and only these few sums are carried on to later steps.
    """
    people = scalar(access.where(F.col("scenario") == baseline).agg(F.sum("pop")))
    jobs = scalar(total_jobs)
    near = F.floor(F.coalesce(F.try_divide(F.col("cum_jobs") * steps, F.col("_jobs")), F.lit(0.0))).cast("int")
    # rounding may put the estimate one step off on either side
    around = F.sequence(F.greatest(near - 1, F.lit(0)), F.greatest(near + 1, F.lit(0)))
    first = F.array_min(
        F.filter(around, lambda s: (F.col("cum_jobs") - s / steps * F.col("_jobs") <= 0) & (s <= steps))
    )
    by_step = (
        access.select("scenario", "pop", "cum_jobs", jobs.alias("_jobs"))
        .withColumn("_first", first)
        .where("_first IS NOT NULL")
        .groupBy("scenario", "_first")
        .agg(F.sum("pop").alias("_pop"))
    )
    # at most one row per scenario and step from here on
    return (
        by_step.select("scenario", "_pop", F.explode(F.sequence(F.col("_first"), F.lit(steps))).alias("_step"))
        .groupBy("scenario", (F.col("_step") / steps).alias("poverty_threshold"))
        .agg(F.sum("_pop").alias("_pop"))
        .select("scenario", "poverty_threshold", ratio(F.col("_pop"), people).alias("share"))
    )


def sigma_performance(access: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Critical people and their share, per scenario and sigma."""
    below = F.col("cum_jobs") <= F.col("critical_access")
    return (
        access.join(thresholds, "sigma_scenario")
        .groupBy("scenario", "sigma_scenario", "critical_access")
        .agg(
            F.sum(F.when(below, F.col("pop")).otherwise(0)).alias("critical_pop"),
            F.sum("pop").alias("_people"),
        )
        .where("critical_pop > 0")
        .select(
            "scenario",
            "sigma_scenario",
            "critical_access",
            "critical_pop",
            ratio(F.col("critical_pop"), F.col("_people")).alias("perc_critical_pop"),
        )
    )


# -- impact --------------------------------------------------------------------------


def impact_regression(
    access: DataFrame, total_jobs: DataFrame, keys: Sequence[str] = ("scenario",)
) -> DataFrame:
    """Least-squares line of the change on the baseline, both as shares of all jobs."""
    base = ratio(F.col("cum_jobs_bl"), scalar(total_jobs))
    return (
        diff_to_baseline(access, (), total_jobs)
        .withColumn("base", base)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.regr_slope("diff", "base").alias("slope"),
            F.regr_intercept("diff", "base").alias("intercept"),
            F.regr_r2("diff", "base").alias("r2"),
        )
    )


def clamp(value: Column, cap: float) -> Column:
    """Limit to ``[-cap, cap]``."""
    return F.greatest(F.lit(-float(cap)), F.least(F.lit(float(cap)), value))


def total_impact(access: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Change times people, per zone and scenario."""
    return diff_to_baseline(access, keys).withColumn("tot_access", F.col("diff") * F.col("pop"))


def size_share(access: DataFrame) -> DataFrame:
    """People of a zone relative to the most peopled one."""
    return access.withColumn("size", ratio(F.col("pop"), scalar(access.agg(F.max("pop")))))


# -- performance ---------------------------------------------------------------------


def performance(people: DataFrame, operation: DataFrame) -> DataFrame:
    """One row per scenario: people below the line, fleets and distances.

    ``operation`` holds ``scenario, mode, max_fleet, total_distance`` with the modes
    ``bus`` and ``metro``.
    """

    def of(mode: str, column: str) -> Column:
        return F.max(F.when(F.col("mode") == mode, F.col(column)))

    modes = operation.groupBy("scenario").agg(
        of("bus", "max_fleet").alias("max_bus_fleet"),
        of("bus", "total_distance").alias("total_bus_distance"),
        of("metro", "max_fleet").alias("max_metro_fleet"),
        of("metro", "total_distance").alias("total_metro_distance"),
    )
    return people.join(modes, "scenario", "left").select(
        "scenario",
        "people_critical",
        "max_bus_fleet",
        "total_bus_distance",
        "max_metro_fleet",
        "total_metro_distance",
    )


def performance_labels(rows: DataFrame, total_population: DataFrame) -> DataFrame:
    """Percent text per scenario, fleet and distance relative to the largest."""
    share = F.round(ratio(F.col("people_critical"), scalar(total_population)) * 100, 1)
    text = F.concat(share.cast("string"), F.lit("%\n"), thousands(F.col("people_critical")), F.lit(" ind."))
    largest = record(
        rows.agg(F.max("max_bus_fleet").alias("fleet"), F.max("total_bus_distance").alias("metres"))
    )
    return rows.select(
        scenario_label(F.col("scenario")).alias("scenario"),
        text.alias("people_critical_perc"),
        ratio(F.col("max_bus_fleet"), largest["fleet"]).alias("fleet_norm"),
        ratio(F.col("total_bus_distance"), largest["metres"]).alias("distance_norm"),
    )


def scenario_tradeoff(rows: DataFrame) -> DataFrame:
    """People below the line against kilometres driven."""
    return rows.select(
        scenario_label(F.col("scenario")).alias("scenario"),
        "people_critical",
        (F.col("total_bus_distance") / 1000).alias("bus_km"),
        (F.col("total_metro_distance") / 1000).alias("metro_km"),
    )
