"""Distribution of accessibility over people: curves, indices, bins and boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.functions.numbers import ratio
from commutelens.operators.running import running_total, weighted_quantiles
from commutelens.operators.scalars import record, scalar

# Area under the equality line below and above half of the people.
HALF_BELOW = 0.125
HALF_ABOVE = 0.375


def palma_ratio(access: DataFrame) -> DataFrame:
    """Mean of the top tenth of the people's zones over that of the lowest 40 %."""
    place = ratio(F.col("cum_pop"), F.col("cum_pop_total"))
    top, low = place >= 0.9, place <= 0.4
    return (
        running_total(access, ["scenario"], ["cum_jobs", "id_hex"], {"cum_pop": "pop"})
        .groupBy("scenario")
        .agg(
            F.avg(F.when(top, F.col("cum_jobs"))).alias("_top"),
            F.avg(F.when(low, F.col("cum_jobs"))).alias("_low"),
        )
        .select("scenario", ratio(F.col("_top"), F.col("_low")).alias("palma_ratio"))
    )


def lorenz_curve(access: DataFrame) -> DataFrame:
    """Cumulative accessibility against cumulative people, both ending at 1.

    ``_x0``/``_y0`` are the point before a row; they are exact, because the people
    are whole numbers, and make every trapezoid computable from its own row.
    """
    ranked = running_total(
        access.withColumn("tot_access", F.col("pop") * F.col("cum_jobs")),
        ["scenario"],
        ["cum_jobs", "id_hex"],
        {"cum_pop": "pop", "cum_access": "tot_access"},
    )
    people, reach = F.col("cum_pop_total"), F.col("cum_access_total")
    return ranked.select(
        "scenario",
        "id_hex",
        "pop",
        "cum_jobs",
        "tot_access",
        ratio(F.col("cum_access"), reach).alias("lorenz_access"),
        ratio(F.col("cum_pop"), people).alias("lorenz_pop"),
        ratio(F.col("cum_pop") - F.col("pop"), people).alias("_x0"),
        ratio(F.col("cum_access") - F.col("tot_access"), reach).alias("_y0"),
    )


def _trapezoid() -> Column:
    return (F.col("lorenz_pop") - F.col("_x0")) * (F.col("lorenz_access") + F.col("_y0")) / 2


def gini_severity(curve: DataFrame) -> DataFrame:
    """Gini and the part of it owed to the lower half of the people.

    Points with the same cumulative accessibility count once, at the last of them.
    Each half sums only the trapezoids between two of its own points, so the one
    before the first point and the one across the middle are left out.
    """
    # zones that reach nothing are one point at the height 0
    rises = F.col("tot_access") > 0
    flat_end = curve.where(~rises & (F.col("pop") > 0)).groupBy("scenario").agg(
        F.max("lorenz_pop").alias("_flat")
    )
    lower, from_lower = F.col("lorenz_pop") <= 0.5, F.col("_x0") <= 0.5
    within = rises & (F.col("_x0") > 0) & (lower == from_lower)
    sums = (
        curve.groupBy("scenario")
        .agg(
            F.sum(F.when(within & lower, _trapezoid())).alias("_lower"),
            F.sum(F.when(within & ~lower, _trapezoid())).alias("_upper"),
            F.count(F.when(rises & lower, True)).alias("_lower_points"),
            F.count(F.when(rises & ~lower, True)).alias("_upper_points"),
        )
        .join(flat_end, "scenario", "left")
    )
    flat = F.col("_flat")
    has_lower = (F.col("_lower_points") > 0) | F.coalesce(flat <= 0.5, F.lit(False))
    has_upper = (F.col("_upper_points") > 0) | F.coalesce(flat > 0.5, F.lit(False))
    areas = sums.select(
        "scenario",
        F.when(has_lower, F.coalesce("_lower", F.lit(0.0))).alias("Bs"),
        F.when(has_upper, F.coalesce("_upper", F.lit(0.0))).alias("Bns"),
    )
    shape = areas.select(
        "scenario",
        (F.col("Bns") + F.col("Bs")).alias("B"),
        (HALF_BELOW - F.col("Bs")).alias("As"),
        (HALF_ABOVE - F.col("Bns")).alias("Asn"),
    ).withColumn("A", F.col("As") + F.col("Asn"))
    return (
        shape.withColumn("gini", ratio(F.col("A"), F.col("A") + F.col("B")))
        .withColumn("severity", ratio(F.col("As"), F.col("A") + F.col("B")))
        .withColumn("severity_perc", ratio(F.col("severity"), F.col("gini")))
    )


def gini_exact(curve: DataFrame) -> DataFrame:
    """Gini with every trapezoid of the curve."""
    return curve.groupBy("scenario").agg((1 - 2 * F.sum(_trapezoid())).alias("gini"))


def access_cdf(access: DataFrame) -> DataFrame:
    """Share of people up to each accessibility value."""
    values = access.groupBy("scenario", "cum_jobs").agg(F.sum("pop").alias("pop"))
    return running_total(values, ["scenario"], ["cum_jobs"], {"_upto": "pop"}).select(
        "scenario",
        "cum_jobs",
        "pop",
        ratio(F.col("_upto"), F.col("_upto_total")).alias("cum_pop"),
    )


def access_cum_cdf(access: DataFrame) -> DataFrame:
    """Running accessibility against running people, over distinct values."""
    values = access.groupBy("scenario", "cum_jobs").agg(F.sum("pop").alias("pop"))
    return running_total(
        values, ["scenario"], ["cum_jobs"], {"_people": "pop", "_reach": "cum_jobs"}
    ).select(
        "scenario",
        "cum_jobs",
        ratio(F.col("_people"), F.col("_people_total")).alias("cum_pop"),
        ratio(F.col("_reach"), F.col("_reach_total")).alias("cum_cum_jobs"),
    )


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    width = (high - low) / bins
    place = F.floor((value - low) / F.nullif(width, F.lit(0.0)))
    return F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("long")


def weighted_histogram(access: DataFrame, threshold: DataFrame, bins: int = 60) -> DataFrame:
    """People per bin, all and below the threshold; one range for all scenarios."""
    span = record(access.agg(F.min("cum_jobs").alias("low"), F.max("cum_jobs").alias("high")))
    index = _bin(F.col("cum_jobs"), span["low"], span["high"], bins)
    below = F.when(F.col("cum_jobs") < scalar(threshold), F.col("pop")).otherwise(0)
    return access.groupBy("scenario", index.alias("bin")).agg(
        F.sum("pop").alias("pop"), F.sum(below).alias("pop_critical")
    )


def weighted_histogram_sigma(
    access: DataFrame, thresholds: DataFrame, bins: int = 60
) -> DataFrame:
    """The same per scenario and sigma, each with its own range.

    The table of ranges has one row per scenario and sigma; Spark picks the join by its size.
    """
    panel = ["scenario", "sigma_scenario"]
    span = access.groupBy(*panel).agg(
        F.min("cum_jobs").alias("_low"), F.max("cum_jobs").alias("_high")
    )
    index = _bin(F.col("cum_jobs"), F.col("_low"), F.col("_high"), bins)
    below = F.when(F.col("cum_jobs") < F.col("critical_access"), F.col("pop")).otherwise(0)
    return (
        access.join(span.join(thresholds, "sigma_scenario"), panel)
        .groupBy(*panel, index.alias("bin"))
        .agg(F.sum("pop").alias("pop"), F.sum(below).alias("pop_critical"))
    )


def boxplot_stats(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """Quartiles, and the furthest values within 1.5 interquartile ranges of them."""
    quartiles = weighted_quantiles(
        df, keys, value, weight, {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    counted = df if weight is None else df.where(F.col(weight) > 0)
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        counted.join(quartiles, list(keys))
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("low"),
            F.max(F.when(inside, F.col(value))).alias("high"),
            F.count("*").alias("n"),
        )
    )
