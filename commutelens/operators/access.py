"""Accessibility: jobs in reach of each origin, discounted by travel time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commutelens.functions.decay import SIGMAS, Kernel, gaussian, weighted
from commutelens.functions.labels import BASELINE
from commutelens.functions.numbers import ratio
from commutelens.operators.scalars import scalar
from commutelens.operators.travel import reachable, unreached

ZONE = ("id_hex", "pop", "R003")

# A sum of doubles depends in its last digits on the order rows arrive in.  Plans keep
# values to a millionth of a job, so that zones equal to each other or to a threshold
# stay equal, in every scenario and after every retry.
PLACES = 6


def _kept(value: Column, places: int | None) -> Column:
    whole = F.coalesce(value, F.lit(0.0))
    return whole if places is None else F.round(whole, places)


def jobs_by_time(
    ttm: DataFrame, origins: DataFrame, destinations: DataFrame, scenarios: Sequence[str]
) -> DataFrame:
    """Destinations and jobs per origin and travel time, unreachable ones at infinity."""
    finite = (
        reachable(ttm, origins, destinations)
        .groupBy("scenario", "from_id", "travel_time")
        .agg(F.sum("pairs").alias("pairs"), F.sum("jobs").alias("jobs"))
    )
    return finite.unionByName(unreached(finite, origins, destinations, scenarios))


def decayed(by_time: DataFrame, kernel: Kernel) -> DataFrame:
    """``dec_jobs`` = jobs discounted by the kernel."""
    return by_time.withColumn(
        "dec_jobs", weighted(F.col("jobs"), kernel, F.col("travel_time"))
    )


def _with_jobs(ttm: DataFrame, destinations: DataFrame) -> DataFrame:
    return ttm.where("from_id <> to_id").join(
        destinations.select(F.col("id").alias("to_id"), "jobs"), "to_id"
    )


def _for_scenarios(origins: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    return origins.select(
        F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario"),
        F.col("id").alias("id_hex"),
        "pop",
        "R003",
    )


def accessibility(
    ttm: DataFrame,
    origins: DataFrame,
    destinations: DataFrame,
    scenarios: Sequence[str],
    kernel: Kernel = gaussian(),
    places: int | None = None,
) -> DataFrame:
    """``(scenario, id_hex, pop, R003, cum_jobs)``, one row per origin and scenario.

    ``cum_jobs`` is rounded only where ``places`` are given.

    An unreachable pair adds nothing under either kernel, so the OD product is not
    needed: reachable pairs are summed per origin (map tasks pre-aggregate, so an
    origin with very many pairs is no burden) and origins without any get 0.
    """
    value = weighted(F.col("jobs"), kernel, F.col("travel_time"))
    gained = (
        _with_jobs(ttm, destinations)
        .groupBy("scenario", F.col("from_id").alias("id_hex"))
        .agg(F.sum(value).alias("_gained"))
    )
    return (
        _for_scenarios(origins, scenarios)
        .join(gained, ["scenario", "id_hex"], "left")
        .select("scenario", *ZONE, _kept(F.col("_gained"), places).alias("cum_jobs"))
    )


def sigma_fanout(
    ttm: DataFrame,
    origins: DataFrame,
    destinations: DataFrame,
    scenarios: Sequence[str],
    sigmas: Mapping[str, float] = SIGMAS,
    places: int | None = None,
) -> DataFrame:
    """Accessibility under several sigmas at once, rounded only where ``places`` are given.

    All sums are taken in the one grouping by origin; the rows are unfolded by
    sigma afterwards, so the shuffle is that of a single sigma.
    """
    sums = [
        F.sum(weighted(F.col("jobs"), gaussian(sigma), F.col("travel_time"))).alias(name)
        for name, sigma in sigmas.items()
    ]
    gained = (
        _with_jobs(ttm, destinations)
        .groupBy("scenario", F.col("from_id").alias("id_hex"))
        .agg(*sums)
    )
    cells = [
        F.struct(
            F.lit(name).alias("sigma_scenario"),
            F.lit(float(sigma)).alias("sigma"),
            _kept(F.col(name), places).alias("cum_jobs"),
        )
        for name, sigma in sigmas.items()
    ]
    return (
        _for_scenarios(origins, scenarios)
        .join(gained, ["scenario", "id_hex"], "left")
        .select("scenario", *ZONE, F.inline(F.array(*cells)))
    )


def sigma_label(sigma: Column, sigmas: Mapping[str, float] = SIGMAS) -> tuple[Column, Column]:
    """Name and rank of a sigma, matched after rounding to whole numbers."""
    name, rank = F.lit(None), F.lit(None)
    for position, (label, value) in reversed(list(enumerate(sigmas.items(), start=1))):
        same = F.round(sigma) == F.round(F.lit(float(value)))
        name = F.when(same, F.lit(label)).otherwise(name)
        rank = F.when(same, F.lit(position).cast("long")).otherwise(rank)
    return name, rank


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables, matched by column name."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


# -- wide, long, and against the baseline ------------------------------------------


def scenario_wide(access: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """One row per zone, one column per scenario."""
    return access.groupBy("id_hex", "pop").pivot("scenario", list(scenarios)).agg(F.max("cum_jobs"))


def scenario_long(wide: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    return wide.unpivot(["id_hex", "pop"], list(scenarios), "scenario", "cum_jobs")


def with_baseline(
    access: DataFrame, keys: Sequence[str] = (), baseline: str = BASELINE
) -> DataFrame:
    """Add each zone's baseline value as ``cum_jobs_bl``.

    The window holds one zone: one row per scenario (and key), never more.
    """
    zone = Window.partitionBy("id_hex", *keys)
    value = F.max(F.when(F.col("scenario") == baseline, F.col("cum_jobs"))).over(zone)
    return access.withColumn("cum_jobs_bl", value)


def diff_to_baseline(
    access: DataFrame,
    keys: Sequence[str] = (),
    total_jobs: DataFrame | None = None,
    baseline: str = BASELINE,
) -> DataFrame:
    """``diff`` = scenario minus baseline, as a share of all jobs if these are given."""
    diff = F.col("cum_jobs") - F.col("cum_jobs_bl")
    if total_jobs is not None:
        diff = ratio(diff, scalar(total_jobs))
    return (
        with_baseline(access, keys, baseline)
        .where(F.col("scenario") != baseline)
        .withColumn("diff", diff)
    )


def share_of_jobs(access: DataFrame, total_jobs: DataFrame) -> DataFrame:
    return access.withColumn("share", ratio(F.col("cum_jobs"), scalar(total_jobs)))
