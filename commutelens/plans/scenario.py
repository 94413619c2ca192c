"""A study: inputs, accessibility of all scenarios, threshold, performance rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commutelens.operators import access as A
from commutelens.operators import equity as Q
from commutelens.operators import feed as FD
from commutelens.operators import shapes as SH
from commutelens.operators import zones as Z
from commutelens.operators.feed import Feed
from commutelens.plans import inputs as I
from commutelens.session import cut


class Study:
    """The tables one comparison of scenarios hangs on.

    ``plain_*`` are lazy.  ``access`` and ``sigma_access`` are written once, because
    the threshold and the tables compared with it both start from them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.zones = I.zones(spark, sf_dir)
        self.origins = Z.origins(self.zones)
        self.destinations = Z.destinations(self.zones)
        self.ttm = I.ttm(spark, sf_dir)

    def plain_access(self) -> DataFrame:
        return A.accessibility(self.ttm, self.origins, self.destinations, I.CODES, places=A.PLACES)

    def plain_sigma_access(self) -> DataFrame:
        return A.sigma_fanout(self.ttm, self.origins, self.destinations, I.CODES, places=A.PLACES)

    @cached_property
    def _access(self) -> DataFrame:
        return cut(self.plain_access())

    @cached_property
    def _sigma_access(self) -> DataFrame:
        return cut(self.plain_sigma_access())

    def access(self) -> DataFrame:
        return self._access

    def sigma_access(self) -> DataFrame:
        return self._sigma_access

    def jobs(self) -> DataFrame:
        return Z.total_jobs(self.destinations)

    def population(self) -> DataFrame:
        return Z.total_population(self.origins)

    def threshold(self) -> DataFrame:
        return Q.critical_threshold(self.access())

    def sigma_thresholds(self) -> DataFrame:
        return Q.sigma_thresholds(self.sigma_access())

    def transitions(self) -> DataFrame:
        return Q.critical_transition(self.access(), self.threshold())

    def operation(self) -> DataFrame:
        """Peak fleet and distance per scenario and mode, both modes in one pass.

        A trip keeps the set of its scenarios until trips are counted, so four scenarios
        or four hundred shuffle the same rows.
        """
        whole = I.feed(self.spark, self.sf_dir)
        mode = F.when(F.col("route_id") < 3, F.lit("metro")).otherwise("bus")
        trips = I.scenario_trips(self.spark, self.sf_dir).withColumn("mode", mode)
        fleet = FD.fleet_max(trips, whole.stop_times, ["mode"], "scenario")
        metres = SH.distance_total(Feed(**{**whole.tables(), "trips": trips}), ["mode"], "scenario")
        return fleet.join(metres, ["scenario", "mode"])

    def performance(self) -> DataFrame:
        """People below the line, fleets and distances: one row per scenario."""
        people = Q.critical_population(self.access(), self.threshold())
        return Q.performance(people, self.operation())


def people_below_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main question: how many people each scenario leaves below the line."""
    study = Study(spark, sf_dir)
    return Q.critical_population(study.access(), study.threshold()).orderBy("scenario")
