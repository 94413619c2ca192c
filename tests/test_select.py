import math
import random

import pytest
from pyspark.sql import functions as F

from commutelens import schemas
from commutelens.functions.decay import inverse
from commutelens.operators import feed as FD
from commutelens.operators import select_trips as S


@pytest.fixture(scope="module")
def lengths(spark):
    rows = [(t % 3, t, float((t * 7) % 11)) for t in range(20)]
    return spark.createDataFrame(rows, "route_id long, trip_id long, distance double")


def test_min_service_takes_the_first_trips(lengths):
    assert sorted(r.trip_id for r in S.min_service(lengths, 2).collect()) == [0, 1, 2, 3, 4, 5]


def test_greedy_fill_by_hand(lengths):
    rows = [(r.trip_id, r.distance) for r in lengths.collect()]
    served = [r for r in rows if r[0] < 6]
    left = 60 - sum(d for _, d in served)
    kept, cost = [], 0.0
    for t, d in sorted((r for r in rows if r[0] >= 6), key=lambda r: (-r[1], r[0])):
        cost += d
        if cost <= left:
            kept.append(t)
    got = S.greedy_fill(lengths, 60.0, 2).collect()
    assert sorted(r.trip_id for r in got if not r.minimum) == sorted(kept)
    assert sorted(r.trip_id for r in got if r.minimum) == [t for t, _ in served]


def test_loo_distance(lengths):
    total = sum(r.distance for r in lengths.collect())
    own = {r.trip_id: r.distance for r in lengths.collect()}
    got = {r.trip_id: r.total_distance for r in S.loo_distance(lengths).collect()}
    assert got == pytest.approx({t: total - d for t, d in own.items()})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loo_fleet_by_removing_each_trip(spark, seed):
    rnd = random.Random(seed)
    visits = []
    for t in range(12):
        start = rnd.randint(0, 40)
        visits += [(t, 1, 1, start, start), (t, 2, 2, start + rnd.randint(0, 25), start + 30)]
    visits = [(t, q, s, a, a) for t, q, s, a, _ in visits]
    stop_times = spark.createDataFrame(visits, schemas.STOP_TIMES)
    trips = spark.createDataFrame([(t,) for t in range(12)], "trip_id long")
    got = {r.trip_id: r.max_fleet for r in S.loo_fleet(trips, stop_times).collect()}
    spans = {t: sorted(a for u, _, _, a, _ in visits if u == t) for t in range(12)}
    for left_out in spans:
        others = [s for t, s in spans.items() if t != left_out]
        peak = max(sum(a <= x < b for a, b in others) for x in range(80))
        assert got[left_out] == peak


def test_candidates_cost_elite_and_addition(spark, lengths):
    listed = spark.createDataFrame([(1, t) for t in range(10)] + [(2, 3)], "cand_id long, trip_id long")
    costs = {r.cand_id: (r.distance, r.feasible) for r in S.candidate_cost(lengths, listed, 20.0).collect()}
    assert costs[2] == (10.0, True) and costs[1][1] is False
    added = S.candidate_add(listed, S.min_service(lengths, 1), 9)
    assert added.where("cand_id = 9").count() == 3
    scored = spark.createDataFrame([(i, -float(i // 2)) for i in range(8)], "cand_id long, fitness double")
    assert [r.cand_id for r in S.candidate_elite(scored, 3).collect()] == [0, 1, 2]


def test_fitness_by_hand(spark):
    zones = {f"z{i}": (5 + i, 10 * (i % 3)) for i in range(8)}  # people, jobs
    rnd = random.Random(7)
    foot = {(a, b): rnd.randint(1, 15) for a in zones for b in zones if a != b and rnd.random() < 0.3}
    rides = {
        (c, a, b): rnd.randint(1, 60)
        for c in (1, 2, 3) for a in zones for b in zones if a != b and rnd.random() < 0.3
    }
    line = 4.0
    origins = spark.createDataFrame([(z, p) for z, (p, _) in zones.items()], "id string, pop long")
    ends = spark.createDataFrame([(z, j) for z, (_, j) in zones.items() if j], "id string, jobs long")
    costs = spark.createDataFrame(
        [(1, 2, 5.0, True), (2, 2, 5.0, True), (3, 2, 50.0, False), (4, 1, 1.0, True)],
        "cand_id long, trips long, distance double, feasible boolean",
    )
    got = {
        r.cand_id: r.fitness
        for r in S.candidate_fitness(
            costs,
            spark.createDataFrame([(*k, v) for k, v in rides.items()], "cand_id long, from_id string, to_id string, travel_time long"),
            spark.createDataFrame([(*k, v) for k, v in foot.items()], "from_id string, to_id string, travel_time long"),
            origins,
            ends,
            line,
            inverse(),
        ).collect()
    }
    for c in (1, 2, 4):
        people = 0
        for a, (p, _) in zones.items():
            reach = 0.0
            for b, (_, j) in zones.items():
                t = min(foot.get((a, b), math.inf), rides.get((c, a, b), math.inf))
                reach += j / t
            people += p if round(reach, 6) <= line else 0
        assert got[c] == -people
    assert got[3] == -math.inf


def test_flat_list_and_remaining_work(spark):
    flat = spark.createDataFrame(
        list(enumerate(["a", "3", "1.5", "b", "4", "2.5"])), "pos long, value string"
    )
    rows = sorted(tuple(r) for r in S.flat_list_to_table(flat).collect())
    assert rows == [("a", 3.0, 1.5), ("b", 4.0, 2.5)]
    work = spark.range(5).withColumnRenamed("id", "trip_id")
    done = work.where("trip_id < 2").union(work.where("trip_id < 2"))
    assert sorted(r[0] for r in S.remaining_work(work, done).collect()) == [2, 3, 4]


def test_fleet_max_per_key(spark):
    stop_times = spark.createDataFrame(
        [(t, q, q, 100 * q + t, 100 * q + t) for t in range(4) for q in (1, 2)], schemas.STOP_TIMES
    )
    trips = spark.range(4).select(
        F.col("id").alias("trip_id"), F.when(F.col("id") < 3, "x").otherwise("y").alias("scenario")
    )
    got = {r.scenario: r.max_fleet for r in FD.fleet_max(trips, stop_times, ["scenario"]).collect()}
    assert got == {"x": 3, "y": 1}
