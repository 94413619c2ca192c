import os

import pytest
from pyspark.sql import functions as F

from commutelens import schemas
from commutelens.operators import feed as FD
from commutelens.operators import shapes as SH
from commutelens.plans import inputs as I
from commutelens.session import cut, new_folder, scratch, shared_dir
from commutelens.sources import files as IO
from commutelens.streaming.intake import take_in_results


def test_shared_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert new_folder(spark, "x").startswith(named + "/x-")
    assert cut(spark.range(5), "five").count() == 5
    assert any(f.startswith("five-") for f in os.listdir(named))


class Unset:
    """Stands for a session on a cluster that names no shared folder."""

    def __init__(self, **settings):
        self.conf = self
        self.get = settings.get


def test_no_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Unset(**{"spark.master": "yarn", "spark.sql.warehouse.dir": "file:/x/spark-warehouse"}))
    there = Unset(**{"spark.master": "yarn", "spark.sql.warehouse.dir": "hdfs://n/warehouse"})
    assert shared_dir(there) == "hdfs://n/warehouse/stored"
    here = Unset(**{"spark.master": "local[4]", "spark.sql.warehouse.dir": "file:/x/spark-warehouse"})
    assert shared_dir(here) == "file:/x/spark-warehouse/stored"


def test_nothing_is_left_behind(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(named))
    with scratch(spark):
        kept = cut(spark.range(7), "seven")
        assert kept.count() == 7 and set(os.listdir(named)) != before
    assert set(os.listdir(named)) == before


def test_feed_round_trip(spark, sf_dir, tmp_path):
    feed = I.feed(spark, sf_dir)
    for fmt in ("csv", "parquet"):
        folder = str(tmp_path / fmt)
        IO.write_feed(feed, folder, fmt)
        back = IO.read_feed(spark, folder, fmt)
        for name, df in feed.tables().items():
            other = back.tables()[name]
            assert other.dtypes == df.select(other.columns).dtypes
            assert df.select(other.columns).exceptAll(other).count() == 0
            assert other.count() == df.count()


def test_text_feed_round_trip(spark, sf_dir, tmp_path):
    feed = I.feed(spark, sf_dir)
    IO.write_text_feed(feed, str(tmp_path))
    back = IO.read_text_feed(spark, str(tmp_path)).tables()
    for name, df in feed.tables().items():
        same = back[name].select(*[F.col(c).cast(t).alias(c) for c, t in df.dtypes])
        assert df.exceptAll(same).count() == 0 and same.count() == df.count()


def test_text_feed_in_any_column_order(spark, tmp_path):
    files = {
        "trips": "service_id,trip_id,route_id\nwd,t1,r1\n",
        "stop_times": "stop_id,trip_id,arrival_time,departure_time,stop_sequence,pickup_type\ns1,t1,25:10:00,25:10:30,1,0\n",
        "stops": "stop_id,stop_name,stop_lat,stop_lon\ns1,Central,-3.7,-38.5\n",
        "routes": "route_id,route_short_name\nr1,one\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwd,1,1,1,1,1,0,0,20211201,20211231\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text)
    feed = IO.read_text_feed(spark, str(tmp_path))
    assert tuple(feed.stop_times.first()) == ("t1", 1, "s1", 90600, 90630)
    assert tuple(feed.stops.first()) == ("s1", -38.5, -3.7)
    assert tuple(feed.trips.first()) == ("t1", "r1", "wd", None, None)
    assert feed.shapes.count() == 0 and feed.calendar_dates.count() == 0
    assert FD.filter_date(feed).trips.count() == 1
    # no shapes, one stop: the trip has a length all the same
    assert SH.distance_by_trip(feed).first().distance == 0.0


REQUIRED = {
    "trips": "trip_id,route_id,service_id\nt1,r1,wd\n",
    "stop_times": "trip_id,stop_sequence,stop_id,arrival_time,departure_time\nt1,1,s1,07:00:00,\n",
    "stops": "stop_id,stop_lat,stop_lon\ns1,-3.7,-38.5\n",
    "routes": "route_id\nr1\n",
    "calendar_dates": "service_id,date,exception_type\nwd,20211201,1\n",
}


@pytest.mark.parametrize("left_out", REQUIRED)
def test_required_files_must_exist(spark, tmp_path, left_out):
    for name, text in REQUIRED.items():
        if name != left_out:
            (tmp_path / f"{name}.txt").write_text(text)
    with pytest.raises(ValueError, match=left_out):
        IO.read_text_feed(spark, str(tmp_path))


def test_required_columns_must_exist(spark, tmp_path):
    for name, text in REQUIRED.items():
        (tmp_path / f"{name}.txt").write_text(text)
    assert IO.read_text_feed(spark, str(tmp_path)).stop_times.first().departure_time is None
    (tmp_path / "stops.txt").write_text("stop_id,stop_lat\ns1,-3.7\n")
    with pytest.raises(ValueError, match="stop_lon"):
        IO.read_text_feed(spark, str(tmp_path))


def test_stacking_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("scenario,fleet\nbaseline,3\n")
    (tmp_path / "b.csv").write_text("fleet,scenario,metro\n4,optimal,1\n")
    rows = IO.read_stacked(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert {(r.scenario, r.fleet, r.metro) for r in rows} == {("baseline", 3, None), ("optimal", 4, 1)}


def test_bad_rows_are_set_aside(spark, tmp_path):
    (tmp_path / "x.csv").write_text("scenario,max_fleet,total_distance\na,1,2.5\nnonsense\nb,x,1\nc,3,4.5\n")
    (tmp_path / "broken.csv.gz").write_bytes(b"\x1f\x8b no archive")
    good, bad, silent = IO.read_tolerant(spark, str(tmp_path), schemas.REMOVAL_COST)
    assert sorted(r.scenario for r in good.collect()) == ["a", "c"]
    assert bad.count() == 2
    assert [r.file.rsplit("/", 1)[1] for r in silent.collect()] == ["broken.csv.gz"]


def test_manifest_tells_files_that_break_off(spark, tmp_path):
    import gzip
    import random

    header, some = "scenario,max_fleet,total_distance\n", random.Random(3)
    lines = "".join(f"s{i},{some.randrange(99)},{some.random()}\n" for i in range(20_000))
    packed = gzip.compress((header + lines).encode())
    (tmp_path / "a file.csv").write_text(header + "a,1,2.5\nnonsense\nb,x,1\nc,3,4.5\n")
    (tmp_path / "whole.csv.gz").write_bytes(packed)
    (tmp_path / "two.csv.gz").write_bytes(gzip.compress(header.encode()) + gzip.compress(b"a,1,2.5\n"))
    (tmp_path / "cut.csv.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "broken.csv.gz").write_bytes(b"\x1f\x8b no archive")
    (tmp_path / "only-header.csv").write_text(header)
    (tmp_path / "nothing.csv").write_text("")
    found = IO.file_manifest(spark, str(tmp_path), schemas.REMOVAL_COST).collect()
    got = {r.file.rsplit("/", 1)[1].replace("%20", " "): r for r in found}
    assert len(found) == 7
    assert {n: r.state for n, r in got.items()} == {
        "a file.csv": "whole", "whole.csv.gz": "whole", "two.csv.gz": "whole", "cut.csv.gz": "damaged",
        "broken.csv.gz": "damaged", "only-header.csv": "empty", "nothing.csv": "empty",
    }
    assert (got["a file.csv"].rows, got["a file.csv"].bad_lines) == (2, 2)
    assert (got["whole.csv.gz"].rows, got["two.csv.gz"].rows, got["broken.csv.gz"].rows) == (20_000, 1, 0)
    assert got["cut.csv.gz"].rows < 20_000 and got["cut.csv.gz"].bytes == len(packed) // 2
    unchecked = IO.file_manifest(spark, str(tmp_path), schemas.REMOVAL_COST, most=100).where("state = 'unchecked'")
    assert {r.file.rsplit("/", 1)[1] for r in unchecked.collect()} == {"whole.csv.gz", "cut.csv.gz"}


def test_model_from_file_name(spark, tmp_path):
    for trip in (17, 18):
        (tmp_path / f"{trip}.prfmnc.csv").write_text(
            f"scenario,max_fleet,total_distance\nx,{trip},1.0\n"
        )
    (tmp_path / "other.txt").write_text("no table")
    found = IO.read_matching(spark, str(tmp_path), "*.prfmnc.csv", schemas.REMOVAL_COST)
    rows = IO.with_model(found, r"([0-9]+)\.prfmnc\.csv$").collect()
    assert {(r.model, r.max_fleet) for r in rows} == {("17", 17), ("18", 18)}


def test_intake_resumes_with_new_files_only(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    os.makedirs(source)

    def drop(trip):
        with open(f"{source}/{trip}.csv", "w") as f:
            f.write(f"scenario,max_fleet,total_distance\nm,{trip},1.0\n")

    def run():
        take_in_results(spark, source, target, progress).awaitTermination(120)
        return sorted(r.model for r in spark.read.parquet(target).collect())

    drop(1)
    drop(2)
    assert run() == ["1", "2"]
    drop(3)
    assert run() == ["1", "2", "3"]
    assert run() == ["1", "2", "3"]


def test_ttm_is_stored_by_scenario(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "ttm")
    IO.write_ttm(I.ttm(spark, sf_dir), folder)
    one = IO.read_ttm(spark, folder).where(F.col("scenario") == "optimal")
    assert "PartitionFilters: [isnotnull(scenario" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == I.ttm(spark, sf_dir).where("scenario = 'optimal'").count()
