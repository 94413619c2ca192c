"""Units of work: markers decide what is finished."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commutelens.operators.select_trips import remaining_work
from commutelens.sources import units

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def rows(spark, n, value):
    return spark.range(n).withColumn("v", F.lit(value))


def broken(spark):
    """Some rows are written, then a task fails."""
    fails = F.when(F.col("id") == 95, F.raise_error(F.lit("lost"))).otherwise(F.lit("half"))
    return spark.range(0, 100, 1, 10).withColumn("v", fails.cast("string"))


def test_a_unit_that_breaks_off_is_open(spark, tmp_path):
    folder = str(tmp_path / "work")
    assert units.read_units(spark, folder, SCHEMA).collect() == []
    made = []

    def work(third):
        def named(unit, make):
            return unit, lambda: made.append(unit) or make()

        return dict([named("a/1", lambda: rows(spark, 3, "a")), named("b", lambda: rows(spark, 0, "b")), named("c", third)])

    with pytest.raises(Exception, match="lost"):
        units.run_open(spark, folder, work(lambda: broken(spark)))
    assert made == ["a/1", "b", "c"]
    assert {r.unit for r in units.finished_units(spark, folder).collect()} == {"a/1", "b"}
    todo = spark.createDataFrame([("a/1",), ("b",), ("c",)], "unit string")
    assert [r.unit for r in remaining_work(todo, units.finished_units(spark, folder), "unit").collect()] == ["c"]
    assert units.run_open(spark, folder, work(lambda: rows(spark, 2, "c"))) == ["c"]
    assert units.run_open(spark, folder, work(lambda: rows(spark, 2, "c"))) == []
    got = sorted((r.unit, r.id, r.v) for r in units.read_units(spark, folder, SCHEMA).collect())
    assert got == [("a/1", 0, "a"), ("a/1", 1, "a"), ("a/1", 2, "a"), ("c", 0, "c"), ("c", 1, "c")]


def test_files_without_a_marker_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "work")
    units.write_unit(rows(spark, 2, "whole"), folder, "a")
    # a driver that died between the rows and the marker
    rows(spark, 5, "half").write.parquet(f"{folder}/data/attempt=dead")
    assert {r.v for r in units.read_units(spark, folder, SCHEMA).collect()} == {"whole"}


def test_the_first_marker_counts(spark, tmp_path):
    folder = str(tmp_path / "work")
    assert units.write_unit(rows(spark, 2, "first"), folder, "a")
    assert not units.write_unit(rows(spark, 7, "second"), folder, "a")
    assert [r.v for r in units.read_units(spark, folder, SCHEMA).collect()] == ["first"] * 2
