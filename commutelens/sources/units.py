"""Results that are made unit by unit: what is finished counts, what broke off is open.

A unit (a scenario, a generation, a trip that is left out) is written to a folder of its own
attempt; then a marker that names the attempt is renamed into place.  Readers go by the markers, so
a run that dies half-way leaves nothing that anybody reads, and the next run does the open
units only.  Of two runs at the same unit the first to place its marker counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "unit string, attempt string"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_unit(df: DataFrame, folder: str, unit: str) -> bool:
    """Write the rows of one unit; whether they are the ones that count."""
    spark = df.sparkSession
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{folder}/data/attempt={attempt}")
    store, draft = _path(spark, f"{folder}/draft/{attempt}")
    stream = store.create(draft, False)
    stream.write(bytearray(json.dumps({"unit": unit, "attempt": attempt}).encode()))
    stream.close()
    marker = _path(spark, f"{folder}/done/{quote(unit, safe='')}.json")[1]
    store.mkdirs(marker.getParent())
    # a rename on to a file fails in Hadoop's stores; the local one would replace it
    return not store.exists(marker) and store.rename(draft, marker)


def finished_units(spark: SparkSession, folder: str) -> DataFrame:
    """``unit, attempt`` of what is finished; of a folder that is not there yet, no rows."""
    store, done = _path(spark, f"{folder}/done")
    if not store.exists(done):
        return spark.createDataFrame([], MARKER)
    return spark.read.schema(MARKER).json(f"{folder}/done")


def read_units(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """``unit`` and the rows of all finished units; unfinished attempts are not read."""
    done = finished_units(spark, folder)
    store, data = _path(spark, f"{folder}/data")
    if not store.exists(data):
        return spark.createDataFrame([], T.StructType([T.StructField("unit", T.StringType()), *schema.fields]))
    # an attempt is a partition: the join tells the scan which folders to leave out
    whole = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    return spark.read.schema(whole).parquet(f"{folder}/data").join(done, "attempt").select("unit", *schema.names)


def run_open(spark: SparkSession, folder: str, work: Mapping[str, Callable[[], DataFrame]]) -> list[str]:
    """Make the units that are open, one after the other, and name them.

    ``work`` is the caller's own list of names; of the finished ones only these are looked up.
    """
    done = finished_units(spark, folder).where(F.col("unit").isin(list(work)))
    finished = {r.unit for r in done.select("unit").distinct().collect()}
    made = [unit for unit in work if unit not in finished]
    for unit in made:
        write_unit(work[unit](), folder, unit)
    return made
