"""Take in the result files of single-removal runs as they appear.

A run over thousands of removed trips drops one small file per model and is
resumed after a stop.  A file stream remembers in its checkpoint which files it has
read, so each start takes the new ones and no file lists are compared.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from commutelens.schemas import REMOVAL_COST
from commutelens.sources.files import with_model


def take_in_results(
    spark: SparkSession,
    folder: str,
    target: str,
    progress: str,
    pattern: str = r"([^/]+)\.csv$",
    schema: T.StructType = REMOVAL_COST,
) -> StreamingQuery:
    """Append the rows of all new CSV files below ``folder`` to ``target``."""
    arrived = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    return (
        with_model(arrived, pattern)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
