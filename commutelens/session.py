"""Session defaults and the shared folder that cut lineage is written to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions and coalesces small ones at run time; both
# are Spark defaults, stated here because the operators count on them.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local benches; on a cluster, pass your own."""
    builder = SparkSession.builder.master(master).appName("commutelens")
    settings = {
        **ADAPTIVE,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir`` of the session.

    Where that is not set, the warehouse serves if it is in a shared store, or if there is
    but one machine (a local master).  Otherwise nothing is written at all: each executor
    would write to a disk of its own, and readers would see a part of the files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    local_master = (spark.conf.get("spark.master", None) or "").startswith("local")
    if warehouse and (local_master or urlsplit(warehouse).scheme not in ("", "file")):
        return f"{warehouse.rstrip('/')}/stored"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the folders that were made inside.

    A lazy result reads from such folders, so use it up before the scope ends.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`; an open :func:`scratch` takes note of it."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(folder)
    return folder


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Used where one input feeds several branches, or where partition ids must stay
    what they were.  The copy survives the loss of any executor, is computed once,
    and later reads take only the columns they need and know its size.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
