"""File sources and sinks, one DataFrame per table, schemas fixed."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commutelens import schemas
from commutelens.functions.clock import clock_text, seconds_of
from commutelens.functions.geo import ring_of
from commutelens.operators.access import stack
from commutelens.operators.feed import Feed
from commutelens.session import cut


def read_feed(spark: SparkSession, folder: str, fmt: str = "parquet") -> Feed:
    """A feed from ``<folder>/<table>``, CSV with header or Parquet."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return Feed(
        **{
            table: reader.schema(schema).load(f"{folder}/{table}")
            for table, schema in schemas.FEED.items()
        }
    )


def write_feed(feed: Feed, folder: str, fmt: str = "parquet") -> None:
    for table, df in feed.tables().items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{folder}/{table}")


# Columns of the public timetable text format, and ours.
_TEXT_COLUMNS = {
    "trips": {"trip_id": "string", "route_id": "string", "service_id": "string", "shape_id": "string", "direction_id": "long"},
    "stop_times": {"trip_id": "string", "stop_sequence": "long", "stop_id": "string", "arrival_time": "clock", "departure_time": "clock"},
    "stops": {"stop_id": "string", "stop_lon": "double", "stop_lat": "double"},
    "routes": {"route_id": "string"},
    "shapes": {"shape_id": "string", "shape_pt_sequence": "long", "shape_pt_lon": "double", "shape_pt_lat": "double"},
    "calendar": {"service_id": "string", "start_date": "day", "end_date": "day", **{d: "long" for d in schemas.WEEKDAYS}},
    "calendar_dates": {"service_id": "string", "date": "day", "exception_type": "long"},
}
_REQUIRED = {
    "trips": ("trip_id", "route_id", "service_id"),
    "stop_times": ("trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"),
    "stops": ("stop_id", "stop_lon", "stop_lat"),
    "routes": ("route_id",),
}
_OUR_NAMES = {"stop_lon": "lon", "stop_lat": "lat", "shape_pt_lon": "lon", "shape_pt_lat": "lat"}


def read_text_feed(spark: SparkSession, folder: str) -> Feed:
    """A feed from the usual text files ``<folder>/<table>.txt``; all ids are text.

    Columns are found by header name, whatever their order.  A file or column that a feed
    can't be without raises ``ValueError``; optional ones that are missing come out empty.
    Clock times become seconds after midnight and may pass 24:00:00; a blank one is
    NULL, and a time filter or search leaves such a stop out.
    """
    absent: list[str] = []

    def load(table: str) -> DataFrame:
        wanted = _TEXT_COLUMNS[table]
        try:
            raw = spark.read.option("header", True).csv(f"{folder}/{table}.txt")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            absent.append(table)
            raw = spark.createDataFrame([], ", ".join(f"{c} string" for c in wanted))

        lacking = [c for c in _REQUIRED.get(table, ()) if c not in raw.columns]
        if lacking:
            raise ValueError(f"{table}.txt has no {', '.join(lacking)}")

        def parse(column: str, kind: str) -> Column:
            if column not in raw.columns:
                return F.lit(None).cast("long" if kind == "clock" else kind)
            text = F.trim(F.col(column))
            if kind == "clock":
                return seconds_of(text)
            if kind == "day":
                return F.to_date(text, "yyyyMMdd")
            return text if kind == "string" else text.cast(kind)

        return raw.select(
            *[parse(c, kind).alias(_OUR_NAMES.get(c, c)) for c, kind in wanted.items()]
        )

    feed = Feed(**{table: load(table) for table in _TEXT_COLUMNS})
    missing = [t for t in ("trips", "stop_times", "stops", "routes") if t in absent]
    if {"calendar", "calendar_dates"} <= set(absent):
        missing.append("calendar or calendar_dates")
    if missing:
        raise ValueError(f"no feed in {folder}: without {', '.join(missing)}")
    return feed


def write_text_feed(feed: Feed, folder: str) -> None:
    """The feed as text files that other timetable tools read."""
    for table, df in feed.tables().items():
        columns = []
        for column, kind in _TEXT_COLUMNS[table].items():
            value = F.col(_OUR_NAMES.get(column, column))
            if kind == "clock":
                value = clock_text(value)
            elif kind == "day":
                value = F.date_format(value, "yyyyMMdd")
            columns.append(value.alias(column))
        write_csv(df.select(*columns), f"{folder}/{table}.txt")


def read_zones(grid: DataFrame, landuse: DataFrame) -> DataFrame:
    """Zone grid with its land use, where there is any; ``polygon`` becomes a ``ring``."""
    if "polygon" in grid.columns:
        grid = grid.withColumn("ring", ring_of(F.col("polygon"))).drop("polygon")
    return grid.join(landuse, "id_hex", "left")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One CSV with header; types are inferred when no schema is given.

    Inference reads the file once more, so pass the schema where it is known.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_matching(
    spark: SparkSession, folder: str, pattern: str, schema: T.StructType
) -> DataFrame:
    """All files below ``folder`` whose name matches, headers checked against the schema."""
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .schema(schema)
        .csv(folder)
    )


def read_stacked(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A few tables with different headers, stacked by column name."""
    return stack([read_csv(spark, path) for path in paths])


def with_model(df: DataFrame, pattern: str, name: str = "model") -> DataFrame:
    """Add the part of each row's file path that ``pattern`` captures."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_tolerant(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows, unreadable lines, and the ``file`` names that gave neither.

    Files that can't be read are passed over; they (and empty ones) make up the third
    table.  Whether a line is readable shows only when all its fields are parsed, so the
    files are parsed once, whole, and all results come from the stored table.
    """
    raw, files = _parsed(spark, path, schema, header)
    silent = files.join(raw.select(_one_slash("_file")).distinct(), "file", "left_anti")
    good = raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file")
    return good, raw.where(F.col(CORRUPT).isNotNull()).select(CORRUPT), silent


CORRUPT = "_unreadable"


def _parsed(spark: SparkSession, path: str, schema: T.StructType, header: bool) -> tuple[DataFrame, DataFrame]:
    """All lines with the name of their file, as a stored table, and the names of all files."""
    found = (
        spark.read.option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreCorruptFiles", True)
        .schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
        .csv(path)
    )
    files = spark.createDataFrame([(f,) for f in found.inputFiles()], "_file string").select(_one_slash("_file"))
    return cut(found.withColumn("_file", F.col("_metadata.file_path"))), files


def _one_slash(column: str) -> Column:
    """A local path has one slash in one place and three in the other."""
    return F.regexp_replace(column, "^file:/+", "file:/").alias("file")


def _listed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``file, bytes, content`` of files that hold something; the content is read only if it is used."""
    listed = spark.read.format("binaryFile").options(**options).load(path)
    return listed.select("length", "content", F.col("_metadata.file_path").alias("_file")).select(
        _one_slash("_file"), F.col("length").alias("bytes"), "content"
    )


def _ends_whole(content: bytes) -> bool:
    """Whether a gzip file can be read to its end; a megabyte of it is unpacked at a time."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
        try:
            while stream.read(1 << 20):
                pass
        except (EOFError, OSError, zlib.error):
            return False
    return True


def file_manifest(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, most: int = 1 << 30
) -> DataFrame:
    """``file, bytes, rows, bad_lines, state`` of each file of a folder.

    A file that breaks off gives the rows before the break and no error, so the counts alone don't
    show it: gzip files are unpacked to their end.  ``state`` is ``whole``, ``damaged`` (what
    rows there are may not be all), ``empty`` (no line but the header), or ``unchecked``: a gzip file
    of more than ``most`` bytes, which is more than one value should hold.
    """
    raw, files = _parsed(spark, path, schema, header)
    counts = raw.groupBy(_one_slash("_file")).agg(
        F.count(F.when(F.col(CORRUPT).isNull(), 1)).alias("rows"), F.count(CORRUPT).alias("bad_lines")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [_ends_whole(c.as_py()) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(ends, pa.bool_())], ["file", "ends"])

    packed = _listed(spark, path, pathGlobFilter="*.gz").where(F.col("bytes") <= most)
    ends = packed.select("file", "content").mapInArrow(check, "file string, ends boolean")
    state = (
        F.when(~F.col("ends"), "damaged")
        .when(F.col("file").endswith(".gz") & F.col("ends").isNull(), "unchecked")
        .when(F.col("rows").isNull(), "empty")
        .otherwise("whole")
    )
    none = F.lit(0).cast("long")
    return (
        files.join(_listed(spark, path).select("file", "bytes"), "file", "left")
        .join(counts, "file", "left")
        .join(ends, "file", "left")
        .select(
            "file",
            F.coalesce("bytes", none).alias("bytes"),
            F.coalesce("rows", none).alias("rows"),
            F.coalesce("bad_lines", none).alias("bad_lines"),
            state.alias("state"),
        )
    )


def write_ttm(ttm: DataFrame, folder: str) -> None:
    """Travel times, one folder per scenario."""
    ttm.write.mode("overwrite").partitionBy("scenario").parquet(folder)


def read_ttm(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.TTM).parquet(folder)


def write_csv(df: DataFrame, folder: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(folder)


def write_scalar(table: DataFrame, folder: str) -> None:
    """Save a one-row table."""
    table.write.mode("overwrite").parquet(folder)


def read_scalar(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.DoubleType())])
    return spark.read.schema(schema).parquet(folder)


def write_candidates(candidates: DataFrame, folder: str) -> None:
    candidates.write.mode("overwrite").partitionBy("generation").parquet(folder)


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.CANDIDATES).parquet(folder)


def inline_table(df: DataFrame, rows: Mapping[str, float], key: str, value: str) -> DataFrame:
    """Pair each row of ``df`` with every row of a short literal table."""
    entries: list[Column] = [
        F.struct(F.lit(name).alias(key), F.lit(number).alias(value))
        for name, number in rows.items()
    ]
    return df.select("*", F.inline(F.array(*entries)))
