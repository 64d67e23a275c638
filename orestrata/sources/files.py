"""Incremental and batch reading of raw files.

A stream lists new files by name only (the content column of the binary source is pruned away); each batch reads its
files by header, so a column that moves, comes or goes lands under its name. Types stay strings until validation.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_rescued"


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The first line of a file as CSV fields, read by the driver: one short read a file of a bounded batch."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([line.lstrip("﻿")]))) if line else ()


def read_csv_by_header(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """Files with headers of any order and set: one read a distinct header, joined by name; absent columns are null.
    Adds _source_file. None if no file has a header."""
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for p in sorted(paths):
        groups[header_of(spark, p)].append(p)
    out: DataFrame | None = None
    for header, files in groups.items():
        if not header:
            continue
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        df = spark.read.schema(schema).option("header", True).option("multiLine", False).csv(files).withColumn("_source_file", F.col("_metadata.file_path"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def new_files(spark: SparkSession, folder: str, max_files: int = 1000, glob: str = "*.csv") -> DataFrame:
    """A stream of the paths of files not seen before."""
    return (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", max_files).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .load(folder).select("path")
    )


def ingest_csv(spark: SparkSession, folder: str, checkpoint: str, land: Callable[[DataFrame, int], None], max_files: int = 1000, extra: dict[str, Column] | None = None) -> None:
    """Drains the files not yet seen into land(rows, batch_id), then stops. Rows carry _ingestion_ts and _source_file."""

    def each(paths: DataFrame, batch_id: int) -> None:
        found = [r.path for r in paths.distinct().collect()]  # at most max_files names
        rows = read_csv_by_header(spark, found) if found else None
        if rows is not None:
            rows = rows.withColumn("_ingestion_ts", F.current_timestamp())
            land(rows.withColumns(extra) if extra else rows, batch_id)

    query = new_files(spark, folder, max_files).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def json_stream(spark: SparkSession, folder: str, schema: T.StructType | str, max_files: int = 1000) -> DataFrame:
    """A stream of JSON objects, one a line, with the given fields typed; a line that does not fit is kept in _rescued."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    df = spark.readStream.schema(full).option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", max_files).json(folder)
    return df.select("*", F.col("_metadata.file_path").alias("_source_file")).withColumns({"_ingestion_ts": F.current_timestamp(), "_ingestion_date": F.current_date()})


def table_stream(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int = 1000) -> DataFrame:
    """A Parquet folder consumed as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def strict_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A whole folder with one fixed header; anything else fails. Batch, for sources that promise their schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def extract_csv(spark: SparkSession, path: str) -> DataFrame:
    """A periodic batch extract, all columns as strings, by header."""
    files = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path").collect()]
    rows = read_csv_by_header(spark, files)
    return rows if rows is not None else spark.createDataFrame([], "_source_file string")


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
