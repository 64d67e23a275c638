"""One row a key: by a total order in batch, within a watermark in a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Spark prunes each task's rows before the shuffle (a window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_latest(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row with the greatest by columns; a hash of the whole row ends ties, so reruns agree."""
    rest = F.xxhash64(*[F.col(c) for c in df.columns])
    return keep_one(df, keys, [*[F.col(c).desc_nulls_last() for c in by], rest.desc()])


def keep_first(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row with the least by columns, ties as in keep_latest."""
    rest = F.xxhash64(*[F.col(c) for c in df.columns])
    return keep_one(df, keys, [*[F.col(c).asc_nulls_last() for c in by], rest.asc()])


def stream_dedup(df: DataFrame, keys: Sequence[str], event_time: str, watermark: str = "2 hours") -> DataFrame:
    """Drops repeats within the watermark; the state is bounded by it, and rows later than it are dropped too."""
    return df.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys that occur more than once (what a bounded stream cannot promise, checked after)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
