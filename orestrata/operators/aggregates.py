"""Aggregations: salted, shares, percentiles, comparisons of two versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_sum(df: DataFrame, keys: Sequence[str], value: str, salts: int = 16) -> DataFrame:
    """sum and count by keys in two phases: by (keys, salt), then by keys, so a hot key is spread over salts tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).alias("_salt")
    partial = df.groupBy(*keys, salt).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return partial.groupBy(*keys).agg(F.sum("_s").alias("total"), F.sum("_n").alias("n"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Rows and percentage of all rows by key; the hottest keys show skew. The total comes from the groups' counts."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(key, "n", (F.col("n") * 100 / F.col("_all")).alias("pct"))


def versions_per_key(df: DataFrame, key: str, top: int = 20) -> DataFrame:
    """The keys with most rows: what a join by this key would multiply by."""
    return df.groupBy(key).agg(F.count("*").alias("versions")).orderBy(F.desc("versions"), key).limit(top)


def lateness_percentiles(df: DataFrame, event: str, arrival: str, at: Sequence[float] = (0.5, 0.95, 0.99, 0.999), accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles of arrival minus event in seconds: what a watermark should be sized by."""
    late = F.unix_timestamp(arrival) - F.unix_timestamp(event)
    return df.select(late.alias("s")).agg(F.percentile_approx("s", list(at), accuracy).alias("p")).select(*[F.element_at("p", i + 1).alias("p" + f"{q * 100:g}".replace(".", "_")) for i, q in enumerate(at)])


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Groups in which two versions differ in row count or in the sum of a value; null keys are a group. One shuffle."""
    tagged = a.select(*keys, *values).withColumn("_a", F.lit(True)).unionByName(b.select(*keys, *values).withColumn("_a", F.lit(False)))
    sides = {"a": F.col("_a"), "b": ~F.col("_a")}
    both = tagged.groupBy(*keys).agg(
        *[F.count_if(side).alias(f"n_{s}") for s, side in sides.items()], *[F.sum(F.when(side, F.col(v))).alias(f"{v}_{s}") for v in values for s, side in sides.items()],
    )
    differ = F.col("n_a") != F.col("n_b")
    for v in values:
        differ = differ | ~F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b"))
    return both.where(differ)
