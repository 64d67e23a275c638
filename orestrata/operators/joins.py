"""Joins beyond the plain ones: by validity, by range, with hot keys apart, with a narrow dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side up to which it is broadcast; beyond, the join shuffles.
SMALL = 100_000


def small_or_not(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows (counted without reading more than that)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lookup(facts: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str], current: str | None = "is_current") -> DataFrame:
    """Left join with a dimension's current rows and named columns only; broadcast if they are few."""
    rows = dimension.where(current) if current else dimension
    return facts.join(small_or_not(rows.select(key, *columns)), key, "left")


def point_in_time(facts: DataFrame, versions: DataFrame, key: str, at: str, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Each fact with the version of its key that was valid at its time: valid_from <= at < valid_to, null valid_to open."""
    v = versions.select(F.col(key).alias("_k"), "valid_from", "valid_to", *columns)
    inside = (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return facts.join(v, (F.col(key) == F.col("_k")) & inside, how).drop("_k", "valid_from", "valid_to")


def outside_validity(facts: DataFrame, versions: DataFrame, key: str, day: str) -> DataFrame:
    """Facts whose key is known, but in no version valid on their day: a semi join, then a temporal anti join."""
    v = versions.select(F.col(key).alias("_k"), F.col("valid_from").cast("date").alias("_a"), F.col("valid_to").cast("date").alias("_b"))
    inside = (F.col(day) >= F.col("_a")) & (F.col("_b").isNull() | (F.col(day) < F.col("_b")))
    known = facts.join(v, F.col(key) == F.col("_k"), "left_semi")
    return known.join(v, (F.col(key) == F.col("_k")) & inside, "left_anti")


def orphans(facts: DataFrame, dimension: DataFrame, key: Column, of: Column) -> DataFrame:
    """Facts (with a key) that no dimension row matches: a null-safe choice, unlike NOT IN."""
    known = dimension.select(of.alias("_of")).where(F.col("_of").isNotNull()).distinct()
    return facts.withColumn("_key", key).join(known, F.col("_key") == F.col("_of"), "left_anti")


def flag_known(facts: DataFrame, dimension: DataFrame, key: Column, of: Column, flag: str = "fornecedor_valido") -> DataFrame:
    """All facts, with whether their key is known."""
    known = dimension.select(of.alias("_of")).where(F.col("_of").isNotNull()).distinct()
    return facts.withColumn("_key", key).join(known, F.col("_key") == F.col("_of"), "left").withColumn(flag, F.col("_of").isNotNull()).drop("_key", "_of")


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Inner join of points (a number) into half-open ranges by buckets of width: an equi-join on the bucket, then the
    exact condition. A range is repeated for each bucket it touches, so width should be near a typical length."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    last = F.floor(F.col(end) / width)  # one bucket more than needed where a range ends on an edge; the exact condition decides
    r = ranges.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), last)))
    return p.join(r, [*keys, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def hot_keys(df: DataFrame, key: str, share: float = 0.001) -> list:
    """Keys that hold more than share of the rows: fewer than 1 / share of them."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    total = df.count()
    return [r[0] for r in counts.where(F.col("count") > total * share).select(key).collect()]


def split_join(facts: DataFrame, dimension: DataFrame, key: str, how: str = "inner", share: float = 0.001) -> DataFrame:
    """A join whose hot keys take a broadcast of their dimension rows (bounded by their number if the key is unique
    there) and all others a shuffle; both paths together give each fact once."""
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    hot = hot_keys(facts, key, share)
    if not hot:
        return facts.join(dimension, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    apart = facts.where(is_hot).join(small_or_not(dimension.where(is_hot)), key, how)
    return apart.unionByName(facts.where(~is_hot).join(dimension.where(~is_hot), key, how))


def hash_join(facts: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A shuffled hash join: the larger side is not sorted."""
    return facts.join(other.hint("shuffle_hash"), key, how)
