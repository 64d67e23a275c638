"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest, sort-merge anti-joined
with the whole index on the digest, and what is new is appended; neither text nor an index row moves for a known digest.
A batch that is run again under its name finds its own rows and adds nothing.

Defined results: a null text counts as empty; texts without any character but white space are equal to each other;
among equal texts the most code points, then the smallest doc_id stays (a null doc_id comes last); each repeated row
counts in its group, and rows that repeat doc_id and length of the one that stays are that document, so they carry its
mark too (keep_one leaves one of them); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parted, settled, shared_dir, written

#: Characters deleted before texts are compared: space and 0x09 to 0x0D.
_DELETED = " \t\n\x0b\x0c\r"
#: A group with more than this share of all rows is joined by broadcast: there are at most 1 / HOT of them.
HOT = 1 / 1000


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without white space."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), _DELETED, "").cast("binary"), 256))


class DigestIndex:
    """A persistent set of digests with the row that stands for each: digest, keep_id, keep_chars, group_size, batch."""

    COLUMNS = "digest BINARY, keep_id BIGINT, keep_chars INT, group_size BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        """Opens the index at location, or makes an empty one; the number of buckets must be the one it was made with."""
        self.spark, self.location, self.buckets = spark, location, buckets
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, location).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, groups: DataFrame, batch: str) -> None:
        """Adds the groups (digest, keep_id, keep_chars, group_size; one row a digest) whose digest the index lacks.

        Recovery: a write is committed as a whole or not at all, and a batch run again under its name finds what it wrote."""
        new = groups.select("digest", "keep_id", "keep_chars", "group_size", F.lit(batch).alias("batch"))
        fresh = new.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def drop(self) -> None:
        """Takes the name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def compact(self) -> None:
        """Rewrites every bucket as one sorted file, then points the name at the new files."""
        place = f"{self.location}-{uuid.uuid4().hex}"
        fresh = DigestIndex(self.spark, place, self.buckets)
        self.table().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(fresh.name)
        self.drop()
        self.name, self.location = fresh.name, place


def digests_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_chars"), digest(F.col("text")).alias("digest"))


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows joined with groups on digest. The groups that hold over 1/1000 of the rows (so under 1000 groups) are
    broadcast and their rows never shuffled; all others, none of them large, meet in a sort-merge join."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") > F.lit(max(1, int(total * HOT)))
    large = F.broadcast(groups.where(hot))
    left = rows.join(large, "digest", "left")
    names = [c for c in groups.columns if c != "digest"]
    done = left.where(F.col("group_size").isNotNull())
    rest = left.where(F.col("group_size").isNull()).drop(*names).join(groups.where(~hot).hint("merge"), "digest")
    return done.unionByName(rest.select(*done.columns))


def grouped(rows: DataFrame) -> DataFrame:
    """digest, keep_id, keep_chars and group_size of the rows (doc_id, n_chars, digest), one row a digest."""
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best")
    groups = rows.groupBy("digest").agg(best, F.count("*").alias("group_size"))
    return groups.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("keep_chars"), "group_size")


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (within this batch), kept, text_sha256, is_new.

    Without an index a fresh one is made in the shared folder. With one, is_new is false for texts that batches of other
    names hold, and keep_id then is the row of that batch. The same batch again gives the same rows."""
    spark = docs.sparkSession
    batch = batch or uuid.uuid4().hex
    own = index is None
    index = index or DigestIndex(spark, shared_dir(spark), max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = written(digests_of(docs))  # the one pass over the texts: 40 bytes a document from here on
    found = written(grouped(rows))
    index.append_new(found, batch)
    held = index.table().select("digest", "keep_id", "keep_chars", (F.col("batch") == batch).alias("is_new")).hint("merge")
    groups = written(found.select("digest", "group_size").join(held, "digest"))
    if own:
        index.drop()
    out = with_groups(rows, groups)
    kept = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "is_new")


def keep_one(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, all their columns; of rows that repeat a doc_id and text, one. Texts of documents of which
    every row stays are filtered where they lie; the others are matched by doc_id and digest."""
    marks = settled(lambda: dedup(docs, index).select("doc_id", "kept", F.col("text_sha256").alias("__digest")))
    by_row = marks.groupBy("doc_id", "__digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    touched = written(by_row.where("NOT kept OR n > 1"))
    clean, others = parted(docs, touched.select("doc_id").distinct())
    mark = others.withColumn("__digest", F.lower(F.hex(digest(F.col("text")))))
    stay = written(by_row.where("kept")).select(F.col("doc_id").alias("__id"), F.col("__digest").alias("__of"))
    stay = mark.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")), "left_semi")
    if touched.where("n > 1").limit(1).count():  # rows repeat a doc_id with the same text: the longest stays
        longest = F.max_by(F.struct(*docs.columns), F.struct(F.length(F.coalesce("text", F.lit(""))), "text"))
        stay = stay.groupBy("doc_id", "__digest").agg(longest.alias("__row")).select("__row.*")
    return clean.unionByName(stay.select(*docs.columns))
