"""A versioned Parquet table: atomic commits, upserts, insert-only merges, time travel, on any Hadoop file system.

A version is a JSON manifest in `_log`: the directories that make up each partition, and the last batch of each writer.
A commit writes new data directories first, checks the constraints on what was written, and then creates the manifest of
the next version, which fails if another writer has created it; the loser reads the new version and tries again. Only
partitions that a merge touches are rewritten, an append rewrites none. Spark's own writers produce all data, so a lost
executor costs its tasks only, and an interrupted commit leaves files that no manifest names (vacuum removes them).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.contract import TableSpec

WHOLE = ""  # the partition of a table without partitions


class ConcurrentCommit(RuntimeError):
    """Another writer committed the version this one was about to commit."""


class Files:
    """The few file operations the log needs, through Hadoop's file system API."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, file: str) -> str:
        stream = self.fs.open(self.path(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, file: str, text: str) -> bool:
        """False if the file exists: whoever creates it first has it. Written aside and renamed, so never half there."""
        to, aside = self.path(file), self.path(f"{file}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.exists(to) and self.fs.rename(aside, to):
            return True
        self.fs.delete(aside, False)
        return False

    def delete(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


@dataclass(frozen=True)
class Version:
    number: int
    parts: dict[str, list[str]]
    batches: dict[str, int]
    operation: str
    at: float


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, spec: TableSpec):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec
        self.files = Files(spark, self.root)
        self.schema = spark.createDataFrame([], spec.schema).schema

    # --- versions

    def _log(self, number: int) -> str:
        return f"{self.root}/_log/{number:012d}.json"

    def version(self, number: int | None = None) -> Version:
        """The given version, or the newest; version 0 is the empty table."""
        if number is None:
            number = max((int(n[:12]) for n in self.files.names(f"{self.root}/_log") if n.endswith(".json")), default=0)
        if number == 0:
            return Version(0, {}, {}, "create", 0.0)
        return Version(**json.loads(self.files.read(self._log(number))))

    def history(self) -> list[Version]:
        return [self.version(n) for n in range(1, self.version().number + 1)]

    def exists(self) -> bool:
        return self.version().number > 0

    def _commit(self, base: Version, parts: dict[str, list[str]], operation: str, batch: tuple[str, int] | None) -> Version:
        batches = base.batches | ({batch[0]: batch[1]} if batch else {})
        new = Version(base.number + 1, {p: d for p, d in parts.items() if d}, batches, operation, time.time())
        if not self.files.create(self._log(new.number), json.dumps(new.__dict__)):
            raise ConcurrentCommit(f"version {new.number} of {self.root} was committed by another writer")
        return new

    # --- reading

    def read(self, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version, of the named partitions only if given."""
        at = self.version(version)
        paths = [d for p, dirs in at.parts.items() if parts is None or p in parts for d in dirs]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{d}" for d in paths])

    def view(self, name: str, version: int | None = None, columns: dict[str, Column] | None = None) -> DataFrame:
        """Publishes a version under a stable name (swap and roll back by calling again); columns: added aliases."""
        df = self.read(version)
        df = df.withColumns(columns) if columns else df
        df.createOrReplaceTempView(name)
        return df

    def changes(self, start: int, end: int | None = None) -> DataFrame:
        """The change feed between two versions: rows with _change insert or delete, equal rows cancelling out.
        Partitions whose directories are the same in both are not read."""
        a, b = self.version(start), self.version(end)
        own = lambda x, y: [f"{self.root}/{d}" for p, dirs in x.parts.items() for d in dirs if d not in set(y.parts.get(p, []))]
        columns = [f.name for f in self.schema]

        def side(paths: list[str], sign: int) -> DataFrame:
            df = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
            return df.withColumn("_sign", F.lit(sign))

        both = side(own(b, a), 1).unionByName(side(own(a, b), -1))
        net = both.groupBy(*columns).agg(F.sum("_sign").alias("_net")).where("_net != 0")
        copies = F.explode(F.array_repeat(F.lit(0), F.abs("_net").cast("int")))
        return net.select("*", copies.alias("_c")).select(*columns, F.when(F.col("_net") > 0, "insert").otherwise("delete").alias("_change"))

    # --- writing

    def _part(self) -> Column:
        return F.coalesce(F.col(self.spec.partition_by).cast("string"), F.lit("null")) if self.spec.partition_by else F.lit(WHOLE)

    def _write(self, df: DataFrame) -> dict[str, list[str]]:
        """Writes df to new directories, one a partition, and checks the constraints on what was written."""
        folder = f"data/{uuid.uuid4().hex}"
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        if self.spec.partition_by:
            # Sorted by the partition too, or the writer sorts again by it alone and the order is lost.
            df.withColumn("_p", self._part()).sortWithinPartitions("_p", *self.spec.sort_by).write.partitionBy("_p").parquet(f"{self.root}/{folder}")
            dirs = {self._unescape(n[3:]): [f"{folder}/{n}"] for n in self.files.names(f"{self.root}/{folder}") if n.startswith("_p=")}
        else:
            (df.sortWithinPartitions(*self.spec.sort_by) if self.spec.sort_by else df).write.parquet(f"{self.root}/{folder}")
            dirs = {WHOLE: [folder]}
        if dirs:
            self.spec.enforce(self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{d}" for ds in dirs.values() for d in ds]))
        return dirs

    @staticmethod
    def _unescape(name: str) -> str:
        from urllib.parse import unquote

        return unquote(name)

    def _attempts(self, work: Callable[[Version], Version], attempts: int = 3, pause: float = 5.0) -> Version:
        """Runs work on the newest version, again after a lost race: at most attempts times, pausing longer each time."""
        for k in range(1, attempts + 1):
            try:
                return work(self.version())
            except ConcurrentCommit:
                if k == attempts:
                    raise
                time.sleep(pause * k)
        raise AssertionError

    def _seen(self, base: Version, batch: tuple[str, int] | None) -> bool:
        return batch is not None and base.batches.get(batch[0], -1) >= batch[1]

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None, pause: float = 5.0) -> Version:
        """Adds rows. With batch (writer, number) a replayed batch changes nothing."""

        def work(base: Version) -> Version:
            if self._seen(base, batch):
                return base
            parts = {p: list(d) for p, d in base.parts.items()}
            for p, dirs in self._write(df).items():
                parts.setdefault(p, []).extend(dirs)
            return self._commit(base, parts, "append", batch)

        return self._attempts(work, pause=pause)

    def overwrite(self, df: DataFrame, only_parts: bool = False, operation: str = "overwrite", batch: tuple[str, int] | None = None, also: Sequence[str] = ()) -> Version:
        """Replaces the table or, with only_parts, the partitions that df has rows in and those named in also."""

        def work(base: Version) -> Version:
            if self._seen(base, batch):
                return base
            new = self._write(df)
            keep = {p: d for p, d in base.parts.items() if p not in new and p not in also} if only_parts else {}
            return self._commit(base, keep | new, operation, batch)

        return self._attempts(work)

    def restore(self, number: int) -> Version:
        """A new version with the content of an older one."""
        return self._attempts(lambda base: self._commit(base, self.version(number).parts, f"restore {number}", None))

    def _touched(self, source: DataFrame, prune: bool) -> list[str] | None:
        """The partitions that source has rows in: as many values as partitions, never rows."""
        if not (prune and self.spec.partition_by):
            return None
        return [r[0] for r in source.select(self._part()).distinct().collect()]

    def upsert(self, source: DataFrame, keys: Sequence[str], newer: str | None, prune: bool = False, batch: tuple[str, int] | None = None, pause: float = 5.0) -> Version:
        """Matched rows are replaced if newer (a column) is strictly greater in source, or always if None; others are
        inserted. A null in a key matches nothing: such rows of both sides stay, and so do target rows that repeat a key, all
        of which a match replaces. prune: equal keys imply equal partitions, so only partitions of source are read and
        rewritten. Source must hold a key once. One shuffle: source and target meet in a window by key."""
        w = Window.partitionBy(*keys, "_alone")
        no_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        here, there = F.max(F.when(F.col("_new") == 0, F.struct(F.col(newer) if newer else F.lit(0)))).over(w), F.max("_new").over(w)
        in_source = F.max(F.when(F.col("_new") == 1, F.struct(F.col(newer) if newer else F.lit(0)))).over(w)
        # Without newer every match replaces; with it, a strictly greater value does (a null is older than any).
        wins = here.isNull() | (F.lit(True) if newer is None else in_source > here)
        stays = F.when(F.col("_new") == 1, wins).otherwise((there == 0) | ~wins)

        def work(base: Version) -> Version:
            if self._seen(base, batch):
                return base
            touched = self._touched(source, prune)
            columns = [f.name for f in self.schema]
            both = self.read(base.number, touched).withColumn("_new", F.lit(0)).unionByName(source.select(*columns).withColumn("_new", F.lit(1)))
            both = both.withColumn("_alone", F.when(no_key, F.monotonically_increasing_id()))
            best = both.withColumn("_stays", stays).where("_stays").drop("_stays", "_new", "_alone")
            keep = {} if touched is None else {p: d for p, d in base.parts.items() if p not in touched}
            return self._commit(base, keep | self._write(best), "upsert", batch)

        return self._attempts(work, pause=pause)

    def insert_only(self, source: DataFrame, keys: Sequence[str], prune: bool = False, null_safe: bool = True, batch: tuple[str, int] | None = None, pause: float = 5.0) -> Version:
        """Adds the rows of source whose key the table lacks; nothing that exists changes. null_safe: null keys match."""

        def work(base: Version) -> Version:
            if self._seen(base, batch):
                return base
            target = self.read(base.number, self._touched(source, prune)).select(*[F.col(k).alias(f"_t_{k}") for k in keys])
            match = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) if null_safe else F.col(k) == F.col(f"_t_{k}") for k in keys]
            fresh = source.join(target, match, "left_anti")
            parts = {p: list(d) for p, d in base.parts.items()}
            for p, dirs in self._write(fresh).items():
                parts.setdefault(p, []).extend(dirs)
            return self._commit(base, parts, "insert", batch)

        return self._attempts(work, pause=pause)

    def replace_and_add(self, replace: DataFrame, part: str, add: DataFrame, operation: str, expect: int) -> Version:
        """One commit on version expect that replaces one partition and appends to the others."""
        base = self.version(expect)
        parts = {p: list(d) for p, d in base.parts.items() if p != part}
        new = self._write(replace.select(*self.schema.names).unionByName(add.select(*self.schema.names)))
        for p, dirs in new.items():
            parts.setdefault(p, []).extend(dirs)
        return self._commit(base, parts, operation, None)

    # --- upkeep

    def compact(self, files_per_part: int = 1) -> Version:
        """Rewrites partitions of several directories into one each, every file sorted by the table's order."""

        def work(base: Version) -> Version:
            many = [p for p, d in base.parts.items() if len(d) > 1]
            if not many:
                return base
            df = self.read(base.number, many)
            df = df.repartition(files_per_part * len(many), *([self._part()] if self.spec.partition_by else []))
            return self._commit(base, {p: d for p, d in base.parts.items() if p not in many} | self._write(df), "compact", None)

        return self._attempts(work)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data that the newest keep versions do not name; returns how many directories went. Not while others write."""
        newest = self.version().number
        named = {d.split("/")[1] for n in range(max(1, newest - keep + 1), newest + 1) for ds in self.version(n).parts.values() for d in ds}
        gone = [n for n in self.files.names(f"{self.root}/data") if n not in named]
        for n in gone:
            self.files.delete(f"{self.root}/data/{n}")
        return len(gone)

    def statistics(self, version: int | None = None) -> DataFrame:
        """Rows and distinct values by column, for a plan or a profile."""
        df = self.read(version)
        return df.agg(F.count("*").alias("rows"), *[F.approx_count_distinct(c).alias(f"distinct_{c}") for c in df.columns])
