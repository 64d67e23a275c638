"""What the operators of this subpackage share: words, the shared folder, written intermediate tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a regular expression class for Spark and for DuckDB.
SPACE = r"[\x20\x09-\x0D]"
#: A word, in the same notation.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased: bytes methods touch ASCII letters and ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of a value's decimal text, modulo mod; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def shared_dir(spark: SparkSession) -> str:
    """A new folder's place below spark.checkpoint.dir. Where that is unset a local session gets a folder in its warehouse;
    a cluster is refused, since no machine's own folder is seen by the others."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/orestrata-shared"
    return f"{base}/orestrata-{uuid.uuid4().hex}"


#: Tables of a Python worker that hold nothing once its rows are done, named by the modules that fill them.
CACHES: list[dict] = []


def tidy() -> None:
    """Gives back what a worker holds between two tasks: caches, Arrow's free memory, the allocator's free pages. Workers wait
    for a minute after a task, beside the executor's heap."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in glibc alone
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """run, a function of mapInArrow, with tidy() after the last of a task's rows."""

    def rows(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return rows


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, batch: int | None = None) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, and a lost executor costs a re-read only.
    batch: rows that Python workers get at once at most, for wide rows; the session's own setting comes back after."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_BATCH)
    if batch:
        spark.conf.set(_BATCH, str(min(batch, int(before)) if int(before) > 0 else batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    if (drafts := _drafts.get()) is not None:
        drafts.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that written() filled since the innermost settled() began.
_drafts: ContextVar[list[str] | None] = ContextVar("drafts", default=None)


def settled(make: Callable[[], DataFrame], batch: int | None = None) -> DataFrame:
    """make() written, like written(); what was written on the way is deleted then, as nothing reads it any more. make must
    hand none of it to anything but its result."""
    token = _drafts.set([])
    try:
        out = written(make(), batch)
        *drafts, path = _drafts.get()
    finally:
        _drafts.reset(token)
    if (outer := _drafts.get()) is not None:
        outer.append(path)
    spark = out.sparkSession
    for draft in map(spark._jvm.org.apache.hadoop.fs.Path, drafts):
        draft.getFileSystem(spark._jsc.hadoopConfiguration()).delete(draft, True)
    return out


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df to be broadcast if it has at most so many rows (counted), else as it is. For narrow rows only."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows with whole texts or sets that a Python worker gets at once.
WIDE = 1000
#: Bits of the bitmap that parted() broadcasts, least and most (half a million rows of 16 bytes).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs whose doc_id is surely not among ids (doc_id long), and all others, which may hold some wrongly: what follows
    must look at those exactly. Only a bitmap of bounded size is sent, so texts of the first part never travel. With far
    more ids than bits it parts less and less, and the exact step then moves more."""
    size = LEAST_BITS
    n = ids.count()
    while size < min(8 * n, MOST_BITS):
        size *= 2
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(size - 1))
    bit = F.expr("shiftleft(1L, cast(__place & 63 AS int))")
    listed = ids.select(place.alias("__place")).groupBy(F.shiftright("__place", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    own = F.xxhash64(F.col("doc_id").cast("long")).bitwiseAND(F.lit(size - 1))
    marked = docs.withColumn("__place", own).withColumn("__word", F.shiftright("__place", 6)).join(F.broadcast(listed), "__word", "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(~hit).select(*docs.columns), marked.where(hit).select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
