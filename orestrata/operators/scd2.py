"""Full history of a slowly changing dimension: one atomic commit closes and opens versions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import TableSpec, require_columns
from ..functions.scalars import attribute_hash, blank_to_null
from .dedup import keep_latest
from .versioned import ConcurrentCommit, VersionedTable

OPEN = "true"  # the partition of current versions


@dataclass(frozen=True)
class Dimension:
    """key and attributes as the source names them; valid_column: business time of a change, if the source has it."""

    key: str = "fornecedor_id"
    attributes: tuple[str, ...] = ("nome", "endereco", "status_contratual", "dados_bancarios")
    valid_column: str = "data_atualizacao"
    salt: str = ""

    @property
    def spec(self) -> TableSpec:
        """Current and closed versions lie apart, so history is only ever appended to."""
        attributes = ", ".join(f"{a} string" for a in self.attributes)
        return TableSpec(
            f"{self.key} string, {attributes}, attribute_hash string, valid_from timestamp, valid_to timestamp, is_current boolean, _snapshot_date date, _ingestion_ts timestamp",
            not_null=(self.key, "attribute_hash", "valid_from", "is_current"),
            checks={"interval": "valid_to IS NULL OR valid_to > valid_from"},
            partition_by="is_current",
            sort_by=(self.key,),
        )


def prepare(snapshot: DataFrame, dim: Dimension) -> DataFrame:
    """A snapshot cleaned, keyed, with validity and hash; per key the row of the latest validity, then ingestion."""
    require_columns(snapshot, [dim.key, *dim.attributes])
    fallback = F.col("_snapshot_date").cast("timestamp")
    stated = F.col(dim.valid_column).try_cast("timestamp") if dim.valid_column in snapshot.columns else F.lit(None)
    clean = snapshot.select(
        blank_to_null(F.col(dim.key)).alias(dim.key), *[blank_to_null(F.col(a)).alias(a) for a in dim.attributes],
        F.coalesce(stated, fallback).alias("valid_from"), "_snapshot_date", "_ingestion_ts",
    ).where(F.col(dim.key).isNotNull())
    return keep_latest(clean.withColumn("attribute_hash", attribute_hash(dim.attributes, dim.salt)), [dim.key], ["valid_from", "_ingestion_ts"])


def apply(table: VersionedTable, snapshot: DataFrame, dim: Dimension, close_missing: bool = False, attempts: int = 3) -> dict[str, int]:
    """Applies one snapshot in one commit. New keys open; keys whose hash differs and whose validity is strictly later
    close the current version at the new one's start; older or equal changes are ignored and counted; missing keys stay
    open, or with close_missing close at the snapshot's date."""
    source = prepare(snapshot, dim).persist()
    try:
        for attempt in range(1, attempts + 1):
            try:
                return _apply(table, source, dim, close_missing)
            except ConcurrentCommit:
                if attempt == attempts:
                    raise
    finally:
        source.unpersist()
    raise AssertionError


def _apply(table: VersionedTable, source: DataFrame, dim: Dimension, close_missing: bool) -> dict[str, int]:
    base = table.version()
    current = table.read(base.number, [OPEN])
    s, t = source.alias("s"), current.alias("t")
    pair = s.join(t, F.col(f"s.{dim.key}") == F.col(f"t.{dim.key}"), "full_outer")
    new_key, gone = F.col(f"t.{dim.key}").isNull(), F.col(f"s.{dim.key}").isNull()
    differs = F.col("s.attribute_hash") != F.col("t.attribute_hash")
    later = F.col("s.valid_from") > F.col("t.valid_from")
    newest = source.agg(F.max("_snapshot_date").cast("timestamp")).first()[0] if close_missing else None
    closes_missing = gone & (F.lit(newest).cast("timestamp") > F.col("t.valid_from")) if close_missing else F.lit(False)
    action = (
        F.when(new_key, "insert").when(closes_missing, "close").when(gone, "keep").when(differs & later, "change").when(differs, "ignore").otherwise("keep")
    )
    acted = pair.withColumn("action", action).persist()
    try:
        counts = {r["action"]: r["count"] for r in acted.groupBy("action").count().collect()}  # five rows at most
        columns = [dim.key, *dim.attributes, "attribute_hash"]
        opened = acted.where("action IN ('insert', 'change')").select(
            *[F.col(f"s.{c}") for c in columns], F.col("s.valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"), F.col("s._snapshot_date"), F.col("s._ingestion_ts"),
        )
        kept = acted.where("action IN ('keep', 'ignore')").select("t.*")
        closed = acted.where("action IN ('change', 'close')").select(
            *[F.col(f"t.{c}") for c in columns], F.col("t.valid_from"), F.coalesce(F.col("s.valid_from"), F.lit(newest).cast("timestamp")).alias("valid_to"), F.lit(False).alias("is_current"), F.col("t._snapshot_date"), F.col("t._ingestion_ts"),
        )
        if set(counts) - {"keep", "ignore"}:
            table.replace_and_add(opened.unionByName(kept), OPEN, closed, "scd2", expect=base.number)
        return {k: counts.get(k, 0) for k in ("insert", "change", "close", "ignore", "keep")}
    finally:
        acted.unpersist()


def history(changes: DataFrame, key: str, at: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """The same history in one pass over all changes at once: versions where value changes, in the order of at (then
    tie). Equals applying snapshots one by one if each key's times strictly increase."""
    w = Window.partitionBy(key).orderBy(at, *tie)
    before = F.lag(value).over(w)
    points = changes.withColumn("_first", F.row_number().over(w) == 1).withColumn("_before", before).where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before")))
    end = F.lead(at).over(w)
    return points.select(key, value, F.col(at).alias("valid_from"), end.alias("valid_to"), end.isNull().alias("is_current"))


def violations(dim: DataFrame, key: str) -> DataFrame:
    """One row: keys without exactly one current version, and versions that do not end where the next begins."""
    per_key = dim.groupBy(key).agg(F.sum(F.col("is_current").cast("int")).alias("current")).agg(F.count_if(F.col("current") != 1).alias("keys_without_one_current"))
    w = Window.partitionBy(key).orderBy("valid_from")
    gaps = dim.withColumn("_next", F.lead("valid_from").over(w)).agg(F.count_if(F.col("_next").isNotNull() & ~F.col("valid_to").eqNullSafe(F.col("_next"))).alias("gaps_or_overlaps"))
    return per_key.crossJoin(gaps)


def current_versions(dim: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a key, and only the columns asked for: what a lookup join should use instead of the whole history."""
    df = dim.where("is_current")
    return df.select(*columns) if columns else df
