"""Mill production: drifting CSV to bronze, then validated, in UTC, deduplicated and upserted; rejects in quarantine."""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contract import TableSpec, require_columns
from ..functions.scalars import blank_to_null, first_filled, payload, to_utc, zone_of
from ..operators import quality
from ..operators.dedup import keep_latest
from ..operators.quality import QUARANTINE, Rule
from ..operators.versioned import VersionedTable
from ..session import build_session
from ..sources.files import ingest_csv
from .ops import Timed, logger, with_restarts

KEYS = ("planta_id", "moinho_id", "data_producao_utc")
SILVER = TableSpec(
    "planta_id string, moinho_id string, data_producao_utc timestamp, data_producao_date date, toneladas_produzidas decimal(18,3), _ingestion_ts timestamp, _source_file string, _processed_ts timestamp",
    not_null=(*KEYS, "data_producao_date", "toneladas_produzidas"),
    checks={"non_negative": "toneladas_produzidas >= 0"},
    partition_by="data_producao_date",
    sort_by=("planta_id", "moinho_id", "data_producao_utc"),
)
LOG = logger("orestrata.production")


@dataclass(frozen=True)
class Config:
    landing_path: str
    checkpoint_base: str
    bronze: str
    silver: str
    quarantine: str
    default_zone: str = "America/Sao_Paulo"
    zone_by_plant: Mapping[str, str] = field(default_factory=dict)
    max_files_per_trigger: int = 1000


def normalise(df: DataFrame, cfg: Config) -> DataFrame:
    """Canonical columns from raw strings: one plant column from either name, UTC time, decimal tonnes, JSON payload."""
    require_columns(df, ["moinho_id", "data_producao", "toneladas_produzidas"], [["planta_id", "id_planta"]])
    plant = first_filled(df, "planta_id", "id_planta")
    raw = blank_to_null(F.col("toneladas_produzidas"))
    return df.select(
        plant.alias("planta_id"), blank_to_null(F.col("moinho_id")).alias("moinho_id"), to_utc(F.col("data_producao"), zone_of(plant, cfg.zone_by_plant, cfg.default_zone)).alias("data_producao_utc"),
        raw.try_cast("decimal(18,3)").alias("toneladas_produzidas"), raw.alias("_raw_tonnes"), "_ingestion_ts", "_source_file", payload(df.columns).alias("_payload"),
    )


def rules() -> list[Rule]:
    # The codes are fixed values that readers of the quarantine rely on.
    tonnes, raw = F.col("toneladas_produzidas"), F.col("_raw_tonnes")
    return [
        Rule("planta_ausente", F.col("planta_id").isNull()),
        Rule("moinho_ausente", F.col("moinho_id").isNull()),
        Rule("timestamp_invalido_ou_ausente", F.col("data_producao_utc").isNull()),
        Rule("toneladas_nulas", raw.isNull()),
        Rule("toneladas_invalidas", raw.isNotNull() & tonnes.isNull()),
        Rule("toneladas_negativas", tonnes < 0),
    ]


def deduplicate(df: DataFrame) -> DataFrame:
    return keep_latest(df, KEYS, ["_ingestion_ts", "_source_file"])


def process(df: DataFrame, batch_id: int, cfg: Config, silver: VersionedTable, rejects: VersionedTable) -> dict:
    """One batch of bronze rows. Rejects go first; both writes ignore a batch they have seen, so a replay is harmless."""
    with Timed(LOG, "production_batch", batch_id=batch_id) as seen:
        rows = quality.classify(normalise(df, cfg), rules()).persist()
        try:
            counts = rows.agg(F.count("*").alias("read"), F.count_if(F.size("_reason") > 0).alias("rejected")).first()
            seen |= counts.asDict()
            if counts["read"]:
                if counts["rejected"]:
                    quality.quarantine(rejects, quality.rejected(rows), batch_id, "production")
                once = deduplicate(quality.valid(rows)).select(
                    *KEYS, F.to_date("data_producao_utc").alias("data_producao_date"), "toneladas_produzidas", "_ingestion_ts", "_source_file", F.current_timestamp().alias("_processed_ts"),
                ).persist()
                try:
                    seen["merged"] = once.count()
                    seen["duplicates_removed"] = counts["read"] - counts["rejected"] - seen["merged"]
                    # The date is part of the key's time, so equal keys lie in equal partitions.
                    silver.upsert(once, KEYS, "_ingestion_ts", prune=True, batch=("production", batch_id))
                finally:
                    once.unpersist()
        finally:
            rows.unpersist()
    return seen


def run(spark: SparkSession, cfg: Config) -> None:
    """Drains new files to bronze and new bronze rows to silver, then stops."""
    silver, rejects = VersionedTable(spark, cfg.silver, SILVER), VersionedTable(spark, cfg.quarantine, QUARANTINE)

    def land(rows: DataFrame, batch_id: int) -> None:
        # A folder a batch, so that a replayed batch replaces itself.
        rows.write.mode("overwrite").parquet(f"{cfg.bronze}/_batch={batch_id}")
        process(rows_of(spark, f"{cfg.bronze}/_batch={batch_id}"), batch_id, cfg, silver, rejects)

    with_restarts(lambda: ingest_csv(spark, cfg.landing_path, f"{cfg.checkpoint_base}/bronze", land, cfg.max_files_per_trigger))


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def reprocess(spark: SparkSession, cfg: Config, first_batch: int) -> None:
    """All of bronze again, its drifting columns merged by name, as one batch (for a rebuilt silver)."""
    silver, rejects = VersionedTable(spark, cfg.silver, SILVER), VersionedTable(spark, cfg.quarantine, QUARANTINE)
    process(spark.read.option("mergeSchema", True).parquet(cfg.bronze).drop("_batch"), first_batch, cfg, silver, rejects)


def publish(spark: SparkSession, cfg: Config, name: str = "producao", version: int | None = None) -> DataFrame:
    """The silver table under a stable view name, with the day under the name that the analytic queries use."""
    return VersionedTable(spark, cfg.silver, SILVER).view(name, version, {"data": F.col("data_producao_date")})


def parse(args: Sequence[str] | None = None) -> Config:
    cli = argparse.ArgumentParser(description=__doc__)
    for f in fields(Config):
        flag = f"--{f.name.replace('_', '-')}"
        if f.name == "zone_by_plant":
            cli.add_argument(flag, type=json.loads, default={}, help="JSON object, plant to zone")
        elif f.name == "max_files_per_trigger":
            cli.add_argument(flag, type=int, default=f.default)
        elif f.name == "default_zone":
            cli.add_argument(flag, default=f.default)
        else:
            cli.add_argument(flag, required=True)
    return Config(**vars(cli.parse_args(args)))


if __name__ == "__main__":
    run(build_session("production"), parse())
