"""Supplier snapshots to a dimension with full history."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import snapshot_date
from ..operators import scd2
from ..operators.versioned import VersionedTable
from ..session import build_session
from ..sources.files import ingest_csv
from .ops import Timed, logger, with_restarts

LOG = logger("orestrata.suppliers")


@dataclass(frozen=True)
class Config:
    landing_path: str
    checkpoint_base: str
    bronze: str
    dimension: str
    max_files_per_trigger: int = 1000
    close_missing: bool = False
    dim: scd2.Dimension = field(default_factory=scd2.Dimension)


def process(rows: DataFrame, batch_id: int, cfg: Config, table: VersionedTable) -> list[dict]:
    """The snapshots of a batch in the order of their dates. A snapshot applied again changes nothing."""
    days = sorted(r[0] for r in rows.select("_snapshot_date").distinct().collect())  # one a file at most
    out = []
    for day in days:
        with Timed(LOG, "snapshot", batch_id=batch_id, day=day) as seen:
            seen |= scd2.apply(table, rows.where(F.col("_snapshot_date") == F.lit(day)), cfg.dim, cfg.close_missing)
            out.append(dict(seen))
    return out


def run(spark: SparkSession, cfg: Config) -> None:
    table = VersionedTable(spark, cfg.dimension, cfg.dim.spec)

    def land(rows: DataFrame, batch_id: int) -> None:
        place = f"{cfg.bronze}/_batch={batch_id}"
        rows.withColumn("_snapshot_date", snapshot_date(F.col("_source_file"), F.current_date())).write.mode("overwrite").parquet(place)
        process(spark.read.parquet(place), batch_id, cfg, table)

    with_restarts(lambda: ingest_csv(spark, cfg.landing_path, f"{cfg.checkpoint_base}/bronze", land, cfg.max_files_per_trigger))


def parse(args: Sequence[str] | None = None) -> Config:
    cli = argparse.ArgumentParser(description=__doc__)
    for f in fields(Config):
        flag = f"--{f.name.replace('_', '-')}"
        if f.name == "dim":
            continue
        if f.name == "close_missing":
            cli.add_argument(flag, action="store_true")
        elif f.name == "max_files_per_trigger":
            cli.add_argument(flag, type=int, default=f.default)
        else:
            cli.add_argument(flag, required=True)
    cli.add_argument("--salt", default="")
    given = vars(cli.parse_args(args))
    return Config(dim=scd2.Dimension(salt=given.pop("salt")), **given)


if __name__ == "__main__":
    run(build_session("suppliers"), parse())
