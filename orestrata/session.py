"""A session as the engine expects it, and the loading of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "orestrata", master: str | None = None, **conf: str) -> SparkSession:
    """UTC always, ANSI on (Spark's default), AQE on (its default); further settings as given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table with its zoneless timestamps read as UTC instants (watermarks and instants need TIMESTAMP)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})
