"""Gold tables. Their inputs are given (lineage); their columns are this engine's own design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import key_norm, month_of
from ..operators.joins import flag_known, lookup


def sensor_windows(readings: DataFrame, minutes: int = 5, watermark: str | None = "2 hours", event: str = "event_ts") -> DataFrame:
    """Readings by sensor in tumbling windows, batch or stream (a stream needs the watermark to finish windows)."""
    df = readings.withWatermark(event, watermark) if readings.isStreaming and watermark else readings
    out = df.groupBy(F.window(event, f"{minutes} minutes"), "sensor_id").agg(
        F.count("*").alias("leituras"), F.avg("temperatura").alias("temperatura_media"), F.max("vibracao").alias("vibracao_max"), F.sum("consumo_eletrico").alias("consumo_total"),
    )
    return out.select(F.col("window.start").alias("inicio"), F.col("window.end").alias("fim"), "sensor_id", "leituras", "temperatura_media", "vibracao_max", "consumo_total")


def plant_productivity(production: DataFrame, day: str = "data_producao_date") -> DataFrame:
    """Tonnes, active mills and tonnes a mill by plant and day."""
    return (
        production.groupBy("planta_id", F.col(day).alias("data")).agg(F.sum("toneladas_produzidas").alias("toneladas"), F.count_distinct("moinho_id").alias("moinhos_ativos"))
        .withColumn("toneladas_por_moinho", F.col("toneladas").cast("double") / F.col("moinhos_ativos"))
    )


def supplier_finance(events: DataFrame, dimension: DataFrame) -> DataFrame:
    """Value by month and supplier; events of unknown suppliers are a line of their own, not dropped."""
    flagged = flag_known(events, dimension, key_norm(F.col("fornecedor_id")), key_norm(F.col("fornecedor_id")))
    keyed = flagged.withColumn("chave", F.when(F.col("fornecedor_valido"), key_norm(F.col("fornecedor_id"))))
    sums = keyed.groupBy(month_of(F.col("data")).alias("mes"), "fornecedor_valido", "chave").agg(F.count("*").alias("eventos"), F.sum("valor").alias("valor"))
    names = dimension.withColumn("chave", key_norm(F.col("fornecedor_id")))
    return lookup(sums, names, "chave", ["nome"])


def features(readings: DataFrame, production: DataFrame) -> DataFrame:
    """Per plant and day: means of the sensors beside the tonnes produced."""
    sensors = readings.groupBy("planta_id", F.to_date("event_ts").alias("data")).agg(
        F.avg("temperatura").alias("temperatura_media"), F.avg("vibracao").alias("vibracao_media"), F.avg("consumo_eletrico").alias("consumo_medio"),
    )
    tonnes = production.groupBy("planta_id", F.col("data_producao_date").alias("data")).agg(F.sum("toneladas_produzidas").alias("toneladas"))
    return sensors.join(tonnes, ["planta_id", "data"], "full_outer")
