"""The analytic questions: largest monthly drops, rolling anomalies, referential and temporal integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_blank, key_norm, month_of, months_between
from ..operators.joins import orphans, outside_validity

MILL = ("planta_id", "moinho_id")


def monthly_drop(production: DataFrame, as_of: Column, top: int = 3, months: int = 6, day: str = "data", tonnes: str = "toneladas_produzidas", mill: Sequence[str] = MILL, rounded: bool = True, ties: bool = False) -> DataFrame:
    """Each mill's worst drop from one month to the next over the last full months, and the top mills by it.

    The series has no holes: a month without rows counts 0, a month whose rows are all null stays unknown and is no
    drop. Mills are those with a row in the window. The monthly sums are the only shuffle of the facts: the list of mills
    comes from them, and the calendar is a few rows."""
    current = month_of(as_of)
    first, last = F.add_months(current, -(months + 1)), F.add_months(current, -1)
    inside = production.where((F.col(day) >= first) & (F.col(day) < current))
    monthly = inside.groupBy(*mill, month_of(F.col(day)).alias("mes")).agg(F.sum(tonnes).cast("double").alias("t"))
    # One array a mill (months + 1 entries) in place of a join of mills with a calendar.
    by_mill = monthly.groupBy(*mill).agg(F.map_from_entries(F.collect_list(F.struct("mes", F.struct("t").alias("v")))).alias("seen"))
    series = by_mill.select(*mill, "seen", months_between(first, last).alias("mes"))
    value = F.when(F.col("seen")[F.col("mes")].isNull(), F.lit(0.0)).otherwise(F.col("seen")[F.col("mes")]["t"])
    w = Window.partitionBy(*mill).orderBy("mes")
    dense = series.select(*mill, "mes", value.alias("now")).withColumn("before", F.lag("now").over(w))
    drops = dense.where((F.col("mes") > first) & (F.col("before") > 0) & (F.col("now") < F.col("before"))).withColumn("pct", (F.col("before") - F.col("now")) / F.col("before") * 100)
    worst = drops.withColumn("_rn", F.row_number().over(Window.partitionBy(*mill).orderBy(F.desc("pct"), F.desc("mes")))).where("_rn = 1")
    # A row a mill; Spark makes it a distributed top-k. With ties, mills of one drop share a place and all come.
    place = F.rank().over(Window.orderBy(F.desc("pct"))) if ties else F.row_number().over(Window.orderBy(F.desc("pct"), *mill))
    pct = F.round("pct", 2) if rounded else F.col("pct")
    return (
        worst.withColumn("posicao", place).where(F.col("posicao") <= top)
        .select("posicao", *mill, F.col("mes").alias("mes_da_queda"), F.col("before").alias("toneladas_mes_anterior"), F.col("now").alias("toneladas_no_mes"), pct.alias("queda_pct"))
        .orderBy("posicao", *mill)
    )


def rolling_anomalies(production: DataFrame, deviations: float = 2.0, least_days: int = 5, days: int = 7, day: str = "data", tonnes: str = "toneladas_produzidas", mill: Sequence[str] = MILL, rounded: bool = True) -> DataFrame:
    """Days whose production is more than some standard deviations from the mean of the calendar days before.

    The frame is a range of day numbers, so missing days shorten it rather than reach further back, and the day itself
    is outside it. Fewer than least_days days, or no deviation, raise no alert. One shuffle: the daily sums are
    partitioned by mill, as the window needs them."""
    daily = production.groupBy(*mill, day).agg(F.sum(tonnes).cast("double").alias("x"))
    w = Window.partitionBy(*mill).orderBy(F.unix_date(F.col(day))).rangeBetween(-days, -1)
    stats = daily.select(*mill, day, "x", F.avg("x").over(w).alias("m"), F.stddev_samp("x").over(w).alias("s"), F.count("x").over(w).alias("n"))
    found = stats.where((F.col("n") >= least_days) & (F.col("s") > 0) & (F.abs(F.col("x") - F.col("m")) > deviations * F.col("s")))
    cut = (lambda c: F.round(c, 2)) if rounded else (lambda c: c)
    return found.select(
        *mill, day, cut(F.col("x")).alias("producao_dia"), cut(F.col("m")).alias("media_7d"), cut(F.col("s")).alias("desvio_7d"),
        cut(F.col("m") - deviations * F.col("s")).alias("limite_inferior"), cut(F.col("m") + deviations * F.col("s")).alias("limite_superior"),
        cut((F.col("x") - F.col("m")) / F.col("s")).alias("z_score"), F.when(F.col("x") > F.col("m"), "ACIMA").otherwise("ABAIXO").alias("tipo_anomalia"),
    ).orderBy(F.desc(day), *mill)


def orphans_by_month(events: DataFrame, dimension: DataFrame, key: str = "fornecedor_id", day: str = "data", document: Sequence[str] = ("bukrs", "belnr"), value: str = "valor", samples: int = 5) -> DataFrame:
    """Events whose key is in no version of the dimension, keys normalised on both sides, by month."""
    keyed = events.where(~is_blank(F.col(key)))
    lost = orphans(keyed, dimension, key_norm(F.col(key)), key_norm(F.col(key)))
    whole = F.when(F.col(document[0]).isNotNull() & F.col(document[1]).isNotNull(), F.struct(*document)) if len(document) > 1 else F.col(document[0])
    lost = lost.withColumn("mes_ocorrencia", month_of(F.col(day)))
    by_month = lost.groupBy("mes_ocorrencia").agg(
        F.count("*").alias("registros_orfaos"), F.count_distinct(whole).alias("documentos_afetados"), F.count_distinct("_key").alias("fornecedores_inexistentes"), F.sum(value).alias("valor_total_afetado"),
    )
    # The first few keys of a month: a top-k before anything is collected, so no month's keys meet in one row.
    keys = lost.groupBy("mes_ocorrencia", key).agg(F.lit(1).alias("_one"))
    few = keys.withColumn("_rn", F.row_number().over(Window.partitionBy("mes_ocorrencia").orderBy(key))).where(F.col("_rn") <= samples)
    examples = few.groupBy("mes_ocorrencia").agg(F.sort_array(F.collect_list(key)).alias("exemplos_fornecedor_id"))
    both = by_month.join(examples.withColumnRenamed("mes_ocorrencia", "_month"), F.col("mes_ocorrencia").eqNullSafe(F.col("_month")))
    return both.select(*by_month.columns, "exemplos_fornecedor_id").orderBy("mes_ocorrencia")


def missing_keys_by_month(events: DataFrame, key: str = "fornecedor_id", day: str = "data", value: str = "valor") -> DataFrame:
    """Events with a null or blank key, by month."""
    lost = events.where(is_blank(F.col(key)))
    return lost.groupBy(month_of(F.col(day)).alias("mes_ocorrencia")).agg(F.count("*").alias("registros_sem_fornecedor"), F.sum(value).alias("valor_total")).orderBy("mes_ocorrencia")


def outside_validity_by_month(events: DataFrame, versions: DataFrame, key: str = "fornecedor_id", day: str = "data", value: str = "valor") -> DataFrame:
    """Events whose key is known but in no version valid on their day, by month."""
    keyed = events.where(~is_blank(F.col(key))).withColumn("_n", key_norm(F.col(key)))
    known = versions.withColumn("_n", key_norm(F.col(key)))
    lost = outside_validity(keyed, known, "_n", day)
    return lost.groupBy(month_of(F.col(day)).alias("mes_ocorrencia")).agg(F.count("*").alias("registros_fora_da_vigencia"), F.sum(value).alias("valor_total_afetado")).orderBy("mes_ocorrencia")
