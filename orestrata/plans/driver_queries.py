"""The engine's operators over the star-schema tables, and the same questions as SQL for an independent engine.

The stand-ins: plant = a supplier's nation, mill = supplier, production = lineitem, supplier master = supplier, ERP event =
lineitem, sensor reading = events. Floating results that two engines may sum in different orders are rounded far from
ties, money is summed as decimal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contract import TableSpec
from ..functions.scalars import alpha_pad, attribute_hash, key_norm, month_of, months_between, payload, snapshot_date, to_utc, zone_of
from ..operators import access, aggregates, dedup, joins, quality, scd2
from ..operators.versioned import VersionedTable
from ..session import load
from ..streaming import production as production_stream
from ..streaming import sensors as sensors_stream
from . import analytics, gold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    mills = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("moinho_id"), F.col("s_nationkey").alias("planta_id"))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("moinho_id"), F.to_date("l_shipdate").alias("data"), F.col("l_quantity").alias("toneladas_produzidas"))
    return rows.join(mills, "moinho_id")


def erp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as ERP events: every 50th has no supplier, the keys of odd lines are zero-padded."""
    key = F.when(F.col("l_orderkey") % 50 != 0, F.when(F.col("l_linenumber") % 2 == 1, F.lpad(F.col("l_suppkey").cast("string"), 10, "0")).otherwise(F.col("l_suppkey").cast("string")))
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("bukrs"), F.col("l_orderkey").alias("belnr"), key.alias("fornecedor_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("valor"), F.to_date("l_shipdate").alias("data"),
    )


def known_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").cast("string").alias("fornecedor_id"), F.col("s_name").alias("nome"))


def place(spark: SparkSession) -> str:
    """A new table's place below spark.checkpoint.dir, or the warehouse of a local session."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{base}/table-{uuid.uuid4().hex}"


_ERP = """e AS (SELECT l_returnflag AS bukrs, l_orderkey AS belnr, CAST(l_suppkey AS VARCHAR) AS k, l_orderkey % 50 = 0 AS missing, l_linenumber,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS valor, CAST(l_shipdate AS DATE) AS data FROM lineitem)"""


@query("""
WITH d AS (SELECT s_nationkey AS planta_id, l_suppkey AS moinho_id, CAST(l_shipdate AS DATE) AS data, sum(l_quantity) AS x
           FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
s AS (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s, count(x) OVER w AS n FROM d
      WINDOW w AS (PARTITION BY planta_id, moinho_id ORDER BY data RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT planta_id, moinho_id, data, x AS producao_dia, round(m, 4) AS media_7d, round(s, 4) AS desvio_7d, round(m - 2 * s, 4) AS limite_inferior,
       round(m + 2 * s, 4) AS limite_superior, round((x - m) / s, 4) AS z_score, CASE WHEN x > m THEN 'ACIMA' ELSE 'ABAIXO' END AS tipo_anomalia
FROM s WHERE n >= 5 AND s > 0 AND abs(x - m) > 2 * s""")
def rolling_anomalies(spark, d):
    out = analytics.rolling_anomalies(production(spark, d), rounded=False)
    return out.withColumns({c: F.round(c, 4) for c in ("media_7d", "desvio_7d", "limite_inferior", "limite_superior", "z_score")})


@query("""
WITH p AS (SELECT s_nationkey AS planta_id, l_suppkey AS moinho_id, CAST(l_shipdate AS DATE) AS data, l_quantity AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
           WHERE l_shipdate >= DATE '2000-12-01' AND l_shipdate < DATE '2001-07-01'),
c AS (SELECT CAST(unnest(generate_series(DATE '2000-12-01', DATE '2001-06-01', INTERVAL 1 MONTH)) AS DATE) AS mes),
m AS (SELECT planta_id, moinho_id, CAST(date_trunc('month', data) AS DATE) AS mes, sum(t) AS t FROM p GROUP BY ALL),
s AS (SELECT k.planta_id, k.moinho_id, c.mes, CASE WHEN m.mes IS NULL THEN 0 ELSE m.t END AS t
      FROM (SELECT DISTINCT planta_id, moinho_id FROM p) k CROSS JOIN c LEFT JOIN m ON m.planta_id = k.planta_id AND m.moinho_id = k.moinho_id AND m.mes = c.mes),
v AS (SELECT *, lag(t) OVER (PARTITION BY planta_id, moinho_id ORDER BY mes) AS b FROM s),
q AS (SELECT *, (b - t) / b * 100 AS pct FROM v WHERE mes >= DATE '2001-01-01' AND b > 0 AND t < b),
w AS (SELECT *, row_number() OVER (PARTITION BY planta_id, moinho_id ORDER BY pct DESC, mes DESC) AS rn FROM q),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY pct DESC, planta_id, moinho_id) AS INTEGER) AS posicao FROM w WHERE rn = 1)
SELECT posicao, planta_id, moinho_id, mes AS mes_da_queda, b AS toneladas_mes_anterior, t AS toneladas_no_mes, round(pct, 4) AS queda_pct FROM r WHERE posicao <= 3""")
def monthly_drop_top3(spark, d):
    return analytics.monthly_drop(production(spark, d), F.lit("2001-07-15").cast("date"), rounded=False).withColumn("queda_pct", F.round("queda_pct", 4))


@query("""
WITH c AS (SELECT c_nationkey AS planta_id, c_custkey % 4 AS moinho_id FROM customer GROUP BY ALL),
m AS (SELECT planta_id, moinho_id, round((50 - planta_id % 5) / 50.0 * 100, 4) AS pct, planta_id % 5 AS now FROM c WHERE planta_id % 5 < 50),
r AS (SELECT *, CAST(rank() OVER (ORDER BY pct DESC) AS INTEGER) AS posicao FROM m)
SELECT posicao, planta_id, moinho_id, pct AS queda_pct FROM r WHERE posicao <= 3""")
def monthly_drop_ties(spark, d):
    """Mills that fall from 50 to their plant's number modulo 5: equal drops share a place, and all of them come."""
    mills = load(spark, d, "customer").select(F.col("c_nationkey").alias("planta_id"), (F.col("c_custkey") % 4).alias("moinho_id")).distinct()
    before = mills.select("*", F.lit("2001-05-10").cast("date").alias("data"), F.lit(50.0).alias("toneladas_produzidas"))
    after = mills.select("*", F.lit("2001-06-10").cast("date").alias("data"), (F.col("planta_id") % 5).cast("double").alias("toneladas_produzidas"))
    out = analytics.monthly_drop(before.unionByName(after), F.lit("2001-07-15").cast("date"), months=1, rounded=False, ties=True)
    return out.select("posicao", "planta_id", "moinho_id", F.round("queda_pct", 4).alias("queda_pct"))


@query(f"""
WITH {_ERP}, o AS (SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN lpad(k, 10, '0') ELSE k END AS raw FROM e WHERE NOT missing AND CAST(k AS BIGINT) % 10 = 3 OR (NOT missing AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = CAST(k AS BIGINT))))
SELECT CAST(date_trunc('month', data) AS DATE) AS mes_ocorrencia, count(*) AS registros_orfaos, count(DISTINCT (bukrs, belnr)) AS documentos_afetados,
       count(DISTINCT k) AS fornecedores_inexistentes, CAST(sum(valor) AS DECIMAL(28,2)) AS valor_total_afetado, list_aggregate(list_sort(list_distinct(list(raw)))[1:5], 'string_agg', ',') AS exemplos_fornecedor_id
FROM o GROUP BY 1""")
def fk_orphans_by_month(spark, d):
    out = analytics.orphans_by_month(erp(spark, d), known_suppliers(spark, d))
    return out.withColumn("exemplos_fornecedor_id", F.array_join("exemplos_fornecedor_id", ","))


@query(f"""
WITH {_ERP} SELECT CAST(date_trunc('month', data) AS DATE) AS mes_ocorrencia, count(*) AS registros_sem_fornecedor, CAST(sum(valor) AS DECIMAL(28,2)) AS valor_total FROM e WHERE missing GROUP BY 1""")
def fk_null_keys(spark, d):
    return analytics.missing_keys_by_month(erp(spark, d))


_VERSIONS = """o AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS v, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS rn FROM orders),
p AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY day) AS b, row_number() OVER (PARTITION BY k ORDER BY day) AS i FROM o WHERE rn = 1),
h AS (SELECT k, v, day AS valid_from, lead(day) OVER (PARTITION BY k ORDER BY day) AS valid_to FROM p WHERE i = 1 OR v IS DISTINCT FROM b)"""


def status_history(spark, d) -> DataFrame:
    """Versions of each customer's latest order status: one change a day at most."""
    o = load(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("at"), "o_orderstatus", "o_orderkey")
    daily = dedup.keep_one(o, ["o_custkey", "at"], [F.desc("o_orderkey")])
    return scd2.history(daily, "o_custkey", "at", "o_orderstatus")


@query(f"WITH {_VERSIONS} SELECT k AS o_custkey, v AS o_orderstatus, valid_from, valid_to, valid_to IS NULL AS is_current FROM h")
def scd2_history(spark, d):
    return status_history(spark, d)


@query("SELECT 0::BIGINT AS keys_without_one_current, 0::BIGINT AS gaps_or_overlaps")
def scd2_validation(spark, d):
    return scd2.violations(status_history(spark, d), "o_custkey")


@query("""
SELECT s_suppkey::VARCHAR AS fornecedor_id, s_name AS nome, s_nationkey::VARCHAR AS endereco, day AS valid_from, nxt AS valid_to, nxt IS NULL AS is_current FROM (
  SELECT *, lead(day) OVER (PARTITION BY s_suppkey ORDER BY day) AS nxt FROM (
    SELECT s_suppkey, s_name, s_nationkey, DATE '2024-01-01' AS day FROM supplier
    UNION ALL SELECT s_suppkey, s_name, s_nationkey + 100, DATE '2024-02-01' FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT s_suppkey, s_name, s_nationkey + 200, DATE '2024-03-01' FROM supplier WHERE s_suppkey % 6 = 0
    UNION ALL SELECT s_suppkey, s_name, s_nationkey + 7, DATE '2024-02-01' FROM supplier WHERE s_suppkey % 3 <> 0))""")
def scd2_apply(spark, d):
    """Three snapshots and a late one, each applied in one commit to a versioned table."""
    dim = scd2.Dimension(attributes=("nome", "endereco"))
    table = VersionedTable(spark, place(spark), dim.spec)
    s = load(spark, d, "supplier")

    def snapshot(day: str, shift) -> DataFrame:
        return s.select(
            F.col("s_suppkey").cast("string").alias("fornecedor_id"), F.col("s_name").alias("nome"), (F.col("s_nationkey") + shift).cast("string").alias("endereco"),
            F.lit(day).cast("date").alias("_snapshot_date"), F.lit(day).cast("timestamp").alias("_ingestion_ts"),
        )

    third, sixth = F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 6 == 0
    scd2.apply(table, snapshot("2024-01-01", F.lit(0)), dim)
    scd2.apply(table, snapshot("2024-02-01", F.when(third, 100).otherwise(0)), dim)
    scd2.apply(table, snapshot("2024-03-01", F.when(sixth, 200).when(third, 100).otherwise(0)), dim)
    scd2.apply(table, snapshot("2024-02-01", F.lit(7)), dim)  # too late for those that changed since January
    return table.read().select("fornecedor_id", "nome", "endereco", F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"), "is_current")


@query(f"""
WITH {_VERSIONS}, v AS (SELECT k, valid_from, valid_to FROM h WHERE v <> 'O'),
l AS (SELECT user_id AS k, CAST(ts AS DATE) - INTERVAL 8000 DAY AS d0, CAST(value AS DECIMAL(18,4)) AS valor FROM events),
f AS (SELECT k, CAST(d0 AS DATE) AS data, valor FROM l)
SELECT CAST(date_trunc('month', data) AS DATE) AS mes_ocorrencia, count(*) AS registros_fora_da_vigencia, CAST(sum(valor) AS DECIMAL(28,4)) AS valor_total_afetado FROM f
WHERE EXISTS (SELECT 1 FROM v WHERE v.k = f.k) AND NOT EXISTS (SELECT 1 FROM v WHERE v.k = f.k AND data >= valid_from AND (valid_to IS NULL OR data < valid_to)) GROUP BY 1""")
def out_of_validity(spark, d):
    versions = status_history(spark, d).where("o_orderstatus <> 'O'").withColumn("fornecedor_id", F.col("o_custkey").cast("string"))
    facts = load(spark, d, "events").select(F.col("user_id").cast("string").alias("fornecedor_id"), F.date_sub(F.to_date("ts"), 8000).alias("data"), F.col("value").cast("decimal(18,4)").alias("valor"))
    return analytics.outside_validity_by_month(facts, versions)


@query(f"""
WITH {_VERSIONS} SELECT event_id, user_id, h.v AS status FROM events e LEFT JOIN h ON h.k = e.user_id AND CAST(e.ts AS DATE) - 8000 >= valid_from AND (valid_to IS NULL OR CAST(e.ts AS DATE) - 8000 < valid_to)""")
def point_in_time_join(spark, d):
    facts = load(spark, d, "events").select("event_id", "user_id", F.date_sub(F.to_date("ts"), 8000).alias("at"))
    versions = status_history(spark, d).select(F.col("o_custkey").alias("user_id"), "valid_from", "valid_to", F.col("o_orderstatus").alias("status"))
    return joins.point_in_time(facts, versions, "user_id", "at", ["status"]).drop("at")


@query("""
SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS l_shipdate, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""")
def keep_latest_dedup(spark, d):
    order = [F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return dedup.keep_one(rows, ["l_orderkey", "l_linenumber"], order).withColumn("l_shipdate", F.to_date("l_shipdate"))


@query("SELECT user_id, min(ts) AS first_ts, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def keep_first_reading(spark, d):
    rows = load(spark, d, "events").select("user_id", "ts", "event_id")
    return dedup.keep_one(rows, ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", F.col("ts").cast("timestamp_ntz").alias("first_ts"), "event_id")


_ORDERS = TableSpec("o_orderkey bigint, o_orderdate date, price decimal(18,2), _ingestion_ts timestamp", not_null=("o_orderkey",), partition_by="o_orderdate")


def _order_table(spark, d) -> tuple[VersionedTable, DataFrame]:
    """Orders not divisible by 3, and an update of the even ones: newer for multiples of 4, older for the others."""
    o = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    at = lambda text: F.lit(text).cast("timestamp")
    month = _ORDERS.__class__(_ORDERS.schema, _ORDERS.not_null)
    table = VersionedTable(spark, place(spark), month)
    table.append(o.where("o_orderkey % 3 <> 0").withColumn("_ingestion_ts", at("2024-01-02 00:00:00")))
    stamp = F.when(F.col("o_orderkey") % 4 == 0, at("2024-01-03 00:00:00")).otherwise(at("2024-01-01 00:00:00"))
    return table, o.where("o_orderkey % 2 = 0").withColumn("price", F.lit(1).cast("decimal(18,2)")).withColumn("_ingestion_ts", stamp)


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CASE WHEN o_orderkey % 4 = 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) THEN 1.00 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END::DECIMAL(18,2) AS price
FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""")
def upsert_if_newer(spark, d):
    table, update = _order_table(spark, d)
    table.upsert(update, ["o_orderkey"], "_ingestion_ts", batch=("u", 1))
    table.upsert(update.withColumn("price", F.lit(9).cast("decimal(18,2)")), ["o_orderkey"], "_ingestion_ts", batch=("u", 1))  # a replay
    return table.read().drop("_ingestion_ts")


@query("""
SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey ELSE -1 END AS k, 'old' AS v FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 2 <> 0
UNION ALL SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey ELSE -1 END, 'new' FROM orders WHERE o_orderkey % 2 = 0""")
def upsert_null_keys(spark, d):
    """Every fifth order has no key: in an upsert of the even ones such rows match nothing and stay, on both sides."""
    o = load(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("k"), "o_orderkey")
    table = VersionedTable(spark, place(spark), TableSpec("k bigint, v string"))
    table.append(o.select("k", F.lit("old").alias("v")))
    table.upsert(o.where("o_orderkey % 2 = 0").select("k", F.lit("new").alias("v")), ["k"], None)
    return table.read().select(F.coalesce("k", F.lit(-1)).cast("bigint").alias("k"), "v")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey + 1000000000, 'P' FROM orders WHERE o_orderstatus = 'P'")
def replaced_partition(spark, d):
    """One partition replaced atomically, then all compacted: every file stays sorted by key."""
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    table = VersionedTable(spark, place(spark), TableSpec("o_orderkey bigint, o_orderstatus string", partition_by="o_orderstatus", sort_by=("o_orderkey",)))
    table.append(o.where("o_orderkey % 2 = 0"))
    table.append(o.where("o_orderkey % 2 <> 0"))
    table.overwrite(o.where("o_orderstatus = 'P'").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000), only_parts=True)
    table.compact()
    return table.read()


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber = 1 AS no_mill, l_suppkey % 11 = 0 AS no_plant, l_quantity > 40 AS no_number FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN no_plant THEN 'planta_ausente' END, CASE WHEN no_mill THEN 'moinho_ausente' END, CASE WHEN no_number THEN 'toneladas_invalidas' END) AS motivos
FROM r WHERE no_mill OR no_plant OR no_number""")
def quarantine_rows(spark, d):
    """Raw production rows through normalisation and rules to the quarantine, a replayed batch once."""
    config = production_stream.Config("", "", "", "", "")
    raw = load(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, "  ").otherwise(F.col("l_suppkey").cast("string")).alias("moinho_id"), F.when(F.col("l_suppkey") % 11 != 0, "P").alias("id_planta"),
        F.lit("2024-03-01T10:00:00Z").alias("data_producao"), F.when(F.col("l_quantity") > 40, "x").otherwise(" 1.5 ").alias("toneladas_produzidas"),
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("_source_file"), F.lit("2024-03-02").cast("timestamp").alias("_ingestion_ts"),
    )
    table = VersionedTable(spark, place(spark), quality.QUARANTINE)
    rows = quality.rejected(quality.classify(production_stream.normalise(raw, config), production_stream.rules()))
    for _ in range(2):
        quality.quarantine(table, rows, 7, "production")
    key = F.split("arquivo_origem", "/")
    return table.read().select(key[0].cast("bigint").alias("l_orderkey"), key[1].cast("int").alias("l_linenumber"), F.array_join("motivos", ",").alias("motivos"))


@query("SELECT event_id AS event_id, CAST(user_id AS VARCHAR) AS sensor_id, ts AS event_ts, CAST(ts AS DATE) AS event_date, CASE WHEN event_id % 3 <> 0 THEN value END AS vibracao FROM events WHERE event_id % 7 <> 0 AND event_id % 10 <> 0")
def flatten_readings(spark, d):
    """Nested readings made flat and typed: no sensor or no time is left out, a value that is no number becomes null."""
    e = load(spark, d, "events")
    sensor = F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    value = F.when(F.col("event_id") % 3 != 0, F.col("value").cast("string")).otherwise("x")
    nested = e.select(
        sensor.alias("sensor_id"), F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("timestamp"),
        F.struct(value.alias("temperatura"), value.alias("vibracao"), value.alias("consumo_eletrico")).alias("leitura"), F.col("ts").alias("_ingestion_ts"), F.lit("f").alias("_source_file"),
    )
    flat = sensors_stream.flatten(nested)
    return flat.select(F.col("event_id").cast("bigint").alias("event_id"), "sensor_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "event_date", "vibracao")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 THEN 'delete' ELSE 'insert' END AS _change FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 3 = 0)
UNION ALL SELECT o_orderkey, 'insert' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0""")
def change_feed(spark, d):
    table, update = _order_table(spark, d)
    table.upsert(update, ["o_orderkey"], "_ingestion_ts")
    return table.changes(1).select("o_orderkey", "_change")


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders WHERE o_orderkey % 3 <> 0")
def time_travel(spark, d):
    """An older version restored after an upsert."""
    table, update = _order_table(spark, d)
    table.upsert(update, ["o_orderkey"], None)
    table.restore(1)
    return table.read().select("o_orderkey", "price")


@query("SELECT event_id, user_id FROM events")
def insert_only_reconcile(spark, d):
    """A stream that lost a seventh of its events, then the insert-only merge of all of them, twice."""
    e = load(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    table = VersionedTable(spark, place(spark), TableSpec("event_id bigint, user_id bigint, day date", not_null=("event_id",), partition_by="day"))
    table.append(e.where("event_id % 7 <> 0"))
    table.insert_only(e, ["event_id"], prune=True)
    table.insert_only(e, ["event_id"], prune=True)
    return table.read().select("event_id", "user_id")


@query("""
SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 7 = 0 THEN 'chave_ausente' END, CASE WHEN s_acctbal < 0 THEN 'saldo_negativo' END, CASE WHEN s_nationkey > 20 THEN 'nacao_invalida' END) AS motivos FROM supplier""")
def quality_reasons(spark, d):
    rules = [quality.Rule("chave_ausente", F.col("s_suppkey") % 7 == 0), quality.Rule("saldo_negativo", F.col("s_acctbal") < 0), quality.Rule("nacao_invalida", F.col("s_nationkey") > 20)]
    return quality.classify(load(spark, d, "supplier"), rules).select("s_suppkey", F.array_join("_reason", ",").alias("motivos"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS inicio, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS v FROM events GROUP BY 1, 2")
def window_5min(spark, d):
    e = load(spark, d, "events").groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("v"))
    return e.select(F.col("window.start").cast("timestamp_ntz").alias("inicio"), "event_type", "n", "v")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS inicio, CAST(user_id AS VARCHAR) AS sensor_id, count(*) AS leituras, max(value) AS vibracao_max FROM events GROUP BY 1, 2")
def gold_sensor_windows(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").cast("string").alias("sensor_id"), F.col("ts").alias("event_ts"), F.col("value").alias("temperatura"), F.col("value").alias("vibracao"), F.col("value").alias("consumo_eletrico"))
    return gold.sensor_windows(e).select(F.col("inicio").cast("timestamp_ntz").alias("inicio"), "sensor_id", "leituras", "vibracao_max")


@query("SELECT s_nationkey AS planta_id, CAST(l_shipdate AS DATE) AS data, sum(l_quantity) AS toneladas, count(DISTINCT l_suppkey) AS moinhos_ativos, sum(l_quantity) / count(DISTINCT l_suppkey) AS toneladas_por_moinho FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def gold_plant_productivity(spark, d):
    return gold.plant_productivity(production(spark, d), "data")


@query(f"""
WITH {_ERP}, j AS (SELECT e.*, s_name, s_suppkey IS NOT NULL AS ok FROM e LEFT JOIN supplier ON NOT missing AND s_suppkey = CAST(k AS BIGINT) AND s_suppkey % 10 <> 3)
SELECT CAST(date_trunc('month', data) AS DATE) AS mes, ok AS fornecedor_valido, CASE WHEN ok THEN k END AS chave, count(*) AS eventos, CAST(sum(valor) AS DECIMAL(28,2)) AS valor, s_name AS nome FROM j GROUP BY 1, 2, 3, 6""")
def gold_supplier_finance(spark, d):
    return gold.supplier_finance(erp(spark, d), known_suppliers(spark, d).withColumn("is_current", F.lit(True)))


@query("SELECT l_returnflag, sum(l_quantity) AS total, count(l_quantity) AS n FROM lineitem GROUP BY 1")
def salted_sum(spark, d):
    return aggregates.salted_sum(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")


@query("SELECT o_orderpriority, count(*) AS n, count(*) * 100 / sum(count(*)) OVER () AS pct FROM orders GROUP BY 1")
def share_of_total(spark, d):
    return aggregates.share_of_total(load(spark, d, "orders"), "o_orderpriority")


@query("SELECT o_custkey, count(*) AS versions FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def versions_per_key(spark, d):
    return aggregates.versions_per_key(load(spark, d, "orders"), "o_custkey")


@query("SELECT quantile_disc(s, 0.5) AS p50, quantile_disc(s, 0.95) AS p95, quantile_disc(s, 0.99) AS p99, quantile_disc(s, 0.999) AS p99_9 FROM (SELECT (event_id * 37) % 7201 AS s FROM events)")
def lateness_percentiles(spark, d):
    e = load(spark, d, "events").select("ts", (F.col("ts").cast("long") + (F.col("event_id") * 37) % 7201).cast("timestamp").alias("arrival"))
    return aggregates.lateness_percentiles(e, "ts", "arrival", accuracy=1_000_000)


@query("SELECT l_returnflag, n_a, n_b, q_a AS l_quantity_a, q_b AS l_quantity_b FROM (SELECT l_returnflag, count(*) AS n_a, sum(l_quantity) AS q_a, count(*) FILTER (WHERE l_linenumber <> 1 OR l_returnflag <> 'R') AS n_b, sum(l_quantity) FILTER (WHERE l_linenumber <> 1 OR l_returnflag <> 'R') AS q_b FROM lineitem GROUP BY 1) WHERE n_a <> n_b OR q_a <> q_b")
def compare_versions(spark, d):
    a = load(spark, d, "lineitem")
    return aggregates.compare(a, a.where("l_linenumber <> 1 OR l_returnflag <> 'R'"), ["l_returnflag"], ["l_quantity"])


@query("SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, (event_id * 7919) % 1000003 AS p FROM events) e JOIN (SELECT o_orderkey, (o_orderkey * 104729) % 1000003 AS a, (o_orderkey * 104729) % 1000003 + 1 + o_orderkey % 40 AS b FROM orders) o ON p >= a AND p < b")
def range_join(spark, d):
    e = load(spark, d, "events").select("event_id", ((F.col("event_id") * 7919) % 1000003).alias("p"))
    start = (F.col("o_orderkey") * 104729) % 1000003
    o = load(spark, d, "orders").select("o_orderkey", start.alias("a"), (start + 1 + F.col("o_orderkey") % 40).alias("b"))
    return joins.range_join(e, o, "p", "a", "b", 32).select("event_id", "o_orderkey")


@query("SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q, min(s_nationkey) AS nation FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def hot_key_split_join(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    out = joins.split_join(load(spark, d, "lineitem").select("l_suppkey", "l_quantity"), s, "l_suppkey")
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.min("s_nationkey").alias("nation"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def shuffle_hash_join(spark, d):
    c, n = load(spark, d, "customer").withColumnRenamed("c_nationkey", "k"), load(spark, d, "nation").withColumnRenamed("n_nationkey", "k")
    return joins.hash_join(c, n, "k").select("c_custkey", "n_name")


@query("SELECT c_custkey, CASE WHEN n_regionkey <> 2 THEN n_name END AS n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def narrow_lookup(spark, d):
    n = load(spark, d, "nation").withColumns({"is_current": F.col("n_regionkey") != 2, "k": F.col("n_nationkey")})
    return joins.lookup(load(spark, d, "customer").withColumn("k", F.col("c_nationkey")), n, "k", ["n_name"]).select("c_custkey", "n_name")


@query(f"WITH {_ERP} SELECT bukrs, belnr, NOT missing AND coalesce(s_suppkey % 10 <> 3, false) AS fornecedor_valido, count(*) AS n FROM e LEFT JOIN supplier ON s_suppkey = CAST(k AS BIGINT) GROUP BY 1, 2, 3")
def orphan_flag(spark, d):
    key = key_norm(F.col("fornecedor_id"))
    return joins.flag_known(erp(spark, d), known_suppliers(spark, d), key, key).groupBy("bukrs", "belnr", "fornecedor_valido").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_name IS NOT NULL THEN '***' END AS s_name FROM supplier WHERE s_nationkey IN (3, 7)")
def masked_rows(spark, d):
    rows = access.visible_rows(load(spark, d, "supplier"), "s_nationkey", {"planta_3", "planta_7"})
    return access.masked(rows, {"s_name": "auditoria"}, {"planta_3"}).select("s_suppkey", "s_name")


@query("""
SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 3 HOUR END AS utc FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 0""")
def to_utc_times(spark, d):
    """Even orders carry a Z, odd ones an hour-only offset of -03, every fifth is no time."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("2024")).when(F.col("o_orderkey") % 2 == 0, F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("-03")))
    out = load(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    return out.select("o_orderkey", to_utc(F.col("raw"), zone_of(F.lit("P"), {"P": "America/Sao_Paulo"}, "UTC")).cast("timestamp_ntz").alias("utc"))


@query("SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 10, '0') AS padded, s_suppkey::VARCHAR AS norm, upper(s_name) AS name_norm, CASE WHEN s_suppkey % 4 = 0 THEN DATE '2024-05-06' ELSE DATE '2020-01-01' END AS day FROM supplier")
def alpha_normalise(spark, d):
    k = F.col("s_suppkey").cast("string")
    path = F.when(F.col("s_suppkey") % 4 == 0, "/a/2023-01-01/f_2024-05-06.csv").otherwise("/a/f_2024-13-45.csv")
    return load(spark, d, "supplier").select(
        "s_suppkey", alpha_pad(k).alias("padded"), key_norm(F.concat(F.lit(" 000"), k, F.lit(" "))).alias("norm"), key_norm(F.col("s_name")).alias("name_norm"),
        snapshot_date(path, F.lit("2020-01-01").cast("date")).alias("day"),
    )


@query("SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS mes FROM (SELECT date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS b FROM orders)")
def month_calendar(spark, d):
    ends = load(spark, d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return ends.select(months_between(month_of(F.col("a")), month_of(F.col("b"))).alias("mes"))


@query("""SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS payload, sha256('s;r_name=' || length(r_name) || ':' || r_name || ';') AS hash FROM region""")
def json_payload(spark, d):
    r = load(spark, d, "region")
    return r.withColumn("_technical", F.lit(1)).select("r_regionkey", payload(["r_regionkey", "r_name", "_technical"]).alias("payload"), attribute_hash(["r_name"], "s").alias("hash"))


@query("SELECT max(ts) AS newest, CAST(epoch(TIMESTAMP '2024-03-01 00:00:00') - floor(epoch(max(ts))) AS BIGINT) AS lag_seconds, true AS stale FROM events")
def freshness(spark, d):
    out = quality.freshness(load(spark, d, "events"), "ts", F.lit("2024-03-01 00:00:00").cast("timestamp"), 3600)
    return out.withColumn("newest", F.col("newest").cast("timestamp_ntz"))
