"""The pipelines over real files, run twice, out of order, and after failures."""

from __future__ import annotations

import json

import pytest
from orestrata.operators.quality import QUARANTINE
from orestrata.operators.versioned import VersionedTable
from orestrata.plans import gold
from orestrata.sources import files
from orestrata.streaming import ops, production, sensors, suppliers
from pyspark.sql import functions as F


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x,z\n3,4,5\n")
    (tmp_path / "c.csv").write_text("")
    rows = files.read_csv_by_header(spark, [str(p) for p in tmp_path.glob("*.csv")]).select("x", "y", "z").collect()
    assert sorted(map(tuple, rows), key=str) == [("1", "2", None), ("4", "3", "5")]
    assert files.extract_csv(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="(?i)header|FAILFAST|schema"):
        files.strict_csv(spark, str(tmp_path / "b.csv"), "x string, y string, z string").collect()


@pytest.fixture
def production_cfg(tmp_path):
    (tmp_path / "in").mkdir()
    return production.Config(str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "bronze"), str(tmp_path / "silver"), str(tmp_path / "bad"))


def silver_of(spark, cfg):
    return sorted((r.planta_id, r.moinho_id, str(r.data_producao_utc), str(r.toneladas_produzidas)) for r in VersionedTable(spark, cfg.silver, production.SILVER).read().collect())


def test_production(spark, tmp_path, production_cfg):
    cfg = production_cfg
    (tmp_path / "in/1.csv").write_text(
        "planta_id,moinho_id,data_producao,toneladas_produzidas\nP01,M1,2024-01-15T13:00:00Z,12.5\n,,2024-01-15T13:00:00Z,3\nP01,M1,15/01/2024,3\n"
        'P01,M1,2024-01-16T13:00:00Z,\nP01,M1,2024-01-16T13:00:00Z,"1,5"\nP01,M1,2024-01-16T13:00:00Z,-1\nP01,M2,2024-01-15T10:00:00-03,3\n'
    )
    production.run(spark, cfg)
    (tmp_path / "in/2.csv").write_text("moinho_id,id_planta,toneladas_produzidas,data_producao\nM1,P01,12.7,2024-01-15 10:00:00\nM1,P02,3,2024-01-15T13:00:00Z\n")
    production.run(spark, cfg)
    expected = [("P01", "M1", "2024-01-15 13:00:00", "12.700"), ("P01", "M2", "2024-01-15 13:00:00", "3.000"), ("P02", "M1", "2024-01-15 13:00:00", "3.000")]
    assert silver_of(spark, cfg) == expected
    bad = VersionedTable(spark, cfg.quarantine, QUARANTINE)
    reasons = sorted(r.motivos for r in bad.read().collect())
    assert reasons == [["planta_ausente", "moinho_ausente"], ["timestamp_invalido_ou_ausente"], ["toneladas_invalidas"], ["toneladas_negativas"], ["toneladas_nulas"]]
    assert json.loads(bad.read().where("motivos[0] = 'toneladas_nulas'").first().payload)["toneladas_produzidas"] is None
    # Nothing new: nothing changes. A replayed batch: nothing changes. An older ingestion: nothing changes.
    production.run(spark, cfg)
    silver = VersionedTable(spark, cfg.silver, production.SILVER)
    production.process(spark.read.parquet(f"{cfg.bronze}/_batch=0"), 0, cfg, silver, bad)
    old = spark.read.parquet(f"{cfg.bronze}/_batch=0").withColumn("_ingestion_ts", F.lit("2000-01-01").cast("timestamp")).withColumn("toneladas_produzidas", F.lit("9"))
    production.process(old.where("planta_id = 'P01' AND moinho_id = 'M1'").limit(1), 99, cfg, silver, bad)
    assert silver_of(spark, cfg) == expected
    assert sum(1 for r in bad.read().collect() if r.batch_id == 0) == 5
    assert production.publish(spark, cfg).select("data").distinct().count() == 1


def test_crash_between_the_writes(spark, tmp_path, production_cfg, monkeypatch):
    cfg = production_cfg
    (tmp_path / "in/1.csv").write_text("planta_id,moinho_id,data_producao,toneladas_produzidas\nP,M,2024-01-15T13:00:00Z,1\nP,M,2024-01-15T13:00:00Z,-1\n")
    real = VersionedTable.upsert
    monkeypatch.setattr(VersionedTable, "upsert", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        production.run(spark, cfg)
    monkeypatch.setattr(VersionedTable, "upsert", real)
    production.run(spark, cfg)
    assert len(silver_of(spark, cfg)) == 1 and VersionedTable(spark, cfg.quarantine, QUARANTINE).read().count() == 1


def test_suppliers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "fornecedor_id,nome,endereco,status_contratual,dados_bancarios\n"
    (tmp_path / "in/s_2024-02-01.csv").write_text(head + 'F1,n,"Rua B, 20",a,b\nF2,m,r,a,b\n')
    (tmp_path / "in/s_2024-01-01.csv").write_text(head + 'F1,n,"Rua A, 10",a,b\n')
    cfg = suppliers.Config(str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "bronze"), str(tmp_path / "dim"))
    for _ in range(2):
        suppliers.run(spark, cfg)
    table = VersionedTable(spark, cfg.dimension, cfg.dim.spec)
    assert sorted((r.fornecedor_id, r.endereco, str(r.valid_from)[:10], r.is_current) for r in table.read().collect()) == [
        ("F1", "Rua A, 10", "2024-01-01", False), ("F1", "Rua B, 20", "2024-02-01", True), ("F2", "r", "2024-02-01", True),
    ]


def reading(sensor, ts, temp=1.0, event=None):
    return json.dumps({"sensor_id": sensor, "planta_id": "P", "event_id": event, "timestamp": ts, "leitura": {"temperatura": temp, "vibracao": 2.0, "consumo_eletrico": 3.0}}) + "\n"


def sensor_cfg(tmp_path, **kw):
    (tmp_path / "in").mkdir(exist_ok=True)
    return sensors.Config(str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "bronze"), str(tmp_path / "silver"), **kw)


def drain(spark, cfg):
    for start in (sensors.start_bronze, sensors.start_silver):
        query = start(spark, cfg, drain=True)
        query.awaitTermination()
    return query


def test_sensors(spark, tmp_path):
    cfg = sensor_cfg(tmp_path)
    (tmp_path / "in/1.json").write_text(reading("S", "2024-01-01T10:00:00Z") * 2 + reading("S", "2024-01-01T09:30:00Z") + reading(" ", "2024-01-01T10:00:00Z") + "{broken\n")
    drain(spark, cfg)
    (tmp_path / "in/2.json").write_text(reading("S", "2024-01-01T10:00:00Z") + reading("S", "2024-01-01T20:00:00Z"))
    drain(spark, cfg)
    (tmp_path / "in/3.json").write_text(reading("S", "2024-01-01T05:00:00Z") + reading("T", "2024-01-01T20:01:00Z"))
    query = drain(spark, cfg)
    silver = VersionedTable(spark, cfg.silver, sensors.SILVER)
    times = lambda: sorted(str(r.event_ts)[11:16] for r in silver.read().collect())
    assert times() == ["09:30", "10:00", "20:00", "20:01"]
    assert sum(m["late"] for m in ops.state_metrics(query)) == 1
    assert sensors.reconcile(spark, cfg)["inserted"] == 1
    assert sensors.reconcile(spark, cfg)["inserted"] == 0
    assert times() == ["05:00", "09:30", "10:00", "20:00", "20:01"]
    assert spark.read.parquet(cfg.bronze).where("_rescued IS NOT NULL").count() == 1
    assert gold.sensor_windows(silver.read()).agg(F.sum("leituras")).first()[0] == 5


def test_sensors_by_event_id(spark, tmp_path):
    cfg = sensor_cfg(tmp_path, use_event_id=True)
    (tmp_path / "in/1.json").write_text(reading("S", "2024-01-01T10:00:00Z", event="e") + reading("S", "2024-01-01T10:01:00Z", event="e") + reading("S", "2024-01-01T10:02:00Z") + reading("S", "2024-01-01T10:03:00Z"))
    drain(spark, cfg)
    silver = VersionedTable(spark, cfg.silver, sensors.SILVER)
    assert silver.read().count() == 3
    for _ in range(2):
        assert sensors.reconcile(spark, cfg)["inserted"] == 0


def test_restarts_and_logs(capsys):
    calls = []

    def start():
        calls.append(1)
        if len(calls) < 3:
            raise KeyError("columns")
        return "done"

    assert ops.with_restarts(start, 2, lambda e: isinstance(e, KeyError)) == "done"
    with pytest.raises(ValueError):
        ops.with_restarts(lambda: (_ for _ in ()).throw(ValueError()), 2)
    log = ops.logger("orestrata.test")
    with ops.Timed(log, "work", n=1) as seen:
        seen["rows"] = 2
    with pytest.raises(ZeroDivisionError), ops.Timed(log, "work"):
        1 / 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["event"] for x in lines] == ["work", "work_failed"] and lines[0]["rows"] == 2


def test_command_lines():
    base = ["--landing-path", "a", "--checkpoint-base", "b", "--bronze", "c"]
    cfg = production.parse([*base, "--silver", "d", "--quarantine", "e", "--zone-by-plant", '{"P": "UTC"}'])
    assert cfg.zone_by_plant == {"P": "UTC"} and cfg.max_files_per_trigger == 1000
    assert suppliers.parse([*base, "--dimension", "d", "--salt", "s"]).dim.salt == "s"
    mode, sensor = sensors.parse(["--mode", "reconcile", *base, "--silver", "d", "--use-event-id"])
    assert mode == "reconcile" and sensor.keys == ("sensor_id", "reading_key")


def test_observed(spark):
    df, seen = ops.observed(spark.range(5), n=F.count("*"))
    df.collect()
    assert seen.get == {"n": 5}
