"""Versioned tables and history."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from orestrata.functions.contract import ConstraintViolation, TableSpec
from orestrata.operators import scd2
from orestrata.operators.versioned import ConcurrentCommit, VersionedTable
from pyspark.sql import functions as F

SPEC = TableSpec("k int, v string, at timestamp, d date", not_null=("k",), checks={"short": "length(v) < 5"}, partition_by="d", sort_by=("k",))


def t(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def rows(spark, *r):
    return spark.createDataFrame([(k, v, t(n), dt.date(2024, 1, d)) for k, v, n, d in r], "k int, v string, at timestamp, d date")


def content(table, version=None):
    return sorted((r.k, r.v) for r in table.read(version).collect())


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), SPEC)


def test_empty(table):
    assert content(table) == [] and not table.exists()


def test_append_replay_and_time_travel(spark, table):
    table.append(rows(spark, (1, "a", 0, 1)), ("w", 0))
    table.append(rows(spark, (1, "a", 0, 1)), ("w", 0))
    table.append(rows(spark, (2, "b", 0, 2)), ("w", 1))
    assert content(table) == [(1, "a"), (2, "b")] and content(table, 1) == [(1, "a")]
    table.restore(1)
    assert content(table) == [(1, "a")] and [v.operation for v in table.history()] == ["append", "append", "restore 1"]


def test_upsert_only_newer_and_only_touched_partitions(spark, table):
    table.append(rows(spark, (1, "a", 5, 1), (2, "b", 5, 1), (3, "c", 5, 2)))
    before = table.version()
    table.upsert(rows(spark, (1, "A", 6, 1), (2, "B", 5, 1), (4, "D", 1, 1)), ["k", "d"], "at", prune=True)
    assert content(table) == [(1, "A"), (2, "b"), (3, "c"), (4, "D")]
    assert table.version().parts["2024-01-02"] == before.parts["2024-01-02"]
    table.upsert(rows(spark, (2, "Z", 0, 1)), ["k", "d"], None)
    assert (2, "Z") in content(table)


def test_upsert_keeps_null_keys_and_replaces_repeats(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "n"), TableSpec("k int, v int"))
    df = lambda *r: spark.createDataFrame(r, "k int, v int")
    table.append(df((None, 1), (None, 2), (1, 1), (2, 2), (2, 3), (3, 3), (3, 4)))
    table.upsert(df((None, 9), (1, 5), (2, 1)), ["k"], "v")
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted([(None, 1), (None, 2), (None, 9), (1, 5), (2, 2), (2, 3), (3, 3), (3, 4)], key=str)
    table.upsert(df((2, 0), (4, 0)), ["k"], None)
    assert sorted(r.v for r in table.read().where("k = 2").collect()) == [0] and table.read().where("k = 4").count() == 1


def test_files_are_sorted(spark, tmp_path):
    spec = TableSpec("k int, p string", partition_by="p", sort_by=("k",))
    table = VersionedTable(spark, str(tmp_path / "s"), spec)
    table.append(spark.range(2000).selectExpr("cast(id * 7919 % 2003 AS int) AS k", "cast(id % 2 AS string) AS p").repartition(2))
    import glob

    import pyarrow.parquet as pq

    files = glob.glob(f"{tmp_path}/s/data/*/*/*.parquet")
    assert files
    for f in files:
        keys = pq.read_table(f, columns=["k"], partitioning=None).column("k").to_pylist()
        assert keys == sorted(keys)


def test_insert_only(spark, table):
    table.append(rows(spark, (1, "a", 0, 1)))
    for _ in range(2):
        table.insert_only(rows(spark, (1, "x", 9, 1), (2, "b", 0, 2)), ["k"], prune=True)
    assert content(table) == [(1, "a"), (2, "b")]


def test_constraints_stop_a_commit(spark, table):
    table.append(rows(spark, (1, "a", 0, 1)))
    with pytest.raises(ConstraintViolation):
        table.append(rows(spark, (2, "toolong", 0, 1)))
    assert content(table) == [(1, "a")]
    table.vacuum()
    assert content(table) == [(1, "a")]


def test_lost_race_is_noticed_and_retried(spark, table):
    base = table.version()
    table.append(rows(spark, (1, "a", 0, 1)))
    with pytest.raises(ConcurrentCommit):
        table._commit(base, {}, "late", None)
    real, calls = table._commit, []

    def racing(at, parts, operation, batch):
        if not calls:
            calls.append(1)
            other = VersionedTable(spark, table.root, SPEC)
            other.append(rows(spark, (9, "z", 0, 3)))
        return real(at, parts, operation, batch)

    table._commit = racing
    table.append(rows(spark, (2, "b", 0, 2)), pause=0)
    assert content(table) == [(1, "a"), (2, "b"), (9, "z")]


def test_changes_compaction_and_replacement(spark, table):
    table.append(rows(spark, (1, "a", 0, 1), (1, "a", 0, 1)))
    table.append(rows(spark, (2, "b", 0, 1)))
    table.overwrite(rows(spark, (1, "a", 0, 1)), only_parts=True)
    assert sorted((r.k, r._change) for r in table.changes(2).collect()) == [(1, "delete"), (2, "delete")]
    table.append(rows(spark, (3, "c", 0, 1)))
    table.compact()
    assert [len(d) for d in table.version().parts.values()] == [1] and content(table) == [(1, "a"), (3, "c")]
    assert table.changes(4).count() == 0
    assert table.vacuum() > 0 and content(table) == [(1, "a"), (3, "c")]
    assert table.statistics().first().rows == 2
    table.view("published", columns={"dia": F.col("d")})
    assert spark.sql("SELECT max(dia) m FROM published").first().m == dt.date(2024, 1, 1)


DIM = scd2.Dimension(attributes=("nome", "endereco"))


def snapshot(spark, day, *people, stated=None):
    d = dt.date(2024, 1, day)
    return spark.createDataFrame(
        [(k, n, e, stated, d, dt.datetime(2024, 1, day)) for k, n, e in people],
        "fornecedor_id string, nome string, endereco string, data_atualizacao string, _snapshot_date date, _ingestion_ts timestamp",
    )


def versions(table):
    return {(r.fornecedor_id, r.nome, r.endereco, r.valid_from.day, r.valid_to and r.valid_to.day, r.is_current) for r in table.read().collect()}


def test_scd2(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "dim"), DIM.spec)
    assert scd2.apply(table, snapshot(spark, 1, ("F1", "n", "Rua A"), ("F2", None, "x"), ("  ", "q", "q")), DIM)["insert"] == 2
    again = table.version().number
    assert scd2.apply(table, snapshot(spark, 1, ("F1", " n ", "Rua A ")), DIM) == {"insert": 0, "change": 0, "close": 0, "ignore": 0, "keep": 2}
    assert table.version().number == again
    scd2.apply(table, snapshot(spark, 5, ("F1", "n", "Rua B"), ("F2", "x", None)), DIM)
    assert versions(table) == {("F1", "n", "Rua A", 1, 5, False), ("F1", "n", "Rua B", 5, None, True), ("F2", None, "x", 1, 5, False), ("F2", "x", None, 5, None, True)}
    assert scd2.apply(table, snapshot(spark, 3, ("F1", "n", "Rua C")), DIM)["ignore"] == 1
    assert scd2.apply(table, snapshot(spark, 9, ("F1", "n", "Rua B"), stated="2024-01-09"), DIM, close_missing=True)["close"] == 1
    assert table.read(None, ["true"]).count() == 1


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.sampled_from("ab"), st.sampled_from("xy"), min_size=1), min_size=1, max_size=4))
def test_scd2_equals_the_one_pass_history(spark, tmp_path_factory, days):
    table = VersionedTable(spark, str(tmp_path_factory.mktemp("dim") / "t"), DIM.spec)
    flat = []
    for i, people in enumerate(days, 1):
        scd2.apply(table, snapshot(spark, i, *[(k, v, "e") for k, v in people.items()]), DIM)
        flat += [(k, v, dt.datetime(2024, 1, i)) for k, v in people.items()]
    once = scd2.history(spark.createDataFrame(flat, "k string, v string, at timestamp"), "k", "at", "v")
    assert sorted(map(str, once.select("k", "v", "valid_from", "valid_to", "is_current").collect())) == sorted(
        map(str, table.read().select(F.col("fornecedor_id").alias("k"), F.col("nome").alias("v"), "valid_from", "valid_to", "is_current").collect())
    )
    assert tuple(scd2.violations(table.read(), "fornecedor_id").first()) == (0, 0)
