from __future__ import annotations

import datetime as dt

import pytest
from orestrata.functions import scalars as S
from orestrata.functions.contract import ConstraintViolation, ContractError, TableSpec, require_columns
from orestrata.operators import access, aggregates, joins, quality
from orestrata.operators.quality import Rule
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-15T13:00:00Z", "2024-01-15 13:00:00"), ("2024-01-15 10:00:00", "2024-01-15 13:00:00"), ("2024-01-15T10:00:00-03", "2024-01-15 13:00:00"),
        ("2024-01-15T10:00:00-0300", "2024-01-15 13:00:00"), ("2024-01-15T10:00:00-03:00", "2024-01-15 13:00:00"), (" 2024-01-15T10:00:00 ", "2024-01-15 13:00:00"),
        ("2024-01-15", "2024-01-15 03:00:00"), ("15/01/2024", None), ("2024", None), ("10:00:00", None), ("", None), (None, None),
    ],
)
def test_to_utc(spark, text, expected):
    got = one(spark, text, lambda c: S.to_utc(c, F.lit("America/Sao_Paulo")).cast("string"))
    assert got == expected


@pytest.mark.parametrize(("text", "expected"), [("0000012345", "12345"), (" 7 ", "7"), ("000", "0"), ("ab0 ", "AB0"), ("", ""), (None, None)])
def test_key_norm(spark, text, expected):
    assert one(spark, text, S.key_norm) == expected


def test_small_functions(spark):
    assert one(spark, "  ", S.blank_to_null) is None and one(spark, " a ", S.blank_to_null) == "a"
    assert one(spark, "42", S.alpha_pad) == "0000000042" and one(spark, "x1", S.alpha_pad) == "x1" and one(spark, "12345678901", S.alpha_pad) == "12345678901"
    today = F.lit("2020-01-01").cast("date")
    assert one(spark, "/in/2023-01-01/f-2024-02-03.csv", lambda c: S.snapshot_date(c, today)) == dt.date(2024, 2, 3)
    assert one(spark, "/in/f-2024-13-03.csv", lambda c: S.snapshot_date(c, today)) == dt.date(2020, 1, 1)
    assert one(spark, "Q", lambda c: S.zone_of(c, {"P": "UTC"}, "Asia/Tokyo")) == "Asia/Tokyo"


def test_hash_sees_where_a_null_is(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), (None, None)], "x string, y string")
    assert df.select(S.attribute_hash(["x", "y"]).alias("h")).distinct().count() == 3
    assert df.select(S.payload(["x", "y", "_z"]).alias("p")).first().p == '{"x":"a","y":null}'


def test_contract(spark):
    df = spark.createDataFrame([(1, -1), (None, 2)], "a int, b int")
    require_columns(df, ["a"], [["c", "b"]])
    with pytest.raises(ContractError, match=r"z.*c\|d"):
        require_columns(df, ["z"], [["c", "d"]])
    with pytest.raises(ConstraintViolation) as e:
        TableSpec("a int, b int", ("a",), {"positive": "b > 0"}).enforce(df)
    assert e.value.counts == {"a NOT NULL": 1, "positive": 1}


def test_rules(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "v int")
    rules = [Rule("nulo", F.col("v").isNull()), Rule("negativo", F.col("v") < 0), Rule("um", F.col("v") == 1, "warn"), Rule("grande", F.col("v") > 9, "fail")]
    rows = quality.classify(df, rules).collect()
    assert [(r._reason, r._warning) for r in rows] == [([], ["um"]), (["negativo"], []), (["nulo"], [])]
    quality.enforce(df, rules)
    with pytest.raises(quality.RuleFailure):
        quality.enforce(df, [Rule("x", F.col("v") == 1, "fail")])


def test_freshness_of_nothing_is_stale(spark):
    df = spark.createDataFrame([], "t timestamp")
    assert quality.freshness(df, "t", F.current_timestamp(), 60).first().stale is True


def test_joins(spark):
    facts = spark.createDataFrame([(i, i % 3 if i % 5 else 0) for i in range(200)], "f int, k int")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k int, n string")
    plain = {tuple(r) for r in facts.join(dim, "k", "left").collect()}
    assert {tuple(r) for r in joins.split_join(facts, dim, "k", "left", 0.4).collect()} == plain
    with pytest.raises(ValueError):
        joins.split_join(facts, dim, "k", "full")
    points = spark.createDataFrame([(i,) for i in range(50)], "p int")
    ranges = spark.createDataFrame([(0, 10, 20), (1, 19, 21), (2, 5, 5), (3, 48, 99)], "r int, a int, b int")
    got = {(r.p, r.r) for r in joins.range_join(points, ranges, "p", "a", "b", 7).collect()}
    assert got == {(p, r) for p in range(50) for r, a, b in [(0, 10, 20), (1, 19, 21), (3, 48, 99)] if a <= p < b}


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0)] * 90 + [("b", 2.0)] * 10 + [(None, None)], "k string, v double")
    assert {r.k: (r.total, r.n) for r in aggregates.salted_sum(df.withColumn("i", F.monotonically_increasing_id()), ["k"], "v").collect()} == {"a": (90.0, 90), "b": (20.0, 10), None: (None, 0)}
    other = df.where("k = 'a' OR v IS NULL")
    assert [r.k for r in aggregates.compare(df, other, ["k"], ["v"]).collect()] == ["b"]


def test_access(spark):
    df = spark.createDataFrame([("P1", "x"), ("P2", None)], "planta string, conta string")
    assert [r.conta for r in access.masked(df, {"conta": "auditoria"}, set()).collect()] == ["***", None]
    assert [r.conta for r in access.masked(df, {"conta": "auditoria"}, {"auditoria"}).collect()] == ["x", None]
    assert access.visible_rows(df, "planta", {"planta_p1"}).count() == 1 and access.visible_rows(df, "planta", set()).count() == 0
    assert access.visible_rows(df, "planta", {"operacoes_global"}).count() == 2
