"""The acceptance scenarios of the analytic questions."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from orestrata.plans import analytics
from orestrata.plans.checks import assert_plan, shuffles
from pyspark.sql import functions as F

AS_OF = "2024-08-15"
PRODUCTION = "planta_id string, moinho_id string, data date, toneladas_produzidas decimal(18,3)"


def day(text):
    return dt.date.fromisoformat(text)


def monthly(spark, rows, **kw):
    df = spark.createDataFrame([(p, m, day(d), None if t is None else Decimal(t)) for p, m, d, t in rows], PRODUCTION)
    return [tuple(r) for r in analytics.monthly_drop(df, F.lit(AS_OF).cast("date"), **kw).collect()]


def level(plant, mill, months, tonnes=100):
    return [(plant, mill, f"2024-{m:02d}-10", tonnes) for m in months]


ALL = range(1, 8)


def test_half_is_50_percent(spark):
    rows = level("P", "A", range(1, 5)) + level("P", "A", range(5, 8), 50)
    assert monthly(spark, rows) == [(1, "P", "A", day("2024-05-01"), 100.0, 50.0, 50.0)]


def test_month_without_rows_is_a_drop_of_100_percent(spark):
    rows = level("P", "A", [1, 2, 3, 5, 6, 7])
    assert monthly(spark, rows)[0][3:] == (day("2024-04-01"), 100.0, 0.0, 100.0)


def test_running_month_is_ignored(spark):
    assert monthly(spark, level("P", "A", ALL) + [("P", "A", "2024-08-02", 1)]) == []


def test_mills_of_two_plants_are_two(spark):
    rows = level("P", "A", range(1, 7)) + level("P", "A", [7], 10) + level("Q", "A", range(1, 7)) + level("Q", "A", [7], 20)
    assert [(r[1], r[6]) for r in monthly(spark, rows)] == [("P", 90.0), ("Q", 80.0)]


def test_unknown_month_is_no_drop(spark):
    rows = level("P", "A", [1, 2, 3]) + [("P", "A", "2024-04-10", None)] + level("P", "A", [5, 6, 7])
    assert monthly(spark, rows) == []


def test_growth_only_is_absent_and_ties_go_by_key(spark):
    grows = [("P", "G", f"2024-{m:02d}-10", 100 * m) for m in ALL]
    falls = [r for k in "DCBA" for r in level("P", k, range(1, 7)) + level("P", k, [7], 50)]
    assert [r[2] for r in monthly(spark, grows + falls)] == ["A", "B", "C"]


def daily(spark, values, start="2024-01-01", mill="A"):
    first = day(start)
    rows = [("P", mill, first + dt.timedelta(days=i), Decimal(v)) for i, v in enumerate(values) if v is not None]
    return [(r.data, r.tipo_anomalia) for r in analytics.rolling_anomalies(spark.createDataFrame(rows, PRODUCTION)).collect()]


def test_spike_and_dip_are_flagged(spark):
    base = [100, 101, 99, 100, 101, 99, 100]
    assert daily(spark, [*base, 200, *base, *base, 5])[::-1] == [(day("2024-01-08"), "ACIMA"), (day("2024-01-23"), "ABAIXO")]


def test_missing_days_shorten_the_frame(spark):
    # Only 4 days lie within the 7 before the spike, though more rows come before it.
    assert daily(spark, [100, 101, 99, 100, None, None, None, 101, 99, 100, 101, 200]) == []
    assert daily(spark, [100, 101, 99, 100, None, None, 101, 99, 100, 101, 99, 200]) == [(day("2024-01-12"), "ACIMA")]


def test_constant_production_and_short_history_raise_nothing(spark):
    assert daily(spark, [100] * 9 + [500]) == []
    assert daily(spark, [100, 101, 99, 100, 500]) == []


DIM = "fornecedor_id string, valid_from timestamp, valid_to timestamp, is_current boolean"
ERP = "bukrs string, belnr string, fornecedor_id string, valor decimal(18,2), data date"


def events(spark, rows):
    return spark.createDataFrame([(b, n, f, Decimal(v), day(d)) for b, n, f, v, d in rows], ERP)


def dimension(spark, rows):
    at = lambda t: t and dt.datetime.fromisoformat(t)
    return spark.createDataFrame([(k, at(a), at(b), b is None) for k, a, b in rows], DIM)


def test_orphans(spark):
    dim = dimension(spark, [("0000012345", "2023-01-01", None), ("X9", "2023-01-01", "2023-06-01")])
    e = events(spark, [
        ("1", "a", "12345", 1, "2024-01-02"), ("1", "a", " x9 ", 1, "2024-01-02"), ("1", "a", "77", 5, "2024-01-03"), ("2", "a", "077", 6, "2024-01-04"),
        ("1", "b", "77", 7, "2024-02-01"), ("1", "c", None, 8, "2024-01-01"), ("1", "c", "  ", 9, "2024-02-01"), ("1", "d", "000", 1, "2024-03-01"),
    ])
    got = [tuple(r) for r in analytics.orphans_by_month(e, dim).collect()]
    assert got == [
        (day("2024-01-01"), 2, 2, 1, Decimal("11.00"), ["077", "77"]), (day("2024-02-01"), 1, 1, 1, Decimal("7.00"), ["77"]), (day("2024-03-01"), 1, 1, 1, Decimal("1.00"), ["000"]),
    ]
    assert [tuple(r) for r in analytics.missing_keys_by_month(e).collect()] == [(day("2024-01-01"), 1, Decimal("8.00")), (day("2024-02-01"), 1, Decimal("9.00"))]


def test_outside_validity(spark):
    dim = dimension(spark, [("1", "2024-01-10", "2024-02-10"), ("1", "2024-02-10", None), ("2", "2024-01-01", "2024-01-05")])
    e = events(spark, [("1", "a", "1", 1, "2024-01-09"), ("1", "b", "01", 1, "2024-01-10"), ("1", "c", "2", 3, "2024-01-05"), ("1", "d", "3", 4, "2024-01-05")])
    assert [tuple(r) for r in analytics.outside_validity_by_month(e, dim).collect()] == [(day("2024-01-01"), 2, Decimal("4.00"))]


def test_plans(spark, sf_dir):
    from orestrata.plans import driver_queries as q

    monthly = q.monthly_drop_top3(spark, sf_dir)
    assert_plan(monthly, has=("PushedFilters", "GreaterThanOrEqual(l_shipdate"), lacks=("CartesianProduct", "BatchEvalPython"))
    rolling = analytics.rolling_anomalies(q.production(spark, sf_dir).repartition(1))
    assert "BatchEvalPython" not in rolling._jdf.queryExecution().toString()
    assert shuffles(rolling) <= 6


def test_anti_join_is_broadcast(spark, sf_dir):
    from orestrata.plans import driver_queries as q

    assert_plan(q.fk_orphans_by_month(spark, sf_dir), has=("LeftAnti",), lacks=("NestedLoop",))
