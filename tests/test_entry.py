"""Every engine query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest
from orestrata.plans import driver_queries as q


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return ""
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float, Decimal)) or hasattr(x, "dtype"):
            return str(x) if str(getattr(x, "dtype", "")) == "bool" else repr(round(float(x), 6))
        return str(x).removesuffix("+00:00").removesuffix(" 00:00:00")

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf_dir, name):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    got, want = q.QUERIES[name](spark, sf_dir).toPandas(), c.sql(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
