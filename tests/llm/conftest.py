from __future__ import annotations

import pytest
from samples import CLASH, SCHEMA, edge_rows


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use inside."""
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
