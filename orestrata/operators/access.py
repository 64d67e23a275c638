"""Masks and row filters as views: a caller's groups are a parameter, since Spark alone has no accounts.

Grants on schemas and groups are not something Spark enforces; they belong to the catalog that serves these views.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masked(df: DataFrame, columns: Mapping[str, str], groups: Collection[str], mask: str = "***") -> DataFrame:
    """columns: column -> group that may see it; others see the mask (nulls stay null)."""
    hidden = [c for c, group in columns.items() if group not in groups]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(mask)) for c in hidden}) if hidden else df


def visible_rows(df: DataFrame, column: str, groups: Collection[str], prefix: str = "planta_", all_group: str = "operacoes_global") -> DataFrame:
    """Rows whose column value, after the prefix, names one of the caller's groups; the global group sees all."""
    if all_group in groups:
        return df
    return df.where(F.concat(F.lit(prefix), F.lower(F.col(column).cast("string"))).isin(sorted(g.lower() for g in groups)))
