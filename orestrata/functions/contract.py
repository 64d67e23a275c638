"""What a frame or table must have: columns, non-null columns and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A frame lacks a column that its contract names."""


class ConstraintViolation(ValueError):
    """Rows about to be committed break a table's constraints; counts by constraint."""

    def __init__(self, counts: Mapping[str, int]):
        super().__init__(", ".join(f"{name}: {n} rows" for name, n in counts.items()))
        self.counts = dict(counts)


def require_columns(df: DataFrame, required: Sequence[str] = (), any_of: Sequence[Sequence[str]] = ()) -> None:
    """Fails if a required column is missing, or all of a group of alternatives."""
    unmet = [names for names in (*([c] for c in required), *any_of) if set(df.columns).isdisjoint(names)]
    if unmet:
        raise ContractError(f"{', '.join(map('|'.join, unmet))} not among {', '.join(df.columns)}")


@dataclass(frozen=True)
class TableSpec:
    """A table's columns (DDL), constraints, partition column and sort order."""

    schema: str
    not_null: tuple[str, ...] = ()
    checks: Mapping[str, str] = field(default_factory=dict)
    partition_by: str | None = None
    sort_by: tuple[str, ...] = ()

    def enforce(self, df: DataFrame) -> None:
        """One aggregation over df; raises if any constraint is broken (a null check counts as kept, as in SQL)."""
        rules = {f"{c} NOT NULL": F.col(c).isNull() for c in self.not_null} | {name: ~F.expr(sql) for name, sql in self.checks.items()}
        if not rules:
            return
        names = list(rules)
        found = df.agg(*[F.count_if(rules[n]).alias(str(i)) for i, n in enumerate(names)]).first()
        broken = {n: found[i] for i, n in enumerate(names) if found[i]}
        if broken:
            raise ConstraintViolation(broken)
