"""Rules that collect every reason a row is rejected for, the split by them, and the quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contract import TableSpec
from .versioned import VersionedTable

QUARANTINE = TableSpec(
    "payload string, motivos array<string>, arquivo_origem string, ingestion_ts timestamp, quarentena_ts timestamp, batch_id bigint",
    not_null=("payload", "motivos"),
)


class RuleFailure(ValueError):
    """A rule of policy fail was broken."""


@dataclass(frozen=True)
class Rule:
    """broken holds for the rows that break the rule. policy: quarantine (row is set aside), warn (row passes, counted),
    fail (nothing passes)."""

    code: str
    broken: Column
    policy: str = "quarantine"


def reasons(rules: Sequence[Rule], policy: str = "quarantine") -> Column:
    """The codes of the broken rules of a policy, in the rules' order; a null condition is not broken."""
    marks = [F.when(r.broken, F.lit(r.code)) for r in rules if r.policy == policy]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def classify(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df with _reason (empty: valid) and _warning."""
    return df.withColumns({"_reason": reasons(rules), "_warning": reasons(rules, "warn")})


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.size("_reason") == 0)


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size("_reason") > 0)


def enforce(df: DataFrame, rules: Sequence[Rule]) -> None:
    """Raises if a rule of policy fail is broken anywhere."""
    hard = [r for r in rules if r.policy == "fail"]
    if hard:
        found = df.agg(*[F.count_if(r.broken).alias(r.code) for r in hard]).first()
        if any(found):
            raise RuleFailure(", ".join(f"{r.code}: {found[r.code]}" for r in hard if found[r.code]))


#: The quarantine's columns, by what a rejected row calls them.
_FROM = {"payload": "_payload", "motivos": "_reason", "arquivo_origem": "_source_file", "ingestion_ts": "_ingestion_ts"}


def quarantine(table: VersionedTable, rows: DataFrame, batch_id: int, app: str = "quarantine") -> None:
    """Appends rejected rows (_payload, _reason, _source_file, _ingestion_ts) once for each batch."""
    known = {"quarentena_ts": F.current_timestamp(), "batch_id": F.lit(batch_id)} | {name: F.col(c) for name, c in _FROM.items()}
    table.append(rows.select(*[known[f.name].cast(f.dataType).alias(f.name) for f in table.schema]), (app, batch_id))


def freshness(df: DataFrame, column: str, now: Column, limit_seconds: int) -> DataFrame:
    """One row: the newest time, the lag in seconds and whether it breaks the limit (an empty table does)."""
    lag = F.unix_timestamp(now) - F.unix_timestamp("newest")
    return df.agg(F.max(column).alias("newest")).select("newest", lag.alias("lag_seconds"), F.coalesce(lag > limit_seconds, F.lit(True)).alias("stale"))
