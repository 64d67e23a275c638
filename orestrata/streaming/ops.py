"""Logging, retries and supervision of streaming queries."""

from __future__ import annotations

import json
import logging
import sys
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Result = TypeVar("Result")


def logger(name: str) -> logging.Logger:
    """A logger that writes bare lines to standard output; one handler however often it is asked for."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
        log.propagate = False
    return log


def log_event(log: logging.Logger, event: str, level: int = logging.INFO, **fields: object) -> None:
    """One JSON object a line."""
    log.log(level, json.dumps({"event": event, **fields}, default=str, ensure_ascii=False))


def schema_changed(error: BaseException) -> bool:
    """Whether a stream stopped because its source's columns changed."""
    text = str(error)
    return isinstance(error, PySparkException) and any(mark in text for mark in ("UNKNOWN_FIELD", "SCHEMA_CHANGED", "schema has changed", "STATE_STORE_KEY_SCHEMA", "CANNOT_MERGE_SCHEMAS"))


def with_restarts(start: Callable[[], Result], restarts: int = 2, again: Callable[[BaseException], bool] = schema_changed) -> Result:
    """Runs start (which starts a query and waits for it) again after a change of schema, a few times."""
    for k in range(restarts + 1):
        try:
            return start()
        except Exception as error:
            if k == restarts or not again(error):
                raise
    raise AssertionError


class Timed:
    """Logs an operation's fields and seconds at its end, or its error, which goes on."""

    def __init__(self, log: logging.Logger, event: str, **fields: object):
        self.log, self.event, self.fields = log, event, fields

    def __enter__(self) -> dict:
        self.start = time.monotonic()
        return self.fields

    def __exit__(self, kind, error, trace) -> bool:
        seconds = round(time.monotonic() - self.start, 2)
        if error is None:
            log_event(self.log, self.event, **self.fields, seconds=seconds)
        else:
            log_event(self.log, f"{self.event}_failed", logging.ERROR, **self.fields, seconds=seconds, error=str(error)[:500])
        return False


def observed(df: DataFrame, **metrics) -> tuple[DataFrame, Observation]:
    """df and an observation of aggregates that the next action on it fills: metrics without a job of their own."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), seen


def supervise(spark: SparkSession, queries: list) -> None:
    """Waits until any query ends; its error is raised, and the others are stopped so that the job as a whole restarts."""
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()


def state_metrics(query) -> list[dict]:
    """Rows held and rows dropped as too late, by batch and stateful operator, of all recent batches."""
    return [
        {"batch": p["batchId"], "rows": s["numRowsTotal"], "late": s["numRowsDroppedByWatermark"], "memory": s["memoryUsedBytes"]}
        for p in query.recentProgress
        for s in p["stateOperators"]
    ]


def count_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: nulls by column, for casts that give null instead of failing."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
