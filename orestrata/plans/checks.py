"""What a plan must look like, checked where plans could change unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame


class PlanRegression(AssertionError):
    """A plan lacks an operator it should have, or has one it should not."""


def plan_of(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def assert_plan(df: DataFrame, has: tuple[str, ...] = (), lacks: tuple[str, ...] = ()) -> None:
    text = plan_of(df)
    wrong = [f"lacks {x}" for x in has if x not in text] + [f"has {x}" for x in lacks if x in text]
    if wrong:
        raise PlanRegression(f"{'; '.join(wrong)}\n{text}")


def shuffles(df: DataFrame) -> int:
    """Exchanges of the physical plan before it runs."""
    return plan_of(df, "simple").count("Exchange hashpartitioning") + plan_of(df, "simple").count("Exchange rangepartitioning") + plan_of(df, "simple").count("Exchange SinglePartition")
