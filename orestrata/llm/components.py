"""Connected components by edge contraction: distributed, a logarithmic number of rounds, hot nodes included.

In each round every node points to the smallest of itself and its neighbours, edges move to what their ends point to,
and equal edges and loops fall away. A node's neighbours are never gathered: they are only aggregated with min.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a long, b long. Returns node long, root long for every node in an edge; a root stands for one component."""
    edges = written(edges.select("a", "b").where("a != b").distinct())
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
        steps.append(to)
        to = small(to)
        at_a = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        at_b = at_a.join(to.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = written(at_b.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps.pop()
    while steps:
        first = steps.pop()
        later = out.select(F.col("node").alias("root"), F.col("root").alias("to"))
        out = written(first.join(small(later), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    return out
