"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.session import written


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges``: u > v, distinct.

    Large: every node sends its larger neighbours to the least node it knows.
    Small: every node sends its smaller neighbours and itself there.
    """
    if large:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least.hint("merge"), "u")
        out = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node of its component, for every node of ``edges`` (u, v) but those least nodes.

    The minima are combined before the shuffle, and a node with very many edges
    meets its minimum in a join whose skewed partitions are split. Ends when a
    round changes nothing.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    ordered, seen = written(ordered, "components"), None
    while True:
        sign = ordered.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).head()
        if seen == sign or not sign.n:
            return ordered.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = sign
        ordered = written(_starred(_starred(ordered, True), False), "components")
