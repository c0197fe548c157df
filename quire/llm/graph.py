"""Connected components of edge tables, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of `edges` (a, b); the component is its smallest node.

    Alternating large-star and small-star rounds, each written to the shared folder: a round joins
    edges with the least neighbour of each node, so no component is ever gathered in one place.
    Loops and edges with a null end add nothing. Without edges there are no rows.
    """
    now = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lower = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        last, now = now, staged(small.distinct(), name)
        discard(last)
    stars = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
