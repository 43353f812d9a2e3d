"""Connected components of an edge table, distributed: alternating large-star and small-star steps.

Each step replaces a node's edges by edges to its smallest neighbour; rows never grow beyond the edges given,
minima are combined before the shuffle, and each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaivo.llm.scratch import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (two long columns), for each node that has an edge.

    Nulls and loops are no edges; repeated edges count once; an empty table gives no rows. rows: about how many edges
    there are, if the caller has counted them.
    """
    a, b = edges.columns
    now = written(edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges", rows=rows)
    state = None
    while True:
        big = _star(now, True).where("u <> v").distinct()
        now = written(_star(big, False).where("u > v").distinct(), "star", rows=rows)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(seen)
        rows = rows and seen[0]
