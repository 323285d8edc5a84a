"""Connected components of an edge table by alternating large- and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release


def _to_least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the least node that ``node`` is linked with, for every node of an edge.

    Each round moves every node to the least neighbour of its neighbours and is written
    to the shared folder; nothing but a yes or no comes to the driver.  Loops and
    repeated edges don't matter; without edges the result has no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = materialize(now, "edges")
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up > 1 or up > 0 and down > 0").limit(1).count() == 0:  # every node hangs at a root
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_to_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = _to_least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(now)
        now = then
