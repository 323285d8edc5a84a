"""Running values over long groups: each group's order is cut into ranges.

A window over a whole group is one task, however large the group is.  Here the order
column is cut at quantiles of the table; what a range adds is summed for each group and
range, those sums (a row for each, at most ``BUCKETS`` a group) are carried forward, and
the window runs within a group's range only.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 256


def with_range(df: DataFrame, order: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds range: equal values of ``order`` share one, larger values never have a lesser one."""
    rows = df.withColumn("__at", F.col(order).cast("double"))
    probabilities = [k / buckets for k in range(1, buckets)] or [0.5]
    cuts = rows.agg(F.percentile_approx("__at", probabilities, 4 * buckets)).first()[0] or []  # of a sketch: ``buckets`` numbers
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:  # an empty table
        return rows.drop("__at").withColumn("range", F.lit(0))
    return Bucketizer(splits=splits, inputCol="__at", outputCol="range", handleInvalid="keep").transform(rows).drop("__at").withColumn("range", F.col("range").cast("int"))


def carried(df: DataFrame, keys: list[str], added: dict[str, Column], forward: dict[str, Column]) -> DataFrame:
    """Adds to rows with a range what the ranges before it in the same group come to.

    ``added``: aggregates of a range; ``forward``: windowed columns over them (by ``before``).
    """
    sums = df.groupBy(*keys, "range").agg(*[c.alias(n) for n, c in added.items()])
    names = {k: f"__{k}" for k in [*keys, "range"]}
    prefix = sums.select(*[F.col(k).alias(n) for k, n in names.items()], *[c.over(before(keys)).alias(n) for n, c in forward.items()])
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(prefix, same, "left").drop(*names.values())


def before(keys: list[str]):
    return W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
