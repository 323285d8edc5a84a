"""Generated buffers: fills, sequences, random and quasi-random numbers, random task graphs.

All are lazy projections over ``range``; none is built on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.types import element, wrapped


def buffer(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i")


def buffers(spark: SparkSession, n: int, /, **columns: Column) -> DataFrame:
    """Generated columns beside each other: one projection over one range."""
    return buffer(spark, n).select("i", *[c.alias(name) for name, c in columns.items()])


def filled(value, kind: str = "double") -> Column:
    return F.lit(value).cast(element(kind).spark)


def set_bytes(byte: int, kind: str = "int32") -> Column:
    """Every byte of every element set: the byte repeated over the element's width."""
    t = element(kind)
    value = sum((byte & 0xFF) << (8 * k) for k in range(t.width))
    return filled(value - (1 << t.bits) if t.signed and value >= 1 << (t.bits - 1) else value, kind)


def stepped(start, step, kind: str = "int64") -> Column:
    t = element(kind)
    value = F.lit(start) + F.col("i") * F.lit(step)
    return value.cast(t.spark) if t.floating else wrapped(value, t)


def fill(spark: SparkSession, n: int, value, kind: str = "double") -> DataFrame:
    return buffers(spark, n, v=filled(value, kind))


def memset(spark: SparkSession, n: int, byte: int, kind: str = "int32") -> DataFrame:
    return buffers(spark, n, v=set_bytes(byte, kind))


def arithmetic(spark: SparkSession, n: int, start, step, kind: str = "int64") -> DataFrame:
    return buffers(spark, n, v=stepped(start, step, kind))


def geometric(spark: SparkSession, n: int, start, ratio) -> DataFrame:
    return buffer(spark, n).withColumn("v", F.lit(float(start)) * F.pow(F.lit(float(ratio)), F.col("i")))


def geometric_wrapping(spark: SparkSession, n: int, start: int, ratio: int, kind: str = "int32") -> DataFrame:
    """Repeated multiplication of machine integers: square-and-multiply modulo 2**bits.

    64-bit products need 128 bits, so kinds of 32 bits or fewer are taken.
    """
    t = element(kind)
    if t.bits > 32:
        raise ValueError("wrapping products are defined for 32 bits or fewer")
    size, power, steps = 1 << t.bits, ratio % (1 << t.bits), []
    for bit in range(40):  # of the index
        steps.append(F.struct(F.lit(bit).alias("bit"), F.lit(power).cast("decimal(38,0)").alias("power")))
        power = power * power % size
    chosen = F.filter(F.array(*steps), lambda s: F.getbit("i", s["bit"]) == 1)
    value = F.aggregate(chosen, F.lit(start % size).cast("decimal(38,0)"), lambda v, s: F.pmod(v * s["power"], F.lit(size)).cast("decimal(38,0)"))
    return buffer(spark, n).withColumn("v", wrapped(value.cast("long"), t))


def uniform_value(low: float, high: float, seed: int, kind: str = "double") -> Column:
    """[low, high); integers are truncated."""
    return (F.rand(seed) * (high - low) + low).cast(element(kind).spark)


def normal_value(mean: float, std: float, seed: int) -> Column:
    return F.randn(seed) * std + mean


def small_integer(seed: int, kind: str = "int32") -> Column:
    """Whole numbers from 1 to 5."""
    return (F.floor(F.rand(seed) * 5) + 1).cast(element(kind).spark)


def uniform(spark: SparkSession, n: int, low: float, high: float, seed: int, kind: str = "double") -> DataFrame:
    return buffers(spark, n, v=uniform_value(low, high, seed, kind))


def normal(spark: SparkSession, n: int, mean: float, std: float, seed: int) -> DataFrame:
    return buffers(spark, n, v=normal_value(mean, std, seed))


def log_normal(spark: SparkSession, n: int, mean: float, std: float, seed: int) -> DataFrame:
    return buffers(spark, n, v=F.exp(normal_value(mean, std, seed)))


def small_integers(spark: SparkSession, n: int, seed: int, kind: str = "int32") -> DataFrame:
    return buffers(spark, n, v=small_integer(seed, kind))


def radical_inverse(i: Column) -> Column:
    """The first Sobol dimension: the index's 64 bits mirrored at the binary point (in [0, 1))."""
    return F.conv(F.reverse(F.lpad(F.bin(i), 64, "0")), 2, 10).cast("double") / float(1 << 64)


#: Numerators and denominators of a published rational approximation of the
#: normal quantile, for the centre and for the tails (below 0.02425), highest power first.
CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution, with a relative error below 1.2e-9;
    null outside (0, 1)."""

    def ratio(parts, x: Column) -> Column:
        top, bottom = (reduce(lambda total, c: total * x + c, cs[1:], F.lit(cs[0])) for cs in parts)
        return top / bottom

    side = F.least(p, 1 - p)
    q, t = p - 0.5, F.sqrt(F.lit(-2.0) * F.log(side))
    tail = F.when(p < 0.5, ratio(TAIL, t)).otherwise(-ratio(TAIL, t))
    return F.when((p > 0) & (p < 1), F.when(side < 0.02425, tail).otherwise(q * ratio(CENTRE, q * q)))


def quasi_normal_value(mean: float = 0.0, std: float = 1.0) -> Column:
    """From the second point on (the first has no finite quantile)."""
    return inverse_normal(radical_inverse(F.col("i") + 1)) * std + mean


def quasi_uniform(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return buffers(spark, n, v=radical_inverse(F.col("i")) * (high - low) + low)


def quasi_normal(spark: SparkSession, n: int, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    return buffers(spark, n, v=quasi_normal_value(mean, std))


def quasi_log_normal(spark: SparkSession, n: int, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    return buffers(spark, n, v=F.exp(quasi_normal_value(mean, std)))


def random_graph(spark: SparkSession, levels: int, width: tuple[int, int], skips: int, mean: float, std: float, seed: int, copies: int = 1) -> tuple[DataFrame, DataFrame]:
    """A random layered task graph: tasks (task_id, level, kernel), dep (task_id, dep_id).

    Each level has a random width; every task below the first takes 1 to 20 parents, a
    normally distributed number, out of the ``skips`` levels above.  ``copies``
    independent copies are numbered one after the other.
    """
    least, most = width
    level = spark.range(levels).select(F.col("id").alias("level"), (F.floor(F.rand(seed) * (most - least + 1)) + least).alias("width"))
    level = level.withColumn("first", F.sum("width").over(W.orderBy("level")) - F.col("width"))  # a row a level
    task = level.select("level", "width", "first", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("k")).withColumn("task_id", F.col("first") + F.col("k"))
    degree = F.least(F.greatest((F.randn(seed + 1) * std + mean).cast("int") / 2, F.lit(1)), F.lit(20)).cast("int")
    drawn = task.filter("level > 0").withColumn("degree", degree).select("task_id", "level", F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("k"))
    drawn = drawn.withColumn("up", F.col("level") - 1 - F.floor(F.rand(seed + 2) * F.least(F.lit(skips), F.col("level")))).withColumn("dice", F.rand(seed + 3))
    above = level.select(F.col("level").alias("up"), F.col("width").alias("w"), F.col("first").alias("f"))
    dep = drawn.join(above, "up").select("task_id", (F.col("f") + F.floor(F.col("dice") * F.col("w"))).alias("dep_id")).distinct()
    if copies > 1:
        n = task.agg(F.count("*").alias("n")).first()["n"]
        shift = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        task = task.withColumn("copy", shift).withColumn("task_id", F.col("task_id") + F.col("copy") * n)
        dep = dep.withColumn("copy", shift).select((F.col("task_id") + F.col("copy") * n).alias("task_id"), (F.col("dep_id") + F.col("copy") * n).alias("dep_id"))
    return task.select("task_id", "level"), dep


def swapped(access: DataFrame, pairs: DataFrame) -> DataFrame:
    """Accesses with buffers renamed by ``pairs`` (mem_id, becomes); others stay."""
    return access.join(pairs, "mem_id", "left").withColumn("mem_id", F.coalesce("becomes", "mem_id")).drop("becomes")


def dice(key: Column) -> Column:
    """A number in [0, 1) for each row, from a hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)


def weighted_choice(dice: Column, names: list[str], weights: list[float]) -> Column:
    """A name for each row: the one whose share of the weights ``dice`` (in [0, 1)) falls into."""
    dice, total, at = dice * sum(weights), 0.0, None
    for name, w in zip(names, weights, strict=True):
        total += w
        hit = F.when(dice < total, name) if at is None else at.when(dice < total, name)
        at = hit
    return at.otherwise(names[-1])
