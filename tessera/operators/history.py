"""Execution traces: statistics, running means, summaries, comparisons.

A trace has kernel, devno, kind (kernel or a transfer kind), start, end, duration, size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.ranges import carried, with_range


def kernel_stats(trace: DataFrame, *keys: str) -> DataFrame:
    """Count, total, mean and bytes for each of ``keys``."""
    return trace.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("duration").alias("total"), F.avg("duration").alias("mean"), F.sum("size").alias("bytes"))


def kernel_report(trace: DataFrame) -> DataFrame:
    """Per kernel and over all (kernel null): count, time and bytes of each kind."""
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    cells = [f for k in ("kernel", "h2d", "d2h", "d2d") for f in (F.count(of(k, F.lit(1))).alias(f"{k}_n"), F.sum(of(k, F.col("duration"))).alias(f"{k}_time"), F.sum(of(k, F.col("size"))).alias(f"{k}_bytes"))]
    return trace.rollup("kernel").agg(*cells)


def makespan(trace: DataFrame, *keys: str) -> DataFrame:
    """Last end minus first start."""
    return trace.groupBy(*keys).agg((F.max("end") - F.min("start")).alias("makespan"))


def medians(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``keys`` and median of the values that aren't null: exact, and no task holds a group.

    A sketch gives each group two values that surely enclose its median.  Values below
    are counted; those between, a few thousandths of the group, are counted by value and
    ranked.
    """
    some = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    slice_ = F.percentile_approx("v", [0.498, 0.502], 2000)  # off by a two-thousandth of the ranks at most
    ends = some.groupBy(*keys).agg(F.count("*").alias("n"), slice_.alias("ends")).select(*[F.col(k).alias(f"__{k}") for k in keys], "n", F.col("ends")[0].alias("lo"), F.col("ends")[1].alias("hi"))
    placed = some.join(ends, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).filter("v <= hi")
    by_value = placed.withColumn("v", F.when(F.col("v") >= F.col("lo"), F.col("v"))).groupBy(*keys, "n", "v").agg(F.count("*").alias("times"))  # null: below
    last = F.sum("times").over(W.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    ranked = by_value.withColumn("last", last).withColumn("first", F.col("last") - F.col("times"))
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("last")), F.col("v")))
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, max, min, median and sample deviation."""
    rest = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))
    middle = medians(df, value, *keys).select(*[F.col(k).alias(f"__{k}") for k in keys], "median")
    out = rest.join(middle, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return out.select(*keys, "mean", "max", "min", "median", "std")


def median_table(df: DataFrame, value: str, row: str, column: str, names: list[str]) -> DataFrame:
    """``row`` and a column for each of ``names``: the median of its values."""
    return medians(df.filter(F.col(column).isin(names)), value, row, column).groupBy(row).pivot(column, names).agg(F.first("median"))


def running_mean(trace: DataFrame, *keys: str, order: str = "start") -> DataFrame:
    """Adds the mean of each group's durations so far; long groups are cut into ranges of ``order``."""
    rows = carried(with_range(trace, order), list(keys), {"__n": F.count("duration"), "__sum": F.sum("duration")}, {"__before": F.sum("__n"), "__sum_before": F.sum("__sum")})
    so_far = W.partitionBy(*keys, "range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    total = F.coalesce("__sum_before", F.lit(0)) + F.coalesce(F.sum("duration").over(so_far), F.lit(0))
    n = F.coalesce("__before", F.lit(0)) + F.count("duration").over(so_far)
    return rows.withColumn("running_mean", F.try_divide(total, n)).drop("range", "__before", "__sum_before")


def ranked(df: DataFrame, order: str, tie: str, *keys: str) -> DataFrame:
    """Adds nth: the rank within each group, counted from 1; long groups are cut into ranges of ``order``."""
    rows = carried(with_range(df, order), list(keys), {"__n": F.count("*")}, {"__before": F.sum("__n")})
    own = F.row_number().over(W.partitionBy(*keys, "range").orderBy(order, tie))
    return rows.withColumn("nth", F.coalesce("__before", F.lit(0)) + own).drop("range", "__before")


def looked_up(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of a small table (a row for each key), null where it has none."""
    return df.join(table, key, "left")


def min_max_normalised(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Adds norm in [0, 1] within each group; null in a constant group."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.join(ends, list(keys)).withColumn("norm", F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))).drop("lo", "hi")


def best_by(df: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """The ``name`` of the least ``value`` in each group (ties: the first name)."""
    return df.groupBy(group).agg(F.min_by(name, F.struct(value, name)).alias(name), F.min(value).alias(value))


def of_best(df: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """The rows of each group's best ``name``."""
    return df.join(best_by(df, group, name, value).select(group, name), [group, name], "left_semi")


def natural_keys(name: Column) -> list[Column]:
    """Sort keys that order x2 before x10."""
    return [F.regexp_replace(name, "[0-9]+$", ""), F.regexp_extract(name, "([0-9]+)$", 1).try_cast("bigint")]


def compared(df: DataFrame, key: str, name: str, value: str, a: str, b: str) -> DataFrame:
    """value of ``a`` divided by that of ``b`` for each key."""
    x, y = (df.filter(F.col(name) == n).select(key, F.col(value).alias(c)) for n, c in ((a, "x"), (b, "y")))
    return x.join(y, key).select(key, F.try_divide("x", "y").alias("ratio"))


def without_internal(trace: DataFrame, name: str, patterns: list[str] | None = None) -> DataFrame:
    """Drop rows of internal transfers and of names that match a wildcard pattern."""
    out = trace.filter(~F.col(name).startswith("Internal-") & ~F.col(name).contains("transferto-"))
    for p in patterns or []:
        out = out.filter(~F.col(name).rlike("^" + ".*".join(map(_quoted, p.split("*"))) + "$"))
    return out


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_ " else c for c in text)


#: What trace tools call the first and the last copies of buffers.
COPIES = {"transferto-": "initial_h2d", "transferfrom-": "final_d2h"}
#: Codes of policies (bits) and of task states.
POLICIES = {1 << 5: "default", 1 << 18: "roundrobin", 1 << 19: "depend", 1 << 20: "data", 1 << 21: "profile", 1 << 22: "random", 1 << 23: "pending", 1 << 24: "sdq", 1 << 25: "ftf"}
STATES = {0: "complete", 1: "running", 2: "submitted", 3: "queued", 4: "none"}


def transfer_names(name: Column) -> Column:
    """One name for the first copies of all buffers and one for the last, without numbers."""
    for mark, short in COPIES.items():
        name = F.when(name.contains(mark), F.concat(F.substring_index(name, mark, 1), F.lit(short))).otherwise(name)
    return name


def named(code: Column, names: dict[int, str]) -> Column:
    """The name of a code; "unknown" for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code.cast("int")), F.lit("unknown"))


def latency(runtime: Column, launches: Column) -> Column:
    """Time of one launch; null without launches."""
    return F.try_divide(runtime, launches)


def bandwidth(size: Column, seconds: Column) -> tuple[Column, Column]:
    """Rate and its unit, scaled by 1024 so that the number stays readable."""
    rate = F.try_divide(size, seconds)
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    step = F.least(F.greatest(F.floor(F.log(rate) / F.log(F.lit(1024.0))), F.lit(0)), F.lit(len(units) - 1)).cast("int")
    return rate / F.pow(F.lit(1024.0), step), F.element_at(F.array(*map(F.lit, units)), step + 1)


def poisson_fit(df: DataFrame, y: str, *x: str) -> dict:
    """Quasi-Poisson regression with a logarithmic link: coefficients (intercept first), dispersion, n.

    The dispersion is Pearson's statistic over the degrees of freedom; it scales the
    coefficients' variances and not the coefficients.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=list(x), outputCol="__x", handleInvalid="skip").transform(df.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double") for c in x]).dropna())
    model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="__x", labelCol="__y", maxIter=50, tol=1e-10).fit(rows)
    fitted = model.transform(rows).select(F.col("__y").alias("y"), F.col("prediction").alias("p"))
    one = fitted.agg(F.sum((F.col("y") - F.col("p")) ** 2 / F.col("p")).alias("pearson"), F.count("*").alias("n")).first()
    free = one["n"] - len(x) - 1
    return {"coefficients": [model.intercept, *model.coefficients.tolist()], "dispersion": one["pearson"] / free if free > 0 else float("nan"), "n": one["n"]}


def linear_fit(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def incremental_means(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Statistics (n, total) of old and new together."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
