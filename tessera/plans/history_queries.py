"""Trace analytics: the ``events`` table read as a trace.

kernel = event_type, device = user_id modulo 4, start = ts, duration = value in
hundredths (whole numbers, so sums are exact), size = k of the JSON props.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import shared_dir
from tessera.operators import history
from tessera.plans.registry import query, read
from tessera.sources import trace_csv

TRACE_SQL = "SELECT event_id AS task_id, event_type AS kernel, CAST(user_id % 4 AS INTEGER) AS devno, epoch_us(ts) AS start, CAST(round(value * 100) AS BIGINT) AS duration, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) AS \"end\", CAST(json_extract(props, '$.k') AS BIGINT) AS size, CASE user_id % 3 WHEN 0 THEN 'linear10' WHEN 1 THEN 'linear25' ELSE 'linear100' END AS dag, CASE event_id % 3 WHEN 0 THEN 'depend' WHEN 1 THEN 'sdq' ELSE 'ftf' END AS policy FROM events"


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    start, duration = F.unix_micros(F.col("ts").cast("timestamp")), F.round(F.col("value") * 100).cast("long")
    return e.select(
        F.col("event_id").alias("task_id"), F.col("event_type").alias("kernel"), (F.col("user_id") % 4).cast("int").alias("devno"), start.alias("start"), duration.alias("duration"), (start + duration).alias("end"),
        F.get_json_object("props", "$.k").cast("long").alias("size"), F.when(F.col("user_id") % 3 == 0, "linear10").when(F.col("user_id") % 3 == 1, "linear25").otherwise("linear100").alias("dag"),
        F.when(F.col("event_id") % 3 == 0, "depend").when(F.col("event_id") % 3 == 1, "sdq").otherwise("ftf").alias("policy"),
    )


def _with(sql: str) -> str:
    return f"WITH trace AS ({TRACE_SQL}) {sql}"


@query("kernel_stats", _with("SELECT kernel, devno, count(*) AS n, sum(duration)::BIGINT AS total, round(avg(duration), 6) AS mean, sum(size)::BIGINT AS bytes FROM trace GROUP BY ALL"))
def kernel_stats(spark, sf_dir):
    return history.kernel_stats(trace(spark, sf_dir), "kernel", "devno").withColumn("mean", F.round("mean", 6))


@query("device_totals", _with("SELECT devno, count(*) AS n, sum(duration)::BIGINT AS total, round(avg(duration), 6) AS mean, sum(size)::BIGINT AS bytes FROM trace GROUP BY devno"))
def device_totals(spark, sf_dir):
    return history.kernel_stats(trace(spark, sf_dir), "devno").withColumn("mean", F.round("mean", 6))


@query("kernel_rollup", _with("SELECT kernel, devno, count(*) AS n, sum(duration)::BIGINT AS total FROM trace GROUP BY ROLLUP (kernel, devno)"))
def kernel_rollup(spark, sf_dir):
    return trace(spark, sf_dir).rollup("kernel", "devno").agg(F.count("*").alias("n"), F.sum("duration").alias("total"))


KIND_SQL = "kinds AS (SELECT *, ['kernel', 'h2d', 'd2h', 'd2d'][event_id % 4 + 1] AS kind FROM (SELECT *, task_id AS event_id FROM trace))"


def with_kind(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.element_at(F.array(*map(F.lit, ["kernel", "h2d", "d2h", "d2d"])), (F.col("task_id") % 4 + 1).cast("int")))


@query("kernel_report", _with(f", {KIND_SQL} SELECT kernel, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_n, sum(duration) FILTER (kind = '{k}')::BIGINT AS {k}_time, sum(size) FILTER (kind = '{k}')::BIGINT AS {k}_bytes" for k in ("kernel", "h2d", "d2h", "d2d")) + " FROM kinds GROUP BY ROLLUP (kernel)"))
def kernel_report(spark, sf_dir):
    return history.kernel_report(with_kind(trace(spark, sf_dir)))


@query("launch_latency", _with("SELECT kernel, round(sum(duration)::DOUBLE / count(*), 6) AS latency FROM trace GROUP BY kernel"))
def launch_latency(spark, sf_dir):
    stats = history.kernel_stats(trace(spark, sf_dir), "kernel")
    return stats.select("kernel", F.round(history.latency(F.col("total"), F.col("n")), 6).alias("latency"))


@query("merged_means", _with("SELECT kernel, devno, count(*) AS n, sum(duration)::BIGINT AS total FROM trace GROUP BY ALL"))
def merged_means(spark, sf_dir):
    """Statistics of an old and of a new part of a trace, put together."""
    rows = trace(spark, sf_dir)
    old, new = (history.kernel_stats(rows.filter(F.col("task_id") % 3 == 0 if part else F.col("task_id") % 3 != 0), "kernel", "devno") for part in (0, 1))
    return history.incremental_means(old.select("kernel", "devno", "n", "total"), new.select("kernel", "devno", "n", "total"), "kernel", "devno")


@query("transfer_labels", "SELECT CASE event_id % 3 WHEN 0 THEN 'initial_h2d' WHEN 1 THEN 'dmem-final_d2h' ELSE event_type END AS name, count(*) AS n FROM events GROUP BY 1")
def transfer_labels(spark, sf_dir):
    e, part = read(spark, sf_dir, "events"), F.col("event_id") % 3
    name = F.when(part == 0, F.concat(F.lit("transferto-"), "event_id")).when(part == 1, F.concat(F.lit("dmem-transferfrom-"), "event_id")).otherwise(F.col("event_type"))
    return e.groupBy(history.transfer_names(name).alias("name")).agg(F.count("*").alias("n"))


@query("code_names", "SELECT event_id, coalesce(MAP {32: 'default', 262144: 'roundrobin', 524288: 'depend', 1048576: 'data', 2097152: 'profile', 4194304: 'random', 8388608: 'pending', 16777216: 'sdq', 33554432: 'ftf'}[(1::BIGINT << (event_id % 10 + 17))::INTEGER], 'unknown') AS policy, coalesce(['complete', 'running', 'submitted', 'queued', 'none'][event_id % 7 + 1], 'unknown') AS state FROM events")
def code_names(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    code = F.pow(F.lit(2), F.col("event_id") % 10 + 17).cast("int")
    return e.select("event_id", history.named(code, history.POLICIES).alias("policy"), history.named(F.col("event_id") % 7, history.STATES).alias("state"))


@query("poisson_fit", _with("SELECT round(ln(a), 4) AS base, round(ln(b / a), 4) AS click, round(pearson / (n - 2), 3) AS dispersion FROM (SELECT any_value(a) AS a, any_value(b) AS b, count(*) AS n, sum((duration - m) ** 2 / m) AS pearson FROM (SELECT duration, CASE WHEN kernel = 'click' THEN b ELSE a END AS m, a, b FROM trace, (SELECT avg(duration) FILTER (kernel <> 'click') AS a, avg(duration) FILTER (kernel = 'click') AS b FROM trace)))"))
def poisson_fit(spark, sf_dir):
    """Quasi-Poisson regression of durations on one indicator, which has a closed form."""
    rows = trace(spark, sf_dir).withColumn("click", (F.col("kernel") == "click").cast("int"))
    fit = history.poisson_fit(rows, "duration", "click")
    base, click = fit["coefficients"]
    return spark.createDataFrame([(round(base, 4), round(click, 4), round(fit["dispersion"], 3))], "base double, click double, dispersion double")


@query("trace_round_trip", _with("SELECT 'task' || task_id AS taskname, start / 1e6 AS start, duration, CASE WHEN task_id % 5 < 4 THEN size END AS size, policy, 'Fast Device' AS device, devno, dag, 'plan' AS schedule FROM trace"))
def trace_round_trip(spark, sf_dir):
    """A trace written as files, whose names carry dimensions, and read back."""
    rows = trace(spark, sf_dir)
    path = f"{shared_dir(spark)}/traces-{uuid.uuid4().hex}"
    rows = rows.select(F.concat(F.lit("task"), "task_id").alias("taskname"), F.when(F.col("task_id") % 5 < 4, "Kernel").otherwise("MemFlushOut").alias("type"), (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), F.col("duration").cast("double").alias("duration"), "size", "policy", F.concat(F.lit("Fast Device "), "devno").alias("acclname"), "dag")
    for name in ("linear10", "linear25", "linear100"):
        trace_csv.write_trace(rows.filter(F.col("dag") == name), f"{path}/{name}-plan")
    return trace_csv.read_trace(spark, f"{path}/*", from_folder=True).select("taskname", "start", F.col("duration").cast("long").alias("duration"), "size", "policy", "device", "devno", "dag", "schedule")


@query("sample_lines", "SELECT conv_id, generate_subscripts([1.5, 2.0, 3.25], 1) - 1 AS at, unnest([1.5, 2.0, 3.25]) * conv_id AS value FROM (SELECT DISTINCT conv_id FROM conversations)")
def sample_lines(spark, sf_dir):
    """Lines of comma-separated numbers with comments between, written as text and read back."""
    path = f"{shared_dir(spark)}/samples-{uuid.uuid4().hex}"
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    number = lambda x: (F.col("conv_id") * x).cast("string")
    line = F.concat_ws("\n", F.concat(F.lit("# conversation "), "conv_id"), F.concat_ws(", ", *map(number, (1.0, 1.5, 2.0, 3.25))), F.lit(""))
    ids.select(line.alias("value")).write.text(path)
    rows = trace_csv.read_samples(spark, path, lines=True)
    return rows.groupBy("line").agg(F.max(F.when(F.col("at") == 0, F.col("value"))).cast("long").alias("conv_id"), F.collect_list(F.when(F.col("at") > 0, F.struct(F.col("at") - 1, F.col("value")))).alias("v")).select("conv_id", F.inline("v")).toDF("conv_id", "at", "value").select("conv_id", F.col("at").cast("long").alias("at"), "value")


@query("devices_by_system", "SELECT o_orderkey AS task_id, coalesce(MAP {'F': 1, 'O': 4}[o_orderstatus], 0) AS devices FROM orders")
def devices_by_system(spark, sf_dir):
    """A small dictionary, looked up by a join."""
    sizes = spark.createDataFrame([("F", 1), ("O", 4)], "system string, devices int")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("system"))
    return history.looked_up(rows, sizes, "system").select("task_id", F.coalesce("devices", F.lit(0)).alias("devices"))


@query("makespan", _with("SELECT dag, policy, max(\"end\") - min(start) AS makespan FROM trace GROUP BY ALL"))
def makespan(spark, sf_dir):
    return history.makespan(trace(spark, sf_dir), "dag", "policy")


@query("makespan_policy", _with("SELECT policy, round(median(makespan), 3) AS median, round(stddev_samp(makespan), 3) AS std FROM (SELECT dag, policy, (max(\"end\") - min(start)) / 1e6 AS makespan FROM trace GROUP BY ALL) GROUP BY policy"))
def makespan_policy(spark, sf_dir):
    spans = history.makespan(trace(spark, sf_dir), "dag", "policy").withColumn("makespan", F.col("makespan") / 1e6)
    return history.summary(spans, "makespan", "policy").select("policy", F.round("median", 3).alias("median"), F.round("std", 3).alias("std"))


@query("summary_stats", _with("SELECT kernel, devno, round(avg(duration), 4) AS mean, max(duration) AS max, min(duration) AS min, round(median(duration), 4) AS median, round(stddev_samp(duration), 4) AS std FROM trace GROUP BY ALL"))
def summary_stats(spark, sf_dir):
    return history.summary(trace(spark, sf_dir), "duration", "kernel", "devno").withColumns({c: F.round(c, 4) for c in ("mean", "median", "std")})


@query("conditional_median", _with("SELECT dag, median(CASE WHEN kernel = 'click' THEN duration END) AS click, median(CASE WHEN kernel = 'view' THEN duration END) AS view FROM trace GROUP BY dag"))
def conditional_median(spark, sf_dir):
    return history.median_table(trace(spark, sf_dir), "duration", "dag", "kernel", ["click", "view"])


@query("running_mean", _with("SELECT task_id, kernel, devno, round(avg(duration) OVER (PARTITION BY kernel, devno ORDER BY task_id ROWS UNBOUNDED PRECEDING), 4) AS running_mean FROM trace"))
def running_mean(spark, sf_dir):
    return history.running_mean(trace(spark, sf_dir), "kernel", "devno", order="task_id").select("task_id", "kernel", "devno", F.round("running_mean", 4).alias("running_mean"))


@query("minmax_norm", _with("SELECT task_id, round((duration - min(duration) OVER w)::DOUBLE / nullif(max(duration) OVER w - min(duration) OVER w, 0), 8) AS norm FROM trace WINDOW w AS (PARTITION BY dag)"))
def minmax_norm(spark, sf_dir):
    return history.min_max_normalised(trace(spark, sf_dir), "duration", "dag").select("task_id", F.round("norm", 8).alias("norm"))


@query("fastest_device", _with("SELECT kernel, devno FROM (SELECT kernel, devno, row_number() OVER (PARTITION BY kernel ORDER BY sum(duration)::DOUBLE / count(*), devno) AS nth FROM trace GROUP BY kernel, devno) WHERE nth = 1"))
def fastest_device(spark, sf_dir):
    means = trace(spark, sf_dir).groupBy("kernel", "devno").agg((F.sum("duration") / F.count("*")).alias("mean"))
    return history.best_by(means, "kernel", "devno", "mean").select("kernel", "devno")


BEST_SQL = "best AS (SELECT dag, arg_min(policy, {'d': duration, 'p': policy}) AS policy FROM trace GROUP BY dag)"


@query("best_policy", _with("SELECT dag, policy, duration FROM (SELECT *, row_number() OVER (PARTITION BY dag ORDER BY duration, policy) AS nth FROM trace) WHERE nth = 1"))
def best_policy(spark, sf_dir):
    return history.best_by(trace(spark, sf_dir), "dag", "policy", "duration")


@query("rows_of_best_policy", _with("SELECT dag, policy, count(*) AS n FROM trace t WHERE EXISTS (SELECT 1 FROM (SELECT dag, policy, row_number() OVER (PARTITION BY dag ORDER BY duration, policy) AS nth FROM trace) b WHERE nth = 1 AND b.dag = t.dag AND b.policy = t.policy) GROUP BY ALL"))
def rows_of_best_policy(spark, sf_dir):
    return history.of_best(trace(spark, sf_dir), "dag", "policy", "duration").groupBy("dag", "policy").agg(F.count("*").alias("n"))


@query("policy_pivot", _with("SELECT dag, median(CASE WHEN policy = 'depend' THEN duration END) AS depend, median(CASE WHEN policy = 'sdq' THEN duration END) AS sdq, median(CASE WHEN policy = 'ftf' THEN duration END) AS ftf FROM trace GROUP BY dag"))
def policy_pivot(spark, sf_dir):
    return history.median_table(trace(spark, sf_dir), "duration", "dag", "policy", ["depend", "sdq", "ftf"])


@query("relative_policy", _with("SELECT a.dag, round(a.m::DOUBLE / b.m, 8) AS ratio FROM (SELECT dag, sum(duration) AS m FROM trace WHERE policy = 'depend' GROUP BY dag) a JOIN (SELECT dag, sum(duration) AS m FROM trace WHERE policy = 'ftf' GROUP BY dag) b USING (dag)"))
def relative_policy(spark, sf_dir):
    sums = trace(spark, sf_dir).groupBy("dag", "policy").agg(F.sum("duration").alias("m"))
    return history.compared(sums, "dag", "policy", "m", "depend", "ftf").withColumn("ratio", F.round("ratio", 8))


@query("natural_sort", "SELECT brand, row_number() OVER (ORDER BY regexp_replace(brand, '[0-9]+$', ''), CAST(regexp_extract(brand, '([0-9]+)$', 1) AS BIGINT)) AS nth FROM (SELECT DISTINCT p_brand AS brand FROM part)")
def natural_sort(spark, sf_dir):
    from pyspark.sql import Window as W

    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct()  # a handful of names
    return brands.withColumn("nth", F.row_number().over(W.orderBy(*history.natural_keys(F.col("brand")))))


@query("linear_fit", _with("SELECT kernel, round(regr_slope(duration, size), 6) AS slope, round(regr_intercept(duration, size), 4) AS intercept, regr_count(duration, size)::BIGINT AS n FROM trace GROUP BY kernel"))
def linear_fit(spark, sf_dir):
    return history.linear_fit(trace(spark, sf_dir), "size", "duration", "kernel").select("kernel", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("bandwidth", _with("SELECT task_id, round(CASE WHEN r < 1024 THEN r WHEN r < 1048576 THEN r / 1024 WHEN r < 1073741824 THEN r / 1048576 ELSE r / 1073741824 END, 6) AS rate, CASE WHEN r < 1024 THEN 'B' WHEN r < 1048576 THEN 'KB' WHEN r < 1073741824 THEN 'MB' ELSE 'GB' END AS unit FROM (SELECT task_id, (size * size * size * size)::DOUBLE / duration AS r FROM trace WHERE duration > 0)"))
def bandwidth(spark, sf_dir):
    rows = trace(spark, sf_dir).filter("duration > 0")
    rate, unit = history.bandwidth(F.col("size") * F.col("size") * F.col("size") * F.col("size"), F.col("duration"))
    return rows.select("task_id", F.round(rate, 6).alias("rate"), unit.alias("unit"))


@query("drop_missing", "SELECT l_orderkey, count(*) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 WHERE s_name IS NOT NULL GROUP BY 1")
def drop_missing(spark, sf_dir):
    rich = read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return read(spark, sf_dir, "lineitem").join(rich, "l_suppkey", "left").na.drop(subset=["s_name"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("user_order", _with("SELECT task_id, row_number() OVER (PARTITION BY dag ORDER BY (task_id * 7919) % 100003, task_id) AS nth FROM trace"))
def user_order(spark, sf_dir):
    """Tasks in an order that a table gives: rank within each graph, by ranges of the order."""
    order = trace(spark, sf_dir).select("task_id", ((F.col("task_id") * 7919) % 100003).alias("wanted"))
    return history.ranked(trace(spark, sf_dir).join(order, "task_id"), "wanted", "task_id", "dag").select("task_id", "nth")


@query("long_form_filter", _with("SELECT kernel, count(*) AS n FROM trace WHERE NOT starts_with(kernel, 'pur') AND NOT regexp_matches(kernel, '^s.*p$') GROUP BY kernel"))
def long_form_filter(spark, sf_dir):
    return history.without_internal(trace(spark, sf_dir).filter(~F.col("kernel").startswith("pur")), "kernel", ["s*p"]).groupBy("kernel").agg(F.count("*").alias("n"))


@query("outer_merge", "SELECT user_id, c.n AS clicks, v.n AS views FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) c FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) v USING (user_id)")
def outer_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    counts = lambda kind, name: e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(name))
    return counts("click", "clicks").join(counts("view", "views"), "user_id", "full")


@query("fill_missing", "SELECT user_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 END), 0)::BIGINT AS errors FROM events GROUP BY user_id")
def fill_missing(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "error", 1)).alias("errors")).na.fill(0)
