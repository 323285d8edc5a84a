"""Device placement: ``orders`` as tasks on a table of four devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import policy
from tessera.plans.graph_queries import chains
from tessera.plans.registry import query, read

#: devno, type, name; 0 and 3 are CPUs.
DEVICES = [(0, "cpu", "host cpu"), (1, "nvidia", "gpu a"), (2, "amd", "gpu b"), (3, "cpu", "second cpu")]
KERNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: The devices that have each kernel: k has every device d with (k + d) % 3 > 0; the last kernel has none.
SUPPORT = [(name, d) for k, name in enumerate(KERNELS[:-1]) for d in range(4) if (k + d) % 3]
TASK_SQL = "task AS (SELECT o_orderkey AS task_id, o_orderkey AS seq, o_orderpriority AS kernel, o_custkey AS items FROM orders)"
ABLE_SQL = TASK_SQL + ", kd AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {d})" for k, d in SUPPORT) + ") t(kernel, devno)), able AS (SELECT task_id, CAST(devno AS INTEGER) AS devno FROM task JOIN kd USING (kernel))"


def _task(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("kernel"), F.col("o_custkey").alias("items"))


def _able(spark, sf_dir):
    return policy.eligible(_task(spark, sf_dir), spark.createDataFrame(SUPPORT, "kernel string, devno int"))


def _device(spark):
    return policy.devices(spark, DEVICES)


@query("policy_default", f"WITH {ABLE_SQL} SELECT task_id, coalesce(min(devno), 0)::INTEGER AS devno FROM task LEFT JOIN able USING (task_id) GROUP BY 1")
def policy_default(spark, sf_dir):
    return policy.first(_task(spark, sf_dir), _able(spark, sf_dir))


@query("policy_last", f"WITH {ABLE_SQL} SELECT task_id, coalesce(max(devno), 0)::INTEGER AS devno FROM task LEFT JOIN able USING (task_id) GROUP BY 1")
def policy_last(spark, sf_dir):
    return policy.last(_task(spark, sf_dir), _able(spark, sf_dir))


@query("policy_ftf", f"WITH {ABLE_SQL} SELECT task_id, coalesce(devno, 0)::INTEGER AS devno FROM task LEFT JOIN able USING (task_id)")
def policy_ftf(spark, sf_dir):
    return policy.everywhere(_task(spark, sf_dir), _able(spark, sf_dir))


@query("policy_roundrobin", f"WITH {TASK_SQL} SELECT task_id, CAST((row_number() OVER (ORDER BY seq) - 1) % 4 AS INTEGER) AS devno FROM task")
def policy_roundrobin(spark, sf_dir):
    return policy.round_robin(_task(spark, sf_dir), _device(spark))


@query("policy_roundrobin_gpu", f"WITH {TASK_SQL} SELECT task_id, CAST((row_number() OVER (ORDER BY seq) - 1) % 2 + 1 AS INTEGER) AS devno FROM task")
def policy_roundrobin_gpu(spark, sf_dir):
    return policy.round_robin(_task(spark, sf_dir), _device(spark), policy.GPU)


@query("policy_device_type", f"WITH {TASK_SQL} SELECT task_id, unnest([0, 3])::INTEGER AS devno FROM task")
def policy_device_type(spark, sf_dir):
    return policy.by_type(_task(spark, sf_dir), _device(spark), policy.DEVICE_TYPES["cpu"])


@query("policy_gws", f"WITH {TASK_SQL} SELECT task_id, unnest(CASE WHEN items > 700 THEN [1, 2] ELSE [0, 3] END)::INTEGER AS devno FROM task")
def policy_gws(spark, sf_dir):
    return policy.by_work_items(_task(spark, sf_dir), _device(spark), 700)


@query("policy_data", "WITH b AS (SELECT l_orderkey AS task_id, CAST(l_suppkey % 4 AS INTEGER) AS devno, sum(l_quantity)::BIGINT AS bytes FROM lineitem GROUP BY 1, 2) SELECT o_orderkey AS task_id, coalesce((SELECT devno FROM (SELECT devno, row_number() OVER (PARTITION BY task_id ORDER BY bytes DESC, devno) AS nth, task_id FROM b) r WHERE nth = 1 AND r.task_id = o_orderkey), 0)::INTEGER AS devno FROM orders")
def policy_data(spark, sf_dir):
    owned = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_suppkey") % 4).cast("int").alias("devno"), F.col("l_quantity").cast("long").alias("bytes"))
    return policy.most_data(_task(spark, sf_dir), owned)


@query("policy_depend", f"WITH {ABLE_SQL}, dep AS (SELECT task_id, task_id - 1 AS dep_id FROM task WHERE task_id % 3 = 1), near AS (SELECT DISTINCT d.task_id, CAST(d.dep_id % 4 AS INTEGER) AS devno FROM dep d JOIN able a ON a.task_id = d.task_id AND a.devno = d.dep_id % 4) SELECT * FROM near UNION ALL SELECT task_id, coalesce(min(devno), 0)::INTEGER FROM task LEFT JOIN able USING (task_id) WHERE task_id NOT IN (SELECT task_id FROM near) GROUP BY 1")
def policy_depend(spark, sf_dir):
    task = _task(spark, sf_dir)
    dep = task.filter("task_id % 3 = 1").select("task_id", (F.col("task_id") - 1).alias("dep_id"))
    placement = task.select("task_id", (F.col("task_id") % 4).cast("int").alias("devno"))
    return policy.of_dependencies(task, dep, placement, _able(spark, sf_dir))


@query("policy_profile", "WITH s AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][user_id % 4 + 1] AS kernel, CAST(event_id % 4 AS INTEGER) AS devno, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / count(*) AS mean FROM events GROUP BY 1, 2), b AS (SELECT kernel, devno, row_number() OVER (PARTITION BY kernel ORDER BY mean, devno) AS nth FROM s) SELECT o_orderkey AS task_id, coalesce(devno, 0)::INTEGER AS devno FROM orders LEFT JOIN b ON kernel = o_orderpriority AND nth = 1")
def policy_profile(spark, sf_dir):
    """The device with the least mean; the last kernel has no history and goes to device 0."""
    names = F.array(*map(F.lit, KERNELS))
    history = read(spark, sf_dir, "events").select(F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("kernel"), (F.col("event_id") % 4).cast("int").alias("devno"), F.round(F.col("value") * 100).cast("long").alias("duration"))
    return policy.fastest(_task(spark, sf_dir), _device(spark), history)


@query("policy_sdq", "SELECT arg_min(devno, n * 10 + devno)::INTEGER AS devno FROM (SELECT d.devno, count(e.event_id) AS n FROM (VALUES (0), (1), (2), (3)) d(devno) LEFT JOIN events e ON e.user_id % 4 = d.devno AND e.event_type = 'error' GROUP BY 1)")
def policy_sdq(spark, sf_dir):
    queue = read(spark, sf_dir, "events").filter("event_type = 'error'").select((F.col("user_id") % 4).cast("int").alias("devno"))
    return policy.shortest_queue(queue, _device(spark))


@query("policy_block_cycle", f"WITH {ABLE_SQL}, t AS (SELECT *, task_id % 7 - 1 AS r, items % 5 AS c FROM task) SELECT task_id, [[0, 1], [2, 3]][r % 2 + 1][c % 2 + 1] AS devno FROM t WHERE r >= 0 UNION ALL SELECT task_id, coalesce(devno, 0)::INTEGER FROM t LEFT JOIN able USING (task_id) WHERE r < 0")
def policy_block_cycle(spark, sf_dir):
    task = _task(spark, sf_dir).withColumns({"row": F.col("task_id") % 7 - 1, "col": F.col("items") % 5})
    return policy.block_cycle(task, _able(spark, sf_dir), 4)


@query("policy_random")
def policy_random(spark, sf_dir):
    return policy.at_random(_task(spark, sf_dir), _able(spark, sf_dir), seed=3)


@query("resolved_policy", "SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'O' THEN 'sdq' ELSE o_orderstatus END AS policy FROM orders")
def resolved_policy(spark, sf_dir):
    own = F.when(F.col("o_orderstatus") == "O", "default").otherwise(F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), policy.resolved_policy(own, F.lit("sdq")).alias("policy"))


@query("adopted_device", "SELECT conv_id * 1000 + turn AS task_id, CASE WHEN turn + 1 < n THEN (conv_id * 1000 + turn + 1) % 4 ELSE 0 END::INTEGER AS devno FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn % 2 = 0")
def adopted_device(spark, sf_dir):
    task, dep = chains(spark, sf_dir)
    return policy.adopt_from_consumer(task.filter("seq % 2 = 0"), dep, task.select("task_id", (F.col("task_id") % 4).cast("int").alias("devno")))
