"""Task graphs: ``events`` as an access log, ``conversations`` as chains of tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.lineage import shared_dir
from tessera.operators import coherence, dag, generate, graphcost, policy, report
from tessera.plans.registry import query, read
from tessera.sources import graph_json

ACCESS_SQL = "access AS (SELECT event_id AS task_id, event_id AS seq, user_id AS mem_id, CASE WHEN event_type IN ('view', 'click') THEN 'r' WHEN event_type IN ('signup', 'error') THEN 'w' ELSE 'rw' END AS mode, CAST(event_id % 4 AS INTEGER) AS devno FROM events)"
EPOCH_SQL = ACCESS_SQL + ", log AS (SELECT *, coalesce(sum(CASE WHEN mode <> 'r' THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS epoch, max(CASE WHEN mode <> 'r' THEN task_id END) OVER w AS last_writer FROM access WINDOW w AS (PARTITION BY mem_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
DEPS_SQL = (
    EPOCH_SQL
    + """, raw AS (SELECT task_id, last_writer AS dep_id, 0 AS k FROM log WHERE mode <> 'w' AND last_writer IS NOT NULL),
war AS (SELECT x.task_id, y.task_id AS dep_id, 1 AS k FROM log x JOIN log y ON x.mem_id = y.mem_id AND x.epoch = y.epoch AND y.mode = 'r' WHERE x.mode <> 'r'),
waw AS (SELECT task_id, last_writer AS dep_id, 2 AS k FROM log x WHERE mode <> 'r' AND last_writer IS NOT NULL AND NOT EXISTS (SELECT 1 FROM log y WHERE x.mem_id = y.mem_id AND x.epoch = y.epoch AND y.mode = 'r')),
deps AS (SELECT task_id, dep_id, ['raw', 'war', 'waw'][min(k) + 1] AS kind FROM (SELECT * FROM raw UNION ALL SELECT * FROM war UNION ALL SELECT * FROM waw) WHERE task_id <> dep_id GROUP BY 1, 2)"""
)
CHAIN_SQL = "task AS (SELECT conv_id * 1000 + turn AS task_id, turn AS seq, role AS name FROM conversations), dep AS (SELECT conv_id * 1000 + turn AS task_id, conv_id * 1000 + turn - 1 AS dep_id FROM conversations WHERE turn > 0)"
TRANSFER_SIZE = 64


def access(spark, sf_dir):
    mode = F.when(F.col("event_type").isin("view", "click"), "r").when(F.col("event_type").isin("signup", "error"), "w").otherwise("rw")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("mem_id"), mode.alias("mode"), (F.col("event_id") % 4).cast("int").alias("devno"))


def chains(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("task_id", F.col("conv_id") * 1000 + F.col("turn"))
    return c.select("task_id", F.col("turn").alias("seq"), F.col("role").alias("name")), c.filter("turn > 0").select("task_id", (F.col("task_id") - 1).alias("dep_id"))


@query("auto_deps", f"WITH {DEPS_SQL} SELECT * FROM deps")
def auto_deps(spark, sf_dir):
    return dag.auto_dependencies(access(spark, sf_dir))


@query("last_writer", f"WITH {EPOCH_SQL} SELECT task_id, epoch, last_writer FROM log")
def last_writer(spark, sf_dir):
    return dag.with_epochs(access(spark, sf_dir)).select("task_id", "epoch", "last_writer")


@query("flush_tasks", f"WITH {ACCESS_SQL} SELECT mem_id, max(task_id) AS task_id FROM access WHERE mode <> 'r' GROUP BY 1")
def flush_tasks(spark, sf_dir):
    return dag.flush_tasks(access(spark, sf_dir))


@query("flushed_buffers", "SELECT event_id AS i, user_id AS mem_id, value AS v FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type NOT IN ('view', 'click'))")
def flushed_buffers(spark, sf_dir):
    """The cells of buffers that some task wrote, brought out to files and read back."""
    path = f"{shared_dir(spark)}/flushed-{uuid.uuid4().hex}"
    cells = read(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("mem_id"), F.col("value").alias("v"))
    dag.flush_out(cells, access(spark, sf_dir), path)
    return spark.read.schema(cells.schema).parquet(path)


@query("distinct_sets", "SELECT user_id % 4 AS devno, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kernels, count(DISTINCT user_id) AS buffers FROM events GROUP BY 1")
def distinct_sets(spark, sf_dir):
    """What each device has ever run, and on how many buffers."""
    e = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("devno"))
    return e.agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kernels"), F.countDistinct("user_id").alias("buffers"))


@query("shadow_versions", f"WITH {EPOCH_SQL} SELECT task_id, seq, mem_id, mode, CASE WHEN mode <> 'w' THEN epoch END AS reads, CASE WHEN mode <> 'r' THEN epoch + 1 END AS writes FROM log")
def shadow_versions(spark, sf_dir):
    return dag.shadow_versions(access(spark, sf_dir))


@query("task_inputs", f"WITH {ACCESS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY mem_id ORDER BY seq) AS nth FROM access) SELECT DISTINCT task_id, mem_id FROM n WHERE mode <> 'w' AND NOT (mem_id % 2 = 0 AND nth = 1)")
def task_inputs(spark, sf_dir):
    log = access(spark, sf_dir)
    return dag.inputs_outputs(log, log.filter("mem_id % 2 = 0").select("mem_id"))[0]


@query("extra_deps", f"WITH {DEPS_SQL}, manual AS (SELECT task_id, task_id - 1 AS dep_id FROM access WHERE task_id % 5 = 0 AND task_id > 0) SELECT *, 'extra' AS side FROM (SELECT task_id, dep_id FROM manual EXCEPT SELECT task_id, dep_id FROM deps) UNION ALL SELECT *, 'missing' FROM (SELECT task_id, dep_id FROM deps EXCEPT SELECT task_id, dep_id FROM manual)")
def extra_deps(spark, sf_dir):
    log = access(spark, sf_dir)
    manual = log.filter("task_id % 5 = 0 and task_id > 0").select("task_id", (F.col("task_id") - 1).alias("dep_id"))
    return dag.difference(manual, dag.auto_dependencies(log))


@query("degree", f"WITH {DEPS_SQL} SELECT task_id, sum(p)::BIGINT AS parents, sum(c)::BIGINT AS children FROM (SELECT task_id, 1 AS p, 0 AS c FROM deps UNION ALL SELECT dep_id, 0, 1 FROM deps) GROUP BY 1")
def degree(spark, sf_dir):
    return dag.degrees(dag.auto_dependencies(access(spark, sf_dir)))


@query("adjacency", f"WITH {CHAIN_SQL} SELECT task_id + 1 AS row, dep_id + 1 AS col FROM dep UNION ALL SELECT task_id + 1, 0 FROM task WHERE task_id NOT IN (SELECT task_id FROM dep)")
def adjacency(spark, sf_dir):
    return dag.adjacency(*chains(spark, sf_dir))


@query("levels", "SELECT conv_id * 1000 + turn AS task_id, CAST(turn AS INTEGER) AS level FROM conversations")
def levels(spark, sf_dir):
    return dag.levels(*chains(spark, sf_dir))


@query("parallelism", "WITH w AS (SELECT turn AS level, count(*) AS n FROM conversations GROUP BY 1) SELECT count(*) AS height, max(n) AS widest, round(sum(n)::DOUBLE / count(*), 6) AS mean_width FROM w")
def parallelism(spark, sf_dir):
    return dag.parallelism(dag.levels(*chains(spark, sf_dir))).withColumn("mean_width", F.round("mean_width", 6))


@query("graph_sizes", "WITH w AS (SELECT conv_id % 7 AS g, turn, count(*) AS n FROM conversations GROUP BY 1, 2), m AS (SELECT g, max(n) AS widest FROM w GROUP BY 1), s AS (SELECT conv_id % 7 AS graph, count(*) AS tasks, count(*) FILTER (turn > 0) AS edges, max(turn) + 1 AS height FROM conversations GROUP BY 1) SELECT s.*, widest FROM s JOIN m ON g = graph")
def graph_sizes(spark, sf_dir):
    """The largest sizes of each graph's matrices."""
    task, dep = chains(spark, sf_dir)
    graph = lambda df: df.withColumn("graph", F.expr("(task_id div 1000) % 7"))
    return policy.graph_features(graph(task), graph(dep), graph(dag.levels(task, dep)), "graph")


@query("pruned_deps", f"WITH {DEPS_SQL} SELECT task_id, dep_id FROM deps WHERE task_id - dep_id < 100")
def pruned_deps(spark, sf_dir):
    """Edges that a list of allowed ones has."""
    found = dag.auto_dependencies(access(spark, sf_dir))
    return dag.pruned(found, found.filter("task_id - dep_id < 100")).select("task_id", "dep_id")


@query("end_edges", "WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) SELECT -1 AS task_id, conv_id * 1000 + turn AS dep_id FROM last UNION ALL SELECT conv_id * 1000 + turn, conv_id * 1000 + turn - 1 FROM conversations WHERE turn > 0")
def end_edges(spark, sf_dir):
    """An end task after every task; only its edges to tasks that nothing else follows stay."""
    task, dep = chains(spark, sf_dir)
    end = task.select(F.lit(-1).cast("long").alias("task_id"), F.col("task_id").alias("dep_id"))
    return dag.without_redundant_ends(dep.unionByName(end), -1)


@query("region_comm", "WITH t AS (SELECT conv_id * 1000 + turn AS task_id, conv_id, turn FROM conversations) SELECT task_id AS from_id, task_id + 1 AS to_id, 1000000 + task_id - 1 AS mem_id, 16 AS size FROM t WHERE turn % 2 = 1 UNION ALL SELECT 0, task_id + 1, conv_id, 64 FROM t WHERE turn % 2 = 0")
def region_comm(spark, sf_dir):
    """Odd turns read the whole of their conversation's buffer, of which the turn before wrote a
    region; even turns read it from the host."""
    task, dep = chains(spark, sf_dir)
    mem = F.expr("task_id div 1000")
    region = (F.col("task_id") + 1_000_000).alias("mem_id")
    outs = task.filter("seq % 2 = 0").select("task_id", region)
    ins = task.select("task_id", mem.alias("mem_id"))
    regions = task.filter("seq % 2 = 0").select(region, mem.alias("parent_id"))
    sizes = regions.select("mem_id", F.lit(16).alias("size")).unionByName(ins.select("mem_id").distinct().select("mem_id", F.lit(64).alias("size")))
    return graphcost.communication_list(dep, outs, ins, sizes, regions)


@query("pushed_outputs", f"WITH {DEPS_SQL} SELECT DISTINCT o.mem_id, o.devno AS from_dev, i.devno AS to_dev FROM deps d JOIN access o ON o.task_id = d.dep_id AND o.mode <> 'r' JOIN access i ON i.task_id = d.task_id AND i.mode <> 'w' AND i.mem_id = o.mem_id WHERE o.devno <> i.devno")
def pushed_outputs(spark, sf_dir):
    log = access(spark, sf_dir)
    ins, outs = dag.inputs_outputs(log)
    return coherence.proactive_transfers(dag.auto_dependencies(log), outs, ins, log.select("task_id", "devno"))


@query("both_ways", f"WITH {CHAIN_SQL} SELECT task_id, dep_id FROM dep UNION SELECT dep_id, task_id FROM dep")
def both_ways(spark, sf_dir):
    return dag.both_ways(chains(spark, sf_dir)[1])


@query("dispatchable", "WITH t AS (SELECT conv_id * 1000 + turn AS task_id, conv_id, turn, CASE WHEN turn < conv_id % 4 THEN 'complete' WHEN turn = conv_id % 4 AND conv_id % 3 = 0 THEN 'running' ELSE 'none' END AS status FROM conversations) SELECT task_id FROM t WHERE status = 'none' AND NOT EXISTS (SELECT 1 FROM t d WHERE d.conv_id = t.conv_id AND d.turn = t.turn - 1 AND d.status <> 'complete' AND NOT (d.status = 'running' AND d.conv_id % 2 = 0))")
def dispatchable(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    status = F.when(F.col("turn") < F.col("conv_id") % 4, "complete").when((F.col("turn") == F.col("conv_id") % 4) & (F.col("conv_id") % 3 == 0), "running").otherwise("none")
    task = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), status.alias("status"), (F.col("conv_id") % 2 == 0).alias("is_async"))
    return dag.dispatchable(task, chains(spark, sf_dir)[1])


@query("split_tasks", "WITH s AS (SELECT o_orderkey AS task_id, o_custkey AS items, greatest(o_custkey // 4, 1) AS chunk FROM orders WHERE o_custkey > 0), c AS (SELECT task_id, items, chunk, unnest(range(0, items, chunk)) AS off FROM s) SELECT task_id, off, least(chunk, items - off) AS size FROM c")
def split_tasks(spark, sf_dir):
    return dag.split_tasks(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("items")), 4)


@query("names_to_deps", f"WITH {CHAIN_SQL}, t AS (SELECT *, task_id // 1000 AS conv FROM task) SELECT x.task_id, y.task_id AS dep_id FROM t x JOIN t y ON y.name = CASE WHEN x.name = 'user' THEN 'assistant' ELSE 'user' END || '-' || x.conv OR (y.conv = x.conv AND y.name = CASE WHEN x.name = 'user' THEN 'assistant' ELSE 'user' END) WHERE y.seq < x.seq")
def names_to_deps(spark, sf_dir):
    task, _ = chains(spark, sf_dir)
    conv = F.expr("cast(task_id div 1000 as string)")
    named = task.withColumn("name", F.concat_ws("-", "name", conv))
    wanted = task.select("task_id", F.concat_ws("-", F.when(F.col("name") == "user", "assistant").otherwise("user"), conv).alias("depends"))
    return dag.resolve_dependencies_by_name(named, wanted)


@query("command_counts", "SELECT user_id AS task_id, count(*) AS total, count(*) FILTER (event_type IN ('view', 'click')) AS kernels, count(*) FILTER (event_type IN ('signup', 'error')) AS copies FROM events GROUP BY 1")
def command_counts(spark, sf_dir):
    opcode = F.when(F.col("event_type").isin("view", "click"), "kernel").when(F.col("event_type") == "signup", "h2d").when(F.col("event_type") == "error", "d2h").otherwise("reset")
    return dag.command_counts(read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), opcode.alias("opcode")))


COMM_SQL = (
    DEPS_SQL
    + ", ins AS (SELECT DISTINCT task_id, mem_id FROM access WHERE mode <> 'w'), outs AS (SELECT DISTINCT task_id, mem_id FROM access WHERE mode <> 'r'), direct AS (SELECT d.dep_id, d.task_id, o.mem_id FROM deps d JOIN outs o ON o.task_id = d.dep_id JOIN ins i ON i.task_id = d.task_id AND i.mem_id = o.mem_id), comm AS (SELECT dep_id + 1 AS from_id, task_id + 1 AS to_id, mem_id, 64 + mem_id AS size FROM direct UNION ALL SELECT 0, task_id + 1, mem_id, 64 + mem_id FROM ins i WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.task_id = i.task_id AND d.mem_id = i.mem_id))"
)


def _communication(spark, sf_dir):
    log = access(spark, sf_dir)
    ins, outs = dag.inputs_outputs(log)
    mem = log.select("mem_id").distinct().withColumn("size", F.col("mem_id") + TRANSFER_SIZE)
    return graphcost.communication_list(dag.auto_dependencies(log), outs, ins, mem)


@query("comm_list", f"WITH {COMM_SQL} SELECT * FROM comm")
def comm_list(spark, sf_dir):
    return _communication(spark, sf_dir)


@query("comm_matrix", f"WITH {COMM_SQL} SELECT from_id, to_id, sum(size)::BIGINT AS bytes FROM comm GROUP BY 1, 2")
def comm_matrix(spark, sf_dir):
    return graphcost.communication_matrix(_communication(spark, sf_dir))


@query("compute_costs", "WITH h AS (SELECT event_type AS kernel, CAST(user_id % 4 AS INTEGER) AS devno, round(avg(CAST(round(value * 100) AS BIGINT)), 6) AS cost FROM events GROUP BY 1, 2), t AS (SELECT o_orderkey AS task_id, ['click', 'view', 'error', 'signup', 'purchase'][o_orderkey % 5 + 1] AS kernel FROM orders) SELECT task_id, devno, cost FROM t JOIN h USING (kernel)")
def compute_costs(spark, sf_dir):
    from tessera.plans.history_queries import trace

    names = F.array(*map(F.lit, ["click", "view", "error", "signup", "purchase"]))
    task = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("kernel"))
    return graphcost.computation_costs(task, trace(spark, sf_dir), "kernel").withColumn("cost", F.round("cost", 6))


@query("object_costs", "WITH h AS (SELECT CAST(user_id % 4 AS INTEGER) AS src, CAST(event_id % 4 AS INTEGER) AS dst, CAST(json_extract(props, '$.k') AS BIGINT) AS size, round(avg(CAST(round(value * 100) AS BIGINT)), 6) AS cost FROM events GROUP BY 1, 2, 3) SELECT p_partkey AS mem_id, src, dst, cost FROM part JOIN h ON h.size = p_size")
def object_costs(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("src"), (F.col("event_id") % 4).cast("int").alias("dst"), F.get_json_object("props", "$.k").cast("long").alias("size"), F.round(F.col("value") * 100).cast("long").alias("duration"))
    mem = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("mem_id"), F.col("p_size").cast("long").alias("size"))
    return graphcost.object_costs(mem, graphcost.transfer_costs(e).withColumn("cost", F.round("cost", 6)))


TRANSFER_SQL = EPOCH_SQL + ", state AS (SELECT x.*, coalesce((SELECT arg_max(y.devno, y.seq) FROM access y WHERE y.mem_id = x.mem_id AND y.seq < x.seq AND y.mode <> 'r'), -1) AS writer, (SELECT list(DISTINCT y.devno) FROM log y WHERE y.mem_id = x.mem_id AND y.epoch = x.epoch AND y.seq < x.seq AND y.mode <> 'w') AS readers FROM log x WHERE x.mode <> 'w'), v AS (SELECT *, list_append(coalesce(readers, []), writer) AS valid FROM state)"
# devices 0 and 1 are CPUs (type 1), 2 and 3 GPUs (type 2)
KIND_SQL = "CASE WHEN list_contains(valid, devno) THEN NULL WHEN list_contains(valid, CASE WHEN devno < 2 THEN 1 - devno ELSE 5 - devno END) THEN 'd2d' WHEN devno >= 2 AND list_has_any(valid, [0, 1]) THEN 'o2d' WHEN devno < 2 AND list_has_any(valid, [2, 3]) THEN 'd2o' WHEN list_contains(valid, -1) THEN 'h2d' ELSE 'd2h_h2d' END"


def _transfers(spark, sf_dir):
    device = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2)], "devno int, type int")
    return coherence.transfers(access(spark, sf_dir), device)


@query("transfers", f"WITH {TRANSFER_SQL} SELECT task_id, seq, mem_id, devno, {KIND_SQL} AS kind FROM v WHERE {KIND_SQL} IS NOT NULL")
def transfers(spark, sf_dir):
    return _transfers(spark, sf_dir)


@query("transfer_bytes", f"WITH {TRANSFER_SQL} SELECT devno, {KIND_SQL} AS kind, count(*) AS n, sum(64 + mem_id)::BIGINT AS bytes FROM v WHERE {KIND_SQL} IS NOT NULL GROUP BY 1, 2")
def transfer_bytes(spark, sf_dir):
    return _transfers(spark, sf_dir).groupBy("devno", "kind").agg(F.count("*").alias("n"), F.sum(F.col("mem_id") + TRANSFER_SIZE).alias("bytes"))


@query("owner_transfers", f"WITH {ACCESS_SQL}, o AS (SELECT *, lag(devno) OVER (PARTITION BY mem_id ORDER BY seq) AS owner FROM access) SELECT task_id, seq, mem_id, owner AS from_dev, devno AS to_dev FROM o WHERE mode <> 'w' AND owner IS NOT NULL AND owner <> devno")
def owner_transfers(spark, sf_dir):
    return coherence.owner_transfers(access(spark, sf_dir))


RANGES_SQL = "a AS (SELECT o_orderkey AS id, o_custkey % 50 AS mem_id, o_orderkey % 1000 AS off, o_custkey % 97 AS size FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS id, o_custkey % 50 AS mem_id, o_orderkey % 1000 AS off, o_custkey % 97 AS size FROM orders WHERE o_orderkey % 2 = 1)"


@query("range_overlap", f"WITH {RANGES_SQL} SELECT a.mem_id, a.id AS id_a, b.id AS id_b, greatest(a.off, b.off) AS off, least(a.off + a.size, b.off + b.size) - greatest(a.off, b.off) AS size FROM a JOIN b ON a.mem_id = b.mem_id AND a.off < b.off + b.size AND b.off < a.off + a.size WHERE a.size > 0 AND b.size > 0")
def range_overlap(spark, sf_dir):
    r = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("mem_id"), (F.col("o_orderkey") % 1000).alias("off"), (F.col("o_custkey") % 97).alias("size"))
    return coherence.range_overlaps(r.filter("id % 2 = 0"), r.filter("id % 2 = 1"), 64)


@query("membership_matrix", f"WITH {ACCESS_SQL} SELECT DISTINCT task_id, mem_id, 1 AS flag FROM access")
def membership_matrix(spark, sf_dir):
    """The ones of the tasks x buffers matrix, of all buffers."""
    return graphcost.membership_matrix(access(spark, sf_dir))


@query("execution_schedule", "SELECT event_id AS task_id, CAST(user_id % 4 AS INTEGER) AS devno, epoch_us(ts) AS start, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) AS \"end\" FROM events")
def execution_schedule(spark, sf_dir):
    from tessera.plans.history_queries import trace

    return graphcost.schedule(trace(spark, sf_dir))


@query("recoloured", "SELECT user_id AS task_id, arg_min(d, event_id) AS devno, CASE arg_min(d, event_id) WHEN 0 THEN 'gold' WHEN 1 THEN 'steelblue' WHEN 2 THEN 'salmon' ELSE 'lightgrey' END AS colour FROM (SELECT *, CAST(event_id % 4 AS INTEGER) AS d FROM events) GROUP BY 1")
def recoloured(spark, sf_dir):
    """Users as tasks, coloured by the device of their first event; device 3 has a type without a colour."""
    ran = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), (F.col("event_id") % 4).cast("int").alias("devno"), F.col("event_id").alias("start"))
    device = spark.createDataFrame([(0, 1), (1, 2), (2, 4), (3, 16)], "devno int, type int")
    return report.recoloured(ran.select("task_id").distinct(), ran, device)


@query("event_lines", "SELECT event_id AS task_id, to_json({'lane': 'dev' || user_id % 4, 'label': ['compute', 'copy in', 'copy out', 'copy across', 'set up', 'other'][event_id % 6 + 1], 'from': event_id, 'to': event_id + 1})::VARCHAR AS line FROM events")
def event_lines(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["kernel", "h2d", "d2h", "d2d", "init", "no such kind"]))
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), (F.col("user_id") % 4).alias("devno"), F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("kind"), F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"))
    return report.event_lines(e)


@query("arguments_by_device", "SELECT user_id AS task_id, event_id AS idx FROM events WHERE ([1, 2, 6, 31][user_id % 4 + 1] & [1, 2, 4][event_id % 3 + 1]) <> 0")
def arguments_by_device(spark, sf_dir):
    """Arguments that count only on some device types (a bit mask), on the device of their task."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    args = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("idx"), pick([1, 2, 6, 31], F.col("user_id") % 4).alias("mask"), pick([1, 2, 4], F.col("event_id") % 3).alias("type"))
    return policy.arguments_on(args).select("task_id", "idx")


@query("memory_shuffles", "SELECT event_id AS task_id, CASE WHEN user_id % 2 = 0 THEN user_id + 1 ELSE user_id - 1 END AS mem_id FROM events")
def memory_shuffles(spark, sf_dir):
    """Pairs of buffers change places in every access."""
    swap = F.when(F.col("mem_id") % 2 == 0, F.col("mem_id") + 1).otherwise(F.col("mem_id") - 1)
    log = access(spark, sf_dir)
    pairs = log.select("mem_id").distinct().select("mem_id", swap.alias("becomes"))
    return generate.swapped(log, pairs).select("task_id", "mem_id")


@query("dot_lines", f"WITH {CHAIN_SQL} SELECT 0 AS part, 0::BIGINT AS id, 'strict digraph {{' AS line UNION ALL SELECT 1, task_id, 'n' || task_id || ' [shape=box, color=lightgrey, tooltip=\"task ' || task_id || '\", label=\"' || name || '\"]' FROM task UNION ALL SELECT 2, task_id, 'n' || dep_id || ' -> n' || task_id FROM dep UNION ALL SELECT 3, task_id, 'source -> n' || task_id FROM task WHERE task_id NOT IN (SELECT task_id FROM dep) UNION ALL SELECT 4, task_id, 'n' || task_id || ' -> sink' FROM task WHERE task_id NOT IN (SELECT dep_id FROM dep) UNION ALL SELECT 5, 0, '}}'")
def dot_lines(spark, sf_dir):
    return report.dot_lines(*chains(spark, sf_dir))


@query("timeline_lines", "SELECT event_id AS task_id, to_json({'lane': 'dev' || user_id % 4, 'label': event_type, 'policy': 'sdq', 'from_us': event_id * 1000000, 'to_us': (event_id + 1) * 1000000})::VARCHAR AS line FROM events")
def timeline_lines(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("task_id"), F.concat(F.lit("dev"), F.col("user_id") % 4).alias("device"), F.col("event_type").alias("name"), F.lit("sdq").alias("policy"), F.col("event_id").cast("double").alias("start"), (F.col("event_id") + 1).cast("double").alias("end"))
    return report.timeline_lines(rows)


def _documents(spark, sf_dir):
    """A JSON document for each conversation: a task for each turn, with one command each."""
    c = read(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("-", F.lit("t"), turn)
    depends = F.when(F.col("turn") > 0, F.array(name(F.col("turn") - 1))).otherwise(F.array().cast("array<string>"))
    kernel = F.struct(F.struct(F.col("role").alias("name"), F.array(F.length("text").cast("string")).alias("global_size")).alias("kernel"))
    task = c.select("conv_id", F.col("turn").alias("seq"), name(F.col("turn")).alias("name"), F.lit("default").alias("target"), depends.alias("depends"), F.array(kernel).alias("commands"))
    return graph_json.record(task, "conv_id")


@query("json_record_load", "SELECT conv_id, CAST(turn AS INTEGER) AS seq, 't-' || turn AS name, 'default' AS target, CASE WHEN turn > 0 THEN 't-' || (turn - 1) ELSE '' END AS depends FROM conversations")
def json_record_load(spark, sf_dir):
    loaded = graph_json.tasks(graph_json.parse(_documents(spark, sf_dir)), "conv_id")
    return loaded.select("conv_id", "seq", "name", "target", F.array_join("depends", ",").alias("depends"))


@query("json_commands", "SELECT conv_id, CAST(turn AS INTEGER) AS seq, 'kernel' AS opcode, role AS name, length(text) AS size FROM conversations")
def json_commands(spark, sf_dir):
    return graph_json.commands(graph_json.parse(_documents(spark, sf_dir)), "conv_id").select("conv_id", "seq", "opcode", "name", "size")


@query("json_problems", "SELECT conv_id, ['no task list', 'task without a name', 'command of an unknown kind', 'parameter of an unknown type', 'memory without permissions'][conv_id % 7] AS problem FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 7 BETWEEN 1 AND 5")
def json_problems(spark, sf_dir):
    """A document for each conversation; five of seven kinds have a fault each."""
    tasks = {
        1: None, 2: '[{"commands": [{"kernel": {"name": "k", "global_size": [1]}}]}]', 3: '[{"name": "t", "commands": [{"move": {"name": "c"}}]}]',
        4: '[{"name": "t", "commands": [{"kernel": {"name": "k", "global_size": [1], "parameters": [{"type": "other", "value": "3"}]}}]}]',
        5: '[{"name": "t", "commands": [{"kernel": {"name": "k", "global_size": [1], "parameters": [{"type": "memory_object", "value": "m"}]}}]}]',
        0: '[{"name": "t", "commands": [{"kernel": {"name": "k", "global_size": [1], "parameters": [{"type": "memory_object", "value": "m", "permissions": "rw"}]}}]}]', 6: '[{"name": "t", "commands": []}]',
    }
    kind, text = F.col("conv_id") % 7, F.lit(None).cast("string")
    for k, t in tasks.items():
        text = F.when(kind == k, F.lit('{"a graph": {"graph": {%s}}}' % (f'"tasks": {t}' if t else ""))).otherwise(text)
    docs = read(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", text.alias("json"))
    return graph_json.problems(graph_json.parse(docs), "conv_id")


@query("json_bound", "SELECT conv_id, 0 AS idx, 'scalar' AS type, (conv_id * 3)::VARCHAR AS value, NULL AS mode FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT DISTINCT conv_id, 1, 'memory_object', 'm', 'rw' FROM conversations")
def json_bound(spark, sf_dir):
    """Kernel arguments whose values name inputs, bound to each document's own numbers."""
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    json = F.concat(F.lit('{"a graph": {"inputs": ["n"], "graph": {"tasks": [{"name": "t", "commands": [{"kernel": {"name": "k", "global_size": [1], "parameters": [{"type": "scalar", "name": "n", "value": "n'), F.col("conv_id"), F.lit('", "data_type": "int32_t"}, {"type": "memory_object", "value": "m", "permissions": "rw"}]}}]}]}}}'))
    bindings = ids.select(F.concat(F.lit("n"), "conv_id").alias("name"), (F.col("conv_id") * 3).cast("string").alias("bound"))
    return graph_json.parameters(graph_json.parse(ids.select("conv_id", json.alias("json"))), "conv_id", bindings=bindings).select("conv_id", "idx", "type", "value", "mode")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("random_graph")
def random_graph(spark, sf_dir):
    return generate.random_graph(spark, levels=40, width=(1, 6), skips=3, mean=4.0, std=2.0, seed=7, copies=2)[1]
