"""Device placement as queries over tasks, devices and what is known of them.

Every policy gives task_id, devno: one device, or several that may all take the task.
``eligible`` (task_id, devno) says which devices support a task's kernel.  Ties go to the
lowest device; a task that no device supports goes to the default device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.linalg import block_cyclic
from tessera.operators.ranges import with_range

DEFAULT_DEVICE = 0
#: Bits of device types.
DEVICE_TYPES = {"cpu": 1, "nvidia": 2, "amd": 4, "fpga": 8, "dsp": 16}
GPU = DEVICE_TYPES["nvidia"] | DEVICE_TYPES["amd"]

def devices(spark: SparkSession, rows: list[tuple[int, str, str]]) -> DataFrame:
    """devno, type (bit), name."""
    return spark.createDataFrame([(n, DEVICE_TYPES[t], name) for n, t, name in rows], "devno int, type int, name string")


def eligible(task: DataFrame, kernel_device: DataFrame) -> DataFrame:
    """task_id, devno of the devices that have the task's kernel."""
    return task.select("task_id", "kernel").join(kernel_device, "kernel").select("task_id", "devno")


def _or_default(task: DataFrame, chosen: DataFrame) -> DataFrame:
    return task.select("task_id").join(chosen, "task_id", "left").na.fill({"devno": DEFAULT_DEVICE})


def first(task: DataFrame, able: DataFrame) -> DataFrame:
    """The first supporting device."""
    return _or_default(task, able.groupBy("task_id").agg(F.min("devno").alias("devno")))


def last(task: DataFrame, able: DataFrame) -> DataFrame:
    return _or_default(task, able.groupBy("task_id").agg(F.max("devno").alias("devno")))


def everywhere(task: DataFrame, able: DataFrame) -> DataFrame:
    """All supporting devices; the first to finish counts."""
    return _or_default(task, able)


def by_type(task: DataFrame, device: DataFrame, mask: int) -> DataFrame:
    """All devices of a type."""
    match = [r["devno"] for r in device.filter(F.col("type").bitwiseAND(mask) != 0).select("devno").collect()]
    return task.select("task_id", F.explode(F.array(*map(F.lit, sorted(match) or [DEFAULT_DEVICE]))).alias("devno"))


def round_robin(task: DataFrame, device: DataFrame, mask: int | None = None, buckets: int = 256) -> DataFrame:
    """Devices in turn, by the tasks' order (column seq), over those of a type if given.

    The turn of a task is its rank.  Ranks are counted in ranges of seq, cut at its
    quantiles: a small table of range sizes gives each range its offset, so no task sorts
    everything.
    """
    chosen = device if mask is None else device.filter(F.col("type").bitwiseAND(mask) != 0)
    order = [r["devno"] for r in chosen.orderBy("devno").select("devno").collect()] or [DEFAULT_DEVICE]
    ranged = with_range(task.select("task_id", "seq"), "seq", buckets)
    sizes = ranged.groupBy("range").count()
    offset = sizes.select("range", (F.sum("count").over(W.orderBy("range")) - F.col("count")).alias("offset"))  # at most ``buckets`` + 1 rows
    nth = F.row_number().over(W.partitionBy("range").orderBy("seq", "task_id")) - 1
    ranked = ranged.withColumn("nth", nth).join(F.broadcast(offset), "range")
    return ranked.select("task_id", F.element_at(F.array(*map(F.lit, order)), ((F.col("offset") + F.col("nth")) % len(order) + 1).cast("int")).alias("devno"))


def of_dependencies(task: DataFrame, dep: DataFrame, placement: DataFrame, able: DataFrame) -> DataFrame:
    """The distinct devices of a task's dependencies that support it, else the first supporting one."""
    near = dep.join(placement.select(F.col("task_id").alias("dep_id"), "devno"), "dep_id").select("task_id", "devno").join(able, ["task_id", "devno"], "left_semi").distinct()
    rest = task.join(near.select("task_id"), "task_id", "left_anti")
    return near.unionByName(first(rest, able))


def most_data(task: DataFrame, owned: DataFrame) -> DataFrame:
    """The device that owns most of the task's bytes (``owned``: task_id, devno, bytes)."""
    sums = owned.groupBy("task_id", "devno").agg(F.sum("bytes").alias("bytes"))
    return _or_default(task, sums.groupBy("task_id").agg(F.max_by("devno", F.struct("bytes", -F.col("devno"))).alias("devno")))


def fastest(task: DataFrame, device: DataFrame, history: DataFrame) -> DataFrame:
    """Per kernel: the first device without any history, else the one with the least mean
    (``history``: kernel, devno, duration)."""
    kernels = task.select("kernel").distinct()
    stats = history.groupBy("kernel", "devno").agg(F.count("*").alias("n"), F.sum("duration").alias("total"))
    slots = kernels.select("kernel", F.explode(F.array(*[F.lit(r["devno"]) for r in device.orderBy("devno").select("devno").collect()])).alias("devno"))
    known = slots.join(stats, ["kernel", "devno"], "left").withColumn("tried", F.when(F.col("n") > 0, 1).otherwise(0))
    best = known.groupBy("kernel").agg(F.min_by("devno", F.struct("tried", F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)).alias("mean"), "devno")).alias("devno"))
    return _or_default(task, task.select("task_id", "kernel").join(best, "kernel").select("task_id", "devno"))


def shortest_queue(queue: DataFrame, device: DataFrame) -> DataFrame:
    """One row: the device with the fewest queued and running tasks (``queue``: a row a task, devno)."""
    loads = device.select("devno").join(queue.groupBy("devno").agg(F.count("*").alias("n")), "devno", "left")
    return loads.agg(F.min_by("devno", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "devno")).alias("devno"))


def at_random(task: DataFrame, able: DataFrame, seed: int) -> DataFrame:
    """Uniform over the supporting devices, drawn by a hash of seed, task and device."""
    return _or_default(task, able.groupBy("task_id").agg(F.min_by("devno", F.xxhash64(F.lit(seed), "task_id", "devno")).alias("devno")))


def block_cycle(task: DataFrame, able: DataFrame, n_devices: int, row: str = "row", col: str = "col") -> DataFrame:
    """The device of the task's tile; all supporting devices without a tile."""
    placed = task.withColumn("devno", block_cyclic(F.col(row), F.col(col), n_devices))
    tiled = placed.filter("devno is not null").select("task_id", "devno")
    return tiled.unionByName(everywhere(placed.filter("devno is null").drop("devno"), able))


def by_work_items(task: DataFrame, device: DataFrame, limit: int, items: str = "items") -> DataFrame:
    """GPUs for more work items than ``limit``, CPUs for others."""
    large, small = F.col(items) > limit, F.col(items) <= limit
    return by_type(task.filter(large), device, GPU).unionByName(by_type(task.filter(small), device, DEVICE_TYPES["cpu"]))


def arguments_on(args: DataFrame) -> DataFrame:
    """Arguments whose ``mask`` of device types has the ``type`` (a bit) of their task's device."""
    return args.filter(F.col("mask").bitwiseAND(F.col("type")) != 0)


def resolved_policy(task_policy: Column, graph_policy: Column) -> Column:
    """A graph's policy replaces only a task's default."""
    return F.when(task_policy == "default", graph_policy).otherwise(task_policy)


def adopt_from_consumer(pending: DataFrame, dep: DataFrame, placement: DataFrame) -> DataFrame:
    """Tasks left pending take the lowest device of the tasks that depend on them."""
    users = dep.select(F.col("task_id").alias("user"), F.col("dep_id").alias("task_id"))
    found = users.join(placement.select(F.col("task_id").alias("user"), "devno"), "user").groupBy("task_id").agg(F.min("devno").alias("devno"))
    return _or_default(pending, found)


def graph_features(task: DataFrame, dep: DataFrame, levelled: DataFrame, *keys: str) -> DataFrame:
    """Tasks, edges, height and widest level of each graph (``keys``): the largest sizes a
    graph's matrices need."""
    widths = levelled.groupBy(*keys, "level").agg(F.count("*").alias("width"))
    height = widths.groupBy(*keys).agg((F.max("level") + 1).cast("long").alias("height"), F.max("width").alias("widest"))
    edges = dep.groupBy(*keys).agg(F.count("*").alias("edges"))
    return task.groupBy(*keys).agg(F.count("*").alias("tasks")).join(edges, list(keys), "left").join(height, list(keys)).na.fill({"edges": 0})
