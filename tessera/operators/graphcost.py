"""Communication and computation costs of a task graph as sparse matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOST = 0  # task number of the host in a communication matrix; tasks are shifted by one


def communication_list(dep: DataFrame, outputs: DataFrame, inputs: DataFrame, mem: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, mem_id, size: what each task gets along its dependencies, and from
    the host what no dependency makes (0 = host, tasks are numbered from 1).

    ``mem``: mem_id, size.  ``regions``: mem_id, parent_id - a region of a parent that a
    dependency makes feeds a task that reads the parent.
    """
    direct = dep.join(outputs.select(F.col("task_id").alias("dep_id"), "mem_id"), "dep_id").join(inputs, ["task_id", "mem_id"]).select("task_id", "dep_id", "mem_id", F.col("mem_id").alias("covers"))
    if regions is not None:
        made = outputs.join(regions, "mem_id").select(F.col("task_id").alias("dep_id"), "mem_id", F.col("parent_id").alias("covers"))
        parts = dep.join(made, "dep_id").join(inputs.select("task_id", F.col("mem_id").alias("covers")), ["task_id", "covers"])
        direct = direct.unionByName(parts.select("task_id", "dep_id", "mem_id", "covers"))
    host = inputs.join(direct.select("task_id", F.col("covers").alias("mem_id")), ["task_id", "mem_id"], "left_anti")
    rows = direct.select((F.col("dep_id") + 1).alias("from_id"), (F.col("task_id") + 1).alias("to_id"), "mem_id").distinct()
    rows = rows.unionByName(host.select(F.lit(HOST).cast("long").alias("from_id"), (F.col("task_id") + 1).alias("to_id"), "mem_id").distinct())
    return rows.join(mem.select("mem_id", "size"), "mem_id").select("from_id", "to_id", "mem_id", "size")


def communication_matrix(comm: DataFrame) -> DataFrame:
    return comm.groupBy("from_id", "to_id").agg(F.sum("size").alias("bytes"))


def computation_costs(task: DataFrame, history: DataFrame, *keys: str) -> DataFrame:
    """Mean time of each task on each device or model, by what tells kernels apart (``keys``)."""
    mean = history.groupBy(*keys, "devno").agg(F.avg("duration").alias("cost"))
    return task.join(mean, list(keys)).select("task_id", "devno", "cost")


def transfer_costs(history: DataFrame) -> DataFrame:
    return history.groupBy("src", "dst", "size").agg(F.avg("duration").alias("cost"))


def object_costs(mem: DataFrame, costs: DataFrame) -> DataFrame:
    """Time of every buffer between every two places: the mean for its size."""
    return mem.join(costs, "size").select("mem_id", "src", "dst", "cost")


def schedule(trace: DataFrame) -> DataFrame:
    """When and where each task ran, in order."""
    return trace.select("task_id", "devno", "start", "end").orderBy("start", "task_id")


def membership_matrix(access: DataFrame) -> DataFrame:
    """task_id, mem_id, flag (1): the cells of the matrix of tasks and buffers that aren't 0."""
    return access.select("task_id", "mem_id").distinct().withColumn("flag", F.lit(1))
