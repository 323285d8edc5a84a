"""Text forms of graphs and traces: one row of text for each line, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours of device types in graph drawings: CPU, two kinds of GPU, FPGA.
COLOURS = {1: "gold", 2: "steelblue", 4: "salmon", 8: "orchid"}
#: Labels of the kinds of events in a chart.
EVENTS = {"kernel": "compute", "h2d": "copy in", "d2h": "copy out", "d2d": "copy across", "d2o": "copy to cpu", "o2d": "copy from cpu", "init": "set up"}


def dot_lines(task: DataFrame, dep: DataFrame, device: DataFrame | None = None) -> DataFrame:
    """part, id, line of a DOT graph: nodes coloured by device type, edges, start and end edges.

    ``task``: task_id, name, and devno with ``device``.  Sort by part and id to write it.
    """
    colour = F.lit("lightgrey")
    if device is not None:
        task = task.join(F.broadcast(device.select("devno", "type")), "devno", "left")
        for t, name in COLOURS.items():
            colour = F.when(F.col("type") == t, name).otherwise(colour)
    nodes = task.select(F.lit(1).alias("part"), F.col("task_id").alias("id"), F.format_string('n%d [shape=box, color=%s, tooltip="task %d", label="%s"]', "task_id", colour, "task_id", "name").alias("line"))
    edges = dep.select(F.lit(2).alias("part"), F.col("task_id").alias("id"), F.format_string("n%d -> n%d", "dep_id", "task_id").alias("line"))
    roots = task.join(dep, "task_id", "left_anti").select(F.lit(3).alias("part"), F.col("task_id").alias("id"), F.format_string("source -> n%d", "task_id").alias("line"))
    leaves = task.join(dep.select(F.col("dep_id").alias("task_id")), "task_id", "left_anti").select(F.lit(4).alias("part"), F.col("task_id").alias("id"), F.format_string("n%d -> sink", "task_id").alias("line"))
    frame = task.sparkSession.createDataFrame([(0, 0, "strict digraph {"), (5, 0, "}")], "part int, id long, line string")
    return frame.unionByName(nodes).unionByName(edges).unionByName(roots).unionByName(leaves)


def timeline_lines(trace: DataFrame) -> DataFrame:
    """A JSON object for each task: lane (device), label, policy, and its ends in whole microseconds."""
    at = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return trace.select("task_id", F.to_json(F.struct(F.col("device").alias("lane"), F.col("name").alias("label"), "policy", at("start").alias("from_us"), at("end").alias("to_us"))).alias("line"))


def event_kind(kind: Column) -> Column:
    """Label of an event in a chart."""
    out = F.lit("other")
    for k, v in EVENTS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def event_lines(events: DataFrame) -> DataFrame:
    """A JSON object for each event (task_id, kind, devno, start, end): its kind's label and its ends."""
    return events.select("task_id", F.to_json(F.struct(F.concat(F.lit("dev"), F.col("devno")).alias("lane"), event_kind(F.col("kind")).alias("label"), F.col("start").alias("from"), F.col("end").alias("to"))).alias("line"))


def recoloured(task: DataFrame, trace: DataFrame, device: DataFrame) -> DataFrame:
    """Tasks with the device they first ran on and its colour."""
    ran = trace.groupBy("task_id").agg(F.min_by("devno", "start").alias("devno"))
    colour = F.lit("lightgrey")
    for t, name in COLOURS.items():
        colour = F.when(F.col("type") == t, name).otherwise(colour)
    return task.join(ran, "task_id", "left").join(F.broadcast(device), "devno", "left").select("task_id", "devno", colour.alias("colour"))
