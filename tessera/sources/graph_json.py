"""Task graphs as JSON documents: load into relations, record from them, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.types import byte_width

#: All scalars as text: documents write them as numbers or as strings.
COPY = "struct<name: string, device_memory: string, host_memory: string, offset: array<string>, size: array<string>, `data-memory-flush`: string>"
PARAMETER = "struct<name: string, type: string, value: string, permissions: string, permission: string, data_type: string, data_size: string, size_bytes: string>"
COMMAND = f"struct<kernel: struct<name: string, global_size: array<string>, local_size: array<string>, offset: array<string>, parameters: array<{PARAMETER}>>, h2d: {COPY}, d2h: {COPY}>"
TASK = f"struct<name: string, target: string, policy: string, device: array<string>, depends: array<string>, commands: array<{COMMAND}>>"
SCHEMA = f"struct<root: struct<inputs: array<string>, graph: struct<tasks: array<{TASK}>>>>"


def _lists(text: Column) -> Column:
    """A lone number or string where a list may stand becomes a list of one."""
    keys = "offset|size|global_size|local_size"
    return F.regexp_replace(text, rf'"({keys})"\s*:\s*("[^"]*"|[-0-9.eE+]+)', '"$1": [$2]')


def parse(docs: DataFrame, text: str = "json") -> DataFrame:
    """doc (kept columns) and tasks; null tasks mark a malformed document."""
    rooted = F.regexp_replace(_lists(F.col(text)), r'^\s*\{\s*"[^"]*"\s*:', '{"root":')  # whatever the one outer key is called
    parsed = F.from_json(rooted, SCHEMA)["root"]
    return docs.select(*[c for c in docs.columns if c != text], parsed["inputs"].alias("inputs"), parsed["graph"]["tasks"].alias("tasks"))


def tasks(parsed: DataFrame, *keys: str) -> DataFrame:
    out = parsed.select(*keys, F.posexplode("tasks").alias("seq", "task"))
    return out.select(*keys, "seq", "task.name", F.coalesce("task.target", F.lit("default")).alias("target"), "task.policy", F.filter(F.coalesce("task.depends", F.array().cast("array<string>")), lambda d: d.isNotNull()).alias("depends"))


def commands(parsed: DataFrame, *keys: str) -> DataFrame:
    """task seq, pos, opcode, name, memory, off, size (first dimension only)."""
    rows = parsed.select(*keys, F.posexplode("tasks").alias("seq", "task")).select(*keys, "seq", F.posexplode("task.commands").alias("pos", "c"))
    opcode = F.when(F.col("c.kernel").isNotNull(), "kernel").when(F.col("c.h2d.data-memory-flush").isNotNull() | F.col("c.d2h.data-memory-flush").isNotNull(), "flush").when(F.col("c.h2d").isNotNull(), "h2d").when(F.col("c.d2h").isNotNull(), "d2h")
    copy = lambda f: F.coalesce(F.col(f"c.h2d.{f}"), F.col(f"c.d2h.{f}"))
    return rows.select(*keys, "seq", "pos", opcode.alias("opcode"), F.coalesce("c.kernel.name", copy("name")).alias("name"), copy("device_memory").alias("memory"), F.get(F.coalesce(copy("offset"), F.col("c.kernel.offset")), 0).try_cast("bigint").alias("off"), F.get(F.coalesce(copy("size"), F.col("c.kernel.global_size")), 0).try_cast("bigint").alias("size"))


def parameters(parsed: DataFrame, *keys: str, bindings: DataFrame | None = None) -> DataFrame:
    """Kernel arguments: seq, pos, idx, type, value, mode and the scalar's bytes.

    With ``bindings`` (name, bound), a value that names an input is replaced by it.
    """
    rows = parsed.select(*keys, F.posexplode("tasks").alias("seq", "task")).select(*keys, "seq", F.posexplode("task.commands").alias("pos", "c")).filter("c.kernel is not null")
    out = rows.select(*keys, "seq", "pos", F.posexplode("c.kernel.parameters").alias("idx", "p")).select(*keys, "seq", "pos", "idx", "p.type", "p.value", F.coalesce("p.permissions", "p.permission").alias("mode"), F.coalesce(F.col("p.data_size").try_cast("int"), byte_width(F.col("p.data_type"))).alias("bytes"))
    if bindings is None:
        return out
    return out.join(bindings, out["value"] == bindings["name"], "left").withColumn("value", F.coalesce("bound", "value")).drop("name", "bound")


def problems(parsed: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and problem, a row for each fault of a document."""
    one = lambda cond, text: F.when(cond, F.lit(text))
    whole = parsed.select(*keys, one(F.col("tasks").isNull(), "no task list").alias("problem"))
    named = tasks(parsed, *keys).select(*keys, one(F.col("name").isNull(), "task without a name").alias("problem"))
    coded = commands(parsed, *keys).select(*keys, one(F.col("opcode").isNull(), "command of an unknown kind").alias("problem"))
    args = parameters(parsed, *keys).select(*keys, one(~F.coalesce(F.col("type").isin("scalar", "memory_object"), F.lit(False)), "parameter of an unknown type").alias("problem"))
    modes = parameters(parsed, *keys).select(*keys, one((F.col("type") == "memory_object") & ~F.coalesce(F.col("mode").isin("r", "w", "rw"), F.lit(False)), "memory without permissions").alias("problem"))
    return whole.unionByName(named).unionByName(coded).unionByName(args).unionByName(modes).filter("problem is not null")


def record(task: DataFrame, key: str, root: str = "task-graph") -> DataFrame:
    """``key`` and json: a document of each key's tasks (seq, name, target, depends, commands).

    Tasks without commands are only marks and are left out.
    """
    kept = task.filter(F.size("commands") > 0)
    body = F.transform(F.array_sort(F.collect_list(F.struct("seq", "name", "target", "depends", "commands"))), lambda t: t.dropFields("seq"))
    return kept.groupBy(key).agg(body.alias("tasks")).select(key, F.to_json(F.struct(F.struct(F.array().cast("array<string>").alias("inputs"), F.struct("tasks").alias("graph")).alias(root))).alias("json"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("json"))
