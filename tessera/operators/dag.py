"""Task graphs as relations: accesses, dependencies, levels, readiness.

An access log has task_id, seq, mem_id, mode (r, w, rw).  Dependencies follow from it:
a read needs the last write before it; a write needs all reads since the last write, or
that write itself if nothing has read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from tessera.lineage import cut_lineage
from tessera.operators.ranges import carried, with_range


def _by_mem() -> WindowSpec:
    """Within a range of a buffer's accesses."""
    return W.partitionBy("mem_id", "range").orderBy("seq", "task_id")


def _writes() -> Column:
    return F.col("mode").isin("w", "rw")


def with_epochs(access: DataFrame) -> DataFrame:
    """Adds epoch (writes of the buffer so far) and last_writer (task of the latest one)."""
    own = F.when(_writes(), F.col("task_id"))
    added = {"writes": F.count(own), "writer": F.max_by("task_id", F.when(_writes(), F.struct("seq", "task_id")))}
    rows = carried(with_range(access, "seq"), ["mem_id"], added, {"writes_before": F.sum("writes"), "writer_before": F.last("writer", ignorenulls=True)})
    before = _by_mem().rowsBetween(W.unboundedPreceding, -1)
    epoch = F.coalesce("writes_before", F.lit(0)) + F.count(own).over(before)
    return rows.withColumns({"epoch": epoch, "last_writer": F.coalesce(F.last(own, ignorenulls=True).over(before), "writer_before")}).drop("range", "writes_before", "writer_before")


def auto_dependencies(access: DataFrame) -> DataFrame:
    """task_id, dep_id, kind (raw, war, waw), each pair once under the first kind that holds."""
    log = with_epochs(access)
    raw = log.filter(F.col("mode").isin("r", "rw") & F.col("last_writer").isNotNull()).select("task_id", F.col("last_writer").alias("dep_id"), F.lit(0).alias("k"))
    readers = log.filter("mode = 'r'").select("mem_id", "epoch", F.col("task_id").alias("dep_id"))
    writers = log.filter(_writes())
    war = writers.join(readers, ["mem_id", "epoch"]).select("task_id", "dep_id", F.lit(1).alias("k"))
    unread = writers.join(readers, ["mem_id", "epoch"], "left_anti").filter("last_writer is not null")
    waw = unread.select("task_id", F.col("last_writer").alias("dep_id"), F.lit(2).alias("k"))
    kind = F.when(F.col("k") == 0, "raw").when(F.col("k") == 1, "war").otherwise("waw")
    return raw.union(war).union(waw).filter("task_id <> dep_id").groupBy("task_id", "dep_id").agg(F.min("k").alias("k")).select("task_id", "dep_id", kind.alias("kind"))


def flush_tasks(access: DataFrame) -> DataFrame:
    """mem_id, task_id: the last writer of each written buffer, which a flush has to follow."""
    return access.filter(_writes()).groupBy("mem_id").agg(F.max_by("task_id", F.struct("seq", "task_id")).alias("task_id"))


def flush_out(cells: DataFrame, access: DataFrame, path: str) -> None:
    """Write the cells (with mem_id) of the buffers that a task wrote; buffers only read stay where they are."""
    cells.join(access.filter(_writes()).select("mem_id").distinct(), "mem_id", "left_semi").select(*cells.columns).write.parquet(path)


def shadow_versions(access: DataFrame) -> DataFrame:
    """The buffer version each access uses when every write gets a buffer of its own."""
    version = F.col("epoch") + F.when(_writes(), 1).otherwise(0)
    return with_epochs(access).select("task_id", "seq", "mem_id", "mode", F.when(F.col("mode") != "w", F.col("epoch")).alias("reads"), F.when(_writes(), version).alias("writes"))


def inputs_outputs(access: DataFrame, is_reset: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Input and output buffers of tasks.  The first use of a buffer in ``is_reset``
    (mem_id) is no input: it was initialised there."""
    log = access
    if is_reset is not None:
        first = access.groupBy("mem_id").agg(F.min(F.struct("seq", "task_id")).alias("first"))
        first = first.join(is_reset.select("mem_id").distinct(), "mem_id", "left_semi")
        log = access.join(first, "mem_id", "left").filter(F.col("first").isNull() | (F.struct("seq", "task_id") != F.col("first")) | (F.col("mode") == "w"))
    ins = log.filter(F.col("mode").isin("r", "rw")).select("task_id", "mem_id").distinct()
    outs = access.filter(_writes()).select("task_id", "mem_id").distinct()
    return ins, outs


def degrees(dep: DataFrame) -> DataFrame:
    """task_id, parents, children of every task of an edge."""
    end = lambda c, p: F.struct(F.col(c).alias("task_id"), F.lit(p).alias("p"), F.lit(1 - p).alias("c"))
    ends = dep.select(F.inline(F.array(end("task_id", 1), end("dep_id", 0))))  # each edge is made once
    return ends.groupBy("task_id").agg(F.sum("p").alias("parents"), F.sum("c").alias("children"))


def adjacency(task: DataFrame, dep: DataFrame) -> DataFrame:
    """row, col of a dependency matrix: task + 1, dependency + 1, and column 0 for roots."""
    edges = dep.select((F.col("task_id") + 1).alias("row"), (F.col("dep_id") + 1).alias("col")).distinct()
    roots = task.join(dep, "task_id", "left_anti").select((F.col("task_id") + 1).alias("row"), F.lit(0).cast("long").alias("col"))
    return edges.unionByName(roots)


def levels(task: DataFrame, dep: DataFrame) -> DataFrame:
    """task_id, level: length of the longest path to a task.

    Chains - a task with one dependency, which nothing else depends on - are first
    contracted to their heads by pointer doubling, in as many rounds as the longest has
    binary digits.  Then heads whose dependencies are all placed are placed, a round for
    each step of the longest path of chains.  A cycle raises.
    """
    edges = cut_lineage(dep.join(task.select(F.col("task_id").alias("dep_id")), "dep_id", "left_semi").select("task_id", "dep_id").distinct())
    only = lambda by: edges.groupBy(by).count().filter("count = 1").select(by)
    links = edges.join(only("task_id"), "task_id", "left_semi").join(only("dep_id"), "dep_id", "left_semi")
    at = task.select("task_id").distinct().join(links, "task_id", "left").select("task_id", F.coalesce("dep_id", "task_id").alias("head"), F.when(F.col("dep_id").isNull(), 0).otherwise(1).cast("long").alias("far"))
    at = cut_lineage(at)
    todo, n = at.filter("far > 0").count(), at.count()
    while todo:
        up = at.select(F.col("task_id").alias("head"), F.col("head").alias("top"), F.col("far").alias("more"))
        at = cut_lineage(at.join(up, "head").select("task_id", F.col("top").alias("head"), (F.col("far") + F.col("more")).alias("far")), at)
        far = at.agg(F.max("far")).first()[0]
        if far >= n:
            raise ValueError("the dependencies have a cycle")
        # a pointer that still moves leads to a task that is no head
        todo = at.filter("task_id <> head").select(F.col("head").alias("task_id")).distinct().join(at.filter("far > 0").select("task_id"), "task_id", "left_semi").limit(1).count()
    of = at.select(F.col("task_id").alias("dep_id"), F.col("head").alias("up"), (F.col("far") + 1).alias("weight"))
    heads = at.filter("far = 0").select("task_id")
    steps = edges.join(heads, "task_id", "left_semi").join(of, "dep_id").groupBy("task_id", "up").agg(F.max("weight").alias("weight"))
    steps, heads, placed = cut_lineage(steps), cut_lineage(heads.withColumn("level", F.lit(0).cast("long"))), None
    while True:
        ready = cut_lineage(heads.join(steps, "task_id", "left_anti"))
        if ready.limit(1).count() == 0:
            if heads.limit(1).count():
                raise ValueError("the dependencies have a cycle")
            break
        placed = ready if placed is None else placed.unionByName(ready)
        reached = steps.join(ready.select(F.col("task_id").alias("up"), "level"), "up")
        reached = reached.groupBy("task_id").agg(F.max(F.col("level") + F.col("weight")).alias("reached"))
        waiting = heads.join(ready.select("task_id"), "task_id", "left_anti").join(reached, "task_id", "left")
        heads, then = cut_lineage(waiting.select("task_id", F.greatest("level", F.coalesce("reached", "level")).alias("level")), heads), steps.join(ready.select(F.col("task_id").alias("up")), "up", "left_anti")
        steps = cut_lineage(then, steps)
    if placed is None:
        return at.select("task_id", F.lit(0).alias("level"))
    return at.join(placed.withColumnRenamed("task_id", "head"), "head").select("task_id", (F.col("level") + F.col("far")).cast("int").alias("level"))


def parallelism(levelled: DataFrame) -> DataFrame:
    """One row: height, the widest level and the mean width."""
    widths = levelled.groupBy("level").count()
    return widths.agg(F.count("*").alias("height"), F.max("count").alias("widest"), (F.sum("count") / F.count("*")).alias("mean_width"))


def dispatchable(task: DataFrame, dep: DataFrame) -> DataFrame:
    """Waiting tasks whose dependencies are complete; a dependency that isn't there counts as done.

    ``task``: task_id, status (none, ready, running, complete).  An asynchronous
    dependency (column is_async) is enough when submitted (status running).
    """
    status = task.select(F.col("task_id").alias("dep_id"), F.col("status").alias("dep_status"), F.col("is_async"))
    open_ = dep.join(status, "dep_id").filter((F.col("dep_status") != "complete") & ~(F.col("is_async") & (F.col("dep_status") == "running")))
    return task.filter("status = 'none'").join(open_.select("task_id"), "task_id", "left_anti").select("task_id")


def difference(manual: DataFrame, inferred: DataFrame) -> DataFrame:
    """task_id, dep_id, side: pairs that only one of the two has (extra: manual, missing: inferred)."""
    m, i = manual.select("task_id", "dep_id").distinct(), inferred.select("task_id", "dep_id").distinct()
    return m.join(i, ["task_id", "dep_id"], "left_anti").withColumn("side", F.lit("extra")).unionByName(i.join(m, ["task_id", "dep_id"], "left_anti").withColumn("side", F.lit("missing")))


def both_ways(dep: DataFrame) -> DataFrame:
    way = lambda a, b: F.struct(F.col(a).alias("task_id"), F.col(b).alias("dep_id"))
    return dep.select(F.inline(F.array(way("task_id", "dep_id"), way("dep_id", "task_id")))).distinct()


def pruned(dep: DataFrame, allowed: DataFrame) -> DataFrame:
    return dep.join(allowed.select("task_id", "dep_id"), ["task_id", "dep_id"], "left_semi")


def without_redundant_ends(dep: DataFrame, end: int) -> DataFrame:
    """Edges of the end task only to tasks that no other task follows."""
    followed = dep.filter(F.col("task_id") != end).select("dep_id").distinct()
    return dep.join(followed, "dep_id", "left_anti").filter(F.col("task_id") == end).unionByName(dep.filter(F.col("task_id") != end).select("dep_id", "task_id")).select("task_id", "dep_id")


def split_tasks(task: DataFrame, n_devices: int) -> DataFrame:
    """Chunks of each task's work items: one for each device, and one for the remainder.

    ``task``: task_id, items.  With fewer items than devices each item is a chunk.
    """
    size = F.greatest(F.floor(F.col("items") / n_devices), F.lit(1)).cast("long")
    at = task.filter("items > 0").select("task_id", "items", size.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("items") - 1, size)).alias("off"))
    return at.select("task_id", "off", F.least("chunk", F.col("items") - F.col("off")).alias("size"))


def command_counts(command: DataFrame) -> DataFrame:
    """total, kernels and copies of each task."""
    return command.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if(F.col("opcode") == "kernel").alias("kernels"), F.count_if(F.col("opcode").isin("h2d", "d2h", "d2d")).alias("copies"))


def resolve_dependencies_by_name(task: DataFrame, wanted: DataFrame) -> DataFrame:
    """task_id, dep_id from names: every earlier task of that name; later ones are ignored.

    ``task``: task_id, seq, name.  ``wanted``: task_id, depends (a name, or null).
    """
    named = task.select(F.col("task_id").alias("dep_id"), F.col("seq").alias("dep_seq"), F.col("name").alias("depends"))
    return wanted.filter("depends is not null").join(task.select("task_id", "seq"), "task_id").join(named, "depends").filter("dep_seq < seq").select("task_id", "dep_id")
