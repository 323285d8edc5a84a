"""A small front end: buffers as columns of one indexed table, tasks as kernel launches on them.

    g = Graph(buffers).task("scale", "scale", "b", "a", factor=2).task("sum", "add", "c", "a", "b")
    g.run()            # the table after all tasks: one chain of projections
    g.dependencies()   # which task waits for which, inferred from what they read and write
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.kernels import Kernel, launch
from tessera.operators import dag


@dataclass(frozen=True)
class Task:
    name: str
    kernel: str | Kernel
    out: str
    inputs: tuple[str, ...]
    where: Column | None
    scalars: dict


@dataclass
class Graph:
    buffers: DataFrame
    tasks: list[Task] = field(default_factory=list)

    def task(self, name: str, kernel: str | Kernel, out: str, *inputs: str, where: Column | None = None, **scalars) -> "Graph":
        """Add a task; with ``where`` it changes only those rows of ``out``, and so reads it too."""
        self.tasks.append(Task(name, kernel, out, inputs, where, scalars))
        return self

    def run(self) -> DataFrame:
        df = self.buffers
        for t in self.tasks:
            df = launch(df, t.kernel, t.out, *t.inputs, where=t.where, **t.scalars)
        return df

    def accesses(self) -> DataFrame:
        """task_id, seq, mem_id, mode: tasks and buffers are numbered in the order of their first use."""
        numbers: dict[str, int] = {}
        rows = []
        for k, t in enumerate(self.tasks):
            read = dict.fromkeys([*t.inputs, *[t.out] * (t.where is not None)])
            for b in dict.fromkeys([*read, t.out]):
                mode = ("r" if b in read else "") + ("w" if b == t.out else "")
                rows.append((k, k, numbers.setdefault(b, len(numbers)), mode))
        return self.buffers.sparkSession.createDataFrame(rows, "task_id long, seq long, mem_id long, mode string")

    def dependencies(self) -> DataFrame:
        """task, needs, kind: the names of tasks and of the tasks they wait for."""
        names = F.array(*[F.lit(t.name) for t in self.tasks])
        name = lambda c: F.get(names, F.col(c).cast("int"))
        return dag.auto_dependencies(self.accesses()).select(name("task_id").alias("task"), name("dep_id").alias("needs"), "kind")
