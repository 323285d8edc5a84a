"""Named kernels as column expressions, applied to the columns of an indexed buffer table.

A kernel maps input columns and scalars to the new value of its output column.  Kernels
of one task are chained projections, which Catalyst collapses into one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import divided, element

Kernel = Callable[..., Column]
KERNELS: dict[str, Kernel] = {}

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def kernel(name: str) -> Callable[[Kernel], Kernel]:
    def add(f: Kernel) -> Kernel:
        KERNELS[name] = f
        return f

    return add


def bind(name: str, **scalars) -> Kernel:
    """A kernel with some arguments set."""
    return partial(KERNELS[name], **scalars)


kernel("add")(lambda a, b: a + b)
kernel("sub")(lambda a, b: a - b)
kernel("mul")(lambda a, b: a * b)
kernel("div")(lambda a, b, kind="double": divided(a, b, element(kind)))
kernel("saxpy")(lambda x, y, scale: F.lit(scale) * x + y)
kernel("copy")(lambda a: a)
kernel("accumulate")(lambda out, a, b: out + a + b)
kernel("uppercase")(lambda a: F.translate(a, LOWER, UPPER))  # ASCII only, unlike upper()
kernel("increment")(lambda a, by=1: a + by)
kernel("scale")(lambda a, factor: a * factor)
kernel("loop_accumulate")(lambda out, i, loop: out + i * (loop * loop))  # loop * loop additions of i
kernel("loop_sum")(lambda start, x, loop: start + x * (loop * (loop - 1) // 2))  # adds k * x for k = 0 .. loop - 1
kernel("identity")(lambda a: a)
kernel("crc32")(lambda a: F.crc32(a))


def launch(df: DataFrame, name: str | Kernel, out: str, *inputs: str | Column, where: Column | None = None, **scalars) -> DataFrame:
    """Set column ``out`` to a kernel's value; with ``where``, only in the rows of an
    index range, the others keep their value."""
    f = KERNELS[name] if isinstance(name, str) else name
    value = f(*[F.col(c) if isinstance(c, str) else c for c in inputs], **scalars)
    return df.withColumn(out, value if where is None else F.when(where, value).otherwise(F.col(out)))


def select_kernel(size: Column, limit: int, small: Column, large: Column) -> Column:
    """A kernel chosen at run time by the number of work items."""
    return F.when(size > limit, large).otherwise(small)


def host_task(df: DataFrame, step: Callable) -> DataFrame:
    """Host code over batches of rows (pandas frames of the same columns)."""
    return df.mapInPandas(lambda batches: map(step, batches), df.schema)


def strided(i: Column, offset: int, extent: int, stride: int = 1) -> Column:
    """Every ``stride``-th index of [offset, offset + extent)."""
    return index_range(i, offset, extent) & ((i - offset) % stride == 0)


def index_range(i: Column, offset: int, size: int | None = None) -> Column:
    """Rows of [offset, offset + size)."""
    return i >= offset if size is None else (i >= offset) & (i < offset + size)
