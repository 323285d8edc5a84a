"""Helpers that several training-data operators share.

Everything here is either a small Arrow/numpy helper that runs inside Spark
tasks or a thin DataFrame helper; none of it holds state between queries.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step inside a task works on; bounds a worker's memory.
STEP_BYTES = 2 << 20

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Rows of an Arrow batch at most: texts are long, and both the JVM and the worker hold whole batches.
BATCH_ROWS = 1_000
#: Breaks words at every ASCII character that is no letter or digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where it is unset, a session on one machine (tests) gets a temporary folder; on a
    cluster that folder would be another one on each executor, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A lost executor then costs only the tasks it ran, since the files are shared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialized inside are deleted at its end, but for those handed to what it yields."""
    before, kept = {path for _, path in _WRITTEN}, set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._tessera_path)
        return df

    yield keep
    for spark, path in [x for x in _WRITTEN if x[1] not in before | kept]:
        _delete(spark, path)
        _WRITTEN.remove((spark, path))


@atexit.register
def _tidy() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def _give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose tasks give back what they have freed, with batches of ``BATCH_ROWS`` rows.

    Spark uses a Python worker again for the tasks of later stages; what it would hold
    on to adds up beside the executor's heap.  The session's setting of the rows of a
    batch is lowered, never raised.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(task, schema)


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of ``column`` (one row at least)."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one row, and the n+1 offsets of the texts (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, breaks: np.ndarray = _SPACE) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+`` of all texts in order,
    and the n+1 offsets of each text's words.  ``breaks``: the bytes that separate words, if not white space."""
    raw, offsets = text_bytes(texts)
    space = breaks[raw]
    starts = ~space
    after = np.empty(len(raw), bool)
    after[:1] = True
    after[1:] = space[:-1]
    cuts = offsets[:-1]
    after[cuts[cuts < len(raw)]] = True
    starts &= after
    at = np.flatnonzero(starts)
    kept = ~space
    data = _UPPER[raw[kept]]
    before = np.cumsum(kept)  # bytes kept up to and with each position
    bounds = np.append(before[at] - 1, len(data)).astype(np.int64) if len(at) else np.zeros(1, np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.searchsorted(at, offsets)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word as a number, and the distinct words by number."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hashed(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the distinct words."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
