"""Array kernels, generated buffers and matrices over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.kernels import launch
from tessera.functions.types import byte_width, divided, element, wrapped, wrapped_product
from tessera.graph import Graph
from tessera.lineage import shared_dir
from tessera.operators import generate, linalg
from tessera.plans.registry import query, read

KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate::VARCHAR AS ship"


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


def _keys(df, *cols):
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *cols)


LK = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("saxpy", f"SELECT {LK}, round(2.5 * l_quantity + l_extendedprice, 4) AS z FROM lineitem")
def saxpy(spark, sf_dir):
    return _keys(launch(_lines(spark, sf_dir), "saxpy", "z", "l_quantity", "l_extendedprice", scale=2.5), F.round("z", 4).alias("z"))


@query("vec_arithmetic", f"SELECT {LK}, l_quantity + l_tax AS s, l_quantity - l_tax AS d, l_quantity * l_tax AS p, l_extendedprice / l_quantity AS q FROM lineitem")
def vec_arithmetic(spark, sf_dir):
    df = _lines(spark, sf_dir)
    for out, name, other in (("s", "add", "l_tax"), ("d", "sub", "l_tax"), ("p", "mul", "l_tax")):
        df = launch(df, name, out, "l_quantity", other)
    return _keys(launch(df, "div", "q", "l_extendedprice", "l_quantity"), "s", "d", "p", "q")


@query("integer_division", f"SELECT {LK}, CAST(trunc((l_orderkey - 700)::DOUBLE / nullif(l_linenumber - 3, 0)) AS BIGINT) AS q FROM lineitem")
def integer_division(spark, sf_dir):
    a, b = F.col("l_orderkey") - 700, F.col("l_linenumber") - 3
    return _keys(_lines(spark, sf_dir), divided(a, b, element("int64")).alias("q"))


@query("wrapping_product", f"SELECT {LK}, CAST(((l_orderkey * l_partkey * 1000003 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS w FROM lineitem")
def wrapping_product(spark, sf_dir):
    return _keys(_lines(spark, sf_dir), wrapped_product(element("int32"), F.col("l_orderkey"), F.col("l_partkey"), F.lit(1000003)).alias("w"))


@query("dataflow_abc", "SELECT o_orderkey AS i, o_orderkey * 20 AS bc FROM orders")
def dataflow_abc(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i")).withColumn("ab", F.col("i"))
    df = launch(df, "scale", "bc", "ab", factor=10)
    return launch(df, "scale", "bc", "bc", factor=2).select("i", "bc")


@query("add_chain", "SELECT o_orderkey AS i, (o_custkey + 1 + 2) * 100 + o_orderkey AS v FROM orders")
def add_chain(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("v"))
    for name, args in (("increment", {"by": 1}), ("increment", {"by": 2}), ("scale", {"factor": 100})):
        df = launch(df, name, "v", "v", **args)
    return launch(df, "add", "v", "v", "i")


@query("loop_accumulate", "SELECT o_orderkey AS i, o_custkey + o_orderkey * 10000 AS v FROM orders")
def loop_accumulate(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("v"))
    return launch(df, "loop_accumulate", "v", "v", "i", loop=100)


@query("offset_update", "SELECT o_orderkey AS i, CASE WHEN o_orderkey >= 800 AND o_orderkey < 1200 THEN o_orderkey + o_custkey ELSE 0 END AS c FROM orders")
def offset_update(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), "o_custkey", F.lit(0).cast("long").alias("c"))
    return launch(df, "add", "c", "i", "o_custkey", where=kernels.index_range(F.col("i"), 800, 400)).select("i", "c")


@query("offset_block_2d", "SELECT vec_id AS i, j, CASE WHEN vec_id >= 100 AND j >= 32 THEN vec_id + j ELSE 0 END AS c FROM (SELECT vec_id, unnest(range(0, 64)) AS j FROM embeddings)")
def offset_block_2d(spark, sf_dir):
    m = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("j")).withColumn("c", F.lit(0).cast("long"))
    return launch(m, "add", "c", "i", "j", where=(F.col("i") >= 100) & (F.col("j") >= 32))


@query("ascii_upper", "SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text FROM documents")
def ascii_upper(spark, sf_dir):
    return launch(read(spark, sf_dir, "documents"), "uppercase", "text", "text").select("doc_id", "text")


@query("kernel_selector", "SELECT o_orderkey AS i, CASE WHEN o_custkey > 500 THEN o_orderkey + 2 ELSE o_orderkey + 1 END AS v FROM orders")
def kernel_selector(spark, sf_dir):
    i = F.col("o_orderkey")
    small, large = kernels.bind("increment", by=1)(i), kernels.bind("increment", by=2)(i)
    return read(spark, sf_dir, "orders").select(i.alias("i"), kernels.select_kernel(F.col("o_custkey"), 500, small, large).alias("v"))


@query("vecadd_join", "SELECT o_orderkey AS i, o_custkey + c_custkey * 2 AS v FROM orders JOIN customer ON o_orderkey = c_custkey")
def vecadd_join(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("a"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), (F.col("c_custkey") * 2).alias("b"))
    return a.join(b, "i").select("i", (F.col("a") + F.col("b")).alias("v"))


@query("sum_reduction", "SELECT l_returnflag AS k, sum(l_quantity) + 100 AS total, max(l_quantity) AS high, min(l_quantity) AS low FROM lineitem GROUP BY 1")
def sum_reduction(spark, sf_dir):
    """Added to the value that the host already holds (100)."""
    return _lines(spark, sf_dir).groupBy(F.col("l_returnflag").alias("k")).agg((F.sum("l_quantity") + 100).alias("total"), F.max("l_quantity").alias("high"), F.min("l_quantity").alias("low"))


@query("error_count", "SELECT count(*) FILTER (o_orderkey * 20 <> o_orderkey * 10 + o_custkey) AS errors FROM orders")
def error_count(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderkey") * 20 != F.col("o_orderkey") * 10 + F.col("o_custkey")).alias("errors"))


@query("fill_buffers", "SELECT i, 7::DOUBLE AS filled, 16843009 AS set, 3 + i * 5 AS seq FROM range(1000) t(i)")
def fill_buffers(spark, sf_dir):
    return generate.buffers(spark, 1000, filled=generate.filled(7.0), set=generate.set_bytes(1), seq=generate.stepped(3, 5))


@query("geometric_seq", "SELECT i, round(3 * pow(1.5, i), 3) AS v FROM range(40) t(i)")
def geometric_seq(spark, sf_dir):
    return generate.geometric(spark, 40, 3, 1.5).withColumn("v", F.round("v", 3))


@query("geometric_wrapping", "WITH RECURSIVE s(i, v) AS (SELECT 0::BIGINT, 3::BIGINT UNION ALL SELECT i + 1, v * 7 % 4294967296 FROM s WHERE i < 99) SELECT i, CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS INTEGER) AS v FROM s")
def geometric_wrapping(spark, sf_dir):
    return generate.geometric_wrapping(spark, 100, 3, 7)


@query("quasi_uniform", "SELECT i, list_sum(list_transform(range(0, 32), lambda k: ((i >> k) & 1) * pow(2.0, -(k + 1)))) AS v FROM range(500) t(i)")
def quasi_uniform(spark, sf_dir):
    return generate.quasi_uniform(spark, 500)


@query("random_buffers")
def random_buffers(spark, sf_dir):
    u, n, k = generate.uniform_value(-1.0, 1.0, 5), generate.normal_value(10.0, 2.0, 6), generate.small_integer(8)
    return generate.buffers(spark, 2000, u=u, n=n, l=F.exp(generate.normal_value(0.0, 0.5, 7)), k=k, q=generate.quasi_normal_value())


@query("weighted_names", "SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 10 < 5 THEN 'mul' WHEN o_orderkey % 10 < 8 THEN 'add' ELSE 'copy' END AS kernel FROM orders")
def weighted_names(spark, sf_dir):
    """A kernel for each task by cumulative weights of a dice (here the last digit of its key)."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), generate.weighted_choice((F.col("o_orderkey") % 10) / 10, ["mul", "add", "copy"], [5.0, 3.0, 2.0]).alias("kernel"))


@query("quasi_log_normal", "SELECT 1999::BIGINT AS n, 0 AS off")
def quasi_log_normal(spark, sf_dir):
    """How many of the points are off the order in which their index has them: the quantile
    function rises with its argument, so neighbours in one order are neighbours in the other."""
    points = generate.buffers(spark, 1999, u=generate.radical_inverse(F.col("i") + 1), v=F.exp(generate.quasi_normal_value(1.0, 0.5)))
    at = W.orderBy("u")  # two thousand rows
    return points.withColumn("up", F.col("v") > F.lag("v").over(at)).agg(F.count("*").alias("n"), F.count_if(~F.col("up")).cast("int").alias("off"))


def _rows(spark, sf_dir):
    """Thousandths as whole numbers: sums don't depend on their order."""
    whole = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000).cast("long"))
    return read(spark, sf_dir, "embeddings").select("vec_id", whole.alias("embedding"))


def _matrix(spark, sf_dir):
    m = linalg.rows_to_matrix(_rows(spark, sf_dir), "vec_id", "embedding")
    return m.select("i", F.col("j").cast("long").alias("j"), "v")


M_SQL = "m AS (SELECT vec_id AS i, unnest(range(0, 64)) AS j, CAST(round(unnest(embedding)::DOUBLE * 1000) AS BIGINT) AS v FROM embeddings), g AS (SELECT a.j AS i, b.j, sum(a.v * b.v)::BIGINT AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2)"


@query("gemm", f"WITH {M_SQL} SELECT m.i, g.j, sum(m.v * g.v)::BIGINT AS v FROM m JOIN g ON m.j = g.i GROUP BY 1, 2")
def gemm(spark, sf_dir):
    """All rows (n x 64) times the 64 x 64 product of the transposed matrix with itself."""
    return linalg.gemm(_matrix(spark, sf_dir), linalg.gram(_rows(spark, sf_dir), "embedding"))


@query("gram_matrix", "WITH m AS (SELECT vec_id AS i, unnest(range(0, 64)) AS j, CAST(round(unnest(embedding)::DOUBLE * 1000) AS BIGINT) AS v FROM embeddings) SELECT a.j AS i, b.j, sum(a.v * b.v)::BIGINT AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2")
def gram_matrix(spark, sf_dir):
    """Transposed times itself, over all rows: row by row outer products, summed."""
    return linalg.gram(_rows(spark, sf_dir), "embedding")


@query("blocked_gemm", f"WITH {M_SQL} SELECT m.i, g.j, sum(m.v * g.v)::DOUBLE AS v FROM m JOIN g ON m.j = g.i GROUP BY 1, 2")
def blocked_gemm(spark, sf_dir):
    """The product of ``gemm``, by tiles."""
    double = lambda m: m.withColumn("v", F.col("v").cast("double"))
    return linalg.blocked_gemm(double(_matrix(spark, sf_dir)), double(linalg.gram(_rows(spark, sf_dir), "embedding")), 16)


@query("blocked_gram_matrix", "WITH m AS (SELECT vec_id AS i, unnest(range(0, 64)) AS j, CAST(round(unnest(embedding)::DOUBLE * 1000) AS BIGINT) AS v FROM embeddings) SELECT a.j AS i, b.j, sum(a.v * b.v)::DOUBLE AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2")
def blocked_gram_matrix(spark, sf_dir):
    """Transposed times itself, over all rows, by tiles."""
    m = _matrix(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    return linalg.blocked_gemm(linalg.transpose(m), m, 16)


@query("transpose", "SELECT unnest(range(0, 64)) AS i, vec_id AS j, unnest(embedding)::DOUBLE AS v FROM embeddings")
def transpose(spark, sf_dir):
    m = linalg.rows_to_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return linalg.transpose(m.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")))


@query("tile_sums", "SELECT i // 16 AS ti, j // 16 AS tj, sum(v)::BIGINT AS total, count(*) AS n FROM (SELECT vec_id AS i, unnest(range(0, 64)) AS j, CAST(round(unnest(embedding)::DOUBLE * 1000) AS BIGINT) AS v FROM embeddings) GROUP BY 1, 2")
def tile_sums(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    (ti, _), (tj, _) = linalg.flat_to_tiled(F.col("i"), 16), linalg.flat_to_tiled(F.col("j"), 16)
    return m.groupBy(ti.alias("ti"), tj.alias("tj")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@query("block_cyclic", "SELECT i, j, [[0, 1], [2, 3]][i % 2 + 1][j % 2 + 1] AS four, [[0, 1, 2], [3, 4, 5]][i % 2 + 1][j % 3 + 1] AS six, [0, 1, 2, 3, 4][j % 5 + 1] AS five FROM range(12) a(i), range(12) b(j)")
def block_cyclic(spark, sf_dir):
    cells = spark.range(144).select(F.expr("id div 12").alias("i"), (F.col("id") % 12).alias("j"))
    return cells.select("i", "j", *[linalg.block_cyclic(F.col("i"), F.col("j"), n).alias(c) for n, c in ((4, "four"), (6, "six"), (5, "five"))])


@query("matrix_mismatches", "SELECT count(*) AS errors FROM (SELECT vec_id, unnest(range(0, 64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) WHERE abs(v - round(v, 3)) > 0.0004")
def matrix_mismatches(spark, sf_dir):
    m = linalg.rows_to_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("v", F.col("v").cast("double"))
    return linalg.mismatches(m, m.withColumn("v", F.round("v", 3)), 0.0004)


@query("tile_round_trip", "SELECT vec_id AS i, unnest(range(0, 64)) AS j, CAST(round(unnest(embedding)::DOUBLE * 1000) AS BIGINT) AS v FROM embeddings")
def tile_round_trip(spark, sf_dir):
    """Written tile by tile and read back."""
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    linalg.write_tiles(_matrix(spark, sf_dir), 16, path)
    return linalg.read_tiles(spark, path, 16)


@query("tile_orders", "WITH t AS (SELECT DISTINCT vec_id // 16 AS ti, j // 16 AS tj FROM embeddings, range(64) r(j)) SELECT ti, tj, row_number() OVER (ORDER BY ti, tj) AS by_row, row_number() OVER (ORDER BY tj, ti) AS by_column, row_number() OVER (ORDER BY CASE WHEN ti > tj THEN ti ELSE tj END, CASE WHEN ti >= tj THEN 1 ELSE 0 END, ti + tj) AS by_square FROM t")
def tile_orders(spark, sf_dir):
    tiles = _matrix(spark, sf_dir).select(linalg.flat_to_tiled(F.col("i"), 16)[0].alias("ti"), linalg.flat_to_tiled(F.col("j"), 16)[0].alias("tj")).distinct()
    place = lambda order: F.row_number().over(W.orderBy(*linalg.tile_order(F.col("ti"), F.col("tj"), order)))  # noqa: E731  a row a tile
    return tiles.withColumns({"by_row": place("row"), "by_column": place("column"), "by_square": place("square")})


@query("tile_counts", "SELECT p_partkey, (p_size + 15) // 16 AS tiles FROM part")
def tile_counts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", linalg.tile_count(F.col("p_size"), 16).cast("int").alias("tiles"))


@query("matrix_lines", "SELECT vec_id AS i, array_to_string(list_transform(embedding, lambda v: CAST(round(v::DOUBLE * 1000) AS BIGINT)), ' ') AS line FROM embeddings")
def matrix_lines(spark, sf_dir):
    return linalg.print_rows(_matrix(spark, sf_dir), 0)


@query("inner_loop", f"SELECT {LK}, CAST(l_quantity AS BIGINT) * 3 + l_linenumber * 50 * 49 // 2 AS v FROM lineitem")
def inner_loop(spark, sf_dir):
    """A kernel with a long inner loop: start plus the sum of k times a number over k = 0 to 49."""
    start = (F.col("l_quantity").cast("long") * 3).alias("start")
    looped = launch(_lines(spark, sf_dir).withColumn("start", start), "loop_sum", "v", "start", "l_linenumber", loop=50)
    return _keys(looped, F.col("v").cast("long").alias("v"))


@query("gemm_repeated", f"WITH {M_SQL} SELECT m.i, g.j, (3 * sum(m.v * g.v))::BIGINT AS v FROM m JOIN g ON m.j = g.i GROUP BY 1, 2")
def gemm_repeated(spark, sf_dir):
    """The sum of each cell taken several times over."""
    return linalg.gemm(_matrix(spark, sf_dir), linalg.gram(_rows(spark, sf_dir), "embedding"), times=3)


def _flow(spark, sf_dir):
    buffers = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"))
    flow = Graph(buffers).task("scale", "scale", "b", "a", factor=20).task("sum", "add", "c", "a", "b")
    return flow.task("late", "increment", "b", "b", where=kernels.index_range(F.col("i"), 100), by=5).task("again", "add", "c", "c", "b")


@query("graph_run", "SELECT o_orderkey AS i, o_custkey AS a, b, o_custkey * 21 + b AS c FROM (SELECT *, o_custkey * 20 + CASE WHEN o_orderkey >= 100 THEN 5 ELSE 0 END AS b FROM orders)")
def graph_run(spark, sf_dir):
    """Four tasks over three buffers by the front end."""
    return _flow(spark, sf_dir).run()


@query("graph_needs", "SELECT * FROM (VALUES ('sum', 'scale', 'raw'), ('late', 'scale', 'raw'), ('late', 'sum', 'war'), ('again', 'sum', 'raw'), ('again', 'late', 'raw')) t(task, needs, kind)")
def graph_needs(spark, sf_dir):
    return _flow(spark, sf_dir).dependencies()


@query("buffer_copy", f"SELECT {LK}, l_quantity AS copied, l_quantity + l_tax AS added FROM lineitem")
def buffer_copy(spark, sf_dir):
    df = launch(_lines(spark, sf_dir), "copy", "copied", "l_quantity")
    return _keys(launch(launch(df, "copy", "added", "l_quantity"), "add", "added", "added", "l_tax"), "copied", "added")


@query("empty_kernel", "SELECT o_orderkey AS i, o_custkey AS v FROM orders")
def empty_kernel(spark, sf_dir):
    return launch(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("v")), "identity", "v", "v")


@query("strided_block", "SELECT vec_id AS i, j, CAST(round(embedding[j + 1]::DOUBLE * 1000) AS BIGINT) AS v FROM embeddings, range(64) t(j) WHERE vec_id >= 100 AND (vec_id - 100) % 7 = 0 AND vec_id < 450 AND j >= 8 AND j < 40 AND (j - 8) % 4 = 0")
def strided_block(spark, sf_dir):
    """A block of a matrix by offset, extent and stride in each dimension."""
    m = _matrix(spark, sf_dir)
    return m.filter(kernels.strided(F.col("i"), 100, 350, 7) & kernels.strided(F.col("j"), 8, 32, 4))


@query("fetch_prefix", "SELECT o_orderkey AS i, o_totalprice AS v FROM orders WHERE o_orderkey < 1000")
def fetch_prefix(spark, sf_dir):
    """The first thousand elements of a buffer, by index: the prefix is the feature."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v")).filter(kernels.index_range(F.col("i"), 0, 1000))


@query("typed_widths", "SELECT p_partkey, CAST((p_partkey * 37 + 128) % 256 - 128 AS TINYINT) AS a, CAST(p_partkey * 3700 % 65536 AS INTEGER) AS b, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 END::INTEGER AS width FROM part")
def typed_widths(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ["char", "int", "double", "no type"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", wrapped_product(element("int8"), F.col("p_partkey"), F.lit(37)).alias("a"), wrapped_product(element("uint16"), F.col("p_partkey"), F.lit(3700)).alias("b"), byte_width(names).alias("width"))


@query("host_task", "SELECT p_partkey, CAST(p_size AS BIGINT) * 7 + length(p_name) AS v FROM part")
def host_task(spark, sf_dir):
    """A step that runs host code over batches of rows."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("v"), F.length("p_name").alias("n"))
    return kernels.host_task(rows, lambda batch: batch.assign(v=batch["v"] * 7 + batch["n"])).select("p_partkey", "v")


@query("days_and_seconds", "SELECT event_id, epoch_us(ts) AS us, CAST(ts AS DATE)::VARCHAR AS day, date_diff('second', TIMESTAMP '2020-01-01', ts) AS seconds FROM events")
def days_and_seconds(spark, sf_dir):
    """Timer readings: microseconds, the day, and whole seconds since a start."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.unix_micros(F.lit("2020-01-01 00:00:00").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", us.alias("us"), F.to_date("ts").cast("string").alias("day"), F.floor((us - start) / 1_000_000).cast("long").alias("seconds"))


@query("text_crc32")
def text_crc32(spark, sf_dir):
    return launch(read(spark, sf_dir, "documents"), "crc32", "crc", "text").select("doc_id", "crc")


@query("source_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def source_digest(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
