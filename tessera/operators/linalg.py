"""Matrices as (i, j, v) tables: products, transposes, tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_to_matrix(df: DataFrame, i: str, values: str) -> DataFrame:
    """A row of an array column for each row of the matrix -> i, j, v."""
    return df.select(F.col(i).alias("i"), F.posexplode(values).alias("j", "v"))


def gemm(a: DataFrame, b: DataFrame, times: int = 1) -> DataFrame:
    """i, j, v of the product, taken ``times`` over; zeros that are not stored stay unstored."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    total = F.sum(F.col("x") * F.col("y"))
    return left.join(right, "k").groupBy("i", "j").agg((total if times == 1 else total * times).alias("v"))


def gram(df: DataFrame, values: str) -> DataFrame:
    """The transposed matrix times itself, from a row of an array column for each row of
    the matrix: outer products within each row, summed in the task before the shuffle."""
    left = df.select(values, F.posexplode(values).alias("i", "x"))
    pairs = left.select("i", "x", F.posexplode(values).alias("j", "y"))
    return pairs.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("v"))


LANE = 64  # tile rows or columns that are multiplied in one group


def blocked_gemm(a: DataFrame, b: DataFrame, tile: int) -> DataFrame:
    """The product by tiles, in doubles: each side is gathered into strips of ``tile`` numbers,
    joined on the inner tile index, and only the sums of strips are shuffled.

    ``LANE`` tile rows of the left side and as many tile columns of the right one make a
    group of the join, so that a group and a task have a bound whatever the matrices' shapes.
    The shuffle moves each number once a lane of the other side.  Cells given twice count
    as their sum; a cell without a product is not stored.
    """
    t = lambda c: F.floor(F.col(c) / tile).cast("long")
    lane = lambda c: F.floor(F.col(c) / (tile * LANE)).cast("long")
    strip = lambda c: F.array(*[F.sum(F.when(F.pmod(F.col(c), F.lit(tile)) == k, F.col("v").cast("double"))) for k in range(tile)])
    left = a.groupBy("i", t("j").alias("tk")).agg(strip("j").alias("row")).withColumn("la", lane("i"))
    columns = b.withColumnsRenamed({"i": "k"}).groupBy(t("k").alias("tk"), "j").agg(strip("k").alias("col"))
    place = F.map_from_entries(F.collect_list(F.struct(F.pmod(F.col("j"), F.lit(tile)).cast("int").alias("c"), "col")))
    right = columns.groupBy("tk", t("j").alias("tj")).agg(place.alias("cols")).withColumn("lb", F.floor(F.col("tj") / LANE).cast("long"))
    right = right.withColumn("cols", F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda c: F.try_element_at("cols", c)))
    # a row a lane: broadcast, so that no side is shuffled by the inner index alone
    left = left.crossJoin(F.broadcast(b.select(lane("j").alias("lb")).distinct()))
    right = right.crossJoin(F.broadcast(a.select(lane("i").alias("la")).distinct()))
    terms = lambda col: [F.col("row")[k] * col[k] for k in range(tile)]
    dot = lambda col: F.when(F.coalesce(*terms(col)).isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in terms(col)), F.lit(0.0)))
    strips = left.join(right, ["la", "lb", "tk"]).select("i", "tj", F.transform("cols", dot).alias("p"))
    sums = strips.groupBy("i", "tj").agg(F.array(*[F.sum(F.col("p")[k]) for k in range(tile)]).alias("p"))
    cells = sums.select("i", "tj", F.posexplode("p").alias("c", "v")).filter("v is not null")
    return cells.select("i", (F.col("tj") * tile + F.col("c")).cast(b.schema["j"].dataType).alias("j"), "v")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def flat_to_tiled(i: Column, tile: int) -> tuple[Column, Column]:
    """Tile number and place within the tile of a flat index."""
    return F.floor(i / tile).cast("long"), i % tile


def tiled_to_flat(tile_no: Column, place: Column, tile: int) -> Column:
    return tile_no * tile + place


def tile_count(n: Column, tile: int) -> Column:
    """Tiles that cover n elements, the last one partly filled if need be."""
    return F.ceil(n / tile)


def tile_order(ti: Column, tj: Column, order: str) -> list[Column]:
    """Sort keys of the ways to walk over tiles: by rows, by columns, or along the border
    of growing squares (the row's part first, then the column's)."""
    border = F.greatest(ti, tj)
    return {"row": [ti, tj], "column": [tj, ti], "square": [border, (ti == border).cast("int"), ti + tj]}[order]


def grid_of(n: int) -> tuple[int, int]:
    """The rows and columns of the squarest full grid of n devices."""
    rows = max(p for p in range(1, math.isqrt(n) + 1) if n % p == 0)
    return rows, n // rows


def block_cyclic(row: Column, col: Column, n_devices: int) -> Column:
    """Device of a tile: a near-square grid of devices, numbered by rows, is laid over the
    tiles again and again.  A negative place has no device of its own (null)."""
    p, q = grid_of(n_devices)
    return F.when((row >= 0) & (col >= 0), (row % p) * q + col % q).cast("int")


def write_tiles(a: DataFrame, tile: int, path: str) -> None:
    """Write the cells i, j, v as a folder for each tile row, whose files hold whole tiles."""
    (ti, r), (tj, c) = flat_to_tiled(F.col("i"), tile), flat_to_tiled(F.col("j"), tile)
    cells = a.select(ti.alias("ti"), tj.alias("tj"), r.alias("r"), c.alias("c"), "v")
    cells.repartition("ti", "tj").sortWithinPartitions("ti", "tj", "r", "c").write.partitionBy("ti").parquet(path)


def read_tiles(spark: SparkSession, path: str, tile: int) -> DataFrame:
    """i, j, v of what ``write_tiles`` wrote."""
    cells = spark.read.parquet(path)
    return cells.select(tiled_to_flat(F.col("ti").cast("long"), F.col("r"), tile).alias("i"), tiled_to_flat(F.col("tj"), F.col("c"), tile).alias("j"), "v")


def print_rows(a: DataFrame, digits: int = 3) -> DataFrame:
    """i, line: the numbers of each row in order, as text; each row is a line of its own."""
    cells = F.array_sort(F.collect_list(F.struct("j", F.col("v").cast("double").alias("v"))))
    return a.groupBy("i").agg(F.array_join(F.transform(cells, lambda x: F.format_string(f"%.{digits}f", x["v"])), " ").alias("line"))


def mismatches(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: cells that differ or that only one side has."""
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full")
    return both.agg(F.count_if(F.col("x").isNull() | F.col("y").isNull() | (F.abs(F.col("x") - F.col("y")) > tolerance)).alias("errors"))
