"""Trace files: reading with the facts that file names carry, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "taskname string, type string, start double, end double, duration double, size long, policy string, acclname string"


def read_trace(spark: SparkSession, path: str, name_parts: tuple[str, ...] = ("dag", "schedule", "system"), from_folder: bool = False) -> DataFrame:
    """The trace columns, a column for each part of the file name (split at ``-``), and devno.
    With ``from_folder`` the name is the file's folder, as where Spark wrote the trace.

    Sizes count only in kernel rows: those of transfers are unreliable and become null.
    """
    rows = spark.read.csv(path, schema=SCHEMA, header=True).withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2 if from_folder else -1))
    parts = F.split(F.regexp_replace("_file", "\\.csv$", ""), "-")
    for k, part in enumerate(name_parts):
        rows = rows.withColumn(part, F.get(parts, k))
    device, number = last_space(F.col("acclname"))
    return rows.withColumns({"device": device, "devno": number.try_cast("int"), "size": F.when(F.col("type") == "Kernel", F.col("size"))}).drop("_file")


def last_space(name: Column) -> tuple[Column, Column]:
    """What stands before and after the last space."""
    return F.regexp_extract(name, "^(.*) [^ ]*$", 1), F.regexp_extract(name, "([^ ]*)$", 1)


def write_trace(trace: DataFrame, path: str) -> None:
    trace.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.csv(path, header=True)


def read_samples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, at, value of files with one line of comma-separated numbers; # begins a comment line.
    With ``lines``, also a number for each line, for files of several."""
    text = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), *[F.monotonically_increasing_id().alias("line")] * lines, "value").filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    keys = ["file", *["line"] * lines]
    return text.select(*keys, F.posexplode(F.split("value", ",")).alias("at", "text")).select(*keys, "at", F.trim("text").try_cast("double").alias("value"))
