"""Cutting the lineage of iterated tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session on one machine (tests) may leave it unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut_lineage(df: DataFrame, *old: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back; the files of ``old`` ones, which it replaces, go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for x in old:
        if gone := getattr(x, "_tessera_round", None):
            place = spark._jvm.org.apache.hadoop.fs.Path(gone)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_round = path
    return out
