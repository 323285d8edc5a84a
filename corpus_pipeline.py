"""A corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its
predecessor kept, and its result is written and read again before the next one.  All but
the last return the columns of ``documents``.

An empty table stays empty.  Null and empty texts go with the first stage.  A null lang is
not learned from; a null doc_id is an id like others; columns beside those of ``documents``
are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, crf_langid, decontaminate, jaccard_join, suffix_dedup
from tessera.llm.common import materialize, release, scratch, table

#: A text whose language is less sure than this is no text in a known language.
LEAST_SURE = 0.5


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(stage: Callable) -> Callable:
    """Let a stage see the extra columns of its input under names that clash with nothing."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {f"__extra{k}" if c not in CORE else c: c for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*own), sf_dir)
        return out.toDF(*[own.get(c, c) for c in out.columns])

    return run_stage


@shielded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognised language go (null, empty, letter-free or unsure ones)."""
    model = crf_langid.fit(docs.filter(crf_langid.fold(docs, 5) != 0))
    columns = docs.columns
    return crf_langid.predict(docs, model, keep=[c for c in columns if c != "doc_id"]).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)).select(*columns)


@shielded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id stays.

    Rows of one id are one document here: texts that differ stay together when one of them
    is its component's least, repeated rows become one.  Only rows of repeated ids are
    shuffled for that.
    """
    groups = jaccard_join.near_duplicates(docs, params=jaccard_join.Params(shingle=5, percent=80))
    stay = groups.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"), F.max(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("__stays")).filter("__stays")
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")))
    return kept.filter("__n = 1").select(*docs.columns).unionByName(kept.filter("__n > 1").select(*docs.columns).dropDuplicates())


@shielded
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes and passages of over 50 words go from the texts, every
    occurrence of them; documents of which nothing remains go too."""
    out = suffix_dedup.remove_repeats(docs, params=(suffix_dedup.Params(), suffix_dedup.PASSAGES))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).filter(F.trim("text") != "").select(*docs.columns)


@shielded
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


@shielded
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of what is left; a text that doesn't decode to itself goes."""
    tokens = bpe.encode_decode(docs, keep=["text"])
    return tokens.filter(F.col("decoded_sha256") == F.sha2(F.encode("text", "utf-8"), 256)).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("bpe_encoding", tokenize),
]

#: SQL can express none of the model, the byte-level repeats and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            made = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        release(docs)  # its successor is written
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
