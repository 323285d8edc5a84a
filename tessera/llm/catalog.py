"""The queries of this subpackage, one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audio, bpe, crf_langid, decontaminate, jaccard_join, kdshard, lineblock, pst_tables, suffix_dedup, url_lm
from tessera.llm.common import table


def op1_url_char_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.url_filter(table(spark, sf_dir, "pages"))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = audio.store(table(spark, sf_dir, "documents"))
    return audio.digest(audio.features(stored, keep=["n_bytes", "media"]))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pst_tables.fit(docs.filter(crf_langid.fold(docs, 7) != 2))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)), F.lit(0)) == 2
    return pst_tables.score(docs, model).withColumn("held_out", held_out)


def op4_line_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineblock.extract(table(spark, sf_dir, "pages"))


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kdshard.shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crf_langid.fold(docs, 5) == 0
    model = crf_langid.fit(docs.filter(~held_out))
    return crf_langid.predict(docs, model).withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)), F.lit(0)) == 0).select("doc_id", "held_out", "lang_pred", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_char_lm": op1_url_char_lm,
        "op2_audio_features": op2_audio_features,
        "op3_suffix_tree": op3_suffix_tree,
        "op4_line_block": op4_line_block,
        "op5_bpe_encoding": op5_bpe_encoding,
        "op6_kd_sharding": op6_kd_sharding,
        "op7_decontamination": op7_decontamination,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_crf_language_id": op9_crf_language_id,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_char_lm": url_lm.oracle()}
