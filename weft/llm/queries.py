"""The queries opN_<name> over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import table


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth", "digest", "shard", "offset", "length"
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op4_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.bpe import bpe_documents

    coded = bpe_documents(table(spark, sf_dir, "documents"), byte_vocabulary())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.mixing import plan

    return plan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_quality_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_lm_scores, op2_media_columns, op3_license_scan, op4_setsketch_near_dedup, op5_bpe,
        op6_mixing, op7_embedding_near_dedup, op8_quality_subwords, op9_toxicity, op10_secret_scan,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from weft.llm import sql

    return {"op3_license_scan": sql.license_scan(), "op4_setsketch_near_dedup": sql.near_dedup(2), "op7_embedding_near_dedup": sql.near_vectors()}
