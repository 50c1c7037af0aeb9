"""A pipeline from documents to token ids.

Stages, each a function (spark, docs, sf_dir) -> DataFrame, written as Parquet
and reread as the next one's docs: toxicity (rejected documents go), MinHash
near-dedup (one document of each group stays), secret scans (secrets are
replaced), mixing to target weights (documents stay as often as the mixture
takes them), BPE (token ids, and the text they decode to).

In every stage null and empty texts are documents like others (they are kept,
hold no secret and encode to no ids), null ids stay null, repeated rows are
rows of their own but for near-dedup's groups, texts of any length are handled
whole, an empty table gives an empty one, and further columns pass through all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bpe import bpe_documents
from weft.llm.common import table
from weft.llm.mixing import mix
from weft.llm.near_dedup import keep_representatives
from weft.llm.queries import byte_vocabulary
from weft.llm.secrets import redact_secrets
from weft.llm.toxicity import drop_toxic
from weft.storage import discard, materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; learns from the labelled ones among docs."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of every group linked at a similarity of 0.8 of five-word shingles."""
    return keep_representatives(docs, shingle=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced and n_chars counted anew."""
    return redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, dealt to shards and shuffled inside them."""
    return mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers."""
    coded = bpe_documents(docs, byte_vocabulary(), keep=("source",))
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("bpe", bpe)]

#: A trained classifier, sketches, decoded layers and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents; a stage's input is deleted once the next is written."""
    docs = table(spark, sf_dir, "documents")
    before: DataFrame | None = None
    for name, stage in STAGES:
        after = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
        docs = before = after
    return docs
