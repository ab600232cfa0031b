"""Corpus preparation: quality filter, near-dedup, secret redaction, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and keeps nulls, repeated rows and further
columns as its operator describes. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import bpe, mixing, near_copies, quality, secret_scan
from tallymart.llm.queries import TOKENIZER, table
from tallymart.llm.scratch import settle


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.near_copies(docs, similarity=0.8, shingle=5)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document, checked by decoding."""
    back = bpe.transcode(docs, TOKENIZER, keep=["doc_id", "source", "lang", "text"])
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return back.select("doc_id", "source", "lang", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("quality", good_documents), ("near_copies", without_copies), ("secrets", without_secrets), ("mixing", mixed), ("encoding", encoded)]
#: SQL expresses neither the SimHash groups nor the language model; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
