"""The registered queries of the subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_codes, bpe, filter_audit, licenses, mixing, packing, quality, secret_scan, simhash, sketches, token_counts, topk, warc
from .oracles import ORACLES  # noqa: F401  registered beside the queries
from .scratch import shared_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Its end-of-document id.
EOD = 50256
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archive")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    at = F.flatten(F.transform("places", lambda p: p.at))
    return found.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "threshold", "keep", "repeats")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), TOKENIZER, EOD)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    each = mixing.copies(docs)
    return each.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _joined(spans, kinds: tuple[str, ...] | None = None):
    some = F.filter(spans, lambda s: s.kind.isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = tuple(r.kind for r in secret_scan.BASE)
    return found.select("doc.doc_id", *map(count, base), F.sha2(_joined(F.col("spans"), base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, F.col("vec_id") % 100 == 0)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.transcode(table(spark, sf_dir, "documents"), TOKENIZER, keep=["doc_id"])
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = sketches.compare_edited(table(spark, sf_dir, "documents"))
    near = lambda other: sketches.resemblance(F.col("own"), F.col(other))
    return each.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketches.as_text(F.col("own")).alias("fingerprint"),
        sketches.as_text(F.col("changed")).alias("edited_fingerprint"), near("changed").alias("near_edited"), near("other").alias("near_next"),
        sketches.containment(F.col("own"), F.col("changed")).alias("kept_in_edited"),
    )


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = ball_codes.encode(table(spark, sf_dir, "embeddings"))
    each = ball_codes.with_label_errors(coded)
    digest = F.lit(books.digest() if books else None).cast("string")
    return each.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), WORD_TOKENIZER))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(filter_audit.cells_of_files(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash, "op2_warc": op2_warc, "op3_licenses": op3_licenses, "op4_quality": op4_quality, "op5_token_counts": op5_token_counts, "op6_mixing": op6_mixing, "op7_secrets": op7_secrets,
    "op8_topk": op8_topk, "op9_bpe": op9_bpe, "op10_sketches": op10_sketches,
    "op11_ball_codes": op11_ball_codes, "op12_packing": op12_packing, "op13_filter_audit": op13_filter_audit,
}
