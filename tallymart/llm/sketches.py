"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the hash range is kept.

Sketches of any two documents hold the same sample of their shingles, whatever their sizes, so sketches merge by union, and
intersections estimate resemblance and containment. With DataFrame functions only.

A document none of whose hashes lies below the fraction keeps its least one, so that short documents can be compared too.

Null texts count as empty; a text with fewer words than a shingle is one shingle; a wordless text has none and an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle

SHINGLE, FRACTION = 5, 0.25
#: Rows of a bucket of neighbouring ids, and buckets at most; beyond them buckets grow.
BUCKET_ROWS, BUCKETS = 20_000, 20_000


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Array of a 64-bit hash for each word shingle; words are split at ASCII white space after lower-casing A-Z."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.array(F.regexp_extract_all(lower, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), lambda w: _hashes(w, shingle))[0]


def _hashes(words: Column, shingle: int) -> Column:
    n = F.greatest(F.size(words) - (shingle - 1), F.least(F.size(words), F.lit(1)))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    shifted = [hashed, *(F.slice(hashed, i + 1, F.size(words)) for i in range(1, shingle))]
    return F.slice(F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(z)), 1, n)


def sketch(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted array of the distinct shingle hashes below ``fraction`` of the range; if none is, of the least one."""
    bound = int(-(2**63) + fraction * 2**64)
    hashes = F.transform(F.array(shingle_hashes(F.coalesce(text, F.lit("")), shingle)), lambda a: _least_too(a, bound))
    return hashes[0]


def _least_too(hashes: Column, bound: int) -> Column:
    low = F.filter(hashes, lambda h: h < bound)
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(low)
    return F.transform(F.array(low), lambda a: F.when(F.size(a) > 0, F.array_sort(F.array_distinct(a))).otherwise(least))[0]


def merged(sketches: Column, fraction: float = FRACTION) -> Column:
    """Sketch of several documents together: an array of sketches, united; of hashes beyond the fraction the least stays."""
    return _least_too(F.flatten(sketches), int(-(2**63) + fraction * 2**64))


def resemblance(a: Column, b: Column) -> Column:
    """Share of the united shingles that both have; two empty sketches (wordless texts): 1."""
    both = F.size(F.array_intersect(a, b))
    united = F.size(a) + F.size(b) - both
    return F.when(united > 0, both / united).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s shingles that ``b`` has too; an empty ``a``: 0."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def as_text(a: Column) -> Column:
    """Sixteen hex digits for each hash, in order, joined."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _identity(doc_id: Column, text: Column) -> list[Column]:
    """Two independent 64-bit hashes of id and text, which stand for a row."""
    return [F.xxhash64(doc_id, text).alias("h"), F.xxhash64(F.lit(1), doc_id, text).alias("g")]


def _before(keys: DataFrame) -> DataFrame:
    """(h, g, before) of ``keys`` (doc_id, h, g, third, times): ``before`` is the (h, g, doc_id, third, times) of the row whose next it is.

    Rows are dealt to buckets by ranges of their order, so neither an id that many rows share nor a null one fills a bucket;
    texts are not moved. The window over all buckets has one row for each of BUCKETS at most.
    """
    keys = settle(keys.select("*", F.isnull("doc_id").alias("none"), F.bitwise_not("doc_id").alias("down")), "next-keys")
    place = ["none", "down", "h", "g"]
    buckets = max(1, min(BUCKETS, -(-keys.count() // BUCKET_ROWS)))
    keys = settle(keys.repartitionByRange(buckets, *place).withColumn("bucket", F.spark_partition_id()), "next-buckets")
    row = F.struct("h", "g", "doc_id", "third", "times")
    ends = keys.groupBy("bucket").agg(F.max_by(row, F.struct(*place)).alias("end"))
    order = W.orderBy("bucket")
    last = F.last("end").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ends = ends.select("bucket", F.coalesce(F.lag("end").over(order), last).alias("end"))
    inside = keys.select("bucket", "h", "g", F.lag(row).over(W.partitionBy("bucket").orderBy(*place)).alias("inside"))
    return inside.join(F.broadcast(ends), "bucket").select("h", "g", F.coalesce("inside", "end").alias("before"))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's sketch against that of its edited text and of the next document.

    The next document follows in descending doc_id order; after the last comes the first, and a single one is its own next. Null
    ids come last; equal ids are ordered by a hash of id and text. Rows that agree in both are one document here, and each of them
    is returned. The edit replaces the last third of the code points (rounded down) by as many from the start of the next document.

    Ids and hashes alone are ordered. A next document then sends its sketch and no more of its text than the edit takes. Repeated
    rows are united before they are shuffled.

    Returns doc_id, n_chars, edited, own, other (the next one's) and changed (the edited text's sketch).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("*", *_identity(F.col("doc_id"), F.col("text")))
    third = F.floor(F.length("text") / 3).cast("int")
    before = _before(rows.groupBy("h", "g").agg(F.first("doc_id").alias("doc_id"), F.first(third).alias("third"), F.count("*").alias("times")))
    # The same columns on both sides of the last join, so that one shuffle of the texts serves both.
    one = rows.groupBy("h", "g").agg(F.first("text").alias("text"))
    begin = F.substring(F.col("text"), F.lit(1), F.col("before.third")).alias("begin")
    sent = one.join(before, ["h", "g"]).select("before.*", begin, sketch(F.col("text")).alias("other"))
    both = one.join(sent, ["h", "g"])
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("third")), F.col("begin"))
    both = both.select("doc_id", "text", "times", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "other")
    out = both.select("doc_id", "times", "n_chars", "edited", sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("changed"), "other")
    each = F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("one")
    return out.select("doc_id", "n_chars", "edited", "own", "changed", "other", each).drop("one")
