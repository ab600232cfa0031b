"""Mixing sources to target weights by capped water-filling.

Sources in code-point order (null last) get ``weights`` in turn and share ``share`` times all words. No source goes beyond
``max_epochs`` times its own words; what a capped source leaves is shared again by weight until none is above. A source's
target over its words is its number of repetitions: every document is taken the whole number of times, and the fraction is a
seeded sample of whole documents whose words come as near to the rest as whole documents allow.

The sample of a source is a prefix of its documents in the order of a seeded hash. Its end is found in two steps that no hot
source can overload: sums over 4096 hash buckets give the bucket in which the prefix ends, and only that bucket's rows are
ordered. What results is one row for each source (target, whole repetitions, last sampled hash), so documents are never
shuffled with their texts.

Null texts have size 0. Rows that agree in doc_id and size are taken alike; a null doc_id hashes like a value of its own.
Sources without words get target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, 7
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, size); the windows run over one row for each source."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(max_epochs)
    each = each.withColumn("weight", weight).withColumn("turn", turn).withColumn("cap", cap)
    # In order of cap / weight the capped sources come first: one is capped if a fair share of what is left reaches its cap.
    order = W.orderBy(F.col("cap") / F.col("weight"), "turn")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(share)
    each = each.withColumn("total", total).withColumn("capped", F.col("cap") * onward <= F.col("weight") * (total - before))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * left / open_weight)
    return each.select("source", "source_size", target.alias("target"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source of ``rows`` (source, size, h): source, source_size, target, whole, last (h, size)."""
    goals = targets(rows, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = settle(goals.withColumn("whole", whole).withColumn("goal", F.col("target") - whole * F.col("source_size")), "mix-goals")
    sums = rows.groupBy("source", F.substring("h", 1, 3).alias("bucket")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    ends = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    here = goals.select(F.col("source").alias("s"), "goal")
    ends = ends.join(here, F.col("source").eqNullSafe(F.col("s"))).where("before <= goal AND goal < upto")
    ends = settle(ends.select("s", "bucket", "before", "goal"), "mix-ends")
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.substring("h", 1, 3) == F.col("bucket")))
    ties = inside.groupBy("s", "before", "goal", "h", "size").agg(F.sum("size").alias("words"))
    start = F.col("before") + F.sum("words").over(W.partitionBy("s").orderBy("h", "size")) - F.col("words")
    taken = ties.withColumn("start", start).where(F.col("start") + F.col("words") / 2 <= F.col("goal"))
    last = taken.groupBy("s").agg(F.max(F.struct("h", "size")).alias("last"))
    none = F.struct(F.col("bucket").alias("h"), F.lit(-1).cast("long").alias("size"))
    last = ends.join(last.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").select("s", F.coalesce("last", none).alias("last"))
    joined = goals.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    return settle(joined.select("source", "source_size", "target", "whole", "last"), "mix-plan")


def copies(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, **how) -> DataFrame:
    """One row for each document: doc (struct of all its columns), size, source_size, target, copies (0 to ``max_epochs``)."""
    size, h = words(F.col(text)), _hash(F.col(doc_id), seed)
    rows = settle(docs.select(F.col(source).alias("source"), size.alias("size"), h.alias("h")), "mix-sizes")
    made = plan(rows, **how).withColumnRenamed("source", "s")
    each = docs.select(F.struct("*").alias("doc"), F.col(source).alias("source"), size.alias("size"), h.alias("h"))
    each = each.join(made, F.col("source").eqNullSafe(F.col("s")))
    extra = F.coalesce(F.struct("h", "size") <= F.col("last"), F.lit(False)).cast("long")
    # A document without words may lead a source whose whole repetitions fill its target.
    taken = F.least(F.col("whole") + extra, F.lit(how.get("max_epochs", MAX_EPOCHS)).cast("long"))
    return each.select("doc", "size", "source_size", "target", taken.alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    return copies(docs, **how).withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
