"""Contributions, or their signed changes, to the report and report_detail tables. Sums are associative: rebuilding and adding
changes are the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import encode_report_key

KEY = ("report", "statistic", "source1", "source2")


def rollup_pending(contributions: DataFrame) -> DataFrame:
    """(report_key, report, statistic, source1, source2, entity_count, record_count, relation_count), all-zero sums left out."""
    sums = contributions.groupBy(*KEY).agg(F.sum("entities").alias("entity_count"), F.sum("records").alias("record_count"), F.sum("relations").alias("relation_count"))
    sums = sums.where("entity_count <> 0 OR record_count <> 0 OR relation_count <> 0")
    return sums.select(encode_report_key(*map(F.col, KEY)).alias("report_key"), *KEY, "entity_count", "record_count", "relation_count")


rebuild_report = rollup_pending


def merge_report(report: DataFrame, changes: DataFrame) -> DataFrame:
    """``report`` with summed ``changes`` (of :func:`rollup_pending`) added; rows stay when they reach zero."""
    counts = ("entity_count", "record_count", "relation_count")
    return report.unionByName(changes).groupBy("report_key", *KEY).agg(*[F.sum(c).alias(c) for c in counts])


def pending_detail(contributions: DataFrame) -> DataFrame:
    """(report_key, report, statistic, source1, source2, entity_id, related_id, stat_count): entity counts at related_id 0, relation
    counts at the pair."""
    count = F.when(F.col("related_id") == 0, F.col("entities")).otherwise(F.col("relations"))
    sums = contributions.groupBy(*KEY, "entity_id", "related_id").agg(F.sum(count).alias("stat_count")).where("stat_count <> 0")
    return sums.select(encode_report_key(*map(F.col, KEY)).alias("report_key"), *KEY, "entity_id", "related_id", "stat_count")


rebuild_detail = pending_detail


def merge_detail(detail: DataFrame, changes: DataFrame) -> DataFrame:
    """``detail`` with ``changes`` (of :func:`pending_detail`) added; rows that reach zero go."""
    both = detail.unionByName(changes).groupBy("report_key", *KEY, "entity_id", "related_id").agg(F.sum("stat_count").alias("stat_count"))
    return both.where("stat_count <> 0")


def reconcile(kept: DataFrame, rebuilt: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Rows in which ``kept`` and ``rebuilt`` differ, zero counts on either side counting as absent."""
    some = " OR ".join(f"{c} <> 0" for c in counts)
    a = kept.where(some).select(*keys, *[F.col(c).alias(f"kept_{c}") for c in counts])
    b = rebuilt.where(some).select(*keys, *[F.col(c).alias(f"rebuilt_{c}") for c in counts])
    both = a.join(b, keys, "full_outer").na.fill(0, [f"{s}_{c}" for s in ("kept", "rebuilt") for c in counts])
    return both.where(" OR ".join(f"kept_{c} <> rebuilt_{c}" for c in counts))
