"""Differences between two states of records and of directed relations. Keys are compared null-safely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fingerprint
from ..sources.snapshots import source_summary


def _outer(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join on ``keys``; values become old_*/new_*, is_old and is_new tell the sides."""
    a = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("is_old"))
    b = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("is_new"))
    return a.join(b, keys, "full_outer")


def _differ(*names: str) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | ~F.col(f"old_{n}").eqNullSafe(F.col(f"new_{n}"))
    return found


def _kind(changed: Column) -> Column:
    return F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").when(changed, "changed")


def records_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_id, data_source, record_id, kind): added, removed, or changed in match key or rule."""
    both = _outer(old, new, ["entity_id", "data_source", "record_id"], ["match_key", "errule_code"])
    return both.withColumn("kind", _kind(_differ("match_key", "errule_code"))).where("kind IS NOT NULL").select("entity_id", "data_source", "record_id", "kind")


def source_sets(records: DataFrame) -> DataFrame:
    """(entity_id, sources): the sorted data sources of each entity."""
    return records.groupBy("entity_id").agg(F.array_sort(F.collect_set("data_source")).alias("sources"))


def relations_diff(old: DataFrame, new: DataFrame, old_records: DataFrame, new_records: DataFrame) -> DataFrame:
    """(entity_id, related_id, kind) of directed relations: added, removed, or changed in type, key or rule, or in the set of
    data sources on either side."""

    def with_sources(relations: DataFrame, records: DataFrame) -> DataFrame:
        sets = source_sets(records)
        own, theirs = sets.withColumnRenamed("sources", "own"), sets.select(F.col("entity_id").alias("related_id"), F.col("sources").alias("theirs"))
        return relations.join(own, "entity_id", "left").join(theirs, "related_id", "left")

    values = ["match_type", "match_key", "errule_code", "own", "theirs"]
    both = _outer(with_sources(old, old_records), with_sources(new, new_records), ["entity_id", "related_id"], values)
    return both.withColumn("kind", _kind(_differ(*values))).where("kind IS NOT NULL").select("entity_id", "related_id", "kind")


def source_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_id, data_source, delta): change of the number of records; a source that is lost altogether counts negative."""
    both = _outer(source_summary(old), source_summary(new), ["entity_id", "data_source"], ["records"])
    delta = F.coalesce("new_records", F.lit(0)) - F.coalesce("old_records", F.lit(0))
    return both.select("entity_id", "data_source", delta.alias("delta")).where("delta <> 0")


def entity_counts(records: DataFrame, relations: DataFrame) -> DataFrame:
    """(entity_id, record_count, relation_count) of each entity that has records; relations are directed."""
    own = records.groupBy("entity_id").agg(F.count("*").alias("record_count"))
    links = relations.groupBy("entity_id").agg(F.count("*").alias("relation_count"))
    return own.join(links, "entity_id", "left").na.fill(0, ["relation_count"])


def entity_count_deltas(old: tuple[DataFrame, ...], new: tuple[DataFrame, ...]) -> DataFrame:
    """(entity_id, record_delta, relation_delta) of entities whose counts differ; states are (records, directed relations)."""
    both = _outer(entity_counts(*old[:2]), entity_counts(*new[:2]), ["entity_id"], ["record_count", "relation_count"])
    delta = lambda n: F.coalesce(f"new_{n}", F.lit(0)) - F.coalesce(f"old_{n}", F.lit(0))
    both = both.select("entity_id", delta("record_count").alias("record_delta"), delta("relation_count").alias("relation_delta"))
    return both.where("record_delta <> 0 OR relation_delta <> 0")


def _digest(*values: str) -> Column:
    """Digest of a multiset of rows by sums that do not depend on order: a few numbers for each group, however large. Nulls are
    hashed as such, since the hash function passes over them."""
    parts = [x for v in values for x in (F.col(v).isNull(), F.col(v))]
    one, two = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    parts = [F.count("*"), total(one), total(two), F.bit_xor(one), F.bit_xor(two)]
    return F.concat(*[x for p in parts for x in (p.cast("string"), F.lit(":"))])


def entity_fingerprints(records: DataFrame, relations: DataFrame, names: DataFrame | None = None, around: DataFrame | None = None) -> DataFrame:
    """(entity_id, entity_hash): equal hashes mean equal name, records and relations, related entities' source sets included.

    ``names``: (entity_id, entity_name); entities that are not in it have no name. ``around``: records of the related entities, if
    ``records`` does not hold them.
    """
    own = records.groupBy("entity_id").agg(_digest("data_source", "record_id", "match_key", "errule_code").alias("rs"))
    theirs = source_sets(records if around is None else around).select(F.col("entity_id").alias("related_id"), F.col("sources").alias("theirs"))
    links = relations.join(theirs, "related_id", "left").groupBy("entity_id")
    links = links.agg(_digest("related_id", "match_type", "match_key", "errule_code", "theirs").alias("ls"))
    both = named(own.join(links, "entity_id", "left"), names)
    return both.select("entity_id", fingerprint(F.col("entity_name"), F.col("rs"), F.col("ls")).alias("entity_hash"))


def named(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """``rows`` (entity_id) with entity_name, null where ``names`` has none."""
    if names is None:
        return rows.withColumn("entity_name", F.lit(None).cast("string"))
    return rows.join(names.select("entity_id", "entity_name"), "entity_id", "left")


def unchanged_entities(old: tuple[DataFrame, ...], new: tuple[DataFrame, ...]) -> DataFrame:
    """(entity_id) of entities whose fingerprint is the same in both states (records, directed relations, names): no work."""
    a, b = entity_fingerprints(*old), entity_fingerprints(*new).withColumnRenamed("entity_hash", "new_hash")
    return a.join(b, "entity_id").where("entity_hash = new_hash").select("entity_id")
