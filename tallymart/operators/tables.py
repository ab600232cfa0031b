"""Maintenance of the entity, record and relation tables: every step takes the stored table and returns the next version.

Stored tables keep their keys unique. ``operation`` names the batch; ``now`` is its time (a column, the clock by default).
Created columns are fixed when a row is inserted, modified ones change with the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fingerprint
from .diff import entity_counts, entity_fingerprints, named, records_diff, relations_diff, source_sets

AUDIT = ("creator_id", "modifier_id", "created_on", "modified_on")


def _audited(df: DataFrame, fresh: Column, changed: Column, operation: str, now: Column | None) -> DataFrame:
    """Audit columns of a joined row: those of ``fresh`` rows are new, those of ``changed`` ones are modified."""
    now = F.current_timestamp() if now is None else now
    for name, value in (("creator_id", F.lit(operation)), ("created_on", now)):
        df = df.withColumn(name, F.when(fresh, value).otherwise(F.col(name)))
    for name, value in (("modifier_id", F.lit(operation)), ("modified_on", now)):
        df = df.withColumn(name, F.when(fresh | changed, value).otherwise(F.col(name)))
    return df


def with_audit(df: DataFrame, operation: str = "load", now: Column | None = None) -> DataFrame:
    """``df`` with audit columns, as if all rows were inserted by ``operation``."""
    now = F.current_timestamp() if now is None else now
    return df.withColumns({"creator_id": F.lit(operation), "modifier_id": F.lit(operation), "created_on": now, "modified_on": now})


def entity_rows(records: DataFrame, relations: DataFrame, names: DataFrame | None = None, around: DataFrame | None = None) -> DataFrame:
    """(entity_id, entity_name, record_count, relation_count, entity_hash) of a state; see :func:`entity_fingerprints`."""
    rows = entity_counts(records, relations).join(entity_fingerprints(records, relations, names, around), "entity_id")
    return named(rows, names).select("entity_id", "entity_name", "record_count", "relation_count", "entity_hash")


def upsert_entities(stored: DataFrame, fresh: DataFrame, operation: str = "load", now: Column | None = None) -> DataFrame:
    """Insert rows of ``fresh``, or update where the hash differs; prev_entity_hash keeps the hash that was replaced."""
    values = ("entity_name", "record_count", "relation_count", "entity_hash")
    new = fresh.select("entity_id", *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("given"))
    both = stored.withColumn("there", F.lit(True)).join(new, "entity_id", "full_outer")
    inserted = F.col("there").isNull()
    changed = F.col("given").isNotNull() & ~inserted & ~F.col("entity_hash").eqNullSafe(F.col("new_entity_hash"))
    both = _audited(both, inserted, changed, operation, now)
    both = both.withColumn("prev_entity_hash", F.when(changed, F.col("entity_hash")).otherwise(F.col("prev_entity_hash")))
    take = inserted | changed
    rows = both.select("*", *[F.when(take, F.col(f"new_{v}")).otherwise(F.col(v)).alias(f"out_{v}") for v in values])
    return rows.select("entity_id", *[F.col(f"out_{v}").alias(v) for v in values], "prev_entity_hash", *AUDIT)


def delete_entities(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """``stored`` without the entities of ``gone`` (entity_id)."""
    return stored.join(gone.select("entity_id").distinct(), "entity_id", "left_anti")


def upsert_records(stored: DataFrame, fresh: DataFrame, operation: str = "load", now: Column | None = None) -> DataFrame:
    """Insert records of ``fresh``, or move them to the entity that holds them now.

    prev_entity_id is the owner before, unless that is the same one or 0 (an orphan); adopter_id is set when an orphan is taken.
    ``change`` tells what happened: insert, adopt, move, update (key or rule only) or null.
    """
    keys, values = ["data_source", "record_id"], ("entity_id", "match_key", "errule_code")
    new = fresh.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("given"))
    both = stored.withColumn("there", F.lit(True)).join(new, keys, "full_outer")
    inserted, given = F.col("there").isNull(), F.col("given").isNotNull()
    differ = lambda v: ~F.col(v).eqNullSafe(F.col(f"new_{v}"))
    change = (
        F.when(inserted, "insert").when(given & (F.col("entity_id") == 0) & (F.col("new_entity_id") != 0), "adopt").when(given & differ("entity_id"), "move").when(given & (differ("match_key") | differ("errule_code")), "update")
    )
    both = both.withColumn("change", change)
    both = _audited(both, inserted, F.col("change").isNotNull(), operation, now)
    previous = F.when(F.col("change") == "move", F.col("entity_id")).otherwise(F.col("prev_entity_id"))
    adopter = F.when(F.col("change") == "adopt", F.lit(operation)).otherwise(F.col("adopter_id"))
    rows = both.withColumn("prev_entity_id", previous).withColumn("adopter_id", adopter)
    rows = rows.select("*", *[F.when(given, F.col(f"new_{v}")).otherwise(F.col(v)).alias(f"out_{v}") for v in values])
    return rows.select(*keys, *[F.col(f"out_{v}").alias(v) for v in values], "prev_entity_id", "adopter_id", *AUDIT, "change")


def record_table(records: DataFrame, operation: str = "load", now: Column | None = None) -> DataFrame:
    """A stored record table of the records of a state."""
    rows = records.select("data_source", "record_id", "entity_id", "match_key", "errule_code", F.lit(None).cast("long").alias("prev_entity_id"), F.lit(None).cast("string").alias("adopter_id"))
    return with_audit(rows, operation, now)


def orphan_records(stored: DataFrame, removed: DataFrame, operation: str = "load", now: Column | None = None) -> DataFrame:
    """Records of ``removed`` (entity_id, data_source, record_id) that their entity still owns become orphans (owner 0)."""
    gone = removed.select("data_source", "record_id", F.col("entity_id").alias("left_id")).distinct()
    both = stored.join(gone, (stored["data_source"] == gone["data_source"]) & (stored["record_id"] == gone["record_id"]) & (stored["entity_id"] == gone["left_id"]), "left")
    both = both.select(*[stored[c] for c in stored.columns], F.col("left_id"))
    lost = F.col("left_id").isNotNull()
    both = _audited(both, F.lit(False), lost, operation, now)
    both = both.withColumn("prev_entity_id", F.when(lost, F.col("entity_id")).otherwise(F.col("prev_entity_id")))
    return both.withColumn("entity_id", F.when(lost, F.lit(0).cast("long")).otherwise(F.col("entity_id"))).drop("left_id")


def resolve_orphans(stored: DataFrame, snapshot_records: DataFrame, entities: DataFrame) -> DataFrame:
    """(data_source, record_id, outcome, entity_id) of every orphan: ``delete`` if no snapshot has it, ``follow_up`` if its
    entity is not loaded yet, else ``attach``."""
    orphans = stored.where("entity_id = 0").select("data_source", "record_id")
    owner = snapshot_records.select("data_source", "record_id", "entity_id").dropDuplicates(["data_source", "record_id"])
    loaded = entities.select("entity_id", F.lit(True).alias("loaded"))
    found = orphans.join(owner, ["data_source", "record_id"], "left").join(loaded, "entity_id", "left")
    outcome = F.when(F.col("entity_id").isNull(), "delete").when(F.col("loaded").isNull(), "follow_up").otherwise("attach")
    return found.select("data_source", "record_id", outcome.alias("outcome"), "entity_id")


def apply_orphans(stored: DataFrame, outcomes: DataFrame, snapshot_records: DataFrame, operation: str = "load", now: Column | None = None) -> DataFrame:
    """``stored`` with orphans deleted or attached as :func:`resolve_orphans` found."""
    keys = ["data_source", "record_id"]
    kept = stored.join(outcomes.where("outcome = 'delete'").select(*keys), keys, "left_anti")
    back = snapshot_records.join(outcomes.where("outcome = 'attach'").select(*keys, "entity_id"), [*keys, "entity_id"], "left_semi")
    return upsert_records(kept, back, operation, now).drop("change")


def relation_rows(relations: DataFrame) -> DataFrame:
    """Undirected relations with relation_hash."""
    parts = [F.col(c).cast("string") for c in ("match_type", "match_key", "rev_match_key", "errule_code")]
    return relations.select("entity_id", "related_id", "match_type", "match_key", "rev_match_key", "errule_code", fingerprint(*parts).alias("relation_hash"))


def upsert_relations(stored: DataFrame, fresh: DataFrame, operation: str = "load", now: Column | None = None) -> DataFrame:
    """Insert pairs of ``fresh`` (of :func:`relation_rows`), or update where the hash differs."""
    keys, values = ["entity_id", "related_id"], ("match_type", "match_key", "rev_match_key", "errule_code", "relation_hash")
    new = fresh.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("given"))
    both = stored.withColumn("there", F.lit(True)).join(new, keys, "full_outer")
    inserted = F.col("there").isNull()
    changed = F.col("given").isNotNull() & ~inserted & ~F.col("relation_hash").eqNullSafe(F.col("new_relation_hash"))
    both = _audited(both, inserted, changed, operation, now)
    both = both.withColumn("prev_relation_hash", F.when(changed, F.col("relation_hash")).otherwise(F.col("prev_relation_hash")))
    rows = both.select("*", *[F.when(inserted | changed, F.col(f"new_{v}")).otherwise(F.col(v)).alias(f"out_{v}") for v in values])
    return rows.select(*keys, *[F.col(f"out_{v}").alias(v) for v in values], "prev_relation_hash", *AUDIT)


def delete_relations(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """``stored`` without the pairs of ``gone`` (entity_id, related_id), given in either direction."""
    pairs = gone.select(F.least("entity_id", "related_id").alias("entity_id"), F.greatest("entity_id", "related_id").alias("related_id")).distinct()
    return stored.join(pairs, ["entity_id", "related_id"], "left_anti")


def stale_relations(stored: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, related_id, kind) for the given entities: stored pairs their snapshot does not know (``unknown``), and pairs
    it knows that are not stored (``missing``). ``relations`` are directed."""
    pairs = ["entity_id", "related_id"]
    both = stored.select(*pairs).union(stored.select(F.col("related_id"), F.col("entity_id"))).distinct()
    own = entities.select("entity_id").distinct()
    there, known = both.join(own, "entity_id", "left_semi"), relations.select(*pairs).distinct().join(own, "entity_id", "left_semi")
    unknown = there.join(known, pairs, "left_anti").withColumn("kind", F.lit("unknown"))
    return unknown.unionByName(known.join(there, pairs, "left_anti").withColumn("kind", F.lit("missing")))


def follow_ups(old: tuple[DataFrame, ...], new: tuple[DataFrame, ...]) -> DataFrame:
    """(entity_id) of the entities to be refreshed again: the other side of every relation that was added, changed or removed,
    all related entities where an entity's own set of sources changed, and the entity itself if anything else is followed."""
    changed = relations_diff(old[1], new[1], old[0], new[0]).select("entity_id", "related_id")
    before, after = source_sets(old[0]), source_sets(new[0]).withColumnRenamed("sources", "now")
    moved = before.join(after, "entity_id", "full_outer").where("NOT (sources <=> now)").select("entity_id")
    follow = changed.union(new[1].join(moved, "entity_id", "left_semi").select("entity_id", "related_id"))
    return follow.select(F.explode(F.array("related_id", "entity_id")).alias("entity_id")).distinct()


def removed_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_id, data_source, record_id) that an entity no longer has."""
    return records_diff(old, new).where("kind = 'removed'").drop("kind")
