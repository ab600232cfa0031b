"""Incremental refresh: changed entity ids in, the next version of the mart out.

A micro-batch names changed entities. Their newest snapshots are compared with the stored state; the same contribution operators
that rebuild the mart give signed changes, which are added to the stored reports. Entities whose change touches others cause
those to be refreshed too, until nothing new is named, since no later message need come.

All work stays with the named entities and their neighbourhood: who takes a record from whom, the relations of both, the far
ends' sources. What is stored, and the snapshots where they are stored likewise, are asked for the rows of some entities or record
keys (:class:`Frames` over tables of any kind, :class:`Buckets` over stored buckets, of which it reads only those that hold them), and
only rows that change are written. A pass looks at the entities that the pass before named, so a chain of follow-ups costs its length.

A record that an entity lost and no snapshot holds becomes an orphan: its row stays, owned by entity 0. Each batch begins with the
orphans that are stored: where a snapshot holds one by then, its entity is refreshed and adopts it, the others are deleted.

Snapshots may carry versions. One that is older than what was applied for its entity is not applied, so batches in wrong order
leave the newer state.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.keys import directed, orient_relations
from ..operators.contributions import contributions, difference
from ..operators.rollup import pending_detail, rollup_pending
from ..operators.tables import entity_rows, follow_ups, orphan_records, relation_rows, resolve_orphans, upsert_entities, upsert_records, upsert_relations
from ..plans.mart import REPLACED, Mart, changed, rebuild
from ..scratch import at_once, passing, remove, settle, settle_all
from ..sources.messages import affected_entities, dead_letters, read_messages
from ..sources.store import BLOCK, LOADED, Stored, current, listed, write_change, write_mart, write_whole
from .waiting import WAITING, Delays, ask, due

#: How often a snapshot with a relation that lacks its match key is read again.
RETRIES = 5
#: Buckets of a mart that a stream begins.
BUCKETS = 64
KEYS, PAIR = ["data_source", "record_id"], ["entity_id", "related_id"]


def _of(rows: DataFrame, ids: DataFrame, column: str = "entity_id", how: str = "left_semi") -> DataFrame:
    return rows.join(ids.select(F.col("entity_id").alias(column)), column, how)


def _touching(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Undirected ``pairs`` with either end among ``ids``."""
    near = _of(pairs, ids)
    return near.unionByName(_of(_of(pairs, ids, "related_id"), ids, how="left_anti").select(near.columns))


def _ids(*columns: DataFrame) -> DataFrame:
    """Distinct ids of tables of one column."""
    return reduce(DataFrame.union, columns).toDF("entity_id").distinct()


class Frames:
    """Rows of some entities or record keys out of whole tables: ``record`` (those of entity 0 are orphans), undirected ``relation``,
    ``entity`` (names at least) and ``seen`` (entity_id, snapshot_version)."""

    def __init__(self, record: DataFrame, relation: DataFrame, entity: DataFrame | None = None, seen: DataFrame | None = None):
        self.record, self.relation, self.entity, self.seen = record, relation, entity, seen

    def records(self, ids: DataFrame) -> DataFrame:
        return _of(self.record.where("entity_id <> 0"), ids)

    def holders(self, keys: DataFrame) -> DataFrame:
        """(data_source, record_id, entity_id) of the records of ``keys`` that an entity holds."""
        return self.record.where("entity_id <> 0").select(*KEYS, "entity_id").join(keys.select(*KEYS), KEYS, "left_semi")

    def orphans(self, keys: DataFrame | None = None) -> DataFrame:
        lost = self.record.where("entity_id = 0")
        return lost if keys is None else lost.join(keys.select(*KEYS), KEYS, "left_semi")

    def relations(self, ids: DataFrame) -> DataFrame:
        return _touching(self.relation, ids)

    def entities(self, ids: DataFrame) -> DataFrame:
        return _of(self.entity, ids)

    def entity_names(self) -> bool:
        """Whether names of entities are given."""
        return self.entity is not None

    def versions(self, ids: DataFrame) -> DataFrame | None:
        return None if self.seen is None else _of(self.seen, ids)


class Buckets(Frames):
    """The same out of stored tables, of which only the buckets that may hold the rows are read."""

    def __init__(self, stored: Stored):
        self.stored = stored

    def entity_names(self) -> bool:
        return True

    def records(self, ids: DataFrame) -> DataFrame:
        return self.stored.of("record", ids)

    def holders(self, keys: DataFrame) -> DataFrame:
        return self.stored.of("owner", keys).select(*KEYS, "entity_id")

    def orphans(self, keys: DataFrame | None = None) -> DataFrame:
        return self.stored.table("orphan") if keys is None else self.stored.of("orphan", keys)

    def relations(self, ids: DataFrame) -> DataFrame:
        near = self.stored.of("relation", ids)
        far = self.stored.of("far", ids.select(F.col("entity_id").alias("related_id")))
        return near.unionByName(_of(far, ids, how="left_anti").select(near.columns))

    def entities(self, ids: DataFrame) -> DataFrame:
        return self.stored.of("entity", ids)

    def versions(self, ids: DataFrame) -> DataFrame | None:
        return self.stored.of("seen", ids) if "seen" in self.stored.state.schemas else None


def write_snapshots(records: DataFrame, relations: DataFrame, names: DataFrame, path: str, versions: DataFrame | None = None, batch: int = LOADED, buckets: int | None = None, block: int = BLOCK) -> bool:
    """Store the newest snapshots of all entities in buckets below ``path``, to be read by :class:`Buckets`."""
    tables = {"record": records, "owner": records.select(*KEYS, "entity_id"), "relation": relations, "far": relations, "entity": names}
    return write_whole(tables | ({"seen": versions} if versions is not None else {}), path, batch, buckets=buckets, block=block)


def empty_mart(spark: SparkSession) -> Mart:
    records = spark.createDataFrame([], "entity_id long, data_source string, record_id string, match_key string, errule_code string")
    relations = spark.createDataFrame([], "entity_id long, related_id long, match_type string, match_key string, rev_match_key string, errule_code string")
    return rebuild(records, relations)


class _Local:
    """Old and new state around some entities, ``ids`` of which take their newest snapshots.

    A record belongs to one entity: where a refreshed entity lists a record that another, not refreshed, still holds, the
    refreshed one owns it. A relation is stored once, so a refreshed side decides for both directions.
    """

    RECORD = ["entity_id", *KEYS, "match_key", "errule_code"]
    PAIRS = [*PAIR, "match_type", "match_key", "rev_match_key", "errule_code"]

    def __init__(self, mart: Frames, snapshots: Frames, ids: DataFrame):
        self.mart, self.snapshots, self.ids = mart, snapshots, ids

    def owners(self, ids: DataFrame) -> DataFrame:
        """The entities ``ids`` and those that lose a record to them."""
        return _ids(ids, self.mart.holders(self.snapshots.records(ids)).select("entity_id"))

    def old_pairs(self, core: DataFrame) -> DataFrame:
        return self.mart.relations(core).select(*self.PAIRS)

    def new_pairs(self, core: DataFrame) -> DataFrame:
        kept = _of(_of(self.old_pairs(core), self.ids, how="left_anti"), self.ids, "related_id", "left_anti").select(*self.PAIRS)
        return kept.unionByName(_touching(self.snapshots.relations(core).select(*self.PAIRS), self.ids))

    def old_records(self, region: DataFrame) -> DataFrame:
        return self.mart.records(region).select(*self.RECORD)

    def new_records(self, region: DataFrame) -> DataFrame:
        fresh = self.snapshots.records(self.ids).select(*self.RECORD)
        kept = _of(self.old_records(region), self.ids, how="left_anti").join(fresh.select(*KEYS), KEYS, "left_anti")
        return _of(fresh, region).select(*self.RECORD).unionByName(kept.select(*self.RECORD))


def _named_next(mart: Frames, snapshots: Frames, ids: DataFrame, front: DataFrame) -> DataFrame:
    """(entity_id) that the refresh of ``front``, a part of ``ids``, causes to be refreshed: the other sides of changed relations,
    and the owners of records that ``front`` no longer has."""
    local = _Local(mart, snapshots, ids)
    core = settle(local.owners(front), "refresh-core")
    old, new = settle_all([directed(pairs(core)) for pairs in (local.old_pairs, local.new_pairs)], "refresh-pairs")
    region = settle(_ids(core, old.select("related_id"), new.select("related_id")), "refresh-region")
    before, after = settle_all([local.old_records(region), local.new_records(region)], "refresh-records")
    follow = follow_ups((before, old), (after, new))
    # Lost records that other entities' newest snapshots hold, and which no refreshed entity has taken.
    lost = _of(before, front).join(after.select(*KEYS), KEYS, "left_anti").withColumn("entity_id", F.lit(0).cast("long"))
    found = resolve_orphans(lost, snapshots.holders(lost), ids.limit(0)).where("outcome = 'follow_up'").select("entity_id")
    return _of(_ids(follow, found), ids, how="left_anti")


def _admitted(mart: Frames, snapshots: Frames, ids: DataFrame) -> DataFrame:
    """``ids`` without those whose snapshot is older than what was applied."""
    given, stored = snapshots.versions(ids), mart.versions(ids)
    if given is None or stored is None:
        return ids
    older = given.alias("g").join(stored.select("entity_id", F.col("snapshot_version").alias("applied")), "entity_id").where("snapshot_version < applied")
    return _of(ids, older, how="left_anti")


def changes(mart: Frames, snapshots: Frames, named: DataFrame, operation: str = "refresh", passes: int | None = None) -> tuple[Mart, DataFrame, DataFrame]:
    """(change, refreshed, left): the change of ``mart`` after the entities ``named`` (entity_id), and those that follow, took their
    newest snapshots; the ids refreshed; those still to be.

    An entity without snapshot records is gone. Changed records tell their owner before (``was``). ``passes``: None goes on until
    nothing is left.
    """
    # Orphans first: adopted where a snapshot holds them, else deleted.
    orphans = settle(mart.orphans(), "refresh-orphans")
    homes = settle(resolve_orphans(orphans, snapshots.holders(orphans), named.select("entity_id").limit(0)), "refresh-homes")
    asked = named.select("entity_id").where("entity_id <> 0").union(homes.where("outcome <> 'delete'").select("entity_id")).distinct()
    ids = front = settle(_admitted(mart, snapshots, settle(asked, "refresh-asked")), "refresh-ids")
    done = 0
    while True:
        left = settle(_admitted(mart, snapshots, settle(_named_next(mart, snapshots, ids, front), "refresh-next")), "refresh-left")
        done += 1
        if left.isEmpty() or done == passes:
            break
        ids, front = ids.union(left), left
        if done % 8 == 0:
            ids = settle(ids, "refresh-ids")
    local = _Local(mart, snapshots, ids)
    core = settle(local.owners(ids), "refresh-core")
    old, new = local.old_pairs(core), local.new_pairs(core)
    # The entities whose contributions may differ: the core and all its neighbours; these need all their own relations.
    around = settle(_ids(core, *[p.select(c) for p in (old, new) for c in PAIR]), "refresh-around")
    old, new = settle_all([directed(pairs(around)) for pairs in (local.old_pairs, local.new_pairs)], "refresh-pairs")
    region = settle(_ids(around, old.select("related_id"), new.select("related_id")), "refresh-region")
    before, after = settle_all([local.old_records(region), local.new_records(region)], "refresh-records")
    own = lambda rows: _of(rows, around)
    was, now = at_once([lambda: contributions(own(before), own(old), before), lambda: contributions(own(after), own(new), after)])
    deltas = settle(difference(was, now), "refresh-deltas")

    stored = mart.entities(around)
    given = snapshots.entities(ids) if snapshots.entity_names() else ids.withColumn("entity_name", F.lit(None).cast("string"))
    known = given.select("entity_id", "entity_name").unionByName(_of(stored, ids, how="left_anti").select("entity_id", "entity_name"))
    rows = entity_rows(own(after), own(new), known, after)
    entity = _changed("entity", stored, upsert_entities(_of(stored, rows), rows, operation))
    change = (entity, _record_change(mart, snapshots, ids, orphans, homes, operation), _relation_change(mart, snapshots, ids, operation), rollup_pending(deltas), pending_detail(deltas))
    return Mart(*settle_all(change, "refresh-change")), ids, left


def _record_change(mart: Frames, snapshots: Frames, ids: DataFrame, orphans: DataFrame, homes: DataFrame, operation: str) -> DataFrame:
    """Records inserted, moved, adopted, orphaned or deleted, with their owner before."""
    fresh = settle(snapshots.records(ids).select(*_Local.RECORD), "refresh-fresh")
    # What the refreshed entities hold, what they take from others, and the orphans that are taken or deleted.
    held = mart.records(ids)
    taken = _of(mart.records(mart.holders(fresh).select("entity_id").distinct()), ids, how="left_anti").join(fresh.select(*KEYS), KEYS, "left_semi")
    deleted = homes.where("outcome = 'delete'").select(*KEYS)
    free = orphans.join(fresh.select(*KEYS).union(deleted).distinct(), KEYS, "left_semi")
    stored = settle(held.unionByName(taken.select(held.columns)).unionByName(free.select(held.columns)), "refresh-stored")
    kept = stored.join(deleted.join(fresh.select(*KEYS), KEYS, "left_anti"), KEYS, "left_anti")
    lost = _of(stored, ids).join(fresh.select(*KEYS), KEYS, "left_anti")
    next_rows = orphan_records(upsert_records(kept, fresh, operation).drop("change"), lost, operation)
    was = stored.select(*KEYS, F.col("entity_id").alias("was"))
    return _changed("record", stored, next_rows).join(was, KEYS, "left")


def _relation_change(mart: Frames, snapshots: Frames, ids: DataFrame, operation: str) -> DataFrame:
    stored, fresh = mart.relations(ids), relation_rows(snapshots.relations(ids).select(*_Local.PAIRS))
    return _changed("relation", stored, upsert_relations(stored.join(fresh.select(*PAIR), PAIR, "left_semi"), fresh, operation))


def _changed(name: str, stored: DataFrame, next_rows: DataFrame) -> DataFrame:
    """Rows of ``next_rows`` that ``stored`` has not like that, and those of ``stored`` whose keys are gone."""
    keys = list(REPLACED[name])
    values = [c for c in stored.columns if c not in keys]
    before = stored.select(*keys, F.struct(*values).alias("before"))
    kept = next_rows.select(*keys, F.struct(*values).alias("after"))
    both = before.join(kept, keys, "full_outer").where("NOT (before <=> after)")
    gone = F.col("after").isNull()
    return both.select(*keys, F.coalesce("after", "before").alias("row"), gone.alias("gone")).select(*keys, "row.*", "gone")


def refresh(mart: Mart, records: DataFrame, relations: DataFrame, named: DataFrame, names: DataFrame | None = None, operation: str = "refresh", passes: int | None = None) -> tuple[Mart, DataFrame]:
    """The next mart, and the ids still to be refreshed; ``records``, undirected ``relations`` and ``names`` are the newest snapshots of
    all entities. See :func:`changes`."""
    change, _, left = changes(Frames(mart.record, mart.relation, mart.entity), as_snapshots((records, relations, *([names] if names is not None else []))), named, operation, passes)
    return changed(mart, change), left


def as_snapshots(given: Frames | tuple[DataFrame, ...]) -> Frames:
    """Snapshots given as (records, undirected relations or directed ones without reverse key, names, versions), the last two left
    out or not."""
    if isinstance(given, Frames):
        return given
    records, relations, *more = given
    if "rev_match_key" not in relations.columns:
        relations = settle(orient_relations(relations), "refresh-relations")
    return Frames(records, relations, *more)


def ingest_stream(spark: SparkSession, path: str, schema: str = "body string", files_per_trigger: int = 100) -> DataFrame:
    """Streaming message feed from a folder of Parquet files, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_keys(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id) of ``ids`` whose newest snapshot has a relation without match key: to be read again."""
    return _ids(directed(_touching(relations.where("match_key IS NULL"), ids)).join(ids, "entity_id", "left_semi").select("entity_id"))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that keeps its state at ``checkpoint``: the same after a restart, another one for a new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def refresh_stream(
    feed: DataFrame, snapshots: Callable[[], Frames | tuple[DataFrame, ...]], mart_path: str, checkpoint: str, letters: str | None = None, trigger: dict | None = None, buckets: int = BUCKETS, delays: Delays | None = None
) -> StreamingQuery:
    """Start the refresh of the mart at ``mart_path`` by the message ``feed`` (body).

    ``snapshots`` gives the newest snapshots (see :func:`as_snapshots`) when a batch runs, so the order of messages does not
    matter. A batch that is replayed after a failure is applied once, another stream's batches are applied too. Bodies that do not
    parse are written to ``letters``, in a folder for each stream and batch. Entities with a relation that lacks its match key are
    refreshed again with the next batches, ``RETRIES`` times at most. ``trigger``: arguments of the writer's trigger, every 60 seconds
    by default. ``buckets``: those of a mart that does not exist yet.

    With ``delays``, named entities wait until they are due (see :mod:`.waiting`), and those that follow are asked for
    like them instead of within the batch. A source of ticks runs beside the feed then, so that batches come without messages
    too; the trigger must be one of processing time, as such a stream has no end.
    """

    def apply(batch: DataFrame, number: int) -> None:
        with passing(batch.sparkSession, "refresh"):
            apply_batch(batch, number, snapshots(), mart_path, stream_id(batch.sparkSession, checkpoint), letters, buckets, delays)

    trigger = trigger or {"processingTime": "60 seconds"}
    if delays:
        if "processingTime" not in trigger:
            raise ValueError(f"requests that wait need a trigger of processing time: {trigger}")
        ticks = feed.sparkSession.readStream.format("rate").load().where("value < 0")
        feed = feed.select("body").unionByName(ticks.select(F.lit(None).cast("string").alias("body")))
    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def apply_batch(batch: DataFrame, number: int, snapshots: Frames | tuple[DataFrame, ...], mart_path: str, stream: str, letters: str | None = None, buckets: int = BUCKETS, delays: Delays | None = None, now: dt.datetime | None = None) -> bool:
    """Refresh the mart at ``mart_path`` by the messages of a ``batch``; False if ``stream`` applied this number before, or if no
    request is due yet under ``delays`` at the time ``now``."""
    if letters and not (delays and batch.isEmpty()):
        dead_letters(batch).write.mode("overwrite").parquet(f"{letters}/stream={stream}/batch={number}")
    named = affected_entities(read_messages(batch).select("message")).select("entity_id")
    if delays:
        return refresh_due(named, number, snapshots, mart_path, stream, delays, now or dt.datetime.now(dt.UTC), buckets)
    return refresh_named(named.distinct(), number, snapshots, mart_path, stream, buckets)


def refresh_due(named: DataFrame, number: int, snapshots: Frames | tuple[DataFrame, ...], mart_path: str, stream: str, delays: Delays, now: dt.datetime, buckets: int = BUCKETS) -> bool:
    """Ask for the entities ``named`` (a row for each request) and refresh those due at ``now``; False if none is, or if ``stream``
    applied this number before. What then waits, followers included, is written before the refresh is applied, so a
    replay of the batch begins with what the batch before left."""
    spark = named.sparkSession
    if number <= current(spark, mart_path, stream)[1]:
        return False
    folder = f"{mart_path}/_waiting/{stream}"
    kept = sorted(int(name.removeprefix("batch-")) for name in listed(spark, folder))
    before = [n for n in kept if n < number]
    waiting = spark.read.schema(WAITING).parquet(f"{folder}/batch-{before[-1]}") if before else spark.createDataFrame([], WAITING)
    asked = settle(ask(waiting, named, now), "waiting")
    ripe = settle(due(asked, now, delays), "due")

    def keep(left: DataFrame) -> None:
        ask(_of(asked, ripe, how="left_anti"), left, now).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch-{number}")

    if ripe.isEmpty():
        if not named.isEmpty():
            keep(named.limit(0))
        done = False
    else:
        done = refresh_named(ripe.select("entity_id"), number, snapshots, mart_path, stream, buckets, passes=1, keep=keep)
    # A replay of this batch needs the last one before it.
    for n in before[:-1]:
        remove(spark, f"{folder}/batch-{n}")
    return done


def refresh_named(
    named: DataFrame, number: int, snapshots: Frames | tuple[DataFrame, ...], mart_path: str, stream: str, buckets: int = BUCKETS, passes: int | None = None, keep: Callable[[DataFrame], None] | None = None
) -> bool:
    """Refresh the mart at ``mart_path`` by the entities ``named``, as batch ``number`` of ``stream``. After ``passes``, those still to be
    refreshed (entity_id) are given to ``keep``, before the batch is applied."""
    spark = named.sparkSession
    version, applied = current(spark, mart_path, stream)
    if number <= applied:
        return False
    if version < 0:
        write_mart(empty_mart(spark), mart_path, LOADED, buckets=buckets)
    waiting = lambda n: f"{mart_path}/_retries/{stream}/batch-{n}"
    schema = "entity_id long, attempt int"
    # What the batch before left, which was written before it was applied.
    again = spark.read.schema(schema).parquet(waiting(applied)).where(F.col("attempt") <= RETRIES) if applied >= 0 else spark.createDataFrame([], schema)
    again = settle(again.groupBy("entity_id").agg(F.max("attempt").alias("attempt")), "retries")
    fresh, mart = as_snapshots(snapshots), Buckets(Stored(spark, mart_path))
    change, ids, left = changes(mart, fresh, named.select("entity_id").union(again.select("entity_id")), f"batch-{number}", passes)
    if keep:
        keep(left)
    missing = without_keys(fresh.relations(ids), ids).join(again, "entity_id", "left").select("entity_id", (F.coalesce("attempt", F.lit(0)) + 1).cast("int").alias("attempt"))
    missing.write.mode("overwrite").parquet(waiting(number))
    write_change(change, mart_path, number, stream, fresh.versions(ids))
    if applied >= 0:
        remove(spark, waiting(applied))
    return True
