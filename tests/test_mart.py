import random

import pytest
from pyspark.sql import functions as F

from tallymart.functions.keys import reverse_match_key
from tallymart.operators.rollup import reconcile
from tallymart.plans.mart import Mart, rebuild
from tallymart.scratch import settle, shared_path
from tallymart.sources import store
from tallymart.sources.store import LOAD, LOADED, Stored, current, read_mart, write_mart
from tallymart.streaming import refresh as streaming
from tallymart.streaming.refresh import Buckets, apply_batch, empty_mart, refresh, refresh_named, refresh_stream, write_snapshots

RECORDS = "entity_id long, data_source string, record_id string, match_key string, errule_code string"
RELATIONS = "entity_id long, related_id long, match_type string, match_key string, rev_match_key string, errule_code string"


def state(spark, seed, entities=12):
    """A random state in which records move between entities from one seed to the next."""
    rng = random.Random(seed)
    records = [(rng.randint(1, entities), rng.choice(["A", "B C"]), str(i), rng.choice([None, "+NAME", "+N+DOB"]), rng.choice([None, "R1", "R2"])) for i in range(30) if rng.random() < 0.8]
    records = [r for i, r in enumerate(records) if not any(q[1:3] == r[1:3] for q in records[:i])]
    there = sorted({r[0] for r in records})
    pairs = {(a, b) for a in there for b in there if a < b and rng.random() < 0.15}
    types = ["AMBIGUOUS_MATCH", "POSSIBLE_MATCH", "POSSIBLE_RELATION", "DISCLOSED_RELATION"]
    relations = [(a, b, rng.choice(types), rng.choice([None, "+ADDR", "+R(X:Y)"]), rng.choice([None, "P"])) for a, b in sorted(pairs)]
    links = spark.createDataFrame(relations, "entity_id long, related_id long, match_type string, match_key string, errule_code string").withColumn("rev_match_key", reverse_match_key(F.col("match_key")))
    return spark.createDataFrame(records, RECORDS), links.select("entity_id", "related_id", "match_type", "match_key", "rev_match_key", "errule_code")


def same(mart, records, relations, names=None):
    true = rebuild(records, relations, names)
    counts = ["entity_count", "record_count", "relation_count"]
    assert reconcile(mart.report, true.report, ["report_key"], counts).count() == 0
    assert reconcile(mart.report_detail, true.report_detail, ["report_key", "entity_id", "related_id"], ["stat_count"]).count() == 0
    for table, columns in (("entity", ["entity_id", "entity_name", "record_count", "relation_count", "entity_hash"]), ("record", ["data_source", "record_id", "entity_id", "match_key", "errule_code"]), ("relation", ["entity_id", "related_id", "match_type", "match_key", "rev_match_key"])):
        rows = lambda m: getattr(m, table).where("entity_id <> 0").select(*columns).collect()  # noqa: E731  orphans are no part of a state
        a, b = (sorted(map(repr, rows(m))) for m in (mart, true))
        assert a == b, table


def test_incremental_equals_rebuild(spark):
    """Loads, changes, deletion of everything and a second load, each as one batch of changed ids."""
    nothing = (spark.createDataFrame([], RECORDS), spark.createDataFrame([], RELATIONS))
    mart = empty_mart(spark)
    for step in (state(spark, 1), state(spark, 2), nothing, state(spark, 3)):
        ids = spark.range(1, 13).withColumnRenamed("id", "entity_id")
        mart, left = refresh(mart, *step, ids)
        assert left.isEmpty()
        mart = type(mart)(*[settle(getattr(mart, t), f"test-{t}") for t in mart.__dataclass_fields__])
        same(mart, *step)


def test_follow_ups_reach_the_new_state(spark):
    """Only entities with changed records are named; the others come in through follow-ups."""
    before, after = state(spark, 5), state(spark, 6)
    mart = rebuild(*before)
    named = before[0].select("entity_id").union(after[0].select("entity_id")).distinct()
    mart, left = refresh(mart, *after, named)
    assert left.isEmpty()
    same(mart, *after)


def test_versions_and_replay(spark):
    path = shared_path(spark, "test-mart")
    first, second = rebuild(*state(spark, 1)), rebuild(*state(spark, 2))
    assert read_mart(spark, path) is None
    assert write_mart(first, path, LOADED) and write_mart(second, path, 0)
    assert not write_mart(first, path, 0) and current(spark, path, LOAD) == (1, 0)
    assert sorted(map(repr, read_mart(spark, path).report.collect())) == sorted(map(repr, second.report.collect()))


def test_prior_owner_and_audit(spark):
    from tallymart.operators import tables as M

    old = spark.createDataFrame([(1, "A", "1", "k", None), (2, "A", "2", None, None), (3, "A", "3", None, None)], RECORDS)
    new = spark.createDataFrame([(2, "A", "1", "k", None), (2, "A", "2", "new", None), (9, "A", "4", None, None)], RECORDS)
    stored = M.orphan_records(M.record_table(old, "one"), spark.createDataFrame([(3, "A", "3"), (1, "A", "2")], "entity_id long, data_source string, record_id string"), "two")
    out = {r.record_id: r for r in M.upsert_records(stored, new, "three").collect()}
    assert (out["1"].entity_id, out["1"].prev_entity_id, out["1"].change, out["1"].creator_id, out["1"].modifier_id) == (2, 1, "move", "one", "three")
    assert (out["2"].change, out["2"].match_key) == ("update", "new") and out["4"].change == "insert"
    assert (out["3"].entity_id, out["3"].prev_entity_id, out["3"].modifier_id, out["3"].change) == (0, 3, "two", None)
    back = M.upsert_records(stored, old.where("record_id = '3'"), "four").where("record_id = '3'").first()
    assert (back.change, back.adopter_id, back.entity_id) == ("adopt", "four", 3)


@pytest.mark.parametrize("seed", [7])
def test_report_keeps_zero_rows(spark, seed):
    mart, _ = refresh(rebuild(*state(spark, seed)), spark.createDataFrame([], RECORDS), spark.createDataFrame([], RELATIONS), spark.range(1, 13).withColumnRenamed("id", "entity_id"))
    assert mart.report.count() > 0 and mart.report.where("entity_count <> 0 OR record_count <> 0 OR relation_count <> 0").count() == 0
    assert mart.report_detail.count() == 0 and mart.entity.count() == 0


def test_stream_follows_a_long_chain(spark):
    """Every entity gets a relation to the next one; the feed names only the first."""
    n, path, feed = 13, shared_path(spark, "test-mart"), shared_path(spark, "test-feed")
    records = spark.createDataFrame([(i, "A", str(i), None, None) for i in range(1, n + 1)], RECORDS)
    chain = spark.createDataFrame([(i, i + 1, "POSSIBLE_MATCH", "+NAME", "+NAME", "P") for i in range(1, n)], RELATIONS)
    write_mart(rebuild(records, spark.createDataFrame([], RELATIONS)), path, LOADED)
    spark.createDataFrame([('{"DATA_SOURCE":"A","RECORD_ID":"1","AFFECTED_ENTITIES":[{"ENTITY_ID":1}]}',)], "body string").write.parquet(feed)
    stream = spark.readStream.schema("body string").parquet(feed)
    refresh_stream(stream, lambda: (records, chain), path, shared_path(spark, "test-state"), trigger={"availableNow": True}).awaitTermination()
    same(read_mart(spark, path), records, chain)


def feed_of(spark, *bodies):
    path = shared_path(spark, "test-feed")
    spark.createDataFrame([(b,) for b in bodies], "body string").write.parquet(path)
    return spark.readStream.schema("body string").parquet(path)


def body_of(*ids):
    return '{"DATA_SOURCE":"A","RECORD_ID":"1","AFFECTED_ENTITIES":[%s]}' % ",".join('{"ENTITY_ID":%d}' % i for i in ids)


def ids_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "entity_id long")


def test_only_full_buckets_are_merged_and_old_versions_go(spark, monkeypatch):
    """Fifty batches that rename one entity each: a bounded number of bytes, and every readable version is whole."""
    monkeypatch.setattr(store, "COMPACT", 3)
    path, (records, relations) = shared_path(spark, "test-mart"), state(spark, 1)
    names = spark.createDataFrame([(i, f"n{i}") for i in range(1, 13)], "entity_id long, entity_name string")
    mart = rebuild(records, relations, names)
    write_mart(mart, path, LOADED, buckets=4, block=1)
    some = sorted(r[0] for r in records.select("entity_id").distinct().collect())
    none = {t: getattr(mart, t).limit(0).withColumn("gone", F.lit(True)) for t in ("record", "relation")}
    sizes, expected = [], {r.entity_id: r.entity_name for r in mart.entity.collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    for batch in range(50):
        one = some[batch % 2]  # the buckets of the others are never rewritten
        expected[one] = f"b{batch}"
        entity = mart.entity.where(F.col("entity_id") == one).withColumn("entity_name", F.lit(f"b{batch}")).withColumn("gone", F.lit(False))
        change = Mart(entity, none["record"].withColumn("was", F.lit(0).cast("long")), none["relation"], mart.report.limit(0), mart.report_detail.limit(0))
        before = store.versions(spark, path)
        assert store.write_change(change, path, batch, "s")
        if batch % 10 == 9:
            assert not store.write_change(change, path, batch, "s")
            assert {r.entity_id: r.entity_name for r in read_mart(spark, path).entity.collect()} == expected
            known = store.versions(spark, path)
            assert len(known) == store.RETAIN and known[-1] > before[-1]
            for version in known:
                assert read_mart(spark, path, version).entity.count() == len(expected)
            sizes.append(files.getContentSummary(hadoop).getLength())
    assert max(sizes) < 1.3 * sizes[0]
    now = store.state(spark, path)
    touched = {b for b, v in now.bases["entity"].items() if v > 0}
    assert 0 < len(touched) <= 2 < len(now.bases["entity"]) and all(v == 0 for b, v in now.bases["record"].items())


def bytes_read(spark, df):
    """Bytes of the files that the scans of ``df`` read, from their metrics."""
    df.write.format("noop").mode("overwrite").save()
    plan, total, stack = df._jdf.queryExecution().executedPlan(), 0, []
    df.collect()
    stack.append(plan)
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
            continue
        if node.metrics().contains("filesSize"):
            total += node.metrics().apply("filesSize").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return total


def big_state(spark, n):
    ids = spark.range(1, n + 1)
    records = ids.select(F.col("id").alias("entity_id"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("data_source"), F.md5(F.col("id").cast("string")).alias("record_id"), F.lit("+NAME").alias("match_key"), F.lit("R").alias("errule_code"))
    relations = ids.where(f"id % 8 <> 0 AND id < {n}").select(F.col("id").alias("entity_id"), (F.col("id") + 1).alias("related_id"), F.lit("POSSIBLE_MATCH").alias("match_type"), F.lit("+N").alias("match_key"), F.lit("+N").alias("rev_match_key"), F.lit("P").alias("errule_code"))
    return records, relations, ids.select(F.col("id").alias("entity_id"), F.concat(F.lit("n"), "id").alias("entity_name"))


def test_a_hundredth_of_the_entities_reads_a_hundredth(spark):
    """Stored buckets, and snapshots stored likewise: the refresh of forty of 4,000 entities."""
    n, path, snaps = 4000, shared_path(spark, "test-mart"), shared_path(spark, "test-snapshots")
    records, relations, names = big_state(spark, n)
    write_mart(rebuild(records, relations, names), path, LOADED, buckets=256, block=32)
    moved = records.withColumn("data_source", F.when((F.col("entity_id").between(1025, 1064)) & (F.col("data_source") == "B"), "C").otherwise(F.col("data_source")))
    write_snapshots(moved, relations, names, snaps, buckets=256, block=32)
    stored, fresh = Stored(spark, path), Stored(spark, snaps)
    ids = settle(spark.range(1025, 1065).select(F.col("id").alias("entity_id")), "test-ids")
    for name, keys in (("entity", ids), ("record", ids), ("relation", ids), ("far", ids.select(F.col("entity_id").alias("related_id")))):
        for tables in (stored, fresh):
            whole, part = bytes_read(spark, tables.table(name)), bytes_read(spark, tables.of(name, keys))
            assert 0 < part < 0.05 * whole, (name, part, whole)
    assert refresh_named(ids, 0, Buckets(fresh), path, "s")
    assert not refresh_named(ids, 0, Buckets(fresh), path, "s")
    same(read_mart(spark, path), moved, relations, names)
    touched = store.state(spark, path).changes
    assert set(touched) >= {"entity", "record", "owner", "report"} and max(len(touched[t]) for t in ("entity", "record", "report_detail")) <= 6


def test_another_stream_begins_with_its_own_numbers(spark):
    path, records = shared_path(spark, "test-mart"), spark.createDataFrame([(i, "A", str(i), None, None) for i in (1, 2, 3)], RECORDS)
    nothing = spark.createDataFrame([], RELATIONS)
    for i in (1, 2):
        refresh_stream(feed_of(spark, body_of(i)), lambda: (records, nothing), path, shared_path(spark, "test-state"), trigger={"availableNow": True}, buckets=2).awaitTermination()
    assert sorted(r.entity_id for r in read_mart(spark, path).entity.collect()) == [1, 2]
    applied = store.state(spark, path).applied
    assert len(applied) == 3 and sorted(applied.values()) == [-1, 0, 0]


def test_orphans_stay_and_are_adopted(spark):
    """A batch loses two records, a later one finds one of them again."""
    path, none = shared_path(spark, "test-mart"), spark.createDataFrame([], RELATIONS)
    rows = [(1, "A", "1", "k", None), (1, "A", "2", "k", None), (1, "A", "3", "k", None), (2, "B", "1", None, None)]
    full = spark.createDataFrame(rows, RECORDS)
    write_mart(rebuild(full, none), path, LOADED, buckets=2)
    less = full.where("record_id = '1'")
    refresh_named(ids_of(spark, 1), 0, (less, none), path, "s")
    stored = {(r.data_source, r.record_id): (r.entity_id, r.prev_entity_id, r.adopter_id, r.modifier_id) for r in read_mart(spark, path).record.collect()}
    assert stored[("A", "2")] == stored[("A", "3")] == (0, 1, None, "batch-0") and stored[("A", "1")][0] == 1
    same(read_mart(spark, path), less, none)
    later = less.union(spark.createDataFrame([(2, "A", "2", "new", None)], RECORDS))
    refresh_named(ids_of(spark, 77), 1, (later, none), path, "s")  # nobody names entity 2
    stored = {(r.data_source, r.record_id): (r.entity_id, r.prev_entity_id, r.adopter_id, r.match_key) for r in read_mart(spark, path).record.collect()}
    assert stored[("A", "2")] == (2, 1, "batch-1", "new") and ("A", "3") not in stored
    same(read_mart(spark, path), later, none)


def test_older_snapshots_are_not_applied(spark):
    path, none = shared_path(spark, "test-mart"), spark.createDataFrame([], RELATIONS)
    write_mart(empty_mart(spark), path, LOADED, buckets=2)
    given = lambda version, key: (spark.createDataFrame([(1, "A", "1", key, None), (2, "A", "2", key, None)], RECORDS), none, ids_of(spark, 1, 2).withColumn("entity_name", F.lit(key)), spark.createDataFrame([(1, version), (2, 5)], "entity_id long, snapshot_version long"))
    for batch, (version, key) in enumerate(((5, "new"), (4, "old"))):
        refresh_named(ids_of(spark, 1, 2), batch, given(version, key), path, "s")
    found = {r.entity_id: r.match_key for r in read_mart(spark, path).record.collect()}
    assert found == {1: "new", 2: "old"}  # the second one's version is the same, so it is read again


def test_relations_without_keys_are_read_again_a_number_of_times(spark, monkeypatch):
    assert streaming.RETRIES == 5
    monkeypatch.setattr(streaming, "RETRIES", 2)
    path, calls = shared_path(spark, "test-mart"), []
    records = spark.createDataFrame([(1, "A", "1", None, None), (2, "A", "2", None, None)], RECORDS)
    pair = spark.createDataFrame([(1, 2, "POSSIBLE_MATCH", None, None, None)], RELATIONS)
    nobody = ids_of(spark)
    for batch in range(5):
        refresh_named(ids_of(spark, 1) if batch == 0 else nobody, batch, (records, pair), path, "s", buckets=1)
        left = spark.read.schema("entity_id long, attempt int").parquet(f"{path}/_retries/s/batch-{batch}")
        calls.append({r.entity_id: r.attempt for r in left.collect()})
    assert [c.get(1) for c in calls] == [1, 2, 3, None, None]
    assert store.listed(spark, f"{path}/_retries/s") == ["batch-4"]


def test_letters_of_a_replayed_batch_are_written_once(spark):
    path, letters = shared_path(spark, "test-mart"), shared_path(spark, "test-letters")
    bodies = spark.createDataFrame([("junk",), (body_of(1),)], "body string")
    given = (spark.createDataFrame([(1, "A", "1", None, None)], RECORDS), spark.createDataFrame([], RELATIONS))
    assert [apply_batch(bodies, 0, given, path, "s", letters, 1) for _ in range(2)] == [True, False]
    assert [(r.body, r.stream, r.batch) for r in spark.read.parquet(letters).collect()] == [("junk", "s", 0)]


def test_relations_without_keys_are_read_again(spark):
    from tallymart.streaming.refresh import without_keys

    pairs = spark.createDataFrame([(1, 2, "POSSIBLE_MATCH", None, None, None), (2, 3, "POSSIBLE_MATCH", "+N", "+N", None)], RELATIONS)
    assert sorted(r[0] for r in without_keys(pairs, spark.createDataFrame([(1,), (3,)], "entity_id long")).collect()) == [1]


def test_fingerprints_hold_no_list_of_an_entity(spark):
    from tallymart.operators.diff import entity_fingerprints

    none = spark.createDataFrame([], RELATIONS)
    hashed = lambda rows: entity_fingerprints(spark.createDataFrame(rows, RECORDS), none)
    a, b, c = (1, "A", "1", None, "R"), (1, "A", "2", "k", None), (1, "A", "1", "", "R")
    out = [hashed(rows).first().entity_hash for rows in ([a, b], [b, a], [a, a, b], [a, b, b], [a, a, a, b], [c, b], [a], [a, a, a])]
    assert out[0] == out[1] and len(set(out)) == 7
    assert "collect_list" not in hashed([a])._jdf.queryExecution().optimizedPlan().toString()
