import time

from tallymart.sources import messages as msg
from tallymart.sources import snapshots as snap
from tallymart.scratch import shared_path
from tallymart.streaming.collapse import collapse_stream


def test_bodies(spark):
    one = '{"DATA_SOURCE":"A","RECORD_ID":"1","AFFECTED_ENTITIES":[{"ENTITY_ID":5},{"ENTITY_ID":5},{"ENTITY_ID":6}]}'
    camel = '{"dataSource":"B","recordId":"2","affectedEntities":[{"entityId":7}]}'
    bodies = [one, f"[{one},{camel}]", "", "  \n", None, "junk", "[1", f" {camel} ", "{}", "[]", one.replace(":6", ':"oops"'), '{"DATA_SOURCE":"A","AFFECTED_ENTITIES":"7"}', '{"NOTICES":3}']
    feed = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    messages = msg.read_messages(feed)
    assert [(r.id, r.number, r.message.data_source) for r in messages.orderBy("id", "number").collect()] == [(0, 0, "A"), (1, 0, "A"), (1, 1, "B"), (7, 0, "B"), (8, 0, None), (10, 0, "A"), (11, 0, "A"), (12, 0, None)]
    assert sorted(r.entity_id for r in msg.affected_entities(messages).collect()) == [5, 5, 5, 6, 6, 7, 7]
    assert sorted(r.record_id for r in msg.touched_records(messages).collect()) == ["1", "1", "1", "2", "2"]
    assert [r.id for r in msg.dead_letters(feed).orderBy("id").collect()] == [5, 6, 10, 11, 12]


def test_duplicates_and_self_relations(spark):
    body = """{"id":1,"name":"n","records":[{"src":"A","id":"1","mkey":"first"},{"src":"A","id":"1","mkey":"second"},{"src":"A","id":"2","mkey":" "}],
      "related":[{"id":2,"matchType":"POSSIBLE_MATCH","matchKey":"old"},{"id":2,"matchType":"POSSIBLE_MATCH","matchKey":"new"},{"id":1,"matchType":"POSSIBLE_MATCH","matchKey":"self"}]}"""
    s = snap.parse_snapshots(spark.createDataFrame([(body,), ("junk",)], "body string"))
    assert sorted((r.record_id, r.match_key) for r in snap.snapshot_records(s).collect()) == [("1", "first"), ("2", None)]
    assert [(r.related_id, r.match_key) for r in snap.snapshot_relations(s).collect()] == [(2, "new")]
    assert snap.self_relations(s).count() == 1 and s.where("entity_id IS NULL").count() == 1


def test_quiet_requests_are_collapsed(spark):
    path, out = shared_path(spark, "test-requests"), []
    spark.createDataFrame([(1,), (1,), (2,)], "entity_id long").write.parquet(path)
    feed = spark.readStream.schema("entity_id long").parquet(path)
    stream = collapse_stream(feed, quiet=1, longest=30).writeStream.foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect()))
    running = stream.option("checkpointLocation", shared_path(spark, "test-state")).trigger(processingTime="1 second").start()
    end = time.time() + 90
    try:
        while len(out) < 2 and time.time() < end:
            time.sleep(0.5)
    finally:
        running.stop()
    assert sorted(out) == [(1, 2), (2, 1)]
