import datetime as dt

import pytest

from tallymart.scratch import shared_path
from tallymart.sources.queue import enqueue, queue_stream

START = dt.datetime(2024, 1, 1)


def rows(spark, *pairs):
    data = [(i, START + dt.timedelta(seconds=s), None if i % 7 == 0 else f"b{i}") for i, s in pairs]
    return spark.createDataFrame(data, "message_id long, created_on timestamp, body string")


def drain(spark, path, state, most, lag=0):
    """Batches that the stream takes until nothing new is there, as sorted lists of ids."""
    taken = []
    take = lambda batch, n: taken.append([r.message_id for r in batch.orderBy("created_on", "message_id").collect()])
    running = queue_stream(spark, path, most, lag).writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return [ids for ids in taken if ids]


def test_oldest_first_in_bounded_batches_and_on_from_the_checkpoint(spark):
    path, state = shared_path(spark, "queue"), shared_path(spark, "queue-state")
    # Later messages lie in earlier files, times repeat, ids fall while times rise.
    enqueue(rows(spark, *[(100 - i, 50 + i // 3) for i in range(20)]).repartition(3), path)
    enqueue(rows(spark, *[(i, 10 + i) for i in range(15)]).repartition(2), path)
    expected = [i for i in range(15)] + [i for _, i in sorted((50 + i // 3, 100 - i) for i in range(20))]
    first = drain(spark, path, state, 8)
    assert [i for batch in first for i in batch] == expected and [len(b) for b in first] == [8, 8, 8, 8, 3]
    assert drain(spark, path, state, 8) == []
    enqueue(rows(spark, (7, 1000), (6, 1001), (5, 999)), path)
    assert drain(spark, path, state, 2) == [[5, 7], [6]]


def test_equal_keys_come_together_and_young_messages_wait(spark):
    path, state = shared_path(spark, "queue"), shared_path(spark, "queue-state")
    assert drain(spark, path, state, 2) == []  # no table yet
    enqueue(rows(spark, (1, 0), (1, 0), (1, 0), (2, 0)), path)
    assert drain(spark, path, state, 2) == [[1, 1, 1], [2]]
    now = dt.datetime.now(dt.UTC)
    enqueue(spark.createDataFrame([(3, now), (4, now - dt.timedelta(hours=1))], "message_id long, created_on timestamp").selectExpr("*", "'b' AS body"), path)
    assert drain(spark, path, state, 5, lag=600) == [[4]]
    assert drain(spark, path, state, 5) == [[3]]


def test_messages_without_place_stop_the_stream(spark):
    path = shared_path(spark, "queue")
    enqueue(spark.createDataFrame([(None, START, "b")], "message_id long, created_on timestamp, body string"), path)
    with pytest.raises(Exception, match="without created_on or message_id"):
        drain(spark, path, shared_path(spark, "queue-state"), 5)
    with pytest.raises(ValueError, match="one message at least"):
        queue_stream(spark, path, most=0)


def test_keys_are_read_once_for_many_batches(spark, monkeypatch, tmp_path):
    """Two files that overlap in time: each row group's keys are read once while they last, in bounded memory, in the right order."""
    from tallymart.sources import queue

    path = str(tmp_path / "queue")
    for part in (0, 1):
        enqueue(rows(spark, *[(i, i // 3) for i in range(200) if i % 2 == part]), path)
    reads, wanted = [], queue._wanted
    monkeypatch.setattr(queue, "_wanted", lambda group, files, columns: reads.append(columns) or wanted(group, files, columns))

    def ends(reader):
        found, key = [], lambda: dict(zip(queue.KEY, reader.reached))
        while (end := reader.latestOffset()) != key():
            reader.partitions(key(), end)
            found.append(end["message_id"])
        return found

    assert ends(queue.QueueReader(path, 10, 0.0)) == list(range(9, 200, 10))
    assert len(reads) <= sum(1 for f in (tmp_path / "queue").glob("*.parquet"))
    monkeypatch.setattr(queue, "AHEAD", 25)  # fewer keys than are left: they are read again, and nothing is lost
    assert ends(queue.QueueReader(path, 10, 0.0)) == list(range(9, 200, 10))
