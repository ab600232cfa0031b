"""Table-backed message queue as a streaming source: oldest first, a bounded number of messages in each batch.

The queue is a folder of Parquet files with message_id (long), created_on (timestamp, in UTC if without zone) and body (string), to
which writers append (:func:`enqueue`, or any other with the same columns).
Offsets are the pair (created_on, message_id) of the last message read; the stream's checkpoint keeps them, so a restart goes on
behind it and nothing is leased. Statistics of row groups, read once for each file, lead to the few that a batch needs.

A message that becomes visible with a time before one already read would be missed, so those younger than ``lag`` seconds wait:
``lag`` must exceed the time from a message's created_on to its commit, and the difference of the writers' clocks. Messages of equal
pairs are read together. A null created_on or message_id has no place in the order and stops the stream with an error; a null
body is handed on. Further columns of the table are not read. Row groups, of the size that writers give them, are the unit of work.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Messages of a batch, and seconds that a message waits to be seen.
MOST, LAG = 10_000, 10.0
#: Keys that the driver reads ahead (16 bytes each), and bytes of a row group that ``enqueue`` writes.
AHEAD, GROUP_BYTES = 1 << 20, 1 << 20
SCHEMA = "message_id long, created_on timestamp, body string"
KEY = ("created_on", "message_id")
#: Times as they are stored: without zone, in UTC, since Spark's older form of timestamps has no statistics.
_UTC = "TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(unix_micros(CAST(created_on AS TIMESTAMP)) AS DECIMAL(18, 0)) / 1000000)"
_FIRST = -(2**63)
_NO_KEYS = pa.table({name: pa.array([], pa.int64()) for name in KEY})
_ARROW = pa.schema([("message_id", pa.int64()), ("created_on", pa.timestamp("us", "UTC")), ("body", pa.string())])

Key = tuple[int, int]


@dataclass
class RowGroup(InputPartition):
    """A row group, the microseconds between which its messages were created, and the messages wanted of it: after ``start``, up to ``end``."""

    path: str
    number: int
    low: int
    high: int
    start: Key = (_FIRST, _FIRST)
    end: Key = (_FIRST, _FIRST)


def _micros(column: pa.ChunkedArray) -> pa.ChunkedArray:
    return column.cast(pa.timestamp("us", "UTC")).cast(pa.int64())


def _after(created: pa.ChunkedArray, ids: pa.ChunkedArray, key: Key) -> pa.ChunkedArray:
    return pc.or_(pc.greater(created, key[0]), pc.and_(pc.equal(created, key[0]), pc.greater(ids, key[1])))


def _wanted(group: RowGroup, files: fs.FileSystem, columns: list[str]) -> pa.Table:
    """Messages of ``group`` between its keys; created_on in microseconds."""
    with files.open_input_file(group.path) as f:
        table = pq.ParquetFile(f).read_row_group(group.number, columns=columns)
    if any(table[name].null_count for name in KEY):
        raise ValueError(f"the queue holds a message without created_on or message_id: {group.path}")
    table = table.set_column(table.schema.get_field_index("created_on"), "created_on", _micros(table["created_on"]))
    created, ids = table["created_on"], table["message_id"]
    return table.filter(pc.and_(_after(created, ids, group.start), pc.invert(_after(created, ids, group.end))))


class QueueReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int, lag: float):
        self.path, self.most, self.lag = path, most, lag
        self.reached: Key = (_FIRST, _FIRST)
        self.groups: dict[str, list[RowGroup]] = {}
        # Keys read ahead of the batches, at most so many; whether more are left, and whether files came since.
        self.keep = max(most, AHEAD)
        self.ahead, self.cut, self.fresh = _NO_KEYS, False, True

    def initialOffset(self) -> dict:
        return dict(zip(KEY, (_FIRST, _FIRST)))

    def latestOffset(self) -> dict:
        """The key of the last message of the next batch; that reached before, if there is none."""
        files, root = fs.FileSystem.from_uri(self.path)
        self._see(files, root)
        until = int((time.time() - self.lag) * 1e6)
        ahead = self._left()
        if self.fresh or (self.cut and ahead.num_rows < self.most):
            self._fill(files)
            ahead = self._left()
        ready = ahead.slice(0, self.most)
        ready = ready.filter(pc.less_equal(ready["created_on"], until))
        return dict(zip(KEY, (ready[name][-1].as_py() for name in KEY) if ready.num_rows else self.reached))

    def _left(self) -> pa.Table:
        """Keys read ahead that lie behind those reached."""
        return self.ahead.filter(_after(self.ahead["created_on"], self.ahead["message_id"], self.reached))

    def _fill(self, files: fs.FileSystem) -> None:
        """Read ahead: the ``keep`` oldest keys that are left, in order, or all; ``cut`` tells whether there are more."""
        self.ahead, self.cut, self.fresh = _NO_KEYS, False, False
        parts, rows = [], 0
        for g in sorted((g for gs in self.groups.values() for g in gs if g.high >= self.reached[0]), key=lambda g: g.low):
            if rows >= self.keep:
                self._merge(parts)
                parts, rows = [], 0
            if self.cut and g.low > self.ahead["created_on"][-1].as_py():
                break
            found = _wanted(RowGroup(g.path, g.number, g.low, g.high, self.reached, (2**63 - 1, 2**63 - 1)), files, list(KEY)).select(KEY).cast(_NO_KEYS.schema)
            parts, rows = [*parts, found], rows + found.num_rows
        self._merge(parts)

    def _merge(self, parts: list[pa.Table]) -> None:
        every = pa.concat_tables([self.ahead, *parts]).sort_by([(name, "ascending") for name in KEY])
        self.ahead, self.cut = every.slice(0, self.keep).combine_chunks(), self.cut or every.num_rows >= self.keep

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        first, last = (tuple(o[name] for name in KEY) for o in (start, end))
        # A restarted stream tells here how far it came.
        self.reached = last
        if first == last:
            return []
        files, root = fs.FileSystem.from_uri(self.path)
        self._see(files, root)
        return [RowGroup(g.path, g.number, g.low, g.high, first, last) for gs in self.groups.values() for g in gs if g.high >= first[0] and g.low <= last[0]]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        table = _wanted(partition, files, _ARROW.names).select(_ARROW.names).sort_by([(name, "ascending") for name in KEY])
        yield from table.cast(_ARROW).to_batches()

    def commit(self, end: dict) -> None:
        pass

    def _see(self, files: fs.FileSystem, root: str) -> None:
        """Note the row groups of files that are new; those of deleted files are forgotten."""
        found = [f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "_."]
        known, self.groups = self.groups, {}
        for path in found:
            if path not in known:
                self.fresh = True
            self.groups[path] = known.get(path) or list(_row_groups(files, path))


def _row_groups(files: fs.FileSystem, path: str) -> Iterator[RowGroup]:
    with files.open_input_file(path) as f:
        about = pq.ParquetFile(f)
        at = about.schema_arrow.get_field_index("created_on")
        for number in range(about.metadata.num_row_groups):
            group = about.metadata.row_group(number)
            column = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "created_on")
            low, high = (_FIRST, 2**63 - 1)
            stats = column.statistics if column.physical_type == "INT64" else None
            if stats is not None and stats.has_min_max:
                low, high = (_micros(pa.chunked_array([pa.array([end], about.schema_arrow.field(at).type)]))[0].as_py() for end in (stats.min, stats.max))
            yield RowGroup(path, number, low, high)


class QueueSource(DataSource):
    """Options: ``path`` (a URI), ``most`` messages of a batch, ``lag`` in seconds."""

    @classmethod
    def name(cls) -> str:
        return "message_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> QueueReader:
        return QueueReader(self.options["path"], int(self.options.get("most", MOST)), float(self.options.get("lag", LAG)))


def enqueue(messages: DataFrame, path: str) -> None:
    """Append ``messages`` (message_id, created_on, body) to the queue at ``path``, dealt and sorted so that small row groups hold few
    times: a batch reads those of its own messages and little else."""
    rows = messages.select("message_id", F.expr(_UTC).alias("created_on"), "body")
    dealt = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    dealt.write.mode("append").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)


def queue_stream(spark: SparkSession, path: str, most: int = MOST, lag: float = LAG) -> DataFrame:
    """Streaming feed of the queue at ``path`` (a URI that tasks and driver can open): message_id, created_on, body."""
    if most < 1 or lag < 0:
        raise ValueError(f"a batch takes one message at least, and the lag is not negative: {most}, {lag}")
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("message_queue").option("path", path).option("most", most).option("lag", lag).load()
