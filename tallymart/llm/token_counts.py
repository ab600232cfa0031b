"""Token counts of flat, unindexed token files by a separator scan.

A token file is a stream of ids in which each document ends with an end-of-document id; nothing says where documents start.
Streams are read in blocks cut without regard to documents. Each block is searched for separators in one vector comparison,
and yields the documents that lie within it, how many ids precede its first separator and follow its last. A prefix scan over
the blocks of a file then gives each block the number of documents before it and the ids of the open document it inherits.

Texts are encoded so that the separator's string in a text is ordinary text. Empty and null texts are documents of 0 tokens. A
file's last document may lack its separator; trailing ids then count as a document. Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .scratch import shared_path

#: Ids of a block, and names of a row of the name list.
BLOCK_IDS, NAME_ROWS = 1 << 16, 1 << 14
#: Blocks of a byte range of a raw file.
RANGE_BLOCKS = 256
STREAM = "file long, block long, ids binary, names array<long>"


def write_stream(docs: DataFrame, path: str, tokenizer: str, eod: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the token stream of ``docs`` to the new folder ``path``: one stream for each task, in blocks of ``BLOCK_IDS`` ids
    (little-endian unsigned 32-bit), and apart from them the ids of its documents in order, without positions or counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, file = bpe.load(tokenizer), TaskContext.get().partitionId()
        end = np.array([eod], dtype="<u4").tobytes()
        size, block, names, held, length = 4 * BLOCK_IDS, 0, [], [], 0

        def rows(blocks: list[tuple[int | None, bytes | None, list | None]]) -> pa.RecordBatch:
            columns = [pa.array([file] * len(blocks), pa.int64()), *(pa.array([b[i] for b in blocks], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64()))))]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "ids", "names"])

        part = 0
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = codec.encode(body, special=False)
                held += [ids, end]
                length += len(ids) + 4
                names.append(name)
                if length >= size:
                    data = b"".join(held)
                    full = len(data) - len(data) % size
                    yield rows([(block + i, data[at : at + size], None) for i, at in enumerate(range(0, full, size))])
                    block += full // size
                    held, length = [data[full:]], len(data) - full
                if len(names) >= NAME_ROWS:
                    yield rows([(part, None, names)])
                    names, part = [], part + 1
        if length:
            yield rows([(block, b"".join(held), None)])
        if names:
            yield rows([(part, None, names)])

    docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(encode, STREAM).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, ids) of a stream that :func:`write_stream` wrote."""
    return spark.read.schema(STREAM).parquet(path).where("ids IS NOT NULL").select("file", "block", "ids")


def read_flat_files(spark: SparkSession, path: str, id_bytes: int = 4) -> DataFrame:
    """(file, block, ids) of raw token files; ``file`` is a hash of the path. Files are cut into byte ranges of ``RANGE_BLOCKS``
    blocks by their lengths alone, and each task reads its ranges only, so a file may have any length. ``path`` must be of a
    store that pyarrow opens (local, HDFS, S3). ``id_bytes`` 2 or 4: width of the little-endian ids; bytes beyond the last whole
    id are left out."""
    if id_bytes not in (2, 4):
        raise ValueError("id_bytes must be 2 or 4")
    size = BLOCK_IDS * id_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, file, first, length in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = pafs.FileSystem.from_uri(where)
                with store.open_input_file(name) as source:
                    for block in range(first, first + RANGE_BLOCKS):
                        data = source.read_at(max(0, min(size, length - block * size)), block * size)
                        ids = np.frombuffer(data, dtype=f"<u{id_bytes}").astype("<u4").tobytes()
                        if ids:
                            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([ids], pa.binary())], ["file", "block", "ids"])

    whole = F.col("length") - F.col("length") % id_bytes
    files = spark.read.format("binaryFile").load(path).select("path", whole.alias("length")).where("length > 0")
    step = RANGE_BLOCKS * size
    first = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step)), lambda i: i * RANGE_BLOCKS)
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    ranges = files.select(uri.alias("path"), F.xxhash64("path").alias("file"), F.explode(first).alias("first"), "length")
    return ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "first").mapInArrow(cut, "file long, block long, ids binary")


def _search(eod: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, first, tail, inner = [], [], [], [], []
            for data in batch.column(2).to_pylist():
                ids = np.frombuffer(data, dtype="<u4")
                at = np.flatnonzero(ids == eod)
                n.append(len(ids))
                ends.append(len(at))
                first.append(int(at[0]) if len(at) else len(ids))
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                inner.append((np.diff(at) - 1).astype(np.int64))
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, ends, first, tail)), pa.array(inner, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "ends", "first", "tail", "inner"])

    return search


def count(blocks: DataFrame, eod: int) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of ``blocks`` (file, block, ids); separators are not counted."""
    found = blocks.mapInArrow(_search(eod), "file long, block long, n long, ends long, first long, tail long, inner array<long>")
    w = W.partitionBy("file").orderBy("block")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    start = F.coalesce(F.sum("n").over(before), zero)
    found = found.withColumn("start", start).withColumn("ordinal", F.coalesce(F.sum("ends").over(before), zero))
    open_since = F.when(F.col("ends") > 0, F.col("start") + F.col("n") - F.col("tail"))
    found = found.withColumn("carry", F.col("start") - F.coalesce(F.max(open_since).over(before), zero)).withColumn("last", F.lead("block").over(w).isNull())
    own = F.concat(F.array(F.col("carry") + F.col("first")), "inner")
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("n"))
    lengths = F.when(F.col("ends") > 0, own).otherwise(F.array().cast("array<long>"))
    lengths = F.when(F.col("last") & (left > 0), F.concat(lengths, F.array(left))).otherwise(lengths)
    each = found.select("file", "ordinal", F.posexplode(lengths).alias("i", "n_tokens"))
    return each.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens")


def names(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, doc_id) of a stream that :func:`write_stream` wrote."""
    rows = spark.read.schema(STREAM).parquet(path).where("names IS NOT NULL")
    each = rows.select("file", "block", F.posexplode("names").alias("i", "doc_id"))
    return each.select("file", (F.col("block") * NAME_ROWS + F.col("i")).alias("ordinal"), "doc_id")


def count_documents(docs: DataFrame, tokenizer: str, eod: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of ``docs``, written to a token stream in the shared folder and counted from it."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_stream(docs, path, tokenizer, eod, doc_id, text)
    return names(spark, path).join(count(read_blocks(spark, path), eod), ["file", "ordinal"]).select("doc_id", "n_tokens")
