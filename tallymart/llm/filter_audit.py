"""Audit of filters that interact: what each removes in every order, by incremental retraction streaming.

Five filters judge whole texts: A under 50 words, B few distinct words, C many capitals, D odd characters, E a text that a smaller
document id has, anywhere in the table. All files are processed as available-now micro-batches. A to D follow from the text alone; E
changes as files arrive. Every document counts at once as failing E, in the counter of its part (source), its mask of failed filters
and its labels. State keyed by the text's digest holds the smallest id seen and whom it counts for: these do not fail E, so they are
moved to the counter without E, and when a smaller id arrives they are retracted, moved back, and the new ones take their place. So
after any batch the counters are those of the files seen so far.

State lies in slices of the digest space, some hundred texts each, since a Python call for each text costs about 3 ms. Before the
shuffle every Arrow batch adds up its counts, and of a text it sends the smallest id only: a text that a third of all rows share sends
one row for each Arrow batch. Each micro-batch writes its signed counts to a folder of its own, overwritten if the batch is repeated; the
counters are their sum, at most 128 rows for each part and batch. A report then needs no documents: all orders are evaluated
on 32 masks for each part.

Null texts are empty, null sources the part ''. Documents without id never fail E, nor do they make others fail it. Repeated rows
(one id and text) are of the same rank: none makes the other fail. Of several label rows for an id, one that says 1 is enough. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .scratch import settle, shared_path

FILTERS = "ABCDE"
WORD_GAP, CAPITAL_GAP, ODD = r"[\x20\x09-\x0D]+", "[^A-Z]+", "[#$%&*|]"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
REPEATED = 1 << FILTERS.index("E")
#: Micro-batches of a run at most, and bytes of input files for each slice of the state.
BATCHES, SLICE_BYTES = 5, 1 << 20
#: Parts of one id's labels: rows of one id are joined in as many slices.
SALT = 8
CELL = ["part", "mask", "good", "toxic"]
CELL_SCHEMA = "part string, mask int, good int, toxic int, n long"
_HELD = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])
_SENT = pa.schema([("slice", pa.int32()), *_HELD])


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, CAPITAL_GAP, ""))
    fails = F.transform(
        F.array(counts),
        lambda c: F.when(c.n < LEAST_WORDS, 1).otherwise(0) + F.when(c.distinct.cast("long") * 100 < c.n.cast("long") * DISTINCT_PERCENT, 2).otherwise(0),
    )[0]
    return (fails + F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT, 4).otherwise(0) + F.when(text.rlike(ODD), 8).otherwise(0)).cast("int")


def features(docs: DataFrame, slices: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, part, digest, slice, mask) of each document; streams too."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(source), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    judged = rows.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), own_mask(F.col("t")).alias("mask"))
    return judged.withColumn("slice", F.pmod(F.xxhash64("digest"), F.lit(slices)).cast("int"))


def label_flags(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(labelled, good, toxic) once for each id."""
    some = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    return labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("labelled")).agg(some("quality"), some("toxic")).withColumnRenamed("quality", "good")


def _labelled(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows without id spread over the join; rows of one id over ``SALT`` copies of its labels. Both sides are shuffled: the size of a
    compressed file says little of the copies, which would go to the driver whole if they were broadcast."""
    given = flags.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge")
    key = F.coalesce("id", F.xxhash64("digest", "part"))
    dealt = rows.withColumns({"key": key, "salt": F.pmod(F.xxhash64("digest"), F.lit(SALT)).cast("int")})
    joined = dealt.join(given, (F.col("key") == F.col("labelled")) & (F.col("salt") == F.col("copy")), "left")
    flag = lambda c: F.when(F.col("id").isNotNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("int").alias(c)
    return joined.select("slice", "digest", "id", "part", "mask", flag("good"), flag("toxic"))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a block, all with ids as failing E, in negative slices; and of each text the rows with the block's smallest id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        known = rows.column("id").is_valid()
        for some, extra in ((rows.filter(known), REPEATED), (rows.filter(pa.compute.invert(known)), 0)):
            cells = some.group_by(CELL).aggregate([([], "count_all")])
            n = cells.num_rows
            if n:
                slices = [-1 - zlib.crc32(p.encode()) % 64 for p in cells.column("part").to_pylist()]
                mask = pa.compute.add(cells.column("mask"), pa.scalar(extra, pa.int32()))
                columns = [pa.array(slices, pa.int32()), pa.array([b""] * n, pa.binary()), pa.array([0] * n, pa.int64()), cells.column("part"), mask, cells.column("good"), cells.column("toxic"), cells.column("count_all")]
                yield from pa.Table.from_arrays(columns, schema=_SENT).combine_chunks().to_batches()
        rows = rows.filter(known)
        if rows.num_rows:
            least = rows.group_by("digest").aggregate([("id", "min")])
            first = rows.join(least, "digest", use_threads=False).filter(pa.compute.field("id") == pa.compute.field("id_min"))
            held = first.group_by([f.name for f in _SENT][:-1]).aggregate([([], "count_all")]).rename_columns([*[f.name for f in _SENT][:-1], "n"])
            yield from held.select(_SENT.names).cast(_SENT).combine_chunks().to_batches()


def _moves(rows: pd.DataFrame, sign: int) -> list[pd.DataFrame]:
    """Rows out of the counters with E into those without (sign 1), or back (sign -1)."""
    return [rows.assign(n=sign * rows.n), rows.assign(mask=rows["mask"] | REPEATED, n=-sign * rows.n)]


def _hold(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    come = pd.concat(list(frames), ignore_index=True)
    if key[0] < 0:
        moved = [come]
    else:
        old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else come.iloc[:0]
        both = pd.concat([old.assign(held=True), come[_HELD.names].assign(held=False)], ignore_index=True)
        first = both.id == both.groupby("digest").id.transform("min")
        moved = [*_moves(both[first & ~both.held], 1), *_moves(both[~first & both.held], -1)]
        kept = both[first].groupby(_HELD.names[:-1], as_index=False).n.sum()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD) as out:
            out.write_table(pa.Table.from_pandas(kept, schema=_HELD, preserve_index=False))
        state.update((sink.getvalue().to_pybytes(),))
    cells = pd.concat(moved).groupby(CELL, as_index=False).n.sum()
    yield cells[cells.n != 0][[*CELL, "n"]]


def cells_of_files(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, columns: tuple[str, str, str] = ("doc_id", "text", "source")) -> DataFrame:
    """(part, mask, good, toxic, n): documents below the Parquet path ``path`` by part, failed filters and labels, counted as a
    stream of at most ``batches`` micro-batches."""
    files = spark.read.format("binaryFile").load(path).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.min("path").alias("path")).first()
    slices = max(64, math.ceil(files.bytes / SLICE_BYTES))
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, math.ceil(files.n / batches)))
    folder, _, name = path.rstrip("/").rpartition("/")
    if files.n == 1 and files.path.endswith(f"/{name}"):  # streams read folders: one file is what its folder holds of that name
        reader, path = reader.option("pathGlobFilter", name), folder
    rows = _labelled(features(reader.parquet(path), slices, *columns), settle(label_flags(labels), "audit-labels"))
    sent = rows.mapInArrow(_combined, f"slice int, digest binary, id long, {CELL_SCHEMA}")
    moved = sent.groupBy("slice").applyInPandasWithState(_hold, CELL_SCHEMA, "held binary", "update", GroupStateTimeout.NoTimeout)
    out, done = shared_path(spark, "audit-counts"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    query = moved.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", shared_path(spark, "audit-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], CELL_SCHEMA)
    # Signed counts of all batches: earlier placements and their retractions cancel.
    counts = spark.read.schema(CELL_SCHEMA).parquet(*[f"{out}/batch={number}" for number in sorted(set(done))])
    return counts.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def _steps() -> list[dict]:
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [
        {"filter_order": "".join(order), "step": at + 1, "own": bit[order[at]], "earlier": sum(bit[f] for f in order[:at])}
        for order in permutations(FILTERS)
        for at in range(len(FILTERS))
    ]


def report(cells: DataFrame) -> DataFrame:
    """Every part, order and step of the filters: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    masks = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 masks at most
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,own:int,earlier:int>>")
    each = parts.select("part", "m", F.explode(steps).alias("s")).select("part", "m", "s.*")

    def total(keep, value=lambda c: c.n) -> Column:
        return F.aggregate(F.filter("m", keep), F.lit(0).cast("long"), lambda a, c: a + value(c))

    own, earlier = F.col("own"), F.col("earlier")
    fails = lambda c, bits: c.mask.bitwiseAND(bits) != 0
    here = lambda c: fails(c, own) & ~fails(c, earlier)
    orders = math.factorial(len(FILTERS))
    # A filter comes first among the k that a document fails in one k-th of all orders.
    share = lambda c: c.n * (F.lit(orders) / F.bit_count(c.mask)).cast("long")
    return each.select(
        "part", "filter_order", "step", total(lambda c: ~fails(c, own.bitwiseOR(earlier))).alias("kept"), total(here).alias("removed"), total(lambda c: fails(c, own) & fails(c, earlier)).alias("redundant"),
        total(lambda c: c.mask == own).alias("unique_fails"), total(here, lambda c: c.good).alias("good_lost"), total(here, lambda c: c.toxic).alias("toxic_lost"), total(lambda c: fails(c, own), share).alias("shapley"),
    )
