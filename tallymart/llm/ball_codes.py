"""Product codes of vectors by ball k-means.

Vectors are cut into ``parts`` consecutive parts; each part position has a codebook of at most ``entries`` entries, which starts as
that part of the vectors with the smallest ids. A round assigns every part to its nearest entry and moves each entry to the floor of
its parts' mean; after the rounds all parts are assigned once more, and the codes are what the last assignment says.

The first assignment measures all entries. Every later one starts from the entry a part was assigned to before, and treats the parts
of an entry as a ball around its moved place. The balls' radii (of the parts in a block of rows, so no pass over the table is needed
for them) define neighbours: an entry can only win a part of the ball if it lies within twice the radius. A part that lies within half
the way to the nearest neighbour is in the stable core and is not measured again; the others lie in rings bounded by half the ways to
the first, second, ... neighbour, and a part of ring r is measured against the first r neighbours alone. All of this is decided on
whole numbers (four times a squared distance against the squared way), so the result is that of measuring everything, ties included.

Each assignment is one job that writes the codes beside the vectors; the sums of a round are partial sums of blocks, added by Spark,
and the driver receives ``parts * entries`` rows of them at most, whatever the table's size.

Rows whose vector is null, empty, or holds null or non-finite components are dropped, as are those whose length is not that of the
vector with the smallest id. That length must be a multiple of ``parts``. A component of 2 ** 26 or more in size, scaled, is an
error, since squared distances would not fit. Of repeated ids the vectors that come first in order of their components start the
codebook; rows without id are coded, and start no entry. If fewer rows have an id, there are fewer entries; without any there is
no codebook and nothing is returned. Repeated rows are coded each. Ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Scaled components stay below this in size: the squared distances of a vector of 4,096 components fit a long then.
LIMIT = 1 << 26
#: Slices in which the rows of one label are joined with their sum.
SALT = 16


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x) in longs; null for vectors that take no part, an error where one is too large."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fits = F.forall(x, lambda c: F.abs(c * F.lit(float(scale))) < F.lit(float(LIMIT)))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return F.when(finite & (F.size(x) > 0), F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large")).cast("array<long>")))


@dataclass(frozen=True)
class Codebooks:
    """Entries as whole numbers: part position, entry, component."""

    values: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimals, joined by commas, by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def ways(self) -> tuple[np.ndarray, np.ndarray]:
        """For each entry the others by rising squared way (ties by index), and these ways: part, entry, rank."""
        step = self.values[:, :, None, :] - self.values[:, None, :, :]
        way = (step * step).sum(axis=3)
        own = np.arange(way.shape[1])
        way[:, own, own] = -1  # the entry itself comes first, and is cut off
        order = np.argsort(way, axis=2, kind="stable")[:, :, 1:]
        return order, np.take_along_axis(way, order, axis=2)


def assign_all(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row's parts, all entries measured. ``x``: row, part, component."""
    best = np.full(x.shape[:2], np.iinfo(np.int64).max)
    entry = np.zeros(x.shape[:2], dtype=np.int64)
    for e in range(books.values.shape[1]):
        step = x - books.values[None, :, e, :]
        far = (step * step).sum(axis=2)
        nearer = far < best
        entry[nearer], best[nearer] = e, far[nearer]
    return entry, best


def assign_from(x: np.ndarray, before: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, int]:
    """As :func:`assign_all`, from the entries that the parts were assigned to ``before``; and how many distances were measured."""
    n, parts, _ = x.shape
    entries = books.values.shape[1]
    order, way = (t.reshape(parts * entries, -1) for t in books.ways())
    place = books.values.reshape(parts * entries, -1)
    points = x.reshape(n * parts, -1)
    base = np.tile(np.arange(parts) * entries, n)
    ball = base + before.reshape(-1)
    step = points - place[ball]
    own = (step * step).sum(axis=1)
    radius = np.full(parts * entries, -1, dtype=np.int64)
    np.maximum.at(radius, ball, own)
    # Neighbours of a ball: entries within twice its radius. All others can win none of its parts.
    neighbours = (way <= 4 * radius[:, None]).sum(axis=1)
    best, entry, measured = own.copy(), ball - base, len(own)
    live = np.flatnonzero(neighbours[ball] > 0)
    for rank in range(order.shape[1]):
        # Out of the stable core and the rings further in: the way to the neighbour of this rank is at most twice the distance.
        live = live[(neighbours[ball[live]] > rank)]
        live = live[way[ball[live], rank] <= 4 * own[live]]
        if not len(live):
            break
        other = order[ball[live], rank]
        step = points[live] - place[base[live] + other]
        far = (step * step).sum(axis=1)
        measured += len(live)
        wins = (far < best[live]) | ((far == best[live]) & (other < entry[live]))
        best[live[wins]], entry[live[wins]] = far[wins], other[wins]
    return entry.reshape(n, parts), best.reshape(n, parts), measured


def _parts_of(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    v = batch.column(batch.schema.get_field_index("v"))
    return v.flatten().to_numpy().reshape(len(v), parts, -1)


def _entries_of(batch: pa.RecordBatch) -> np.ndarray:
    code = batch.column(batch.schema.get_field_index("code"))
    return np.array([np.frombuffer(c, dtype=np.uint8) for c in code.to_pylist()], dtype=np.int64)


def _assigner(books: Codebooks, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts = books.values.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts_of(batch, parts)
            entry, far = assign_all(x, books) if first else assign_from(x, _entries_of(batch), books)[:2]
            code = pa.array([row.tobytes() for row in entry.astype(np.uint8)], pa.binary())
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("id", "label", "v")]
            yield pa.RecordBatch.from_arrays([*kept, code, pa.array(far.sum(axis=1))], ["id", "label", "v", "code", "error"])

    return run


def _sums(parts: int, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial sums of blocks: slot (part and entry), number of parts, sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts_of(batch, parts)
            slot = (_entries_of(batch) + np.arange(parts) * entries).reshape(-1)
            n = np.bincount(slot, minlength=parts * entries)
            total = np.zeros((parts * entries, x.shape[2]), dtype=np.int64)
            np.add.at(total, slot, x.reshape(len(slot), -1))
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there]), pa.array(total[there].tolist(), pa.list_(pa.int64()))], ["slot", "n", "total"])

    return run


def _moved(coded: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the floor of the mean of its parts; unused entries stay."""
    parts, entries, width = books.values.shape
    partial = coded.select("v", "code").mapInArrow(_sums(parts, entries), "slot long, n long, total array<long>")
    summed = partial.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
    values = books.values.copy().reshape(parts * entries, width)
    for row in summed.collect():  # parts * entries rows at most
        values[row.slot] = [row[f"t{i}"] // row.n for i in range(width)]
    return Codebooks(values.reshape(parts, entries, width))


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, Codebooks | None]:
    """((id, label, v, code, error), codebooks): code holds the entry of each part, one byte each (so 256 entries at most); error is
    the sum of the squared distances. None, and no rows, where no row has an id."""
    if not 0 < entries <= 256:
        raise ValueError("between 1 and 256 entries")
    kept = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), quantised(F.col(vector), scale).alias("v")).where("v IS NOT NULL")
    rows = settle(kept, "codes-rows")
    first = rows.where("id IS NOT NULL").select("id", "v").orderBy("id", "v").limit(1).collect()
    if not first:
        return rows.limit(0).select("id", "label", "v", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    length = len(first[0].v)
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    rows = rows.where(F.size("v") == length)
    start = rows.where("id IS NOT NULL").select("id", "v").orderBy("id", "v").limit(entries).collect()
    books = Codebooks(np.array([r.v for r in start], dtype=np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy())
    schema = f"id long, label {rows.schema['label'].dataType.simpleString()}, v array<long>, code binary, error long"
    coded = settle(rows.mapInArrow(_assigner(books, True), schema), "codes")
    for _ in range(rounds):
        books = _moved(coded, books)
        coded = settle(coded.mapInArrow(_assigner(books, False), schema), "codes")
    return coded, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of all rows of equal label (nulls together) added up. One label may hold most rows:
    its sum is joined in ``SALT`` slices."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    sums = sums.withColumnRenamed("label", "other")
    dealt = coded.withColumn("slice", F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALT)).cast("int"))
    return dealt.join(sums, dealt["label"].eqNullSafe(sums["other"]) & (dealt["slice"] == sums["slice"])).drop("slice", "other")
