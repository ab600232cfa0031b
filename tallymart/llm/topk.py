"""Exact top-k search by distributed histogram selection.

Every query is scored against every row. Rather than sorting scores, each pass counts them in ``BINS`` bins for each query over the
range that still holds the kth highest score, sums the counts of all tasks, and narrows the range to the bin of the kth score,
until the range is one value. A last pass keeps what lies above it, and of ties the smallest ids.

Rows and queries are packed into blocks (``ROWS`` and ``QUERIES`` vectors) by hash; a pass is one job over all pairs of a row block
and a query block, in which a query block carries the ranges of its queries. So the number of jobs, and every plan, is the same for
any number of queries, and nothing but the largest width of a range comes to the driver. Scores are recomputed in every pass as
one matrix product for each pair of blocks, which costs less than writing them.

Components are whole numbers below 2 ** 63 in size, floor(scale * x); scores are exact (floats where all sums are exact in them,
whole numbers of any size elsewhere). A component or score that does not fit a long is an error.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without id. Vectors of another length
than the query's are no candidates. A row is not its own candidate, but another row that repeats its id or its vector is; repeated
queries each give their results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle

SCALE, ROWS, QUERIES, BINS = 1024, 4096, 512, 256
#: Sums of integer products below these are exact in a float and in a long.
IN_FLOAT, IN_LONG = 2.0**53, 2.0**63
#: Slices of a query's last candidates that are ranked apart before they are ranked together.
SLICES = 32
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x) in longs; null for vectors that take no part, an error where one does not fit."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.floor(c * F.lit(float(scale)))
    fits = F.forall(x, lambda c: F.abs(c * F.lit(float(scale))) < F.lit(IN_LONG))
    checked = F.when(fits, F.transform(x, lambda c: whole(c).cast("long"))).otherwise(F.raise_error(F.lit("a component does not fit a long")).cast("array<long>"))
    return F.when(finite & (F.size(x) > 0), checked)


def _product(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products, rows by queries."""
    size = lambda m: np.abs(m.astype(np.float64)).max(axis=1, initial=0)
    out, own, theirs = np.empty((len(rows), len(queries)), dtype=np.int64), size(rows), size(queries)
    # Most vectors are small; a large one does not make the others slow.
    small = [s * np.median(o) * rows.shape[1] * 8 < IN_FLOAT for s, o in ((own, theirs), (theirs, own))] if out.size else [own < 0, theirs < 0]
    for a in (small[0], ~small[0]):
        for b in (small[1], ~small[1]):
            if not a.any() or not b.any():
                continue
            x, y = rows[a], queries[b]
            most = own[a].max() * theirs[b].max() * rows.shape[1]
            if most < IN_FLOAT:
                found = (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
            elif most < IN_LONG / 2:
                found = x @ y.T
            else:
                exact = x.astype(object) @ y.T.astype(object)
                if max(abs(int(exact.max())), abs(int(exact.min()))) > _HIGH:
                    raise OverflowError("a score does not fit a long")
                found = exact.astype(np.int64)
            out[np.ix_(a, b)] = found
    return out


def _blocks(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """``rows`` (uid, vec_id, v) of each length packed by hash into blocks of about ``size``: block, len, uids, ids, vectors."""
    lengths = rows.groupBy(F.size("v").alias("len")).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blocks"))
    dealt = rows.withColumn("len", F.size("v")).join(F.broadcast(lengths), "len")  # one row for each vector length
    block = F.pmod(F.xxhash64("uid", F.lit(kind)), F.col("blocks"))
    # One shuffle by block; a block has a bounded number of rows.
    packed = dealt.groupBy("len", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", "vec_id", "v"))).alias("r"))
    names = {"row": ("block", "uids", "ids", "vectors"), "query": ("q_block", "q_uids", "q_ids", "q_vectors")}[kind]
    return packed.select(F.xxhash64("len", "block").alias(names[0]), F.col("len").alias("len" if kind == "row" else "q_len"), *[getattr(F.col("r"), "getField")(f).alias(n) for f, n in zip(("uid", "vec_id", "v"), names[1:])])


class _Pair:
    """A row block against a query block: scores, and which of them count."""

    def __init__(self, at: int, batch: pa.RecordBatch):
        value = lambda n: batch.column(batch.schema.get_field_index(n))[at].values
        self.uids, self.ids, self.q_uids, self.q_ids = (value(n).to_numpy() for n in ("uids", "ids", "q_uids", "q_ids"))
        rows, queries = (value(n).flatten().to_numpy().reshape(len(u), -1) for n, u in (("vectors", self.uids), ("q_vectors", self.q_uids)))
        self.scores = _product(rows, queries)
        self.allowed = self.uids[:, None] != self.q_uids[None, :]
        self.low, self.high = (value(n).to_numpy() if n in batch.schema.names else None for n in ("low", "high"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Pair]:
    for batch in batches:
        same = batch.column(batch.schema.get_field_index("len")).to_numpy() == batch.column(batch.schema.get_field_index("q_len")).to_numpy()
        for at in np.flatnonzero(same):
            yield _Pair(int(at), batch)


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in _pairs(batches):
        low, high = (np.where(p.allowed, p.scores, fill) for fill in (_HIGH, _LOW))
        columns = [p.q_uids, low.min(axis=0), high.max(axis=0), p.allowed.sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["q", "low", "high", "n"])


def _widths(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Width of each query's bins; ranges may span nearly all longs, so the difference is unsigned."""
    span = high.view(np.uint64) - low.view(np.uint64)
    return span // np.uint64(BINS) + np.uint64(1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in _pairs(batches):
        n, wide = len(p.q_uids), p.high > p.low
        allowed = p.allowed & (p.scores >= p.low) & (p.scores <= p.high) & wide
        row, q = np.nonzero(allowed)
        bin_ = (p.scores[row, q].view(np.uint64) - p.low.view(np.uint64)[q]) // _widths(p.low, p.high)[q]
        table = np.bincount(q * BINS + bin_.astype(np.int64), minlength=n * BINS)
        there = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p.q_uids[there // BINS], (there % BINS).astype(np.int64), table[there].astype(np.int64))], ["q", "bin", "n"])


def _keep(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _pairs(batches):
            row, q = np.nonzero(p.allowed & (p.scores >= p.low))
            order = np.lexsort((p.ids[row], -p.scores[row, q].astype(np.float64), q)) if len(row) else np.zeros(0, int)
            row, q = row[order], q[order]
            # Above the kth score there are fewer than k rows anywhere; ties with it are kept by id, k for each block at most.
            tied = p.scores[row, q] == p.low[q]
            rank = np.cumsum(tied) - np.concatenate([[0], np.cumsum(tied)])[np.searchsorted(q, q)]
            some = ~tied | (rank <= k)
            row, q = row[some], q[some]
            columns = [p.q_uids[q], p.q_ids[q], p.ids[row], p.scores[row, q], p.uids[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["q", "query_id", "vec_id", "score", "uid"])

    return run


def _ranges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Query blocks with the range (low, high) of each of their queries, in their order."""
    each = blocks.select("q_block", F.posexplode("q_uids").alias("at", "q")).join(ranges.select("q", "low", "high"), "q", "left")
    # A query without candidates has an empty range.
    each = each.withColumn("low", F.coalesce("low", F.lit(0).cast("long"))).withColumn("high", F.coalesce("high", F.lit(0).cast("long")))
    packed = each.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("r"))
    return blocks.join(packed.select("q_block", F.col("r.low").alias("low"), F.col("r.high").alias("high")), "q_block")


def search(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` that is a query (condition ``queries``) the k highest integer
    inner products with other rows, ties to the smaller id."""
    made = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    # Row numbers are written once: they tell rows of one id apart.
    rows = settle(made.where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("uid", F.monotonically_increasing_id()), "topk-rows")
    own = settle(_blocks(rows, ROWS, "row"), "topk-blocks")
    asked = settle(_blocks(rows.where("asked"), QUERIES, "query"), "topk-queries")
    # The query set in blocks against all rows in blocks.
    against = lambda q: own.crossJoin(q)
    sums = against(asked).mapInArrow(_extent, "q long, low long, high long, n long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    few = F.col("n") <= k
    wanted = F.least(F.col("n"), F.lit(k)).alias("wanted")
    ranges = settle(sums.where("n > 0").select("q", "low", F.when(few, F.col("low")).otherwise(F.col("high")).alias("high"), wanted), "topk-ranges")
    while not ranges.where("high > low").isEmpty():
        counts = against(_ranges(asked, ranges)).mapInArrow(_count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("q").orderBy(F.col("bin").desc()))  # BINS rows for each query at most
        reached = counts.withColumn("upto", upto).join(ranges.select("q", "wanted"), "q").where("upto >= wanted")
        at = reached.groupBy("q").agg(F.max_by(F.struct("bin", "upto", "n"), "bin").alias("at")).select(F.col("q").alias("p"), "at.*")
        both = ranges.join(at, F.col("q") == F.col("p"), "left")
        exact = lambda c: c.cast("decimal(38,0)")
        span = exact(F.col("high")) - exact(F.col("low"))
        width = F.floor(span / F.lit(BINS)) + 1
        start = exact(F.col("low")) + exact(F.col("bin")) * exact(width)
        end = F.least(exact(F.col("high")), start + exact(width) - 1)
        moved = F.col("p").isNotNull()
        next_ = [F.when(moved, v.cast("long")).otherwise(F.col(n)).alias(n) for n, v in (("low", start), ("high", end), ("wanted", F.col("wanted") - (F.col("upto") - F.col("n"))))]
        ranges = settle(both.select("q", *next_), "topk-ranges")
    found = against(_ranges(asked, ranges)).mapInArrow(_keep(k), "q long, query_id long, vec_id long, score long, uid long")
    # Ties of a hot vector come from every block: they are ranked in slices first.
    best = [F.col("score").desc(), F.col("vec_id"), F.col("uid")]
    part = found.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(SLICES)))
    part = part.withColumn("r", F.row_number().over(W.partitionBy("q", "part").orderBy(*best))).where(F.col("r") <= k)
    rank = F.row_number().over(W.partitionBy("q").orderBy(*best))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
