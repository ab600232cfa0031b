"""SimHash near-duplicates found through vantage-point trees.

Fingerprints: each word shingle is hashed and a fingerprint bit is 1 where over half of the hashes have it.

The tree (:func:`grow`) is grown from a sample of at most about ``SAMPLE`` fingerprints; every fingerprint is indexed. The 64 bits
are dealt to levels, as many as the number of fingerprints asks for; the distance on one level's bits is a metric of its own, and
the distances on all levels add up to the Hamming distance. A node takes as vantage point the sampled fingerprint, of a few, whose
distances on the level's bits spread most, and cuts these distances into branches at their quantiles. A node is split until the
rows that its share of the sample stands for are ``LEAF_ROWS`` or fewer, or the levels end.

A fingerprint goes down the branch of its own distance and those next to it that cost no more than its budget, where the cost of a
branch is how far the distance lies outside its radii. By the triangle inequality two fingerprints within ``radius`` bits
differ by at most that in the sum of their distances over a path. So one of them is stored in each leaf that costs at most half
the radius, the other queried in each leaf within the other half, and all other branches are pruned: each close pair meets in
at least one leaf, where the exact distance decides.

Leaves travel as sorted rows and a task holds one at a time. A leaf that would hold more than ``SHARD_ROWS`` is dealt to several
shards: stored rows to one each, queried ones to all. Only one row for each distinct fingerprint enters the search, and a shard
returns links that span its groups rather than all pairs, so a group of many near copies costs links in proportion to its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import settle

SEED = 42
#: Fingerprints that a tree is grown from (about, at most), rows of a leaf to aim at, rows of a shard, candidates for a vantage point.
SAMPLE, LEAF_ROWS, SHARD_ROWS, CANDIDATES = 1 << 17, 64, 1 << 14, 4
#: Branches of a node at most, and levels of a tree at most.
ARITY, MOST_LEVELS = 9, 16
#: Pairs compared at once, and hashes expanded to bits at once.
CHUNK_PAIRS, CHUNK_HASHES = 1 << 21, 1 << 16


def fingerprint_bytes(text: str | None, shingle: int) -> bytes:
    """64-bit fingerprint of one text; words are split at ASCII white space after lower-casing A-Z."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - shingle + 1)
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=n).astype(">u8")
    return majority(hashes.view(np.uint8).reshape(n, 8))


def majority(hashes: np.ndarray) -> bytes:
    """Bits that over half of the rows of bytes have."""
    n = len(hashes)
    counts = sum(np.unpackbits(hashes[i : i + CHUNK_HASHES], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, CHUNK_HASHES))
    return np.packbits(counts * 2 > n).tobytes()


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprint column (long, the 64 bits as signed). Null or wordless texts: zero."""

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.frombuffer(b"".join(fingerprint_bytes(t, shingle) for t in texts), dtype=">i8").astype(np.int64))

    return made(F.coalesce(text, F.lit("")))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same groups as the links a-b, one for each node that is not its group's root."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all() and (label[x] == label[y]).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


class Links:
    """Collects links and keeps only spanning ones, so that memory follows the nodes and not the pairs."""

    def __init__(self) -> None:
        self.a, self.b, self.more = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.more += len(a)
            if self.more > 2 * CHUNK_PAIRS:
                self.shrink()
                self.more = 0

    def shrink(self) -> tuple[np.ndarray, np.ndarray] | None:
        if self.a:
            a, b = spanning(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b = [a], [b]
            return a, b
        return None


class Tree(NamedTuple):
    """Nodes by number, root 0. ``branch`` has a row for each node: the child for each distance, -1 throughout for a leaf."""

    vantage: np.ndarray
    level: np.ndarray
    branch: np.ndarray
    shards: np.ndarray
    masks: np.ndarray


def grow(sample: np.ndarray, total: int, leaf_rows: int = LEAF_ROWS, seed: int = SEED, levels: int | None = None, shard_rows: int = SHARD_ROWS) -> Tree:
    """Tree for ``total`` fingerprints (unsigned) from a sample of them, one level after the other; ``levels`` to which the bits are
    dealt are as many as ``total`` asks for, if not given."""
    sample = np.random.default_rng(seed).permutation(sample)
    scale = total / max(1, len(sample))
    # A level of some eight bits tells about 2.3 bits.
    levels = levels or int(min(MOST_LEVELS, max(1, math.ceil(math.log2(max(2.0, total / leaf_rows)) / 2.3))))
    bits = -(-64 // levels)
    masks = np.array([sum(1 << b for b in range(at, 64, levels)) for at in range(levels)], dtype=np.uint64)
    node_of = np.zeros(len(sample), dtype=np.int64)
    vantage, level, branch = [np.zeros(1, dtype=np.uint64)], [np.zeros(1, dtype=np.int8)], [np.full((1, bits + 1), -1, dtype=np.int32)]
    first, size = 0, 1  # the nodes of the level
    for at in range(levels):
        count = np.bincount(node_of[node_of >= first] - first, minlength=size)
        split = np.flatnonzero((count * scale > leaf_rows) & (count > 1))
        if not len(split):
            break
        inside = np.flatnonzero(node_of >= first)
        here = node_of[inside] - first
        order = inside[np.argsort(here, kind="stable")]
        starts = np.cumsum(count) - count
        best, spread = np.zeros(size, dtype=np.uint64), np.full(size, -1.0)
        for c in range(CANDIDATES):
            tried = np.zeros(size, dtype=np.uint64)
            tried[split] = sample[order[starts[split] + c % count[split]]]
            far = np.bitwise_count((sample[inside] ^ tried[here]) & masks[at]).astype(np.float64)
            mean = np.bincount(here, far, size) / np.maximum(1, count)
            variance = np.bincount(here, far * far, size) / np.maximum(1, count) - mean * mean
            better = variance > spread
            best[better], spread[better] = tried[better], variance[better]
        far = np.bitwise_count((sample[inside] ^ best[here]) & masks[at])
        held = np.zeros((size, bits + 1), dtype=np.int64)
        np.add.at(held, (here, far), 1)
        upto = np.cumsum(held, axis=1) - held / 2
        part = np.minimum(ARITY - 1, upto * ARITY / np.maximum(1, count)[:, None]).astype(np.int64)
        new = np.concatenate([np.ones((size, 1), dtype=bool), np.diff(part, axis=1) > 0], axis=1)
        new[count * scale <= leaf_rows] = False
        new[count <= 1] = False
        child = np.cumsum(new.ravel()).reshape(new.shape) - 1 + first + size
        branch[-1][split] = child[split]
        vantage[-1][split] = best[split]
        is_split = np.zeros(size, dtype=bool)
        is_split[split] = True
        moved = is_split[here]
        node_of[inside[moved]] = child[here[moved], far[moved]]
        first, size = first + size, int(new.sum())
        vantage.append(np.zeros(size, dtype=np.uint64))
        level.append(np.full(size, at + 1, dtype=np.int8))
        branch.append(np.full((size, bits + 1), -1, dtype=np.int32))
    branches = np.concatenate(branch)
    shards = np.maximum(1, np.ceil(np.bincount(node_of, minlength=len(branches)) * scale / shard_rows)).astype(np.int32)
    return Tree(np.concatenate(vantage), np.concatenate(level), branches, shards, masks)


def route(tree: Tree, fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, cost) of every leaf that a fingerprint reaches within ``budget``."""
    row, node, cost = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int32), np.zeros(len(fps), dtype=np.int8)
    found = []
    while len(row):
        leaf = tree.branch[node, 0] < 0
        found.append((row[leaf], node[leaf], cost[leaf]))
        row, node, cost = row[~leaf], node[~leaf], cost[~leaf]
        far = np.bitwise_count((fps[row] ^ tree.vantage[node]) & tree.masks[tree.level[node] % len(tree.masks)]).astype(np.int64)
        steps = []
        for step in range(-budget, budget + 1):
            there = far + step
            open_ = np.flatnonzero((cost + abs(step) <= budget) & (there >= 0) & (there < tree.branch.shape[1]))
            child = tree.branch[node[open_], there[open_]]
            if step:  # the branch was reached at less cost already
                fresh = child != tree.branch[node[open_], there[open_] - (1 if step > 0 else -1)]
                open_, child = open_[fresh], child[fresh]
            steps.append((row[open_], child, (cost[open_] + abs(step)).astype(np.int8)))
        row, node, cost = (np.concatenate([s[i] for s in steps]) for i in range(3))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def shard_links(shard: np.ndarray, fp: np.ndarray, stored: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Spanning links among rows that share a shard; rows are sorted by (shard, fp)."""
    last = np.searchsorted(shard, shard, side="right")
    # Of a close pair either end is stored where the other is queried, so the stored one may be taken to be the earlier.
    own = np.flatnonzero(stored)
    reps = last[own] - own - 1
    own, reps = own[reps > 0], reps[reps > 0]
    total, links, i = np.cumsum(reps), Links(), 0
    while i < len(own):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + CHUNK_PAIRS, side="right")))
        n = reps[i:j]
        a = np.repeat(own[i:j], n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        x, y = fp[a], fp[b]
        near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        links.add(x[near], y[near])
        i = j
    return links.shrink()


def tree_links(fps: DataFrame, radius: int = 3, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links (a, b) that span the groups of the distinct 64-bit fingerprints ``fps`` (fp long) at ``radius`` bits or fewer."""
    spark = fps.sparkSession
    total = fps.count()
    some = fps.select("fp").sample(min(1.0, SAMPLE / max(1, total)), SEED).toArrow()  # about SAMPLE rows at most
    tree = grow(some.column("fp").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), total, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)  # its nodes are bounded by the sample
    nodes = len(tree.level)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(values), 2048):
                part = values[i : i + 2048]
                row, leaf, cost = route(tree, part, radius - radius // 2)
                fp, stored, many = part[row], cost <= radius // 2, tree.shards[leaf]
                at = np.repeat(np.arange(len(row)), many)
                turn = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                mine = (fp[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % many[at].astype(np.uint64) == turn.astype(np.uint64)
                columns = [pa.array(leaf[at].astype(np.int64) + nodes * turn), pa.array(fp[at].view(np.int64)), pa.array(stored[at] & mine)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "fp", "stored"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links() -> Iterator[pa.RecordBatch]:
            shard, fp, stored = (np.concatenate([h[i] for h in held]) for i in range(3))
            found = shard_links(shard, fp.view(np.uint64), stored, radius)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if batch.num_rows else 0
            if cut or (held and batch.num_rows and held[-1][0][-1] != columns[0][0]):  # all shards but the last are complete
                held.append(tuple(c[:cut] for c in columns))
                yield from links()
                held.clear()
            if batch.num_rows:
                held.append(tuple(c[cut:] for c in columns))
        if held:
            yield from links()

    sent = fps.select("fp").mapInArrow(spread, "shard long, fp long, stored boolean")
    dealt = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(search, "a long, b long")


def near_groups(docs: DataFrame, radius: int = 3, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): 64-bit fingerprints, linked at ``radius`` differing bits or fewer.

    ``component_id`` is the smallest doc_id reachable over links, the own one included. Null and wordless texts have the
    fingerprint zero and are linked like any other. Repeated rows give repeated results. Rows whose doc_id is null are linked
    too and take the component's id; a component of such rows alone has a null id. Other columns are not read.
    """
    rows = settle(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "simhash-docs")
    groups = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-groups")
    roots = components(tree_links(groups, radius))
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = settle(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = settle(named.join(least, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")
