"""Near copies at a stated similarity of word shingles (shared over united): SimHash and vantage-point trees, verified exactly.

Documents with the same set of shingles are one node, and a node has a SimHash fingerprint of 128 bits. Fingerprints of a pair of
similarity 0.8 differ in about a seventh of their bits, and no single tree prunes at such a radius: distances to any point spread
less than that. So a forest is grown with the tree of :mod:`simhash`. Each tree draws bits of its own and cuts them into levels of
``LEVEL_BITS``; a node of a level has a vantage point, and a fingerprint goes down the branch of its distance to it, alone. A pair
keeps its branch on a level as long as the distances of its two ends to the vantage point agree, so a tree of few levels holds a
good part of all close pairs, and every tree is another draw. Trees are added until of sampled fingerprints, each with its bits
turned over as often as a pair of just that similarity differs, no more than ``MISSED`` meet their original in no leaf. A
table of ``LEAF_ROWS`` nodes or fewer is one leaf, and every pair is compared. Every fingerprint is in every tree; the trees are
grown from a sample of ``SAMPLE``, about.

Links are verified by the shingle sets of both ends, joined by key. In a leaf two nodes are candidates if their fingerprints lie
within :func:`radius_of` bits and their sizes within the ratio. They are sent to verification nearest first: 1 for each node, then 4,
16 and so on, until no leaf has any left between nodes of different components. From the second turn on they pass a triangle bound,
too: the shingles' hash space is cut into ``PARTS`` parts, and the differences of the two sets' sizes on all parts add up to no more
than the shingles that one of them lacks, which the similarity bounds. So this filter loses no link. Only leaves that have candidates
left go to the next turn, and of these only the nodes that are near to some other.

So the groups are the components of all verified links among candidates: no group is cut for its size, and no pair of a group that
is joined already is looked at. Large leaves are dealt to several tasks.

Shingle sets hold 32 bits of each hash; two shingles of a pair of documents agree by chance about once in 40,000 pairs of 300 words.
They are made for candidates alone. Intermediate tables are removed before the texts are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .scratch import likely, passing, settle
from .simhash import Tree, grow, majority, route

BITS, SEED = 128, 42
#: Bits of a level, rows of a leaf to aim at, sampled fingerprints (about, at most), those that are tried in pairs, and the share of
#: pairs of just the similarity that no tree may hold.
LEVEL_BITS, LEAF_ROWS, SAMPLE, TRIED, MISSED = 2, 1 << 12, 1 << 16, 1 << 13, 0.004
#: Words whose hash a task remembers, and documents that it turns over at once.
CACHE_WORDS, DOCS = 200_000, 256
#: Parts of the hash space (a power of two).
PARTS = 128
#: Rows of a leaf in one task, pairs for each node in the first turn, and pairs compared at once (what a core's cache holds).
BUCKET_ROWS, NEAREST, CHUNK_PAIRS = 1 << 13, 1, 1 << 17
_RNG = np.random.default_rng(SEED)
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _PLACE[-1]
    h = (h ^ (h >> np.uint64(29))) * _PLACE[-2]
    return h ^ (h >> np.uint64(32))


def shingles(words: list[bytes], shingle: int, known: dict[bytes, int]) -> np.ndarray:
    """Distinct hashes of the shingles of ``shingle`` words (up to 32), sorted; fewer words are one shingle."""
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.array([known[w] for w in words], dtype=np.uint64)
    n = max(1, len(words) - shingle + 1)
    # Fewer words take other multipliers than the first of a full shingle would.
    parts = [h[i : i + n] * _PLACE[i + (32 if len(words) < shingle else 0)] for i in range(min(shingle, len(words)))]
    return np.unique(_mixed(sum(parts[1:], parts[0])))


def _grams(text: str | None, shingle: int, known: dict[bytes, int]) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return shingles(words, shingle, known) if words else np.zeros(0, dtype=np.uint64)


def _long(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))


def turned(similarity: float) -> float:
    """Share of the bits in which fingerprints of a pair of that similarity differ; its cosine is 2s / (1 + s)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: float, bits: int = BITS) -> int:
    """Differing bits within which all but one in 10,000 pairs of that similarity lie: what is expected of such a pair, and four
    standard deviations more."""
    p = turned(similarity)
    return int(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` (id, idh, content, text) with key, n (distinct shingles) and the fingerprint's halves f0 and f1 in the place of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                keys, sizes, fps = [], [], []
                for text in part.column(3).to_pylist():
                    g = _grams(text, shingle, known)
                    keys.append(xxhash.xxh3_64_intdigest(g.tobytes()))
                    sizes.append(len(g))
                    fps.append(majority(np.stack([g, _mixed(~g)], axis=1).view(np.uint8)) if len(g) else bytes(16))
                halves = np.frombuffer(b"".join(fps), dtype="<i8").reshape(-1, 2)
                columns = [*part.columns[:3], _long(keys), pa.array(sizes, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "idh", "content", "key", "n", "f0", "f1"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, idh long, content long, key long, n int, f0 long, f1 long")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """key, n, grams and parts (shingles in each part of the hash space, 255 at most) of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                keys, sizes, grams, parts = [], [], [], []
                for text in batch.column(0).slice(at, DOCS).to_pylist():
                    g = _grams(text, shingle, known)
                    keys.append(xxhash.xxh3_64_intdigest(g.tobytes()))
                    sizes.append(len(g))
                    grams.append(np.unique(g.astype(np.uint32)).view(np.int32))
                    at_part = (g >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
                    parts.append(np.minimum(np.bincount(at_part, minlength=PARTS), 255).astype(np.uint8).tobytes())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, grams)]).astype(np.int32)), pa.array(np.concatenate(grams), pa.int32()))
                yield pa.RecordBatch.from_arrays([_long(keys), pa.array(sizes, pa.int32()), lists, pa.array(parts, pa.binary())], ["key", "n", "grams", "parts"])

    return texts.mapInArrow(run, "key long, n int, grams array<int>, parts binary")


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 bits as unsigned numbers."""
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").ravel().astype(np.uint64)


def _leaves(tree: Tree, words: np.ndarray) -> np.ndarray:
    row, leaf, _ = route(tree, words, 0)
    found = np.empty(len(words), dtype=np.int64)
    found[row] = leaf
    return found


def forest(sample: np.ndarray, total: int, similarity: float) -> list[tuple[np.ndarray, Tree]]:
    """Trees for ``total`` fingerprints, with the 64 bits that each of them draws; ``sample`` has a row of bits for each fingerprint."""
    rng = np.random.default_rng(SEED)
    some = sample[rng.permutation(len(sample))[:TRIED]]
    moved = some ^ (rng.random(some.shape) < turned(similarity))
    missed = np.ones(len(some), dtype=bool)
    trees: list[tuple[np.ndarray, Tree]] = []
    while not trees or missed.sum() > MISSED * len(some):
        places = rng.permutation(BITS)[:64]
        tree = grow(_words(sample[:, places]), total, LEAF_ROWS, SEED + len(trees), 64 // LEVEL_BITS, BUCKET_ROWS)
        if len(some):
            missed &= _leaves(tree, _words(some[:, places])) != _leaves(tree, _words(moved[:, places]))
        trees.append((places, tree))
    return trees


def _bits(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """A row of bits for each fingerprint (f0, f1)."""
    halves = np.stack([batch.column(c).to_numpy() for c in ("f0", "f1")], axis=1)
    return np.unpackbits(np.ascontiguousarray(halves).view(np.uint8), axis=1)


def leaf_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """(shard, key, n, f0, f1, own) of ``sets`` (key, n, f0, f1) for every tree. A shard is a leaf, or of a large leaf all nodes, of which some
    are its own."""
    spark = sets.sparkSession
    total = sets.count()
    some = sets.select("f0", "f1").sample(min(1.0, SAMPLE / max(1, total)), SEED).toArrow()  # about SAMPLE rows at most
    shared = spark.sparkContext.broadcast(forest(_bits(some), total, similarity))  # bounded by the sample

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                bits = _bits(part)
                drawn = part.column(0).to_numpy().view(np.uint64)
                for no, (places, tree) in enumerate(shared.value):
                    leaf = _leaves(tree, _words(bits[:, places]))
                    many = tree.shards[leaf]
                    at = np.repeat(np.arange(len(leaf)), many)
                    turn = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    own = drawn[at] % many[at].astype(np.uint64) == turn.astype(np.uint64)
                    shard = (no << 48) + (leaf[at] << 24) + turn
                    yield pa.RecordBatch.from_arrays([pa.array(shard), *(c.take(pa.array(at)) for c in part.columns), pa.array(own)], ["shard", "key", "n", "f0", "f1", "own"])

    return sets.select("key", "n", "f0", "f1").mapInArrow(spread, "shard long, key long, n int, f0 long, f1 long, own boolean")


def verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``links`` (a, b) of which the shingle sets (key, n, grams) are that similar."""
    one = sets.select(F.col("key").alias("a"), F.col("n").alias("n1"), F.col("grams").alias("g1"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("n2"), F.col("grams").alias("g2"))
    both = links.join(one, "a").where(F.size("g1") > 0).join(two, "b")
    shared = F.size(F.array_intersect("g1", "g2"))
    return both.where(shared >= F.lit(similarity) * (F.col("n1") + F.col("n2") - shared)).select("a", "b")


def _nearest(similarity: float, low: int, high: int):
    """Of shards' rows (shard, key, n, f0, f1, own, then comp and parts where they are known): pairs (shard, a, b), each node with those
    of other components that rank from ``low`` to ``high`` among its near ones; and of shards that have more, the rows (shard, a, n,
    f0, f1, own) of nodes that are near to some other."""
    allowed = radius_of(similarity)

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        shard, n = rows.column(0).to_numpy(), rows.column(2).to_numpy().astype(np.float64)
        f0, f1 = (rows.column(c).to_numpy().view(np.uint64) for c in (3, 4))
        own = rows.column(5).to_numpy(zero_copy_only=False)
        comp = rows.column(6).to_numpy() if rows.num_columns > 6 else np.arange(len(shard))
        parts = np.frombuffer(b"".join(rows.column(7).to_pylist()), dtype=np.uint8).reshape(-1, PARTS) if rows.num_columns > 6 else None
        ends = np.flatnonzero(np.concatenate([shard[1:] != shard[:-1], [True]])) + 1
        left, right, more = [], [], []
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
            others = a + np.flatnonzero(own[a:b])
            touched, open_ = np.zeros(b - a, dtype=bool), False
            step = max(1, CHUNK_PAIRS // max(1, len(others)))
            one, two = f0[others][None, :], f1[others][None, :]
            for i in range(a, b, step):
                x = np.arange(i, min(b, i + step))
                far = np.bitwise_count(f0[x][:, None] ^ one)
                far += np.bitwise_count(f1[x][:, None] ^ two)
                far = far.ravel()
                at = np.flatnonzero(far <= allowed)
                far, u, v = far[at], x[at // max(1, len(others))], others[at % max(1, len(others))]
                kept = (u != v) & (np.minimum(n[u], n[v]) >= similarity * np.maximum(n[u], n[v]))
                if parts is not None:
                    kept[kept] = np.concatenate([_close(parts, n, u[kept][at : at + (1 << 14)], v[kept][at : at + (1 << 14)], similarity) for at in range(0, max(1, kept.sum()), 1 << 14)])
                far, u, v = far[kept], u[kept], v[kept]
                touched[u - a] = touched[v - a] = True
                order = np.lexsort((v, far, u))
                u, v = u[order], v[order]
                rank = np.arange(len(u)) - np.searchsorted(u, u)
                apart = comp[u] != comp[v]
                now = apart & (rank >= low) & (rank < high)
                left.append(u[now])
                right.append(v[now])
                open_ |= bool((apart & (rank >= high)).any())
            if open_:
                more.append(a + np.flatnonzero(touched))
        u, v = (np.concatenate(x or [np.zeros(0, int)]) for x in (left, right))
        key = rows.column(1)
        first, second = key.take(pa.array(u)), key.take(pa.array(v))
        none = [pa.nulls(len(u), kind) for kind in (pa.int32(), pa.int64(), pa.int64(), pa.bool_())]
        names = ["shard", "a", "b", "n", "f0", "f1", "own"]
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(u)), first, second, *none], names)
        rest = rows.take(pa.array(np.concatenate(more or [np.zeros(0, int)])))
        yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.nulls(rest.num_rows, pa.int64()), *(rest.column(c) for c in (2, 3, 4, 5))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))
            if cut or (held and held[-1].column(0)[-1].as_py() != shard[0]):  # all shards but the last are complete
                held.append(batch.slice(0, cut))
                yield from pairs(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs(held)

    return run


def _close(parts: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the pairs p-q pass the triangle bound; as whole numbers, with room for rounding of the similarity."""
    apart = np.abs(parts[p].astype(np.int16) - parts[q]).sum(axis=1, dtype=np.int64)
    return apart <= (1 - similarity) / (1 + similarity) * (n[p] + n[q]) + 1e-6


def links(sets: DataFrame, rows: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(node, root) of the nodes of ``sets`` (key, n, f0, f1; a row for each key) that have verified links. ``rows`` (content, key) and
    ``texts`` (content, text) lead to their texts, any number of rows for each key."""
    spark = sets.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held, good, roots, grams = leaf_rows(sets.where("n > 0"), similarity), None, None, None
    low, high = 0, NEAREST
    while True:
        dealt = held.repartition(count, "shard").sortWithinPartitions("shard", "key")
        found = settle(dealt.mapInArrow(_nearest(similarity, low, high), "shard long, a long, b long, n int, f0 long, f1 long, own boolean"), "copies-found")
        pairs = found.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = found.where("b IS NULL").select("shard", F.col("a").alias("key"), "n", "f0", "f1", "own")
        if grams is None:
            # Every node that is near to some other is in a pair of the first turn.
            keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
            wanted = settle(rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min("content").alias("content")).select("content"), "copies-wanted")
            some = likely(texts, F.col("content"), wanted.select(F.col("content").alias("key")))
            some = some.groupBy("content").agg(F.first("text").alias("text")).join(wanted, "content", "left_semi").select("text")
            grams = settle(shingle_sets(some, shingle).dropDuplicates(["key"]), "copies-grams")
        more = settle(verified(pairs, grams, similarity), "copies-links")
        if roots is None or not more.isEmpty():
            good = more if good is None else good.unionByName(more)
            roots = components(good)
        if rest.isEmpty():
            return roots
        known = rest.join(roots.withColumnRenamed("node", "key"), "key", "left").join(grams.select("key", "parts"), "key")
        held = known.select("shard", "key", "n", "f0", "f1", "own", F.coalesce("root", "key").alias("comp"), "parts")
        low, high = high, 4 * high


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without near copies: of each group, the row with the smallest doc_id stays.

    Links join texts whose sets of ``shingle``-word shingles share ``similarity`` or more of what they have together. Null and
    wordless texts form one group. A row whose doc_id is null stays only if no row of its group has one. Rows are told apart by
    doc_id and text; of rows that repeat both one stays, and so of rows without doc_id that repeat a text. All columns, of any
    type and name, are kept as they are. An empty table stays empty.
    """
    body, own = F.coalesce(F.col(text), F.lit("")), F.col(doc_id)
    idh, content = F.xxhash64(own.isNull(), own.cast("string")), F.xxhash64(body)
    with passing(docs.sparkSession, "copies"):
        rows = settle(nodes(docs.select(own.alias("id"), idh.alias("idh"), content.alias("content"), body.alias("text")), shingle), "copies-docs")
        sets = rows.groupBy("key").agg(F.first(F.struct("n", "f0", "f1")).alias("s"), F.min("id").alias("rep")).select("key", "s.*", "rep")
        sets = settle(sets, "copies-sets")
        texts = docs.select(content.alias("content"), body.alias("text"))
        roots = links(sets.select("key", "n", "f0", "f1"), rows.select("content", "key"), texts, similarity, shingle)
        named = settle(sets.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root")), "copies-named")
        least = settle(named.groupBy("root").agg(F.min("rep").alias("rep")), "copies-least")
        owners = settle(named.select("key", "root").join(least, "root").select("key", "root", "rep"), "copies-owners")
        kept = rows.select("id", "idh", "content", "key").join(owners, "key").where(F.col("id").eqNullSafe(F.col("rep")))
        # Of several texts under the smallest id of a group the one with the least hash stays.
        kept = settle(kept.groupBy("idh", "root").agg(F.min("content").alias("content")).select("idh", "content"), "copies-kept", lasting=True)
    # Repeated rows are reduced within each task; the join follows the same key, so texts are shuffled once.
    whole = docs.select(F.struct("*").alias("doc"), idh.alias("idh"), content.alias("content"))
    once = whole.groupBy("idh", "content").agg(F.first("doc").alias("doc"))
    return once.join(kept, ["idh", "content"], "left_semi").select("doc.*")
