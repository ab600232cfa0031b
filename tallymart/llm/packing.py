"""Best-fit packing of documents into sequences of a fixed capacity, by a grouping genetic algorithm.

Documents become pieces: their token ids and one end id; only documents longer than the capacity are cut. Full pieces are sequences of
their own. The others are dealt by hash into shards of about ``SHARD`` pieces, and each shard is packed by several islands: an island
keeps a few packings, and its crossover injects whole well-filled bins of one packing into another, drops the bins that would hold a
document twice, and best-fits the displaced documents, longest first. After each epoch an island's best packing migrates to the next
island of its shard. A shard is done when it needs no more bins than its tokens fill, which cannot be beaten; the others go on for ``EPOCHS``.

A bin is whole within a shard, so shards lose room at their ends. The emptiest bins of every shard (at most an eighth of its bins, one at
least) are therefore opened, and their pieces are packed again in the shards of a next level, until one shard is left. Levels shrink by
their ratio, so their number is a logarithm of the pieces. Only lengths, packings and their order travel; a task holds one shard.

``pieces`` cuts texts at single spaces and line feeds, which the tokenizer drops and no token spans, and the distinct words of a block
after letters where the tokenizer tells them apart; each part is encoded once for each worker (a bounded cache), and ids of words and
texts are put together by places. ``sequences`` puts the ids of packed pieces together again.

Null texts are empty: one piece, the end id. Repeated rows are packed each. Rows without id are packed too. An empty table gives
nothing. Which of several equal packings results depends on the order of rows in files; the number of sequences hardly does.
"""

from __future__ import annotations

import functools
import json
import os
import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import settle

CAPACITY, END = 2048, 0
SHARD, ISLANDS, EPOCHS, GENERATIONS, PACKINGS = 4096, 3, 3, 12, 4
#: Share of a packing's bins that one crossover injects, and of a shard's bins that the next level may open.
INJECTED, OPENED = 0.08, 0.125
#: Parts of words of one of the two generations that a worker caches, and the longest that is cached.
CACHE_WORDS, CACHE_LENGTH = 600_000, 40
#: Bytes of text that a task encodes at once (one text at least), texts whose ids are joined at once, and new parts in one string for the
#: tokenizer.
BLOCK, ROWS, JOINED = 8_000_000, 256, 1000
#: A word of one id that stands between new parts.
MARK = "\x01"
#: A normalizer and pre-tokenizer whose pre-tokens end after letters, and places where those letters are followed by ASCII that is none.
#: ASCII composes with nothing before it; U+0130 is no such letter, since a mark comes of it in lower case.
LETTERS_APART = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
)
AFTER_LETTERS = "([A-Za-zÀ-ÖØ-öø-įı-ɏ])([!-@\\[-`{-~])"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Strings cut at spaces: how many words each has, the words' codes, and the distinct words."""
    words = pc.split_pattern(column, " ")
    coded = words.flatten().dictionary_encode()
    return pc.list_value_length(words).to_numpy(), coded.indices.to_numpy(), coded.dictionary


def _joined(ids: np.ndarray, bounds: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds of lists of ``counts`` words each, of the words' own ids and bounds."""
    lengths = np.diff(bounds)[codes]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    places = np.repeat(bounds[codes] - ends[:-1], lengths)
    places += np.arange(len(places))
    return ids[places], ends[np.concatenate([[0], np.cumsum(counts)])]


class _Words:
    """Ids (little-endian unsigned 32-bit) of texts, by their distinct words and these by their parts; parts met before are looked up.
    When the young generation of the cache is full it becomes the old one, and parts that are met again come back from there."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        spec = json.loads(self.tokenizer.to_str())
        normalizer, first = spec["normalizer"], ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [None])[0]
        self.apart = (normalizer, first) == LETTERS_APART and all(not t["normalized"] for t in spec["added_tokens"])
        self.added = [t["content"] for t in spec["added_tokens"]]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """``words`` in few calls, told apart by the marks between them, or by where their tokens begin if any holds the mark."""
        out: list[bytes] = []
        chunks = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for chunk, found in zip(chunks, self.tokenizer.encode_batch_fast([f" {MARK} ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            marks = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else ids
            if len(self.mark) == 1 and len(marks) == len(chunk) - 1:
                begins, ends = [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)]
            else:
                found = self.tokenizer.encode(" ".join(chunk), add_special_tokens=False)
                ids = np.array(found.ids, dtype="<u4")
                starts = np.cumsum([0, *(len(w) + 1 for w in chunk[:-1])])
                begins = np.searchsorted(np.array([at for at, _ in found.offsets], dtype=np.int64), starts).tolist()
                ends = [*begins[1:], len(ids)]
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(begins, ends)]
        return out

    def _looked_up(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct ``parts``."""
        ids = list(map(self.young.get, parts))
        places = [at for at, i in enumerate(ids) if i is None]
        fresh = {p: i for at in places if (i := self.old.get(p := parts[at])) is not None}
        new = [p for at in places if (p := parts[at]) not in fresh]
        if new:
            fresh.update(zip(new, self._encoded(new)))
        for at in places:
            ids[at] = fresh[parts[at]]
        self.young.update((p, i) for p, i in fresh.items() if len(p) <= CACHE_LENGTH)
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        return ids

    def _parts(self, words: pa.Array) -> pa.Array:
        """Distinct words with spaces where the tokenizer tells their parts apart too; those that may hold an added token stay whole."""
        if not self.apart:
            return words
        cut = pc.replace_substring_regex(words, AFTER_LETTERS, r"\1 \2")
        for token in self.added:
            cut = pc.if_else(pc.match_substring(words, token), words, cut)
        return cut

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        words_of, words, distinct = _lists(pc.replace_substring(pc.fill_null(column, ""), "\n", " "))
        parts_of, parts, distinct = _lists(self._parts(distinct))
        found = self._looked_up(distinct.to_pylist())
        bounds = np.cumsum([0, *map(len, found)]) // 4
        ids, bounds = _joined(np.frombuffer(b"".join(found), dtype="<u4"), bounds, parts_of, parts)
        first, out = np.concatenate([[0], np.cumsum(words_of)]), []
        for at in range(0, len(words_of), ROWS):
            counts = words_of[at : at + ROWS]
            some, cuts = _joined(ids, bounds, counts, words[first[at] : first[at + len(counts)]])
            data, cuts = some.tobytes(), (4 * cuts).tolist()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BLOCK`` bytes of text, one row at least."""
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(before, before[at] + BLOCK, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


@functools.cache
def _words(path: str) -> _Words:
    return _Words(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document; ``tokenizer`` is a vocabulary file of the tokenizers library
    whose pre-tokens span no white space, ids are little-endian unsigned 32-bit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for block in _blocks(batch):
                rows, no, start, length, crc, data = array("q"), array("i"), array("q"), array("q"), array("q"), []
                for row, ids in enumerate(words.encode(block.column(1))):
                    ids += last
                    for k, place in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[place : place + 4 * capacity]
                        rows.append(row), no.append(k), start.append(place // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                        data.append(part if with_ids else None)
                columns = [block.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array(data, pa.binary())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                kept = range(len(names) if with_ids else len(names) - 1)
                yield pa.RecordBatch.from_arrays([columns[i] for i in kept], [names[i] for i in kept])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(doc_id, text).mapInArrow(cut, schema)


# The grouping genetic algorithm of one shard. A packing gives each item's bin; bins are lists of items with what they hold.


class Packing:
    """Bins of items: which items, and how much room is left. Packings share the lists of bins that they have in common, so a bin
    that changes is replaced. ``order``: each item's place when the longest come first, worked out once for all packings of a shard."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]] | None = None, free: list[int] | None = None, order: list[int] | None = None):
        self.lengths, self.capacity, self.order = lengths, capacity, order
        self.bins = bins or []
        self.free = [capacity - sum([lengths[i] for i in b]) for b in self.bins] if free is None else free
        self._cost: tuple[int, float] | None = None

    def best_fit(self, items: list[int]) -> Packing:
        """Put ``items``, in their order, each into the fullest bin that takes it."""
        # Room and number of a bin are one whole number, which compares faster than a pair.
        lengths, bins, free = self.lengths, self.bins, self.free
        room = sorted([f << 32 | b for b, f in enumerate(free) if f])
        for i in items:
            n = lengths[i]
            at = bisect_left(room, n << 32)
            if at < len(room):
                b = room.pop(at) & 0xFFFFFFFF
                bins[b] = [*bins[b], i]
            else:
                b = len(bins)
                bins.append([i])
                free.append(self.capacity)
            free[b] -= n
            if free[b]:
                insort(room, free[b] << 32 | b)
        self._cost = None
        return self

    def longest_first(self, items: list[int]) -> Packing:
        if self.order is None:
            self.order = [0] * len(self.lengths)
            for place, i in enumerate(sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i))):
                self.order[i] = place
        return self.best_fit(sorted(items, key=self.order.__getitem__))

    def cost(self) -> tuple[int, float]:
        """Number of bins, and less the more the filling differs: full bins and empty ones beat half-full ones."""
        if self._cost is None:
            self._cost = len(self.bins), -sum([(1 - f / self.capacity) ** 2 for f in self.free])
        return self._cost

    def crossed(self, other: Packing, rng: random.Random, share: float = INJECTED) -> Packing:
        """This packing with whole well-filled bins of ``other``; bins that share an item with them go, and what else they held is
        best-fitted."""
        drawn = rng.sample(range(len(other.bins)), min(len(other.bins), max(2, int(2 * share * len(other.bins)))))
        chosen = sorted(drawn, key=lambda b: (other.free[b], b))[: max(1, len(drawn) // 2)]
        given = [other.bins[b] for b in chosen]
        twice = {i for b in given for i in b}
        kept, free, displaced = [], [], []
        for b, f in zip(self.bins, self.free):
            if twice.isdisjoint(b):
                kept.append(b)
                free.append(f)
            else:
                displaced += [i for i in b if i not in twice]
        kept += given
        free += [other.free[b] for b in chosen]
        return Packing(self.lengths, self.capacity, kept, free, self.order).longest_first(displaced)

    def shaken(self, rng: random.Random) -> Packing:
        """Some of the emptier bins and as many others are opened and their items best-fitted."""
        order = sorted(range(len(self.bins)), key=lambda b: -self.free[b])
        opened = set(order[: max(2, len(order) // 50)]) | set(rng.sample(order, max(1, len(order) // 50)))
        kept = [b for at, b in enumerate(self.bins) if at not in opened]
        free = [f for at, f in enumerate(self.free) if at not in opened]
        return Packing(self.lengths, self.capacity, kept, free, self.order).longest_first([i for at in opened for i in self.bins[at]])

    def of_items(self) -> list[int]:
        """The bin of each item."""
        out = [0] * len(self.lengths)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out

    @classmethod
    def from_items(cls, lengths: list[int], capacity: int, of: list[int]) -> Packing:
        bins: list[list[int]] = [[] for _ in range(max(of, default=-1) + 1)]
        for i, b in enumerate(of):
            bins[b].append(i)
        return cls(lengths, capacity, bins)


def least_bins(lengths: list[int], capacity: int) -> int:
    """A bound that no packing beats: what the tokens fill, and the items of over half the capacity."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def evolve(lengths: list[int], capacity: int, start: list[list[int]], seed: int, generations: int = GENERATIONS, packings: int = PACKINGS) -> list[Packing]:
    """The packings of an island after ``generations``, best first; ``start`` holds packings that it begins with."""
    rng, goal, n = random.Random(seed), least_bins(lengths, capacity), len(lengths)
    group = [Packing.from_items(lengths, capacity, s) for s in start]
    if not group:
        group = [Packing(lengths, capacity).longest_first(list(range(n)))]
    while len(group) < packings and min(len(p.bins) for p in group) > goal:
        # Best fit in an order that is only roughly by length.
        noisy = sorted(range(n), key=lambda i: -lengths[i] * rng.uniform(0.7, 1.3))
        group.append(Packing(lengths, capacity).best_fit(noisy))
    group.sort(key=Packing.cost)
    for _ in range(generations):
        if len(group[0].bins) <= goal:
            break
        for _ in range(packings):
            a, b = sorted(rng.sample(range(len(group)), 2))  # ranks: the better one receives
            child = group[a].crossed(group[b], rng)
            if rng.random() < 0.5:
                child = child.shaken(rng)
            group.append(child)
        group = sorted(group, key=Packing.cost)[:packings]
    return group


_STATE = "shard long, island int, lengths array<int>, elites array<array<int>>"
_EVOLVED = f"{_STATE}, bins int, fitness double, done boolean"
_PLACED = "shard long, first array<int>, offset array<int>, opened array<boolean>"


def _evolve_island(capacity: int, generations: int, epoch: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        lengths = [int(n) for n in row.lengths]
        start = [[int(b) for b in e] for e in row.elites] if row.elites is not None else []
        group = evolve(lengths, capacity, start, zlib.crc32(f"{row.shard}:{row.island}:{epoch}".encode()), generations)
        bins, fitness = group[0].cost()
        elites = [p.of_items() for p in group[:2]]
        return pd.DataFrame({"shard": [row.shard], "island": [row.island], "lengths": [lengths], "elites": [elites], "bins": [bins], "fitness": [fitness], "done": [bins <= least_bins(lengths, capacity)]})

    return run


def _place(capacity: int):
    """For each item of a shard: the first item of its bin, its place there, and whether the bin is one of the emptiest."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        packing = Packing.from_items([int(n) for n in row.lengths], capacity, [int(b) for b in row.packing])
        some = sorted((b for b, f in enumerate(packing.free) if f), key=lambda b: (-packing.free[b], b))
        opened = set(some[:1]) | {b for b in some[: int(OPENED * len(packing.bins))] if packing.free[b] * 16 >= capacity}
        n = len(packing.lengths)
        first, offset, flags = [0] * n, [0] * n, [False] * n
        for b, items in enumerate(packing.bins):
            at = 0
            for i in items:
                first[i], offset[i], flags[i] = items[0], at, b in opened
                at += packing.lengths[i]
        return pd.DataFrame({"shard": [row.shard], "first": [first], "offset": [offset], "opened": [flags]})

    return run


def _packed_level(items: DataFrame, shards: int, capacity: int, islands: int, epochs: int, generations: int, name: str) -> DataFrame:
    """``items`` (uid, length, row) with sequence_id, offset and ``opened``."""
    dealt = items.groupBy(F.pmod(F.xxhash64("uid", F.lit(shards)), F.lit(shards)).alias("shard"))
    # A shard has a bounded number of items, whatever their lengths.
    shard = settle(dealt.agg(F.sort_array(F.collect_list(F.struct("uid", "length", "row"))).alias("items")), f"{name}-shards")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    state = shard.select("shard", numbers, F.transform("items", lambda i: i.length.cast("int")).alias("lengths"), F.lit(None).cast("array<array<int>>").alias("elites"))
    best = []
    for epoch in range(epochs):
        grown = settle(state.groupBy("shard", "island").applyInPandas(_evolve_island(capacity, generations, epoch), _EVOLVED), f"{name}-epoch")
        found = grown.groupBy("shard").agg(F.max("done").alias("done"), F.min_by(F.struct("lengths", F.col("elites")[0].alias("packing")), F.struct("bins", "fitness", "island")).alias("b"))
        last = epoch + 1 == epochs
        best.append(found.where(F.lit(last) | F.col("done")).select("shard", "b.*"))
        if last:
            break
        open_ = found.where("NOT done").select("shard")
        grown = grown.join(open_, "shard", "left_semi")
        if grown.isEmpty():
            break
        # The best packing of each island migrates to the next one.
        moved = grown.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elites")[0].alias("guest"))
        state = grown.join(moved, ["shard", "island"]).select("shard", "island", "lengths", F.concat("elites", F.array("guest")).alias("elites"))
    placed = reduce(DataFrame.unionByName, best).groupBy("shard").applyInPandas(_place(capacity), _PLACED)
    both = placed.join(shard, "shard")
    each = both.select("items", F.explode(F.arrays_zip("items", "first", "offset", "opened")).alias("e"))
    number = F.element_at("items", F.col("e.first") + 1)["uid"]
    return each.select(F.col("e.items.uid").alias("uid"), F.col("e.items.length").alias("length"), F.col("e.items.row").alias("row"), number.alias("sequence_id"), F.col("e.offset").cast("long").alias("offset"), F.col("e.opened").alias("opened"))


def pack(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """``parts`` (rows with a ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    columns = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    rows = settle(parts.select(F.monotonically_increasing_id().alias("uid"), F.col("length").cast("long").alias("length"), F.struct(*columns).alias("row")), "packing-pieces")
    done = [rows.where(F.col("length") >= capacity).select("row", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    items, level, before = rows.where(F.col("length") < capacity), 0, None
    while True:
        n = items.count()
        # Where every piece would be opened again, a level gains nothing.
        shards = 1 if n <= shard else -(-n // shard)
        packed = settle(_packed_level(items, shards, capacity, islands, epochs, generations, f"packing-{level}"), f"packing-level-{level}")
        final = shards == 1 or (before is not None and n >= before)
        done.append((packed if final else packed.where("NOT opened")).select("row", "sequence_id", "offset"))
        if final:
            break
        items, level, before = packed.where("opened").select("uid", "length", "row"), level + 1, n
    return reduce(DataFrame.unionByName, done).select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces) of packed pieces with ``ids``: the ids of each sequence in a row, and how many pieces it holds."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p.ids))
    return packed.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", joined.alias("ids"), F.size("p").alias("pieces"))
