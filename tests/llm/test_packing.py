"""Packing: pieces against the tokenizers library, sequences whole and gapless, and fewer bins than best fit alone needs."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymart.llm import packing
from tallymart.llm.queries import WORD_TOKENIZER, op12_packing, table

DOCS = "doc_id long, text string, uid string, row string, length string, offset string, sequence_id string"


def library(text, tokenizer=Tokenizer.from_file(WORD_TOKENIZER)):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def true_pieces(doc_id, text, capacity):
    ids = library(text)
    out = []
    for k, at in enumerate(range(0, len(ids), capacity)):
        part = ids[at : at + capacity]
        out.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return out


def check_sequences(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(bins)


TEXTS = [None, "", " ", "\n\n", "Hello  world\nA\tB\r\nC", "İstanbul ΣΑΣ ǅ é é ́x ﬁ", "a<|endoftext|>b <|startoftext|> <|endof text|>", "don't I'LL 12345 #$%!", "nbsp x y\x1cz\x85w", "漢字 かな 👩‍👩‍👧 " * 40, "x" * 5000, "word " * 3000]


def test_pieces_are_those_of_the_library(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], DOCS)
    for capacity in (16, 2048):
        found = packing.pieces(docs, WORD_TOKENIZER, capacity, with_ids=True).collect()
        true = Counter(p for r in rows for p in true_pieces(*r, capacity))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == true
        packed = packing.pack(packing.pieces(docs, WORD_TOKENIZER, capacity, with_ids=True), capacity, shard=20)
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect()) == true
        n = check_sequences(packed.collect(), capacity)
        whole = packing.sequences(packed)
        total = sum(k[3] * v for k, v in true.items())
        assert whole.count() == n and whole.agg(F.sum(F.length("ids"))).first()[0] == 4 * total
        assert n <= math.ceil(total / capacity) + 2


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    words = packing._Words(WORD_TOKENIZER)
    for text in ("a b c d", "a e", "b f g h i", "a b", "", "a z z y x w"):
        assert words.encode([text, None]) == [np.array(library(t)[:-1], dtype="<u4").tobytes() for t in (text, None)]
        assert len(words.young) <= 3 + 6


def test_random_texts_cut_at_spaces(spark):
    rng = random.Random(5)
    parts = ["a", "B'", "'s", " ", "\n", "\t", "\x0b", " ", " ", "́", "1", "é", "Σ", "<|endoftext|>", "-", "the"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    found = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), WORD_TOKENIZER).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == Counter(p for r in rows for p in true_pieces(*r, 2048))


def triples(n, capacity, seed):
    """Lengths that fill ``n`` bins by threes: hard for best fit."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(int(0.38 * capacity), int(0.49 * capacity))
        b = rng.randint(int(0.25 * capacity), (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def test_crossover_keeps_whole_bins_and_every_item():
    lengths = triples(40, 1000, 1)
    rng = random.Random(2)
    a, b = packing.Packing(lengths, 1000).longest_first(list(range(120))), packing.Packing(lengths, 1000).best_fit(list(range(120)))
    for _ in range(20):
        child = a.crossed(b, rng)
        assert sorted(i for x in child.bins for i in x) == list(range(120)) and min(child.free) >= 0
        assert sum(x in b.bins for x in child.bins) >= 1
        assert sorted(i for x in child.shaken(rng).bins for i in x) == list(range(120))
        assert packing.Packing.from_items(lengths, 1000, child.of_items()).cost() == child.cost()


def test_evolution_beats_best_fit():
    gained = 0
    for seed in range(3):
        lengths = triples(40, 1000, seed)
        best_fit = len(packing.Packing(lengths, 1000).longest_first(list(range(120))).bins)
        evolved = len(packing.evolve(lengths, 1000, [], seed, generations=150, packings=8)[0].bins)
        assert 40 <= evolved <= best_fit
        gained += best_fit - evolved
    assert gained >= 3


def test_levels_and_islands(spark):
    rng = random.Random(7)
    lengths = [rng.choice([1, 7, 300, 511, 700, 1023, 1025, 1500, 2047, 2048]) for _ in range(900)]
    parts = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, uid string")
    packed = packing.pack(parts, 2048, shard=100, epochs=2, generations=3).collect()
    assert sorted(r.doc_id for r in packed) == list(range(900)) and all(lengths[r.doc_id] == r.length and r.uid == "x" for r in packed)
    n = check_sequences(packed, 2048)
    alone = packing.Packing(lengths, 2048).longest_first(list(range(900)))
    assert n <= len(alone.bins) + 3
    ones = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("length"))
    assert check_sequences(packing.pack(ones, 64, shard=90).collect(), 64) <= math.ceil(5000 / 64) + 1
    wide = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(40).cast("long").alias("length"))
    assert check_sequences(packing.pack(wide, 64, shard=50, epochs=2).collect(), 64) == 300


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert packing.pack(packing.pieces(docs, WORD_TOKENIZER)).count() == 0


def test_query_over_whole_table(spark, sf_dir):
    rows = op12_packing(spark, sf_dir).collect()
    true = Counter(p for r in table(spark, sf_dir, "documents").collect() for p in true_pieces(r.doc_id, r.text, 2048))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == true
    total = sum(k[3] * v for k, v in true.items())
    assert check_sequences(rows, 2048) <= math.ceil(total / 2048) + 1


def test_packings_share_bins_and_order():
    """Children take lists of bins, their room and the order of items from their parents, which stay as they were."""
    rng = random.Random(4)
    lengths = [rng.randint(1, 90) for _ in range(400)]
    parents = [packing.Packing(lengths, 100).longest_first(list(range(400)))]
    parents.append(packing.Packing(lengths, 100, order=parents[0].order).best_fit(rng.sample(range(400), 400)))
    before = [([list(b) for b in p.bins], list(p.free), p.cost()) for p in parents]
    for _ in range(20):
        child = parents[0].crossed(parents[1], rng).shaken(rng)
        assert child.order is parents[0].order and any(b is p for b in child.bins for p in parents[0].bins)
        assert sorted(i for b in child.bins for i in b) == list(range(400))
        assert child.free == [100 - sum(lengths[i] for i in b) for b in child.bins] and min(child.free) >= 0
        assert child.cost() == (len(child.bins), pytest.approx(-sum((1 - f / 100) ** 2 for f in child.free)))
        assert before == [([list(b) for b in p.bins], p.free, p.cost()) for p in parents]


def test_words_share_parts(monkeypatch):
    """What stands before punctuation is encoded once, whatever follows; what may hold an added token or a mark of lower case stays whole."""
    words, asked = packing._Words(WORD_TOKENIZER), []
    encoded = words._encoded
    monkeypatch.setattr(words, "_encoded", lambda parts: asked.extend(parts) or encoded(parts))
    texts = [f"zyxhouse{c} Été{c}" for c in (".", ",", "!!", "'s", "42")]
    for _ in range(2):
        assert words.encode(texts) == [np.array(library(t)[:-1], dtype="<u4").tobytes() for t in texts]
    assert sorted(asked) == sorted(["zyxhouse", "Été", ".", ",", "!!", "'s", "42"])
    whole = pa.array(["a.b", "x<|endoftext|>y", "İ.", "e\u0301.", "Σ.", "don't", "Zoë4"])
    assert words._parts(whole).to_pylist() == ["a .b", "x<|endoftext|>y", "İ.", "e\u0301.", "Σ.", "don 't", "Zoë 4"]
    words.apart = False
    assert words._parts(whole) is whole


def test_random_parts_and_marks(monkeypatch):
    monkeypatch.setattr(packing, "JOINED", 7)
    monkeypatch.setattr(packing, "ROWS", 5)
    rng = random.Random(6)
    parts = ["a", "H", "\u0331", "\u0301", "\u0307", "İ", "i", "į", "ß", "Σ", "σ", "É", "ɏ", "'", "'s", "'LL", "re", ".", "!?", "$", "7", "<", "|>", "<|endoftext|>", "\x01", "²", "文", "×", "_", " ", "\n", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    words = packing._Words(WORD_TOKENIZER)
    assert words.encode(texts) == [np.array(library(t)[:-1], dtype="<u4").tobytes() for t in texts]
    assert words.encode(pa.array(["x", None, *texts]).slice(1, 90)) == words.encode([None, *texts[:89]])
    words.mark, words.young, words.old = [1, 2], {}, {}
    assert words.encode(texts[:300]) == [np.array(library(t)[:-1], dtype="<u4").tobytes() for t in texts[:300]]


def test_blocks(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 10)
    texts = ["x" * 4, None, "y" * 6, "", "z" * 25, "é" * 3, "a" * 4, "b", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["id", "text"]).slice(0)
    found = [b.column(1).to_pylist() for b in packing._blocks(batch)]
    assert found == [texts[:4], texts[4:5], texts[5:7], texts[7:]]
    assert [b.column(0).to_pylist() for b in packing._blocks(batch.slice(2, 3))] == [[2, 3], [4]]
    assert list(packing._blocks(batch.slice(0, 0))) == []
