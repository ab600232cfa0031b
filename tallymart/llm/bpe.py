"""Byte-level BPE: exact linear-time encoding by backtracking over longest matches, decoding through an offset table.

Encoding a pre-token walks it from the left. An Aho-Corasick automaton over the vocabulary gives every token that starts at
each byte; the walk takes the longest one that is compatible with the token before it and whose end has not been proven
unreachable, falls back to shorter ones, and steps back when none is left. Two adjacent tokens are compatible when merging
their joined bytes yields the same two tokens again; these answers are kept in a pair table. A sequence whose neighbours are
all compatible is the one that the merge rules produce, so the result is exact. Every byte position is ruled out at most
once, so the work is linear in the length.

Null texts count as empty. Empty texts give no ids. Rows are independent: repeated rows, ties and extra columns need nothing.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Cached words a worker holds before it starts afresh, and the longest word (in characters) that is cached.
CACHE_WORDS, CACHE_LENGTH = 200_000, 40
CACHE_PAIRS = 500_000
#: Documents that a task turns over at once.
ROWS = 256


def _byte_symbols() -> dict[str, int]:
    """Symbol to byte: printable Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """A byte-level BPE vocabulary file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], _byte_symbols()
        to_bytes = lambda token: bytes(symbols[c] for c in token)
        vocab = {to_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = token
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = to_bytes(a), to_bytes(b)
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        first: dict[int, int] = {}
        for rank, token in self.merges.values():
            first[token] = min(rank, first.get(token, rank))
        #: Whether every rule comes after the rules that make its sides: rank order is then the order of time.
        self.ordered = all(first.get(side, -1) < rank for pair, (rank, _) in self.merges.items() for side in pair)
        self.last_merges: dict[int, tuple | None] = {}
        self.byte_ids = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.lengths = lengths
        self.offsets = np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        self.pre_token = regex.compile(PRE_TOKEN)
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """The merge rules applied one by one, lowest rank first, while more than ``until`` tokens are left; used only on the bytes
        of one or two tokens."""
        ids = [self.byte_ids[b] for b in data]
        while len(ids) > until:
            ranked = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
            if not ranked:
                break
            _, i = min(ranked)
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def last_merge(self, token: int) -> tuple[int, int, int] | None:
        """(left, right, rank) of the merge that completes the bytes of ``token``; () for a byte, None if they give other tokens."""
        known = self.last_merges.get(token, 0)
        if known == 0:
            ids = self.merged(self.token_bytes[token], 2)
            made = self.merges.get(tuple(ids)) if len(ids) == 2 else None
            known = () if ids == [token] else (*ids, made[0]) if made and made[1] == token else None
            self.last_merges[token] = known
        return known

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at the left (0) or right (1) end of ``token`` while it is merged, each with the rank of the merge
        that uses it up."""
        found, limit = [], math.inf
        while True:
            found.append((token, limit))
            made = self.last_merge(token)
            if not made:
                return found
            token, limit = made[side], made[2]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens survive the merge rules; ``left`` -1: whether ``right`` alone does.

        They do not if a merge across their border comes before one of its two sides is used up within its own token. Of two
        merges by the same rule the left one is first.
        """
        key = (left + 1) << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.last_merge(right) is not None
            if known and left >= 0 and not self.ordered:
                known = self.merged(self.token_bytes[left] + self.token_bytes[right]) == [left, right]
            elif known and left >= 0:
                ends, starts, rule = self.edge(left, 1), self.edge(right, 0), self.merges.get
                known = not any((made := rule((a, b))) and made[0] < used_a and made[0] <= used_b for a, used_a in ends for b, used_b in starts)
            self.pairs[key] = known
        return known

    def encode_word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        n, known, check = len(data), self.pairs.get, self.compatible
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(data.decode("latin-1")):
            starting[end - match[0] + 1].append(match)
        dead = bytearray(n + 1)  # positions from which the rest cannot be finished after the tokens chosen so far
        chosen: list[int] = []
        at: list[tuple[int, int]] = []  # where each chosen token starts, and which candidate of that place it is
        # A token that is compatible with the one before it survives alone too, so only a first token is checked alone.
        last, position, candidate = -1, 0, len(starting[0]) - 1 if n else -1
        while position < n:
            here = starting[position]
            while candidate >= 0:
                length, token = here[candidate]
                if not dead[position + length]:
                    fits = known((last + 1) << 32 | token)
                    if check(last, token) if fits is None else fits:
                        break
                candidate -= 1
            if candidate >= 0:
                chosen.append(token)
                at.append((position, candidate))
                last = token
                position += length
                candidate = len(starting[position]) - 1 if position < n else -1
            elif chosen:
                dead[position] = 1
                chosen.pop()
                last = chosen[-1] if chosen else -1
                position, candidate = at.pop()
                candidate -= 1
            else:
                raise ValueError("the vocabulary cannot spell these bytes")
        return chosen

    def _word(self, word: str) -> bytes:
        ids = np.array(self.encode_word(word.encode()), dtype="<u4").tobytes()
        if len(word) <= CACHE_LENGTH:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _ordinary(self, text: str) -> bytes:
        words = self.words
        return b"".join([words.get(w) or self._word(w) for w in self.pre_token.findall(text)])

    def encode(self, text: str | None, special: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; ``special``: added tokens in the text become their own ids."""
        if not text:
            return b""
        if not special or self.split_special is None:
            return self._ordinary(text)
        parts = self.split_special.split(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if i % 2 else self._ordinary(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes | None) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        if not ids:
            return ""
        token = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        lengths = self.lengths[token]
        ends = np.cumsum(lengths)
        places = np.repeat(self.offsets[token] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.flat[places].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """The tokenizer of a file, once for each worker process."""
    return Tokenizer(path)


def encode(text: Column, path: str, special: bool = True) -> Column:
    """Binary column of the ids of ``text`` (little-endian unsigned 32-bit integers)."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        tokenizer = load(path)
        return pd.Series([tokenizer.encode(t, special) for t in texts], dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """Text column of binary ids as :func:`encode` makes them."""

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        tokenizer = load(path)
        return pd.Series([tokenizer.decode(i) for i in column], dtype=object)

    return texts(F.coalesce(ids, F.lit(b"")))


def encode_documents(docs: DataFrame, path: str, text: str = "text", special: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (binary) and ``n_tokens``; columns of these names are replaced."""
    return docs.withColumn("ids", encode(F.col(text), path, special)).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of its ids."""
    return docs.withColumn("decoded", decode(F.col(ids), path))


def transcode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, special: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ids, n_tokens and decoded: encoding and decoding in one pass, which
    holds one tokenizer and a few documents for each task; equal texts among these are encoded once. Columns of these names are
    replaced."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_tokens", "decoded")]
    body = "text_" + "_" * max(map(len, docs.columns))  # no column has this name
    rows = docs.select(*kept, F.col(text).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(len(kept)).to_pylist()
                ids_of = {t: tokenizer.encode(t, special) for t in set(texts)}  # copies of a text stand side by side in a mix
                text_of = {i: tokenizer.decode(i) for i in set(ids_of.values())}
                ids = [ids_of[t] for t in texts]
                made = [pa.array(ids, pa.binary()), pa.array([text_of[i] for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], [*kept, "ids", "decoded"])

    schema = rows.drop(body).schema.add("ids", "binary").add("decoded", "string")
    return rows.mapInArrow(run, schema).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
