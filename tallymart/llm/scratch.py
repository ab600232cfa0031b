"""Intermediate tables in the folder that all executors share, and a filter that spares most rows a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import passing, settle, shared_path

__all__ = ["likely", "marked", "passing", "settle", "shared_path"]

#: Slots of the filter; 2 ** 17 words of 64 bits at most are broadcast.
SLOTS = 1 << 23


def marked(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` as row (struct) and slot, the word of a bitmap of hashed keys; with ``likely``, which is false only for rows whose
    ``key`` (a long hash) is not in ``keys`` (key), and for most of those."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    words = keys.groupBy(F.floor(place(F.col("key")) / 64).alias("word")).agg(F.bit_or(bit(F.col("key"))).alias("set_bits"))
    found = rows.select(F.struct("*").alias("row"), F.floor(place(key) / 64).alias("slot"), bit(key).alias("own_bit")).join(F.broadcast(words), F.col("slot") == F.col("word"), "left")
    return found.select("row", "slot", (F.coalesce("set_bits", F.lit(0).cast("long")).bitwiseAND(F.col("own_bit")) != 0).alias("likely"))


def likely(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a long hash) is not in ``keys`` (key): a bitmap of hashed keys, to go before an
    exact join. No row whose key is there is lost. One column is added, ``slot``, the word of the bitmap."""
    return marked(rows, key, keys).where("likely").select("row.*", "slot")
