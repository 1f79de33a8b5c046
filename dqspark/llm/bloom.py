"""Bloom filters from built-in expressions.

A filter is one binary literal, built by one aggregation over bit positions and read
inside whichever expression asks, so a membership test needs neither join nor Python.
Null keys are in no filter; an empty table gives a filter that holds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import cut

#: No filter takes more bits than this (a megabyte).
MAX_BITS = 1 << 23

#: Bits of one value of bitmap_construct_agg.
_PAGE = 32768


@dataclass(frozen=True)
class Bloom:
    """packed holds seven bits a byte: each byte is an ASCII character, which SQL reads at once."""

    bits: int
    hashes: int
    seed: int
    packed: bytes

    def contains(self, key: Column) -> Column:
        """Whether the filter may hold the key; never false for a key it was built from. Null: false."""
        if not any(self.packed):
            return F.lit(False)
        # one literal, whatever the number of hash functions
        places = F.array(*[position(key, self.bits, self.seed, k) for k in range(self.hashes)])
        byte = lambda at: F.substring(F.lit(self.packed), F.floor(at / 7).cast("int") + 1, F.lit(1))
        test = F.forall(places, lambda at: F.getbit(F.ascii(byte(at).cast("string")), F.pmod(at, F.lit(7)).cast("int")) == 1)
        return F.coalesce(key.isNotNull() & test, F.lit(False))


def position(key: Column, bits: int, seed: int, k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * 64 + k), key), F.lit(bits).cast("long"))


def size_for(n: int, rate: float, most: int | None = None) -> tuple[int, int]:
    """Bits, a multiple of 56 of about so many (MAX_BITS) at most, and hash functions for n keys at a false positive rate."""
    bits = min(most or MAX_BITS, math.ceil(max(n, 1) * -math.log(rate) / math.log(2) ** 2))
    bits = (bits + 55) // 56 * 56
    return bits, max(1, min(round(-math.log2(rate)), round(bits / max(n, 1) * math.log(2))))


def build(keys: DataFrame, n: int, rate: float, seed: int = 0, most: int | None = None) -> Bloom:
    """Of the column key of a table of about n rows, repeated ones allowed. Only its bits, so many at most, reach the driver."""
    bits, hashes = size_for(n, rate, most)
    at = F.explode(F.array(*[position(F.col("key"), bits, seed, k) for k in range(hashes)]))
    pages = (
        keys.where(F.col("key").isNotNull())
        .select(at.alias("at"))
        .groupBy(F.floor(F.col("at") / _PAGE).cast("int").alias("page"))
        .agg(F.bitmap_construct_agg(F.pmod("at", F.lit(_PAGE))).alias("bitmap"))
    )
    raw = bytearray(-(-bits // _PAGE) * _PAGE // 8)
    for row in pages.collect():  # bits / _PAGE rows at most
        raw[row["page"] * _PAGE // 8 : (row["page"] + 1) * _PAGE // 8] = row["bitmap"]
    packed = bytearray()
    for k in range(0, bits // 8, 7):
        group = int.from_bytes(raw[k : k + 7], "little")
        packed += bytes(group >> 7 * j & 127 for j in range(8))
    return Bloom(bits, hashes, seed, bytes(packed))


def holds(n: int, rate: float, most: int | None = None) -> bool:
    """Whether a filter of at most so many bits (MAX_BITS) has the rate for n keys."""
    return n * -math.log(rate) / math.log(2) ** 2 <= (most or MAX_BITS)


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in keys (stored, of one column), and a few others: those that a Bloom filter takes for such.

    More keys than a filter holds are joined, and only rows that the full filter lets through are shuffled.
    """
    n = keys.count()
    maybe = df.where(build(keys.select(F.col(key).alias("key")), n, 0.01).contains(F.col(key)))
    return maybe if holds(n, 0.01) else maybe.join(keys.distinct(), key, "left_semi")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in gone. Only rows that a Bloom filter takes for gone are shuffled; null keys stay."""
    gone = cut(gone.select(key).distinct())
    n = gone.count()
    maybe = build(gone.select(F.col(key).alias("key")), n, 0.01).contains(F.col(key))
    kept = df.where(maybe).join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
    return df.where(~maybe).unionAll(kept)
