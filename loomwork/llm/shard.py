"""Sharding by a Feistel permutation with cycle walking over global row numbers, in DataFrame functions alone.

Row numbers 0..N-1 are laid out as pairs (left, right) on a grid of a x b >= N places. A generalised Feistel network
permutes the grid; a row that lands outside 0..N-1 is sent through again until it lands inside. The shuffled place p
then gives shard p % shards and slot p / shards, so both can be computed for any row number from (N, seed) alone, and
counts differ by one at most.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ROUNDS = 6


def grid(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(place: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over the a x b grid; a permutation for any round function."""
    place = place.cast("long")
    pair = F.struct(F.pmod(place, F.lit(a)).cast("long").alias("l"), _div(place, a).alias("r"))
    for k in range(ROUNDS):
        # named fields of an array of one struct keep each round's value from being computed twice
        mixed = F.transform(F.array(pair), _round(k, a, b, seed))
        pair = F.element_at(mixed, 1)
    last = F.transform(F.array(pair), lambda p: p["r"] * F.lit(a) + p["l"])
    return F.element_at(last, 1)


def _div(x: Column, by: int) -> Column:
    """Exact whole division of a long that isn't negative."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def _round(k: int, a: int, b: int, seed: int):
    def step(p: Column) -> Column:
        l, r = p["l"].cast("long"), p["r"].cast("long")
        if k % 2 == 0:
            return F.struct(F.pmod(l + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), r), F.lit(a)), F.lit(a)).alias("l"), r.alias("r"))
        return F.struct(l.alias("l"), F.pmod(r + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), l), F.lit(b)), F.lit(b)).alias("r"))

    return step


def feistel(rank: Column, n: int, seed: int) -> Column:
    """The shuffled place of row number ``rank`` among ``n``, by cycle walking.

    At most a*b - n < a places lie outside, so a walk ends within that many steps; few rows walk at all.
    """
    a, b = grid(n)
    once = permuted(rank, a, b, seed)
    if a * b == n:
        return once
    walk = lambda at: F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), at, lambda x, _: F.when(x >= F.lit(n), permuted(x, a, b, seed)).otherwise(x))
    return F.element_at(F.transform(F.array(once), lambda x: F.when(x >= F.lit(n), walk(x)).otherwise(x)), 1)


def shards(docs: DataFrame, count: int = 8, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, rank, shard, slot, *keep) for each row of ``docs`` (doc_id, text).

    size is the UTF-8 length plus one (null text: 1, and crc32 of nothing). Row numbers follow doc_id (null first),
    ties follow crc32 and size; whole repeated rows take neighbouring numbers. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), *keep)
    ranked = C.global_order(rows, ["doc_id", "text_crc32", "size"])
    n = ranked.count()
    place = feistel(F.col("_rank"), n, seed) if n else F.col("_rank")
    placed = ranked.withColumn("_place", place)
    return placed.select("doc_id", "size", "text_crc32", F.col("_rank").alias("rank"), F.pmod("_place", F.lit(count)).cast("int").alias("shard"), _div(F.col("_place"), count).alias("slot"), *keep)
