"""Sharding by rendezvous hashing (highest random weight).

Every shard draws a number from (key, shard); the record goes to the shard whose draw is best. A draw depends on that
key and that shard alone, so one more shard takes records only into itself, and a shard that goes gives its records to
the others without moving any of theirs. Nothing is shuffled to find a shard; only slots (numbers within a shard) need
the rows of a shard counted, and those are counted in buckets (`common.numbered`), since a shard grows with the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import numbered

SLOT_BUCKETS = 1024


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, …) of `key` among shards of these weights, as an int; a shard of weight 0 gets nothing.

    The draw u of shard s is 52 bits of xxhash64(key, s) as a number in (0, 1); the shard with the least -ln(u) / weight
    wins, so each gets its weight's share. Ties of the score go to the smaller shard. A null key is a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: non-negative, one of them positive")
    draws = []
    for s, w in enumerate(weights):
        if w > 0:
            # text first: null and the number 0 must not hash alike
            h = F.xxhash64(F.coalesce(key.cast("string"), F.lit("\u0000null")), F.lit(s))
            u = (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
            draws.append(F.struct((-F.log(u) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row of `docs`; other columns are not looked at.

    size: UTF-8 bytes of the text plus 1; a null text has none, size 1 and CRC 0, as the empty text. law is `key`: only
    the key and the shards decide, so equal texts under other keys may part and repeated rows stay together. slot: gapless
    from 0 within the shard; rows alike in every column share their slots out in any order. grown_shard: with one more
    shard of weight `grown_weight` (default: the mean weight). An empty table gives none.
    """
    more = sum(weights) / len(weights) if grown_weight is None else grown_weight
    k = F.col(key)
    d = docs.select(
        k,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(k, weights).alias("shard"),
        shard_of(k, [*weights, more]).alias("grown_shard"),
    )
    order = F.xxhash64(F.coalesce(k.cast("string"), F.lit("\u0000null")), F.lit(-1))
    return numbered(d.withColumn("_order", order), ["shard"], ["_order", key, "text_crc32", "size"], "slot", F.pmod("_order", F.lit(SLOT_BUCKETS))).drop("_order")
