"""Rendezvous hashing of stable record keys over weighted shards.

Every shard scores every key as `weight / -ln(u)`, u being a uniform hash of
(key, shard); the highest score takes the record.  A shard that is added can
only win records, never move one between the others, and a shard's share of
the records follows its weight.  The choice needs the row alone: no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .common import number_rows


def _score(key: Column, shard: int, weight: float) -> Column:
    # 53 bits of the hash, moved off 0 so that the logarithm is finite.
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.lit(float(weight)) / -F.log(u)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard (int) of `key` among `weights` (shard -> weight above 0).

    Keys are compared as strings, so 7 and "7" are one key.  A null key is a
    key of its own.  Of equal scores the smaller shard wins.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need weights above 0")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    scored = [F.struct(_score(text, s, w).alias("score"), F.lit(-s).alias("low")) for s, w in sorted(weights.items())]
    best = F.array_max(F.array(*scored)) if len(scored) > 1 else scored[0]
    return (-best["low"]).cast("int")


def shard_records(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every record with its shard, its place there, and its shard among `grown`.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null text: 1),
    text_crc32 (of the UTF-8 bytes; null text as empty), law `key`, shard, slot
    (gapless from 0 within the shard) and grown_shard.  Repeated rows each have
    a slot of their own; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
    numbered = number_rows(placed, ["shard"], ["doc_id", "size", "text_crc32"], docs.count(), "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
