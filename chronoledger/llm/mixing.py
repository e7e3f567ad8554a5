"""Mixing sources to target weights by Pfair scheduling.

The text of each source is a stream of bytes cut into blocks of one size, and
time is a row of slots, each taken by one block.  Source s with weight w(s)
(weights add up to 1) may place its block k no earlier than slot floor(k / w)
and must place it before slot ceil((k + 1) / w).  Earliest deadline first meets
every deadline, so after any number of slots t each source has had more than
t * w - 1 and fewer than t * w + 1 blocks.

Weights are whole numbers.  The schedule repeats after as many slots as they add
up to, so one period is scheduled once, on the driver, from the weights alone;
the slot of any block then follows by arithmetic on its number.  When a source
ends, the others go on by their weights among themselves in a new phase: nothing
is dropped or repeated to hold the target.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import BUCKET_ROWS, unused

#: A period has at most so many slots, and a mixture so many sources; more are refused.
MAX_PERIOD, MAX_SOURCES = 4096, 256

#: Sources that no weight names are mixed as one source of this name.
OTHER = "(other)"


def period(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first among the
    released blocks, ties by the order of `weights`."""
    total = sum(weights.values())
    if not weights or min(weights.values()) < 1 or total > MAX_PERIOD:
        raise ValueError(f"weights must be whole numbers from 1 that add up to at most {MAX_PERIOD}")
    names = list(weights)
    release = lambda s, k: k * total // weights[names[s]]
    deadline = lambda s, k: -(-(k + 1) * total // weights[names[s]])
    waiting = [(0, s, 0) for s in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, k), s, k))
        due, s, k = heapq.heappop(ready)
        assert due > slot
        out.append(names[s])
        if k + 1 < weights[names[s]]:
            heapq.heappush(waiting, (release(s, k + 1), s, k + 1))
    return out


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[dict]:
    """When which sources are mixed, given how many blocks each has.

    Each phase: start (slot), first (block number of each source at its start),
    order (the period's sources).  It lasts until one of its sources ends.
    """
    left = {s: blocks.get(s, 0) for s in weights if blocks.get(s, 0) > 0}
    done = dict.fromkeys(left, 0)
    out, start = [], 0
    while left:
        mine = {s: weights[s] for s in left}
        order = period(mine)
        places: dict[str, list[int]] = {s: [] for s in mine}
        for slot, s in enumerate(order):
            places[s].append(slot)
        # Slots until the last block of the source that ends first is placed.
        ends = {s: (n - 1) // mine[s] * len(order) + places[s][(n - 1) % mine[s]] + 1 for s, n in left.items()}
        length = min(ends.values())
        out.append({"start": start, "first": {s: done[s] for s in left}, "order": order, "places": places})
        full, rest = divmod(length, len(order))
        for s in list(left):
            used = full * mine[s] + sum(p < rest for p in places[s])
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        start += length
    return out


def _plan_table(spark: SparkSession, plan: list[dict], weights: Mapping[str, int]) -> DataFrame:
    """A row for each source and phase: the blocks [first, until) of the source
    are placed in it.  At most MAX_SOURCES * MAX_SOURCES rows and MAX_SOURCES *
    MAX_PERIOD places, whatever the corpus."""
    rows = []
    for s in weights:
        mine = [(i, p) for i, p in enumerate(plan) if s in p["first"]]
        for n, (i, p) in enumerate(mine):
            until = mine[n + 1][1]["first"][s] if n + 1 < len(mine) else None
            rows.append({"_of": s, "phase": i, "first": p["first"][s], "until": until, "begin": p["start"], "slots": len(p["order"]), "weight": weights[s], "places": p["places"][s]})
    schema = "array<struct<_of:string,phase:int,first:bigint,until:bigint,begin:bigint,slots:bigint,weight:bigint,places:array<bigint>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def mix(docs: DataFrame, weights: Mapping[str, int], block_bytes: int, other: int = 1, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of `docs` with its place in the mixture.

    Returns doc_id, source (as mixed: `(other)` for null and unnamed sources,
    which share the weight `other`), size (UTF-8 bytes of the text plus 1),
    start_byte in the source's stream, block, slot and phase.  Reading by
    (slot, start_byte) gives the mixture.  A document belongs to the block it
    starts in and fills the blocks it runs through, so a slot may start none.
    Within a source documents are in order of a hash of their key; rows equal
    in key and size are interchangeable.  A null text has size 1.
    """
    if OTHER in weights or len(weights) >= MAX_SOURCES:
        raise ValueError(f"{OTHER} is taken, and at most {MAX_SOURCES - 1} sources can be named")
    weights = {**weights, OTHER: other}
    body = F.coalesce(F.col(text), F.lit(""))
    named = F.when(F.col(source).isin([s for s in weights if s != OTHER]), F.col(source)).otherwise(F.lit(OTHER))
    rows = docs.select(F.col(key).alias("doc_id"), named.alias("source"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("_crc"))
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size", "_crc"), F.lit(buckets)))
    sums = dealt.groupBy("source", "_bucket").agg(F.sum("size").alias("_bytes"))
    totals = {r["source"]: r["bytes"] for r in sums.groupBy("source").agg(F.sum("_bytes").alias("bytes")).collect()}  # a row for each weight
    plan = phases(weights, {s: -(-b // block_bytes) for s, b in totals.items()})
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("source", "_bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "_crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.join(starts, (F.col("source") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("start_byte", (F.col("_start") + F.coalesce(F.sum("size").over(inner), F.lit(0))).cast("long"))
        .withColumn("block", F.floor(F.col("start_byte") / F.lit(block_bytes)).cast("long"))
    )
    table = _plan_table(docs.sparkSession, plan, weights)
    at = F.col("block") - F.col("first")
    slot = F.col("begin") + F.expr("(block - first) div weight") * F.col("slots") + F.get("places", (at % F.col("weight")).cast("int"))
    within = (F.col("source") == F.col("_of")) & (F.col("block") >= F.col("first")) & (F.col("until").isNull() | (F.col("block") < F.col("until")))
    return placed.join(F.broadcast(table), within).select("doc_id", "source", "size", "start_byte", "block", slot.alias("slot"), "phase")


def places(docs: DataFrame, weights: Mapping[str, int], block_bytes: int, other: int = 1, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, slot, start_byte) of each key in the mixture: the earliest place
    of its rows.  The same rows have the same places, in whatever files they are."""
    first = mix(docs, weights, block_bytes, other, key, text, source).groupBy("doc_id").agg(F.min(F.struct("slot", "start_byte")).alias("_at"))
    return first.select("doc_id", "_at.slot", "_at.start_byte")


def in_mixed_order(docs: DataFrame, weights: Mapping[str, int], block_bytes: int, other: int = 1, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows and columns of `docs`, written out in the order of the mixture.

    Documents are ranged by (slot, start_byte) and sorted in their range, so the
    files read one after another are the mixture.  Spark's own readers don't read
    files by name: whoever rereads them has the order from `places`.  Rows whose
    key repeats take the earliest place of their key.
    """
    placed = places(docs, weights, block_bytes, other, key, text, source)
    whose, place = unused(docs, "__placed", "__place")
    placed = placed.select(F.col("doc_id").alias(whose), F.struct("slot", "start_byte").alias(place))
    joined = docs.join(placed, docs[key].eqNullSafe(placed[whose]))
    return joined.repartitionByRange(place).sortWithinPartitions(place).select(*docs.columns)
