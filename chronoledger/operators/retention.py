"""Pruning what has been delivered, and batching what is to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Rows of one bucket of the running sums.
BUCKET = 100_000


def running_total(df: DataFrame, key: str, order: str, value: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """`df` with `out`: the sum of `value` up to and with each row, by `order`
    (whole numbers) within `key`.  Sums are taken within buckets of the order
    and offset by the sums of earlier buckets, so no task has a whole key."""
    rows = df.withColumn("_b", F.expr(f"{order} div {bucket}"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(key, "_b").agg(F.sum(value).alias("_s")).select(key, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(base, [key, "_b"]).withColumn(out, (F.col("_base") + F.sum(value).over(inner)).cast("long")).drop("_b", "_base")


def prune_set(events: DataFrame, delivered: int, cutoff: float | None = None, max_bytes: int | None = None) -> DataFrame:
    """(installation_id, producer_sequence, reason) of events to prune.

    Only events up to the delivery cursor go: those recorded before `cutoff`,
    and then the oldest of the rest while the ledger is over `max_bytes`.  An
    event goes if the ledger is still over budget before it.  events:
    (installation_id, producer_sequence, recorded_at, bytes).
    """
    done = F.col("producer_sequence") <= delivered
    old = done & (F.col("recorded_at") < cutoff) if cutoff is not None else F.lit(False)
    marked = events.withColumn("old", F.coalesce(old, F.lit(False)))
    aged = marked.filter("old").select("installation_id", "producer_sequence", F.lit("age").alias("reason"))
    if max_bytes is None:
        return aged
    left = marked.filter("not old")
    totals = left.groupBy("installation_id").agg(F.sum("bytes").alias("total"))
    ranked = running_total(left.filter(done), "installation_id", "producer_sequence", "bytes", "upto")
    over = ranked.join(totals, "installation_id").filter(F.col("total") - (F.col("upto") - F.col("bytes")) > max_bytes)
    return aged.unionByName(over.select("installation_id", "producer_sequence", F.lit("size").alias("reason")))


def prune(events: DataFrame, going: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, tombstones) of a ledger table, given the prune set.  Tombstones
    hold no content: see retention_summary."""
    from .mappers import retention_summary

    keys = ["installation_id", "producer_sequence"]
    return events.join(going, keys, "left_anti"), retention_summary(events.join(going, keys, "left_semi"))


def ship_batches(records: DataFrame, max_records: int, max_bytes: int, base_bytes: int, key: str = "installation_id", order: str = "producer_sequence", size: str = "bytes", max_batches: int | None = None) -> DataFrame:
    """(key, order, batch): records packed in order, a new batch when the current
    one has `max_records` or the next record with its separator would exceed
    `max_bytes`; a record above the limit goes alone.  With `max_batches` only
    the first so many batches of each key.

    Where a batch starts depends on where the last one did, so this is a fold
    over each key's sizes, which keeps the starts only; the records then take
    their batch from a running count of starts.  `max_batches` bounds the fold:
    the first n batches lie within the first n * max_records records.
    """
    if max_batches is not None:
        ranked = running_total(records.withColumn("_one", F.lit(1)), key, order, "_one", "_rank")
        records = ranked.filter(F.col("_rank") <= max_batches * max_records).drop("_one", "_rank")
    def step(a: Column, r: Column) -> Column:
        full = (a["n"] > 0) & ((a["n"] >= max_records) | (a["used"] + r["size"] + 1 > max_bytes))
        batch = a["batch"] + full.cast("int")
        used = F.when(full | (a["n"] == 0), F.lit(base_bytes).cast("bigint") + r["size"]).otherwise(a["used"] + r["size"] + 1)
        n = F.when(full, F.lit(1)).otherwise(a["n"] + 1)
        starts = F.when(full, F.concat(a["starts"], F.array(r["o"]))).otherwise(a["starts"])
        return F.struct(batch.alias("batch"), n.alias("n"), used.alias("used"), starts.alias("starts"))

    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(base_bytes).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("starts"))
    listed = records.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(size).cast("bigint").alias("size")))).alias("rows"))
    starts = listed.select(F.col(key).alias("_k"), F.explode(F.aggregate("rows", start, step, lambda a: a["starts"])).alias("_o"))
    marked = records.select(key, order).join(starts, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_o")), "left").select(key, order, F.col("_o").isNotNull().cast("long").alias("_first"))
    packed = running_total(marked, key, order, "_first", "batch").select(key, order, "batch")
    return packed if max_batches is None else packed.filter(F.col("batch") < max_batches)


def unshipped_keys(keys: DataFrame) -> DataFrame:
    return keys.filter("shipped_at is null").orderBy("created_at", "key_version")


def accept(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, counts) of a sink that takes each event_id once; counts:
    accepted and duplicates."""
    fresh = batch.dropDuplicates(["event_id"]).join(stored.select("event_id"), "event_id", "left_anti")
    return fresh, batch.agg(F.count(F.lit(1)).alias("received")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("accepted"))).select("accepted", (F.col("received") - F.col("accepted")).alias("duplicates"))
