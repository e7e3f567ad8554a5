"""Ordered delivery: batches, acknowledgements, the cursor, and what to retry.

A pass ships what lies beyond the cursor in order of the sequence.  The cursor
moves only over batches that were acknowledged in full, and stops before the
first that was not; the next pass starts there.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .retention import ship_batches

# The protocol's limits and the retry schedule.
MAX_RECORDS, MAX_BYTES, HARD_LIMIT = 500, 1 << 20, 4 << 20
ATTEMPTS, BASE_DELAY, MAX_DELAY = 5, 0.5, 30.0


def retry_class(status: Column, login_page: Column | None = None) -> Column:
    """What a response status asks for: `ok`, `auth`, `terminal` or `retryable`.
    A login page in place of an answer is an `auth` failure whatever its status;
    so is a missing status (no answer at all) `retryable`."""
    login = F.lit(False) if login_page is None else F.coalesce(login_page, F.lit(False))
    return (
        F.when(login, "auth").when(status.isNull(), "retryable").when(status.between(200, 299), "ok").when(status.isin(401, 403), "auth")
        .when((status == 429) | status.between(500, 599), "retryable").otherwise("terminal")
    )


def delay_ceiling(attempt: Column, base: float = BASE_DELAY, most: float = MAX_DELAY) -> Column:
    """The longest wait before the attempt after `attempt` (from 1); the wait is
    drawn uniformly below it."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def pending(records: DataFrame, cursors: DataFrame, key: str = "installation_id", order: str = "producer_sequence") -> DataFrame:
    """Records beyond their installation's cursor (key, cursor); all without one."""
    return records.join(cursors.select(key, "cursor"), key, "left").filter(F.col(order) > F.coalesce("cursor", F.lit(0))).drop("cursor")


def plan_batches(records: DataFrame, cursors: DataFrame, max_records: int = MAX_RECORDS, max_bytes: int = MAX_BYTES, base_bytes: int = 0, max_batches: int | None = None) -> DataFrame:
    """(installation_id, batch, first, last, records, bytes) of a pass.  Batches
    hold to the target; a record that alone exceeds HARD_LIMIT is refused by the
    protocol, so its batch is marked `oversize`."""
    waiting = pending(records, cursors)
    placed = ship_batches(waiting, max_records, min(max_bytes, HARD_LIMIT), base_bytes, max_batches=max_batches)
    sized = placed.join(waiting.select("installation_id", "producer_sequence", "bytes"), ["installation_id", "producer_sequence"])
    return sized.groupBy("installation_id", "batch").agg(
        F.min("producer_sequence").alias("first"), F.max("producer_sequence").alias("last"), F.count(F.lit(1)).alias("records"), F.sum("bytes").cast("long").alias("bytes"),
        (F.max("bytes") + base_bytes > HARD_LIMIT).alias("oversize"),
    )


def judged(batches: DataFrame, acks: DataFrame) -> DataFrame:
    """Batches with their acknowledgement (installation_id, batch, accepted,
    duplicates, high_water) and why it is refused, null if it is good: there is
    none, a negative count, counts that don't cover the batch, or a high water
    below the batch's."""
    a, d = F.col("accepted"), F.col("duplicates")
    why = (
        F.when(a.isNull() | d.isNull() | F.col("high_water").isNull(), "no acknowledgement").when((a < 0) | (d < 0), "negative count")
        .when(a + d != F.col("records"), "incomplete").when(F.col("high_water") < F.col("last"), "high water below the batch")
    )
    return batches.join(acks, ["installation_id", "batch"], "left").withColumn("refused", why)


def advanced(batches: DataFrame, cursors: DataFrame) -> DataFrame:
    """The cursors (installation_id, cursor) after a pass of judged batches: over
    the good ones up to the first refused."""
    stop = batches.groupBy("installation_id").agg(F.min(F.when(F.col("refused").isNotNull(), F.col("batch"))).alias("_stop"))
    good = batches.join(stop, "installation_id").filter(F.col("_stop").isNull() | (F.col("batch") < F.col("_stop")))
    moved = good.groupBy("installation_id").agg(F.max("last").alias("_to"))
    both = cursors.join(moved, "installation_id", "full_outer")
    return both.select("installation_id", F.greatest(F.coalesce("cursor", F.lit(0)), F.coalesce("_to", F.lit(0))).cast("long").alias("cursor"))


def outcome(before: DataFrame, after: DataFrame, batches: DataFrame, high_water: DataFrame) -> DataFrame:
    """The record of a pass: (installation_id, outcome, acked, cursor, pending)
    with outcome `done`, `idle`, or why the first refused batch was refused."""
    first = batches.filter("refused is not null").groupBy("installation_id").agg(F.min_by("refused", "batch").alias("why"))
    sent = batches.select("installation_id").distinct().withColumn("sent", F.lit(True))
    rows = high_water.join(after, "installation_id", "left").join(before.select("installation_id", F.col("cursor").alias("was")), "installation_id", "left").join(first, "installation_id", "left").join(sent, "installation_id", "left")
    now, was = F.coalesce("cursor", F.lit(0)), F.coalesce("was", F.lit(0))
    told = F.coalesce("why", F.when(F.col("sent"), "done").otherwise("idle"))
    return rows.select("installation_id", told.alias("outcome"), (now - was).cast("long").alias("acked"), now.cast("long").alias("cursor"), (F.col("high") - now).cast("long").alias("pending"))


def key_batches(keys: DataFrame, max_keys: int) -> DataFrame:
    """Unshipped content keys in batches of `max_keys`, by (created_at, key_version)."""
    w = Window.partitionBy("installation_id").orderBy("created_at", "key_version")
    return keys.filter("shipped_at is null").withColumn("batch", F.floor((F.row_number().over(w) - 1) / max_keys).cast("long"))


def mark_shipped(keys: DataFrame, acked: DataFrame, now: float) -> DataFrame:
    """`keys` with the time of shipping of those in `acked` (key_version)."""
    done = acked.select("key_version", F.lit(True).alias("_done")).distinct()
    return keys.join(done, "key_version", "left").withColumn("shipped_at", F.coalesce("shipped_at", F.when(F.col("_done"), F.lit(now)))).drop("_done")


class Retryable(Exception):
    """A failure that another attempt may mend."""


@dataclass
class Retrying:
    """A transport that tries again after retryable failures, waiting a uniform
    share of a ceiling that doubles; other failures go through at once."""

    send: Callable[[list[dict]], dict]
    attempts: int = ATTEMPTS
    base: float = BASE_DELAY
    most: float = MAX_DELAY
    sleep: Callable[[float], None] = time.sleep
    draw: Callable[[], float] = random.random

    def __call__(self, records: list[dict]) -> dict:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.send(records)
            except Retryable:
                if attempt == self.attempts:
                    raise
                self.sleep(min(self.most, self.base * 2 ** (attempt - 1)) * self.draw())
        raise ValueError("attempts must be at least 1")


def ship_pass(spark: SparkSession, records: DataFrame, cursors: DataFrame, high_water: DataFrame, send: Callable[[list[dict]], dict], max_batches: int = 1, max_records: int = MAX_RECORDS, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(cursors, outcome) after sending the next `max_batches` batches of every
    installation, in order, one after the other.

    A batch is read when it is sent: at most `max_records` rows and the protocol's
    hard limit of bytes are on the driver at a time.  An installation stops at its
    first batch that fails or is not acknowledged; the others go on.
    """
    batches = plan_batches(records, cursors, max_records, max_bytes, max_batches=max_batches).orderBy("installation_id", "batch").collect()  # max_batches rows an installation
    acks, stopped = [], set()
    for b in batches:
        if b["installation_id"] in stopped:
            continue
        rows = records.filter((F.col("installation_id") == b["installation_id"]) & F.col("producer_sequence").between(b["first"], b["last"])).orderBy("producer_sequence")
        try:
            ack = send([r.asDict(recursive=True) for r in rows.collect()]) if not b["oversize"] else {}
        except Exception as e:  # noqa: BLE001  (any failure of a transport ends its installation's pass)
            ack = {"failed": str(e)}
        acks.append((b["installation_id"], b["batch"], ack.get("accepted"), ack.get("duplicates"), ack.get("high_water")))
        if ack.get("accepted") is None or ack["accepted"] + ack["duplicates"] != b["records"] or ack["high_water"] < b["last"]:
            stopped.add(b["installation_id"])
    planned = spark.createDataFrame([tuple(b) for b in batches], "installation_id string, batch long, first long, last long, records long, bytes long, oversize boolean")
    told = judged(planned, spark.createDataFrame(acks, "installation_id string, batch long, accepted long, duplicates long, high_water long"))
    after = advanced(told, cursors)
    return after, outcome(cursors, after, told, high_water)
