"""Invocations: pairing starts with ends, windows, and as-of attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Windows kept for a session, newest first.
WINDOWS_KEPT = 32

#: A user row may precede the start it belongs to by so many seconds.
START_SKEW = 30.0


def pair_starts(events: DataFrame, key: str, order: str, is_start: Column) -> DataFrame:
    """`events` with paired_with: for an end, the order value of the start right
    before it in its key (a later start replaces a pending one, an end takes it);
    null for starts, for ends without a pending start, and for null keys."""
    w = Window.partitionBy(key).orderBy(order)
    started = F.coalesce(F.lag(is_start).over(w), F.lit(False))
    pending = F.when(~is_start & started & F.col(key).isNotNull(), F.lag(F.col(order)).over(w))
    return events.withColumn("paired_with", pending)


def build_windows(events: DataFrame) -> DataFrame:
    """(session_id, invocation_id, started_at, ended_at) from starts and ends:
    the earliest of each; invocations without a start have no window."""
    start, end = F.col("event_type") == "invocation.started", F.col("event_type") == "invocation.completed"
    both = events.filter((start | end) & F.col("session_id").isNotNull() & F.col("invocation_id").isNotNull())
    return both.groupBy("session_id", "invocation_id").agg(F.min(F.when(start, F.col("occurred_at"))).alias("started_at"), F.min(F.when(end, F.col("occurred_at"))).alias("ended_at")).filter("started_at is not null")


def cap_windows(windows: DataFrame) -> DataFrame:
    """Windows that are open or reach over the next start end at that start."""
    following = F.lead("started_at").over(Window.partitionBy("session_id").orderBy("started_at", "invocation_id"))
    return windows.withColumn("following", following).withColumn(
        "ended_at", F.when(F.col("following").isNotNull() & (F.col("ended_at").isNull() | (F.col("ended_at") >= F.col("following"))), F.col("following")).otherwise(F.col("ended_at"))
    ).drop("following")


def newest_windows(windows: DataFrame, keep: int = WINDOWS_KEPT) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("started_at"), F.desc("invocation_id")))
    return windows.withColumn("rank", rank).filter(F.col("rank") <= keep).drop("rank")


def attribute(activity: DataFrame, windows: DataFrame, key: str, user_row: Column | None = None, skew: float = START_SKEW) -> DataFrame:
    """`activity` (key, session_id, at) with the invocation it falls in.

    The last window started at or before `at` holds it, unless it ended before.
    A row for which `user_row` is true first asks the nearest start at or after
    it, and takes it if that is within `skew` seconds.  Times of 0 or less are
    in no window.  One shuffle: windows and activity are sorted together.
    """
    wants = F.coalesce(user_row, F.lit(False)) if user_row is not None else F.lit(False)
    rows = activity.select("session_id", "at", F.lit(1).alias("side"), F.struct(*activity.columns).alias("row"), wants.alias("wants"), F.lit(None).cast("struct<started_at:double,invocation_id:string,ended_at:double>").alias("window"))
    marks = windows.select("session_id", F.col("started_at").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(False).alias("wants"), F.struct(F.col("started_at").cast("double").alias("started_at"), "invocation_id", F.col("ended_at").cast("double").alias("ended_at")).alias("window"))
    order = [F.col("at"), F.col("side"), F.col("window.invocation_id")]
    back = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Seen from the end; a start at the very time of a row counts as ahead of it.
    ahead = Window.partitionBy("session_id").orderBy(F.desc("at"), F.col("side"), F.desc("window.invocation_id")).rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumn("before", F.last("window", ignorenulls=True).over(back))
    if user_row is not None:
        both = both.withColumn("after", F.last("window", ignorenulls=True).over(ahead))
    held = F.when((F.col("at") > 0) & (F.col("before.ended_at").isNull() | (F.col("at") <= F.col("before.ended_at"))), F.col("before.invocation_id"))
    if user_row is not None:
        soon = F.col("wants") & (F.col("at") > 0) & F.col("after").isNotNull() & (F.col("after.started_at") - F.col("at") <= skew)
        held = F.when(soon, F.col("after.invocation_id")).otherwise(held)
    return both.filter("side = 1").select("row.*", F.when(F.col("session_id").isNotNull(), held).alias("invocation_id"))
