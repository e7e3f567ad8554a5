"""The driver's tables seen as a ledger and its sources, in Spark and in SQL.

events: signup is an invocation's start, purchase its end, click a tool call,
view a usage record, error a failed model call; a user is a session.  Every 97th
event is left out of the ledger, as if its capture had been lost.  customer is a
tree of sessions (parent = key div 2), orders are runs and snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

INSTALLATION = "installation-1"

#: Audits are pure functions of a given time: midnight after the last event, and
#: the day after the last order.
NOW_EVENTS, NOW_ORDERS = 1706659200.0, 996710400.0

EVENT_TYPES = {"signup": "invocation.started", "purchase": "invocation.completed", "click": "tool.call_completed", "view": "model.usage_recorded", "error": "model.call_failed"}

_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_TYPES.items()) + " END"

#: The ledger in DuckDB, without the events that were lost.
LEDGER_SQL = f"""
    all_events AS (SELECT event_id + 1 AS producer_sequence, epoch_us(ts) / 1e6 AS occurred_at, CAST(user_id AS VARCHAR) AS session_id,
        {_CASE} AS event_type, value, event_id FROM events),
    ledger AS (SELECT * FROM all_events WHERE event_id % 97 <> 13)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str):
    """The driver's timestamps have no zone; they are UTC."""
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.lit(INSTALLATION).alias("installation_id"), (F.col("event_id") + 1).alias("producer_sequence"), (F.col("event_id") + 1).alias("arrival"), epoch("ts").alias("occurred_at"),
        F.col("user_id").cast("string").alias("session_id"), F.lit(None).cast("string").alias("parent_session_id"), F.col("user_id").cast("string").alias("correlation_id"),
        kind.alias("event_type"), F.col("value"), F.col("event_id"), F.col("props"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_events(spark, sf_dir).filter("event_id % 97 <> 13")


def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg((F.coalesce(F.max("event_id"), F.lit(-1)) + 1).alias("high")).select(F.lit(INSTALLATION).alias("installation_id"), "high")
