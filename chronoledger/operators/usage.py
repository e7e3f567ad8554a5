"""Cumulative counters as deltas, and a session's own usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

COUNTERS = ("api_call_count", "input_tokens", "output_tokens", "cache_read_tokens", "reasoning_tokens", "estimated_cost_usd")


def deltas(snapshots: DataFrame, keys: Sequence[str], order: str, counters: Sequence[str]) -> DataFrame:
    """Each snapshot of cumulative counters as its increase over the one before.

    A counter that fell was reset: its new value is the increase, and its name
    is in reset_fields.  A snapshot equal to its predecessor in counters and
    `order` is dropped; the first one counts whole.  Null counters are 0.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    now = snapshots.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in counters})
    seen = now.withColumn("_before", F.lag(F.struct(order, *counters)).over(w))
    fresh = seen.filter(~F.col("_before").eqNullSafe(F.struct(order, *counters)))
    before = {c: F.coalesce(F.col(f"_before.{c}"), F.lit(0.0)) for c in counters}
    resets = F.filter(F.array(*[F.when(F.col(c) < before[c], F.lit(c)) for c in counters]), lambda x: x.isNotNull())
    return fresh.select(*keys, order, *[F.when(F.col(c) < before[c], F.col(c)).otherwise(F.col(c) - before[c]).alias(f"delta_{c}") for c in counters], *[F.col(c).alias(f"cumulative_{c}") for c in counters], resets.alias("reset_fields"))


def last_states(events: DataFrame, keys: Sequence[str], sequence: str, counters: Sequence[str]) -> DataFrame:
    """The latest absolute counters of each key, from usage events: a delta
    event has them in cumulative_*, an older one in the counters themselves."""
    is_delta = F.col("usage_semantics").eqNullSafe("monotonic_delta")
    state = F.struct(*[F.coalesce(F.when(is_delta, F.col(f"cumulative_{c}")).otherwise(F.col(c)).cast("double"), F.lit(0.0)).alias(c) for c in counters])
    return events.groupBy(*keys).agg(F.max_by(state, sequence).alias("state")).select(*keys, "state.*")


def own_usage(terminals: DataFrame, usage: DataFrame) -> DataFrame:
    """Each session's own tokens and cost.

    The last terminal (session_id, producer_sequence, partial, usage_semantics,
    input_tokens, output_tokens, estimated_cost_usd) decides: if it is not
    partial and its semantics are null or `cumulative_total` its totals hold,
    else the usage deltas of the session add up.
    """
    fields = ("input_tokens", "output_tokens", "estimated_cost_usd")
    last = terminals.groupBy("session_id").agg(F.max_by(F.struct("partial", "usage_semantics", *fields), "producer_sequence").alias("end"))
    sums = usage.groupBy("session_id").agg(*[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"sum_{c}") for c in fields])
    whole = F.col("end").isNotNull() & ~F.coalesce(F.col("end.partial"), F.lit(False)) & (F.col("end.usage_semantics").isNull() | (F.col("end.usage_semantics") == "cumulative_total"))
    pick = lambda c: F.coalesce(F.when(whole, F.col(f"end.{c}").cast("double")).otherwise(F.col(f"sum_{c}")), F.lit(0.0))
    return last.join(sums, "session_id", "full_outer").select("session_id", pick("input_tokens").cast("long").alias("input_tokens"), pick("output_tokens").cast("long").alias("output_tokens"), pick("estimated_cost_usd").alias("cost"))
