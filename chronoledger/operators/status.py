"""Health of sources from their passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def health_states(passes: DataFrame) -> DataFrame:
    """(source, last_success, last_attempt, failures): failures since the last
    success; one at its very time is not after it.  passes: (source, at, ok).

    Passes are read twice and only counted, so a source may have any number.
    """
    last = passes.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"), F.max("at").alias("last_attempt"))
    later = passes.filter("not ok").join(F.broadcast(last.select(F.col("source").alias("_s"), F.col("last_success").alias("_good"))), F.col("source").eqNullSafe(F.col("_s"))).filter("_good is null or at > _good")
    failed = later.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("failures"))
    return last.join(failed, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "last_success", "last_attempt", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))


def verdict(readable: Column, failures: Column, last_success: Column, now: float, stale_after: float) -> Column:
    """The first that holds: UNREADABLE, BROKEN (failed last), NO SUCCESS, STALE, OK."""
    return F.when(~readable, "UNREADABLE").when(failures > 0, "BROKEN").when(last_success.isNull(), "NO SUCCESS").when(F.lit(now) - last_success > stale_after, "STALE").otherwise("OK")


def report(states: DataFrame, required: list[str], now: float, stale_after: float) -> DataFrame:
    """Each source's verdict, and whether all is well: only required sources count."""
    judged = states.withColumn("verdict", verdict(F.lit(True), F.col("failures"), F.col("last_success"), now, stale_after))
    judged = judged.withColumn("required", F.col("source").isin(*required))
    return judged.withColumn("healthy", F.min((F.col("verdict") == "OK") | ~F.col("required")).over(Window.partitionBy()))


def reconcile_threshold(threshold: float, interval: float) -> float:
    return max(threshold, 3 * interval)


def heartbeat_verdict(value: Column, now: float, threshold: float) -> Column:
    """Of the text of the last success: NO SUCCESS RECORDED, UNREADABLE, STALE or OK."""
    at = F.trim(value).try_cast("double")
    return F.when(value.isNull(), "NO SUCCESS RECORDED").when(at.isNull(), "UNREADABLE").when(F.lit(now) - at > threshold, "STALE").otherwise("OK")


def build_verdict(installed: Column, package: Column, hook: Column) -> Column:
    """MISMATCH unless what is installed, what runs and what the hook has are one
    build; without an installed build there is nothing to compare."""
    return F.when(installed.isNull() | (installed.eqNullSafe(package) & installed.eqNullSafe(hook)), "OK").otherwise("MISMATCH")


def full_report(builds: DataFrame, capture: DataFrame, sources: DataFrame, required: list[str], reconcile: DataFrame, lag: DataFrame, now: float, threshold: float, interval: float) -> DataFrame:
    """(item, verdict, required, detail): the build, the capture's heartbeat, each
    source, the audit, and what is pending.

    builds: (installed, package, hook).  capture: (value), text or null.  sources
    and reconcile: rows of health_states; the audit is stale after three of its
    intervals, at least the threshold.  lag: (high, cursor).  All is well if
    every required item is OK.
    """
    row = lambda df, item, told, needed=F.lit(True), detail=F.lit(None): df.select(item.cast("string").alias("item"), told.alias("verdict"), needed.alias("required"), detail.cast("long").alias("detail"))
    state = lambda stale: verdict(F.lit(True), F.col("failures"), F.col("last_success"), now, stale)
    pending = F.col("high") - F.col("cursor")
    parts = [
        row(builds, F.lit("build"), build_verdict(F.col("installed"), F.col("package"), F.col("hook"))),
        row(capture, F.lit("capture"), heartbeat_verdict(F.col("value"), now, threshold), detail=F.floor(F.lit(now) - F.trim("value").try_cast("double"))),
        row(sources, F.concat(F.lit("source "), "source"), state(threshold), F.col("source").isin(*required), F.col("failures")),
        row(reconcile, F.lit("reconcile"), state(reconcile_threshold(threshold, interval)), detail=F.col("failures")),
        row(lag, F.lit("pending"), F.lit("OK"), F.lit(False), pending),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def healthy(report: DataFrame) -> DataFrame:
    """(healthy): whether every required item is OK."""
    return report.agg(F.coalesce(F.min((F.col("verdict") == "OK") | ~F.col("required")), F.lit(True)).alias("healthy"))
