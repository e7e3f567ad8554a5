"""One capture pass over all sources, each on its own."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.lineage import cut


def run_pass(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], now: float, enabled: Mapping[str, bool] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(records of all sources that could be read, health rows).

    A source that fails, in planning or while it is read, is left out of this
    pass and marked; the others go on.  Each source is read once, into a table
    of its own that the records are taken from.  Health: (source, at, ok, error).
    """
    parts, health = [], []
    for name, source in sources.items():
        if enabled is not None and not enabled.get(name, True):
            continue
        try:
            parts.append(cut(source()))
            health.append((name, now, True, None))
        except (PySparkException, OSError, ValueError) as e:
            health.append((name, now, False, str(e)[:200]))
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
    return records, spark.createDataFrame(health, "source string, at double, ok boolean, error string")


def counts(records: DataFrame) -> DataFrame:
    return records.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


#: Seconds between captures, health checks, audits and syncs.
CADENCE = {"capture": 15, "health": 60, "audit": 3600, "sync": 60}


def trigger(kind: str, once: bool = False) -> dict[str, object]:
    """The trigger of a stream of this kind."""
    return {"availableNow": True} if once else {"processingTime": f"{CADENCE[kind]} seconds"}
