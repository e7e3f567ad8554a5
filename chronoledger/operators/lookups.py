"""Lookups in the ledger and the version store, and links between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import TOMBSTONE


def event_by_key(events: DataFrame, dedup_key: str) -> DataFrame:
    return events.filter(F.col("dedup_key") == dedup_key)


def summaries(retained: DataFrame, pruned: DataFrame) -> DataFrame:
    """Retained and pruned events in the columns audits read."""
    names = TOMBSTONE.fieldNames()
    return retained.select(*[c for c in names if c in retained.columns]).unionByName(pruned, allowMissingColumns=True)


def versions_after(versions: DataFrame, cursors: DataFrame) -> DataFrame:
    """Versions beyond each artifact's cursor (artifact_id, seq)."""
    return versions.join(cursors.select("artifact_id", F.col("seq").alias("_cursor")), "artifact_id", "left").filter(F.col("seq") > F.coalesce("_cursor", F.lit(0))).drop("_cursor")


def version_blobs(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """(artifact_id, seq, path, blob_hash, size, content) of the files of some
    versions (manifest); a blob that is not stored has neither size nor content."""
    files = versions.select("artifact_id", "seq", F.inline("manifest"))
    return files.join(blobs.select("blob_hash", "content"), "blob_hash", "left").select("artifact_id", "seq", "path", "blob_hash", F.octet_length("content").cast("long").alias("size"), "content")


def first_artifacts(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Artifacts by id, each as it was first seen."""
    columns = [c for c in known.columns if c != "artifact_id"]
    return known.unionByName(seen).groupBy("artifact_id").agg(F.min_by(F.struct(*columns), "first_seen").alias("_a")).select("artifact_id", "_a.*")


def attributed(versions: DataFrame, events: DataFrame) -> DataFrame:
    """Versions (artifact_id, seq, origin) with the event that carried them
    (artifact_id, seq, event_id, foreground): a foreground event wins, and makes
    the version a foreground one."""
    best = events.groupBy("artifact_id", "seq").agg(F.max_by(F.struct("event_id", "foreground"), F.struct("foreground", F.col("event_id"))).alias("_e"))
    return versions.join(best, ["artifact_id", "seq"], "left").withColumn("linked_event", F.col("_e.event_id")).withColumn("origin", F.when(F.col("_e.foreground"), "foreground").otherwise(F.col("origin"))).drop("_e")


def compaction_edges(mutations: DataFrame, known: DataFrame) -> DataFrame:
    """(dedup_key, source, target) of mutations (assistant_id, call_id, source,
    absorbed_into) that supersede another artifact, each told once: `known`
    (dedup_key) are told already."""
    edges = mutations.filter(F.coalesce(F.col("absorbed_into"), F.lit("")) != "").select(
        F.concat_ws(":", F.lit("state.db:knowledge-compacted"), F.col("assistant_id").cast("string"), "call_id").alias("dedup_key"), "source", F.col("absorbed_into").alias("target")
    )
    return edges.dropDuplicates(["dedup_key"]).join(known.select("dedup_key"), "dedup_key", "left_anti")
