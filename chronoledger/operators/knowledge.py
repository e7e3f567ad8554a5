"""From tool calls to versions: the composed path of captured knowledge.

Tool results are paired with the calls they answer, successful knowledge calls
are classified and given their artifact, the files after each call are folded,
limits are applied to them, states that differ become versions, and versions
become events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from . import store
from .lineage import cut


def mutations(messages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Knowledge calls that took effect: (at, session_id, assistant_id,
    tool_call_id, artifact_id, kind, name, action, arguments, result).

    messages: (id, session_id, role, tool_call_id, tool_calls, content); the id
    of the result is the time.  artifacts: (artifact_id, name, tombstone,
    first_seen).
    """
    results = messages.select(F.col("id").alias("_id"), F.col("content").alias("result"))
    calls = store.pair_tool_calls(messages).withColumnRenamed("name", "tool_name").join(results, F.col("id") == F.col("_id")).drop("_id")
    told = store.classify_mutations(calls).withColumn("category", F.get_json_object("arguments", "$.category"))
    named = store.resolve_artifact(told, artifacts)
    artifact = F.when(F.col("kind") == "memory", F.concat(F.lit("memory:"), "name")).otherwise(F.col("artifact_id"))
    return named.select(F.col("id").alias("at"), "session_id", "assistant_id", "tool_call_id", artifact.alias("artifact_id"), "kind", "name", "action", "arguments", "result")


def snapshots(changes: DataFrame, max_count: int, max_file: int, max_total: int) -> tuple[DataFrame, DataFrame]:
    """(states, files) after each mutation that can be told.

    states: (artifact_id, at, manifest, manifest_hash, skipped, tombstone); an
    artifact without files is a tombstone.  files: (artifact_id, at, path,
    blob_hash, content, skipped), skipped ones with the limit they exceed.
    """
    # Written once: states and files would each fold all edits anew.
    known = cut(store.after_states(changes).filter("files is not null")).withColumn("held", F.from_json("files", "map<string,string>"))
    key = F.struct("artifact_id", "at")
    each = known.select("artifact_id", "at", F.explode("held").alias("path", "content")).withColumn("size", F.octet_length("content"))
    limits = store.limit_files(each.select(key.alias("artifact_id"), "path", "size"), max_count, max_file, max_total).select("artifact_id.*", "path", "skipped")
    files = cut(each.join(limits, ["artifact_id", "at", "path"]).withColumn("blob_hash", S.content_hash("content")))
    kept = F.array_sort(F.collect_list(F.when(F.col("skipped").isNull(), F.struct("path", "blob_hash"))))
    lost = F.array_sort(F.collect_list(F.when(F.col("skipped").isNotNull(), F.struct("path", "skipped"))))
    made = files.groupBy("artifact_id", "at").agg(kept.alias("manifest"), lost.alias("skipped"))
    none = lambda t: F.array().cast(t)
    states = known.select("artifact_id", "at", (F.size("held") == 0).alias("tombstone")).join(made, ["artifact_id", "at"], "left")
    manifest = F.coalesce("manifest", none(store.MANIFEST))
    states = states.select("artifact_id", "at", manifest.alias("manifest"), store.manifest_hash(manifest).alias("manifest_hash"), F.coalesce("skipped", none("array<struct<path:string,skipped:string>>")).alias("skipped"), "tombstone")
    return states, files.select("artifact_id", "at", "path", "blob_hash", "content", "skipped")


def captured(messages: DataFrame, artifacts: DataFrame, max_count: int = 256, max_file: int = 4 << 20, max_total: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """(versions, events) of all knowledge calls in `messages`.

    versions: (artifact_id, seq, at, manifest, manifest_hash, skipped,
    tombstone), each differing from the one before.  events: a bundle for each
    version, as of store.version_events.
    """
    states, files = snapshots(mutations(messages, artifacts), max_count, max_file, max_total)
    versions = cut(store.version_chain(states))
    blobs = files.filter("skipped is null").select("blob_hash", "content").dropDuplicates(["blob_hash"])
    return versions, store.version_events(versions, blobs)
