"""The content-addressed version store: blobs, manifests, version chains, diffs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

MANIFEST = "array<struct<path:string,blob_hash:string>>"


def new_blobs(contents: DataFrame, stored: DataFrame, column: str = "content") -> DataFrame:
    """(blob_hash, content) of contents that `stored` (blob_hash) has not, each once."""
    hashed = contents.select(S.content_hash(F.col(column)).alias("blob_hash"), F.col(column).alias("content"))
    return hashed.dropDuplicates(["blob_hash"]).join(stored.select("blob_hash"), "blob_hash", "left_anti")


def manifest_hash(manifest: Column) -> Column:
    """Hash of the canonical JSON of a manifest sorted by path."""
    canonical = F.transform(F.array_sort(manifest), lambda e: F.struct(e["blob_hash"].alias("blob_hash"), e["path"].alias("path")))
    return S.content_hash(F.to_json(canonical))


def manifests(files: DataFrame) -> DataFrame:
    """(artifact_id, version, manifest, manifest_hash, n_files, bytes) from files
    (artifact_id, version, path, blob_hash, size)."""
    made = files.groupBy("artifact_id", "version").agg(
        F.array_sort(F.collect_list(F.struct("path", "blob_hash"))).alias("manifest"), F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("bytes")
    )
    return made.withColumn("manifest_hash", manifest_hash(F.col("manifest")))


def version_chain(states: DataFrame, order: str = "at") -> DataFrame:
    """States (artifact_id, order, manifest_hash, skipped, tombstone) that differ
    from the one before, numbered from 1 as seq."""
    w = Window.partitionBy("artifact_id").orderBy(order)
    same = F.struct("manifest_hash", "skipped", "tombstone")
    kept = states.withColumn("_before", F.lag(same).over(w)).filter(~F.col("_before").eqNullSafe(same)).drop("_before")
    return kept.withColumn("seq", F.row_number().over(w).cast("long"))


def newest_versions(versions: DataFrame, keep: int) -> DataFrame:
    """The `keep` newest versions of each artifact, at least one."""
    rank = F.row_number().over(Window.partitionBy("artifact_id").orderBy(F.desc("seq")))
    return versions.withColumn("_rank", rank).filter(F.col("_rank") <= max(1, keep)).drop("_rank")


def orphan_blobs(blobs: DataFrame, versions: DataFrame) -> DataFrame:
    """Blobs (blob_hash) that no version's manifest names."""
    used = versions.select(F.explode("manifest.blob_hash").alias("blob_hash"))
    return blobs.join(used, "blob_hash", "left_anti")


def retained(mode: str, max_versions: int) -> int | None:
    """Versions that a retention mode keeps; None for all."""
    return {"latest_only": 1, "max_versions": max_versions}.get(mode)


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(artifact_id, path, change) between two sets of manifest entries
    (artifact_id, path, blob_hash): `+` added, `-` removed, `~` changed."""
    b = before.select("artifact_id", "path", F.col("blob_hash").alias("old"))
    a = after.select("artifact_id", "path", F.col("blob_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "+").when(F.col("new").isNull(), "-").when(F.col("old") != F.col("new"), "~")
    return b.join(a, ["artifact_id", "path"], "full_outer").withColumn("change", change).filter("change is not null").select("artifact_id", "path", "change")


def last_diff(versions: DataFrame) -> DataFrame:
    """The diff between the two newest versions of each artifact that has two."""
    rank = F.row_number().over(Window.partitionBy("artifact_id").orderBy(F.desc("seq")))
    two = versions.withColumn("rank", rank).filter("rank <= 2").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("artifact_id"))).filter("n = 2")
    entries = two.select("artifact_id", "rank", F.inline("manifest"))
    return manifest_diff(entries.filter("rank = 2"), entries.filter("rank = 1"))


def restore(versions: DataFrame, blobs: DataFrame, seq: int | None = None) -> DataFrame:
    """(artifact_id, path, content) of a version, the newest by default; a
    tombstone and an unknown version have no files."""
    picked = newest_versions(versions, 1) if seq is None else versions.filter(F.col("seq") == seq)
    return picked.filter(~F.col("tombstone")).select("artifact_id", F.inline("manifest")).join(blobs, "blob_hash").select("artifact_id", "path", "content")


def limit_files(files: DataFrame, max_count: int, max_file: int, max_total: int) -> DataFrame:
    """Files (artifact_id, path, size) with why they are skipped, null if kept.

    In order of path: files beyond the first `max_count` are skipped, then those
    above `max_file`, then those that do not fit into what `max_total` leaves; a
    skipped file takes up none of it.  A fold over the sizes of each artifact's
    first `max_count` files; what is beyond them needs none.
    """
    rank = F.row_number().over(Window.partitionBy("artifact_id").orderBy("path"))
    ranked = files.withColumn("_rank", rank)
    beyond = ranked.filter(F.col("_rank") > max_count).select("artifact_id", "path", F.col("size").cast("bigint").alias("size"), F.lit("max_file_count").alias("skipped"))
    files = ranked.filter(F.col("_rank") <= max_count).drop("_rank")

    def step(a: Column, f: Column) -> Column:
        why = F.when(f["size"] > max_file, "max_file_bytes").when(a["used"] + f["size"] > max_total, "max_artifact_bytes")
        out = F.struct(f["path"].alias("path"), f["size"].alias("size"), why.alias("skipped"))
        return F.struct(F.when(why.isNull(), a["used"] + f["size"]).otherwise(a["used"]).alias("used"), F.concat(a["out"], F.array(out)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<path:string,size:bigint,skipped:string>>").alias("out"))
    listed = files.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("path", F.col("size").cast("bigint").alias("size")))).alias("files"))
    return listed.select("artifact_id", F.inline(F.aggregate("files", start, step, lambda a: a["out"]))).unionByName(beyond)


def captured_changes(disk: DataFrame, latest: DataFrame) -> DataFrame:
    """What a scan finds against the latest versions: (artifact_id, change) with
    `create`, `update` or `delete` (vanished from disk).  disk: (artifact_id,
    disk_hash).  latest: (artifact_id, manifest_hash, tombstone)."""
    joined = disk.join(latest, "artifact_id", "full_outer")
    gone = F.col("disk_hash").isNull()
    change = F.when(F.col("manifest_hash").isNull(), "create").when(gone & ~F.col("tombstone"), "delete").when(~gone & (F.col("tombstone") | (F.col("disk_hash") != F.col("manifest_hash"))), "update")
    return joined.withColumn("change", change).filter("change is not null").select("artifact_id", "change")


def changed_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, modified, length) whose fingerprint is not in `known`; only
    these need their content read."""
    return listing.join(known.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")


def version_events(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """A bundle for each version: (artifact_id, seq, action, bundle), files in
    base 64 by path."""
    action = F.when(F.col("tombstone"), "delete").when(F.col("seq") == 1, "create").otherwise("update")
    files = versions.select("artifact_id", "seq", F.explode_outer("manifest").alias("e")).select("artifact_id", "seq", "e.*").join(blobs, "blob_hash", "left")
    entry = F.struct("path", F.octet_length("content").cast("long").alias("byte_count"), F.col("blob_hash").alias("content_hash"), F.base64(F.encode("content", "UTF-8")).alias("content_b64"))
    packed = files.groupBy("artifact_id", "seq").agg(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), entry))).alias("files"))
    return versions.withColumn("action", action).join(packed, ["artifact_id", "seq"]).select("artifact_id", "seq", "action", F.to_json(F.struct("artifact_id", F.col("seq").alias("version_seq"), "manifest_hash", "files")).alias("bundle"))


def resolve_artifact(calls: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Calls (name, category) with their artifact: with a category its id is
    spelled out; else a live artifact of the name, then the one first seen last,
    then a name of its own."""
    best = artifacts.groupBy("name").agg(F.max_by("artifact_id", F.struct(~F.col("tombstone"), F.col("first_seen"))).alias("_known"))
    spelled = F.concat(F.lit("skill:"), F.col("category"), F.lit("/"), F.col("name"))
    return calls.join(best, "name", "left").withColumn("artifact_id", F.when(F.coalesce(F.col("category"), F.lit("")) != "", spelled).otherwise(F.coalesce("_known", F.concat(F.lit("skill:"), F.col("name"))))).drop("_known")


# Actions of the two knowledge tools.
SKILL_ACTIONS = ("create", "edit", "patch", "write_file", "remove_file", "delete")
MEMORY_ACTIONS = ("add", "replace", "remove")


def classify_mutations(calls: DataFrame) -> DataFrame:
    """Successful, unstaged knowledge calls (tool_name, arguments, result) with
    kind and action; calls of several operations are a `batch`, calls with an
    unknown action or target are dropped."""
    arg = lambda name: F.get_json_object("arguments", f"$.{name}")
    ok = (F.get_json_object("result", "$.success") == "true") & (F.coalesce(F.get_json_object("result", "$.staged"), F.lit("false")) != "true")
    operations = F.from_json(arg("operations"), "array<struct<action:string>>")
    many = F.coalesce(F.size(operations), F.lit(0)) > 0
    skill = F.when((F.col("tool_name") == "skill_manage") & arg("action").isin(*SKILL_ACTIONS) & (F.coalesce(arg("name"), F.lit("")) != ""), arg("action"))
    valid = F.forall(operations, lambda o: F.coalesce(o["action"].isin(*MEMORY_ACTIONS), F.lit(False)))
    target = F.coalesce(arg("target"), F.lit("memory"))
    memory = F.when((F.col("tool_name") == "memory") & target.isin("memory", "user"), F.when(many, F.when(valid, F.lit("batch"))).otherwise(F.when(arg("action").isin(*MEMORY_ACTIONS), arg("action"))))
    named = calls.filter(ok).withColumn("action", F.coalesce(skill, memory)).filter("action is not null")
    return named.withColumn("kind", F.when(F.col("tool_name") == "memory", "memory").otherwise("skill")).withColumn("name", F.when(F.col("tool_name") == "memory", target).otherwise(arg("name"))).withColumn("operation_actions", F.when(many, operations["action"]))


def pair_tool_calls(messages: DataFrame) -> DataFrame:
    """Tool results with the call they answer: the latest earlier assistant row
    of the session whose calls have the id.  (id, session_id, tool_call_id,
    assistant_id, name, arguments), results without a call are left out."""
    calls = "array<struct<id:string,call_id:string,function:struct<name:string,arguments:string>>>"
    asked = messages.filter("role = 'assistant' and tool_calls is not null").select(F.col("session_id").alias("s"), F.col("id").alias("assistant_id"), F.explode(F.from_json("tool_calls", calls)).alias("c"))
    asked = asked.select("s", "assistant_id", F.coalesce(F.nullif("c.id", F.lit("")), F.col("c.call_id")).alias("call"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))
    results = messages.filter("role = 'tool' and tool_call_id <> ''").select("id", "session_id", "tool_call_id")
    both = results.join(asked, (F.col("session_id") == F.col("s")) & (F.col("tool_call_id") == F.col("call")) & (F.col("assistant_id") < F.col("id")))
    return both.groupBy("id", "session_id", "tool_call_id").agg(F.max_by(F.struct("assistant_id", "name", "arguments"), "assistant_id").alias("c")).select("id", "session_id", "tool_call_id", "c.*")


MEMORY_DELIMITER = "\n§\n"


def fold_skill(files: dict[str, str] | None, action: str, args: dict) -> dict[str, str] | None:
    """The files of a skill after one call; None if the call cannot be applied."""
    content, path = args.get("content"), args.get("file_path")
    if action == "delete":
        return {}
    if action == "create":
        return {"SKILL.md": content} if isinstance(content, str) else None
    if files is None:
        return None
    if action == "edit":
        return {**files, "SKILL.md": content} if isinstance(content, str) else None
    if action == "write_file":
        body = args.get("file_content")
        return {**files, path: body} if isinstance(path, str) and isinstance(body, str) else None
    if action == "remove_file":
        return {k: v for k, v in files.items() if k != path} if path in files else None
    if action == "patch":
        path, old, new = path or "SKILL.md", args.get("old_string"), args.get("new_string")
        if path not in files or not isinstance(old, str) or not isinstance(new, str):
            return None
        found, every = files[path].count(old), args.get("replace_all") is True
        return {**files, path: files[path].replace(old, new)} if found == 1 or found and every else None
    return None


def fold_memory(entries: list[str], operations: list[dict]) -> list[str] | None:
    """A memory's entries after some operations; None if one is invalid or its
    text fits several different entries."""
    out = list(entries)
    for op in operations:
        if not isinstance(op, dict):
            return None
        action, content, old = (op.get(k) for k in ("action", "content", "old_text"))
        text = content.strip() if isinstance(content, str) else ""
        if action == "add":
            if not text:
                return None
            out += [] if text in out else [text]
            continue
        hits = [i for i, entry in enumerate(out) if isinstance(old, str) and old.strip() in entry]
        if action not in ("replace", "remove") or not hits or len({out[i] for i in hits}) > 1 or action == "replace" and not text:
            return None
        out[hits[0] : hits[0] + 1] = [text] if action == "replace" else []
    return out


def _object(text: str | None) -> dict:
    """A JSON object; an empty one for anything else."""
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def memory_after(state: dict[str, str] | None, file: str, action: str, args: dict, result: dict) -> dict[str, str] | None:
    """A memory's file after one call; None if that cannot be told.

    What a memory held before it was first seen, or after a call that could not
    be applied, is unknown.  It is taken to have been empty only if the call's
    result counts as many entries as that would leave.
    """
    known = state is not None and file in state
    entries = [x.strip() for x in state[file].split(MEMORY_DELIMITER) if x.strip()] if known else []
    operations = args.get("operations")
    done = fold_memory(entries, operations if isinstance(operations, list) and operations else [{**args, "action": action}])
    count = result.get("entry_count")
    agrees = isinstance(count, int) and not isinstance(count, bool) and done is not None and count == len(done)
    return {file: MEMORY_DELIMITER.join(done)} if done is not None and (known or agrees) else None


def after_states(mutations: DataFrame) -> DataFrame:
    """(artifact_id, at, files as JSON) after each mutation (artifact_id, kind,
    name, at, action, arguments, and result if there is one) in order; null where
    it cannot be told, and then from there on until the artifact is created anew
    or a memory's result tells its size.  Arguments and results that are no JSON
    objects are empty ones.

    A fold with free text edits per artifact, so it runs as Python over the
    mutations of a partition in order; an artifact has all of its own there.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: object = batches  # no artifact's id
        state: dict[str, str] | None = None
        for pdf in batches:
            told = []
            for r in pdf.itertuples():
                if r.artifact_id != of:
                    of, state = r.artifact_id, None
                args = _object(r.arguments)
                if r.kind == "memory":
                    state = memory_after(state, "USER.md" if r.name == "user" else "MEMORY.md", r.action, args, _object(r.result))
                else:
                    state = fold_skill(state, r.action, args)
                told.append(None if state is None else json.dumps(state, sort_keys=True, ensure_ascii=False))
            yield pd.DataFrame({"artifact_id": pdf["artifact_id"], "at": pdf["at"], "files": pd.Series(told, index=pdf.index, dtype=object)})

    result = F.col("result") if "result" in mutations.columns else F.lit(None).cast("string").alias("result")
    return mutations.select("artifact_id", "kind", "name", "at", "action", "arguments", result).repartition("artifact_id").sortWithinPartitions("artifact_id", F.col("at").asc_nulls_last()).mapInPandas(run, "artifact_id string, at long, files string")
