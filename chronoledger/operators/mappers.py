"""Source rows to event records: the columns every mapper returns are those of
`record`, with a payload of JSON text in alphabetical key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from ..schema import FINDINGS  # noqa: F401  (re-exported for finding builders)

# Task event kinds and run outcomes of the board.
TASK_KINDS = {
    "block_loop_detected": "task.failed_terminal", "blocked": "task.blocked", "claimed": "task.claimed", "completed": "task.completed",
    "created": "task.created", "dependency_wait": "task.blocked", "gave_up": "task.failed_terminal", "scheduled": "task.blocked",
}
OUTCOMES = {
    "blocked": "released", "completed": "success", "crashed": "failure", "gave_up": "failure", "rate_limited": "released",
    "reclaimed": "released", "scheduled": "released", "spawn_failed": "failure", "stale": "released", "timed_out": "failure",
}
TASK_DETAILS = ("priority", "assignee", "project_id", "idempotency_key", "block_kind", "consecutive_failures")
USAGE_TOTALS = (
    "api_call_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens",
    "estimated_cost_usd", "actual_cost_usd", "cost_status", "cost_source",
)
RECORD = ("event_type", "occurred_at", "source", "capture_method", "correlation_id", "session_id", "parent_session_id", "invocation_id", "profile", "partial", "payload", "content", "dedup_key")


def payload_of(**fields: Column) -> Column:
    """JSON of the fields that are not null, keys in alphabetical order."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]))


def record(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` as records; columns not given are null, profile `default`, partial false."""
    kinds = {"occurred_at": "double", "partial": "boolean"}
    given = {"profile": F.lit("default"), "partial": F.lit(False)} | columns
    profile = F.coalesce(F.nullif(given["profile"].cast("string"), F.lit("")), F.lit("default"))
    given["profile"] = profile
    return df.select(*[given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RECORD])


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def session_records(sessions: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """A start for each session, and an end for each that is ended and final.

    roots: (id, root) for correlation; else the session itself.  A null
    expiry_finalized counts as final.
    """
    df = sessions if roots is None else sessions.join(roots, "id", "left")
    root = F.col("id") if roots is None else F.coalesce("root", "id")
    sub, kind = F.coalesce(F.col("source") == "subagent", F.lit(False)), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))
    starts, ends = F.when(sub, "subagent.child_spawned").otherwise("session.created"), F.when(sub, "subagent.completed").otherwise("session.ended")
    common = dict(source=F.lit("state.db:sessions"), capture_method=F.lit("poll:state.db:sessions"), correlation_id=root, session_id=F.col("id"), parent_session_id=F.col("parent_session_id"), profile=F.col("profile_name"))
    counts = dict(kind=kind, message_count=F.col("message_count"), tool_call_count=F.col("tool_call_count"))
    start = record(df, event_type=starts, occurred_at=F.col("started_at"), payload=payload_of(event_type=starts, surface=kind, model=F.col("model"), **counts), dedup_key=F.concat(F.lit("state.db:"), starts, F.lit(":"), F.col("id")), **common)
    over = df.filter(F.col("ended_at").isNotNull() & ~F.col("expiry_finalized").eqNullSafe(0))
    totals = {c: F.col(c) for c in USAGE_TOTALS if c in df.columns}
    end = record(over, event_type=ends, occurred_at=F.col("ended_at"), payload=payload_of(event_type=ends, end_reason=F.col("end_reason"), usage_semantics=F.lit("cumulative_total"), **counts, **totals), dedup_key=F.concat(F.lit("state.db:"), ends, F.lit(":"), F.col("id")), **common)
    return start.unionByName(end)


def message_records(messages: DataFrame, content_limit: int) -> DataFrame:
    """Messages as invocation, model or tool events; empty user and assistant
    rows are skipped, content is cut at `content_limit` bytes.

    messages: id, session_id, role, content, timestamp, finish_reason and, where
    known, tool_name, tool_call_id, effect_disposition, correlation_id,
    invocation_id.
    """
    from ..sources.scans import tolerant

    shape = {"id": ("bigint", None), "session_id": ("string", None), "role": ("string", None), "content": ("string", None), "timestamp": ("double", None), **{c: ("string", None) for c in ("finish_reason", "tool_name", "tool_call_id", "effect_disposition", "correlation_id", "invocation_id")}}
    df = tolerant(messages, shape).filter((F.col("role") == "tool") | (F.col("role").isin("user", "assistant") & (F.coalesce(F.col("content"), F.lit("")) != "")))
    df = df.withColumn("cut", S.limited("content", content_limit))
    tool, middle = F.col("role") == "tool", (F.col("role") == "assistant") & F.col("finish_reason").eqNullSafe("tool_calls")
    kind = F.when(tool, "tool.call_completed").when(F.col("role") == "user", "invocation.started").when(middle, "model.call_succeeded").otherwise("invocation.completed")
    talk = lambda x: F.when(~tool, x)
    body = payload_of(
        event_type=kind, message_row_id=F.col("id"), message_role=talk(F.col("role")),
        message_phase=F.when(F.col("role") == "assistant", F.when(middle, "intermediate").otherwise("final")),
        finish_reason=F.when(F.col("role") == "assistant", F.col("finish_reason")),
        tool_name=F.when(tool, F.col("tool_name")), tool_call_id=F.when(tool, F.col("tool_call_id")), effect_disposition=F.when(tool, F.col("effect_disposition")),
        status=F.when(tool, S.tool_status("content")),
        content_original_bytes=F.col("cut.original_bytes"), content_captured_bytes=F.col("cut.captured_bytes"), content_truncated=F.col("cut.truncated"),
        invocation_attribution=F.when(F.col("invocation_id").isNotNull(), "inferred_from_session_window"),
    )
    return record(
        df, event_type=kind, occurred_at=S.epoch_or_zero("timestamp"), source=F.lit("state.db:messages"), capture_method=F.lit("poll:state.db:messages"),
        correlation_id=F.coalesce("correlation_id", "session_id"), session_id=F.col("session_id"), invocation_id=F.col("invocation_id"),
        partial=F.col("cut.truncated"), payload=body, content=F.col("cut.content"), dedup_key=F.concat_ws(":", F.lit("state.db"), F.col("role"), F.col("id").cast("string")),
    )


def delegation_records(delegations: DataFrame) -> DataFrame:
    """Dispatches, with their goal and the summaries of their results as content."""
    truthy = F.coalesce(F.get_json_object("event_json", "$.is_batch"), F.lit("false"))
    session = F.coalesce(F.nullif(F.col("parent_session_id"), F.lit("")), F.col("origin_session"))
    goal = F.nullif(F.get_json_object("event_json", "$.goal"), F.lit(""))
    summaries = F.transform(F.from_json(F.get_json_object("result_json", "$.results"), "array<struct<summary:string>>"), lambda x: x["summary"])
    return record(
        delegations, event_type=F.lit("delegation.dispatched"), occurred_at=S.epoch_or_zero("dispatched_at"), source=F.lit("state.db:async_delegations"),
        capture_method=F.lit("poll:state.db:async_delegations"), correlation_id=session, session_id=session, parent_session_id=F.col("parent_session_id"),
        payload=payload_of(event_type=F.lit("delegation.dispatched"), delegation_id=F.col("delegation_id"), state=F.col("state"), delivery_state=F.col("delivery_state"), is_batch=~truthy.isin("false", "0", "", "[]", "{}"), owner_pid=F.col("owner_pid")),
        content=F.when(goal.isNotNull() | summaries.isNotNull(), F.to_json(F.struct(goal.alias("goal"), summaries.alias("summaries")))),
        dedup_key=F.concat(F.lit("state.db:deleg:"), F.col("delegation_id")),
    )


def execution_records(executions: DataFrame) -> DataFrame:
    """A claim for each scheduler run and a finish for each finished one, which
    is ok if completed without an error."""
    common = dict(source=F.lit("cron:executions.db"), capture_method=F.lit("poll:cron:executions.db"), correlation_id=F.col("job_id"))
    at = F.coalesce(S.to_epoch("claimed_at"), F.lit(0.0))
    ids = dict(job_id=F.col("job_id"), execution_id=F.col("id"), status=F.col("status"))
    claim = record(executions, event_type=F.lit("cron.run_claimed"), occurred_at=at, payload=payload_of(event_type=F.lit("cron.run_claimed"), run_source=F.col("source"), pid=F.col("pid"), **ids), dedup_key=F.concat(F.lit("cron:claimed:"), F.col("id")), **common)
    no_error = F.coalesce(F.col("error"), F.lit("")) == ""
    ended = executions.filter("finished_at is not null")
    finish = record(
        ended, event_type=F.lit("cron.run_finished"), occurred_at=F.coalesce(F.nullif(S.to_epoch("finished_at"), F.lit(0.0)), at),
        payload=payload_of(event_type=F.lit("cron.run_finished"), ok=(F.col("status").eqNullSafe("completed")) & no_error, started_at=F.col("started_at").cast("string"), finished_at=F.col("finished_at").cast("string"), **ids),
        content=F.nullif(F.col("error"), F.lit("")), dedup_key=F.concat(F.lit("cron:finished:"), F.col("id")), **common,
    )
    return claim.unionByName(finish)


def board_records(events: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task transitions with their task and run, and a record for each ended
    attempt.  All three tables have `board`; unknown kinds are dropped, unknown
    outcomes have the disposition `unknown`."""
    t = tasks.select("board", F.col("id").alias("task_id"), F.col("session_id"), F.col("status"), *[F.col(c) for c in TASK_DETAILS])
    r = runs.select("board", F.col("id").alias("run_id"), F.col("task_id").alias("run_task"), "claim_lock", "claim_expires", "worker_pid", "last_heartbeat_at", "started_at", "ended_at", "outcome", "profile", "step_key")
    lease = dict(holder=F.col("claim_lock"), claim_expires=F.col("claim_expires"), worker_pid=F.col("worker_pid"), last_heartbeat_at=F.col("last_heartbeat_at"))
    kind = lookup(TASK_KINDS, F.col("kind"))
    moves = events.join(t, ["board", "task_id"], "left").join(r, ["board", "run_id"], "left").withColumn("event_type", kind).filter("event_type is not null")
    moved = record(
        moves, event_type=F.col("event_type"), occurred_at=S.epoch_or_zero("created_at"), source=F.lit("kanban:task_events"), capture_method=F.lit("poll:kanban:task_events"),
        correlation_id=F.col("task_id"), session_id=F.col("session_id"),
        payload=payload_of(event_type=F.col("event_type"), board=F.col("board"), task_id=F.col("task_id"), event_kind=F.col("kind"), run_id=F.col("run_id"), status=F.col("status"), **lease, **{c: F.col(c) for c in TASK_DETAILS}),
        dedup_key=F.concat_ws(":", F.lit("kanban"), F.col("board"), F.lit("event"), F.col("id").cast("string")),
    )
    ends = r.filter("outcome is not null").withColumn("task_id", F.col("run_task")).join(t.select("board", "task_id", "session_id"), ["board", "task_id"], "left")
    ended = record(
        ends, event_type=F.lit("task.attempt_ended"), occurred_at=F.coalesce(F.nullif(F.col("ended_at").cast("double"), F.lit(0.0)), F.col("started_at").cast("double"), F.lit(0.0)),
        source=F.lit("kanban:task_runs"), capture_method=F.lit("poll:kanban:task_runs"), correlation_id=F.col("task_id"), session_id=F.col("session_id"),
        payload=payload_of(event_type=F.lit("task.attempt_ended"), board=F.col("board"), task_id=F.col("task_id"), run_id=F.col("run_id"), run_outcome=F.col("outcome"), attempt_disposition=F.coalesce(lookup(OUTCOMES, F.col("outcome")), F.lit("unknown")), profile=F.col("profile"), step_key=F.col("step_key"), **lease),
        dedup_key=F.concat_ws(":", F.lit("kanban"), F.col("board"), F.lit("run"), F.col("run_id").cast("string")),
    )
    return moved.unionByName(ended)


#: Offsets that one bucket of the search for a session's start covers.
HOOK_BUCKET = 100_000

HOOK_SCHEMA = "event_type string, captured_at double, context struct<session_id:string,session_key:string,platform:string,user_id:string,chat_type:string,thread_id:string,chat_id:string,platforms:array<string>>"


def hook_records(lines: DataFrame, installation: str, generation: str, column: str = "value") -> DataFrame:
    """Spool lines (value, offset) as gateway, session and invocation events;
    other types and lines that are no JSON objects are dropped.

    An end takes the invocation of the start pending in its session; a session
    end finds its session by the latest start before it with its key.  Offsets
    are worked in buckets, each with the last start of the ones before it, so a
    key may have any number of lines.
    """
    from .attribution import pair_starts
    from .lineage import cut
    from ..sources.scans import json_objects
    from pyspark.sql.window import Window

    # Written once, as its rows are wanted in several parts.
    parsed = cut(json_objects(lines, HOOK_SCHEMA, column).select("offset", "object.*").select("offset", "event_type", "captured_at", "context.*")).withColumn("hook", F.col("event_type"))
    kinds = {"gateway:startup": "runtime.gateway_started", "session:start": "session.created", "session:end": "session.ended", "session:reset": "session.ended", "agent:start": "invocation.started", "agent:end": "invocation.completed"}
    known = parsed.withColumn("kind", lookup(kinds, F.col("hook"))).filter("kind is not null")
    ending = F.col("hook").isin("session:end", "session:reset")
    agent = F.col("kind").isin("invocation.started", "invocation.completed")
    # Only ends of sessions look back, and only to starts of sessions with their key.
    talks = known.filter(~agent).withColumn("_b", F.expr(f"offset div {HOOK_BUCKET}"))
    started = F.when((F.col("hook") == "session:start") & (F.coalesce(F.col("session_id"), F.lit("")) != ""), F.col("session_id"))
    last_of = talks.filter(started.isNotNull()).groupBy("session_key", "_b").agg(F.max_by(started, "offset").alias("_started"))
    upto = Window.partitionBy("session_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("session_key", "_b").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    base = talks.select("session_key", "_b").distinct().join(last_of, ["session_key", "_b"], "left").withColumn("_before", F.last("_started", ignorenulls=True).over(upto)).drop("_started")
    talks = talks.withColumn("last_started", F.last(started, ignorenulls=True).over(within)).join(base, ["session_key", "_b"], "left")
    talks = talks.withColumn("session", F.when(ending, F.when(F.coalesce(F.col("session_key"), F.lit("")) != "", F.coalesce("last_started", "_before"))).otherwise(F.col("session_id"))).drop("_b", "_before", "last_started")
    paired = pair_starts(known.filter(agent).withColumn("session", F.col("session_id")), "session_id", "offset", F.col("kind") == "invocation.started")
    at = F.col("offset").cast("string")
    named = paired.withColumn("invocation_id", F.when(F.col("session_id").isNull(), F.concat(F.lit("unknown:hook:"), at)).otherwise(F.concat(F.col("session_id"), F.lit(":hook:"), F.coalesce(F.col("paired_with").cast("string"), at))))
    every = named.drop("paired_with").unionByName(talks.withColumn("invocation_id", F.lit(None).cast("string")))
    gateway, start, session_start = F.col("hook") == "gateway:startup", F.col("hook") == "agent:start", F.col("hook") == "session:start"
    body = payload_of(
        event_type=F.col("kind"), platforms=F.when(gateway, F.col("platforms")), platform=F.when(~gateway, F.col("platform")), surface=F.when(session_start, F.nullif(F.col("platform"), F.lit(""))),
        user_id=F.when(~gateway, F.col("user_id")), reason=F.when(ending, F.when(F.col("hook") == "session:reset", "reset").otherwise("end")),
        chat_type=F.when(agent, F.col("chat_type")), thread_id=F.when(start, F.col("thread_id")), chat_id=F.when(start, F.col("chat_id")),
        gateway_id=F.when(gateway, S.gateway_id(F.lit(installation), S.epoch_or_zero("captured_at"), F.col("offset"))),
    )
    key = F.concat_ws(":", F.lit("hook-spool"), *([] if generation == "legacy" else [F.lit(generation)]), at)
    correlation = F.when(gateway, F.concat(F.lit("gateway:"), at)).otherwise(F.coalesce(F.nullif(F.col("session"), F.lit("")), F.when(~agent, F.nullif(F.col("session_key"), F.lit(""))), F.concat(F.lit("hook:"), at)))
    return record(
        every, event_type=F.col("kind"), occurred_at=S.epoch_or_zero("captured_at"), source=F.concat(F.lit("hook:"), F.substring_index("hook", ":", 1)), capture_method=F.concat(F.lit("hook:"), F.col("hook")),
        correlation_id=correlation, session_id=F.col("session"), invocation_id=F.col("invocation_id"), partial=agent | ending, payload=body, dedup_key=key,
    )


def failure_records(failures: DataFrame) -> DataFrame:
    """Failed model calls (of sources.scans.failure_lines)."""
    return record(
        failures, event_type=F.lit("model.call_failed"), occurred_at=F.col("occurred_at"), source=F.lit("logs:agent.log"), capture_method=F.lit("poll:gateway-log"),
        correlation_id=F.col("session_id"), session_id=F.col("session_id"),
        payload=payload_of(event_type=F.lit("model.call_failed"), provider=F.col("provider"), model=F.col("model"), attempts=F.col("attempts"), error_class=F.col("error_class"), http_status=F.col("http_status")),
        content=F.col("summary"), dedup_key=F.concat_ws(":", F.lit("gateway-log:model.call_failed"), F.col("session_id"), F.sha2("value", 256)),
    )


def content_chunks(contents: DataFrame, size: int, key: str = "dedup_key", content: str = "content") -> DataFrame:
    """Content longer than `size` bytes as numbered chunks: (content_ref, chunk,
    chunks, bytes, data), to be placed right before their parent."""
    raw = F.encode(F.col(content), "UTF-8")
    n = F.ceil(F.octet_length("raw") / F.lit(float(size))).cast("int")
    long = contents.select(F.col(key).alias("content_ref"), raw.alias("raw")).filter(F.octet_length("raw") > size)
    cut = long.withColumn("chunks", n).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.expr(f"substring(raw, chunk * {size} + 1, {size})")
    return cut.select("content_ref", "chunk", "chunks", F.octet_length(data).cast("long").alias("bytes"), data.alias("data"))


def reassembled(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents (content_ref, total_bytes, content_hash) with their content put
    together again: ok only if every chunk is there once and bytes and hash agree.

    Where both sides have a producer_sequence, only chunks in the sequences right
    before the parent count (as many as it says, chunk_count), so a reference
    that is used again does not take the chunks of an older parent.
    """
    if "producer_sequence" in chunks.columns and "producer_sequence" in parents.columns:
        at = parents.select(F.col("content_ref").alias("_ref"), F.col("producer_sequence").alias("_at"), F.col("chunk_count").alias("_count"))
        near = (F.col("content_ref") == F.col("_ref")) & F.col("producer_sequence").between(F.col("_at") - F.col("_count"), F.col("_at") - 1)
        chunks = chunks.join(at, near).select("content_ref", "chunk", "chunks", "data")
    whole = chunks.groupBy("content_ref").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("parts"), F.max("chunks").alias("chunks"), F.min("chunks").alias("least"), F.count(F.lit(1)).alias("n"),
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["data"]))
    gapless = F.forall(F.transform("parts", lambda p, i: p["chunk"] == i), lambda x: x)
    out = parents.join(whole, "content_ref", "left").withColumn("whole", joined)
    good = (F.col("n") == F.col("chunks")) & (F.col("least") == F.col("chunks")) & gapless & (F.octet_length("whole") == F.col("total_bytes")) & (S.content_hash(F.col("whole")) == F.col("content_hash"))
    return out.select("content_ref", F.coalesce(good, F.lit(False)).alias("ok"), F.when(good, F.col("whole")).alias("content"))


# The fields of a payload that audits read after it is pruned.
RETAINED_FIELDS = ("board", "execution_id", "message_row_id", "model", "run_id", "task", "task_id")


def retention_summary(events: DataFrame) -> DataFrame:
    """What stays of a pruned event: identity, and of the payload the type and
    the fields that audits read.  Content, times of occurrence and correlation go."""
    from ..schema import TOMBSTONE

    v = F.try_parse_json("payload")
    kept = {name: F.try_variant_get(v, f"$.{name}", "variant") for name in ("event_type", *RETAINED_FIELDS)}
    # Numbers stay numbers: each field is taken over as the JSON it was.
    parts = [F.when(x.isNotNull(), F.concat(F.lit(f'"{name}":'), F.to_json(x))) for name, x in sorted(kept.items())]
    narrow = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ","), F.lit("}"))
    return events.withColumn("payload", F.when(v.isNotNull(), narrow)).select(*TOMBSTONE.fieldNames())
