"""The event envelope: its fields, event types and derived sets."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must be as they are, here and in the other modules, stand
# together under a comment that says so; where their order has no meaning it is
# alphabetical.

SCHEMA_VERSION = "1"

# Event types of envelope version 1.
CAPTURED_EVENT_TYPES = (
    "cron.run_claimed", "cron.run_finished", "cron.run_missed", "cron.ticker_heartbeat",
    "delegation.dispatched", "invocation.completed", "invocation.started", "model.usage_recorded",
    "reconcile.capture_stale", "reconcile.gap_detected", "reconcile.terminal_missing",
    "runtime.gateway_start_failed", "runtime.gateway_started", "session.created", "session.ended",
    "subagent.child_spawned", "subagent.completed", "tool.call_completed",
)
RESERVED_EVENT_TYPES = (
    "command.invoked", "cron.definition_changed", "delegation.delivered", "delegation.progress",
    "handoff.state_changed", "knowledge.record_compacted", "knowledge.record_written",
    "model.call_failed", "model.call_requested", "model.call_succeeded",
    "runtime.content_chunk_recorded", "runtime.gateway_stopped", "security.secret_detected",
    "session.compressed", "session.finalized", "step.iterated", "task.attempt_ended", "task.blocked",
    "task.claimed", "task.completed", "task.created", "task.failed_terminal",
    "tool.approval_requested", "tool.approval_responded", "tool.call_requested",
)
EVENT_TYPES = CAPTURED_EVENT_TYPES + RESERVED_EVENT_TYPES

SESSION_STARTS = ("session.created", "subagent.child_spawned")
SESSION_ENDS = ("session.ended", "subagent.completed")
TASK_EVENTS = ("task.created", "task.claimed", "task.completed", "task.blocked", "task.failed_terminal", "task.attempt_ended")
TASK_TERMINALS = ("task.completed", "task.blocked", "task.failed_terminal")
FINDINGS = ("reconcile.gap_detected", "reconcile.terminal_missing", "reconcile.capture_stale", "cron.run_missed", "runtime.gateway_start_failed")

#: (field, kind, required); object fields are JSON text.
FIELDS = (
    ("schema_version", "string", True), ("event_id", "string", True), ("producer_sequence", "integer", True),
    ("occurred_at", "number", True), ("recorded_at", "number", True), ("installation_id", "string", True),
    ("tenant_id", "string", True), ("profile", "string", True), ("runtime", "object", True),
    ("session_id", "string", False), ("session_key", "string", False), ("parent_session_id", "string", False),
    ("invocation_id", "string", False), ("correlation_id", "string", True), ("causation_id", "string", False),
    ("source", "string", True), ("capture_method", "string", True), ("payload", "object", True),
    ("content_ciphertext", "string", False), ("content_nonce", "string", False), ("content_hash", "string", False),
    ("key_version", "string", False), ("partial", "boolean", True),
)
CONTENT_COMPANIONS = ("content_nonce", "content_hash", "key_version")

_KINDS = {"string": T.StringType(), "object": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}

#: Columns of the ledger at rest.  event_type is promoted out of the payload so
#: that filters on it reach the scan.
ENVELOPE = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind, _ in FIELDS] + [T.StructField("event_type", T.StringType()), T.StructField("dedup_key", T.StringType())])

#: What a pruned event leaves behind.
TOMBSTONE = T.StructType([
    T.StructField("installation_id", T.StringType()), T.StructField("producer_sequence", T.LongType()), T.StructField("event_id", T.StringType()),
    T.StructField("dedup_key", T.StringType()), T.StructField("recorded_at", T.DoubleType()), T.StructField("event_type", T.StringType()),
    T.StructField("session_id", T.StringType()), T.StructField("parent_session_id", T.StringType()), T.StructField("invocation_id", T.StringType()), T.StructField("payload", T.StringType()),
])
