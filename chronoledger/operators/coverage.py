"""Durable rows as subjects that an event must cover, a builder for each kind.

Every builder returns the columns of `SUBJECT`; `detect.uncaptured` then takes
away what is captured and what is from before the horizon, whatever the kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

SUBJECT = ("subject_type", "subject_id", "source_table", "correlation_id", "session_id", "parent_session_id", "at")

#: Roles whose messages can be captured at all.
ROLES = ("user", "assistant", "tool")


def _subject(df: DataFrame, kind: str, subject: Column, table: str | Column, correlation: Column, at: Column, session: Column | None = None, parent: Column | None = None) -> DataFrame:
    none = F.lit(None)
    values = (F.lit(kind), subject, F.lit(table) if isinstance(table, str) else table, correlation, none if session is None else session, none if parent is None else parent)
    return df.select(*[v.cast("string").alias(c) for c, v in zip(SUBJECT, values, strict=False)], at.cast("double").alias("at"))


def _nonzero(column: str) -> Column:
    """Epoch seconds; 0 is no time."""
    return F.nullif(S.to_epoch(column), F.lit(0.0))


def session_subjects(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """sessions: (id, parent_session_id, started_at).  roots: (id, root)."""
    df = sessions.join(roots, "id", "left")
    return _subject(df, "session", F.col("id"), "state.db:sessions", F.coalesce("root", "id"), S.to_epoch("started_at"), F.col("id"), F.col("parent_session_id"))


def _of_session(df: DataFrame, sessions: DataFrame, roots: DataFrame) -> DataFrame:
    started = sessions.select(F.col("id").alias("_s"), S.to_epoch("started_at").alias("_started"))
    rooted = roots.select(F.col("id").alias("_r"), "root")
    return df.join(started, F.col("session_id") == F.col("_s"), "left").join(rooted, F.col("session_id") == F.col("_r"), "left")


def message_subjects(messages: DataFrame, sessions: DataFrame, roots: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """Messages that can be captured: tool rows, and others with a content; a
    table without contents proves tool rows only.  A message without a time has
    that of its session's start."""
    said = F.length("content") > 0 if "content" in messages.columns else F.lit(False)
    own = messages.filter(F.col("role").isin([r for r in ROLES if r in roles]) & ((F.col("role") == "tool") | said))
    df = _of_session(own, sessions, roots)
    at = F.coalesce(S.to_epoch("timestamp") if "timestamp" in messages.columns else F.lit(None).cast("double"), F.col("_started"))
    return _subject(df, "message", F.col("id"), "state.db:messages", F.coalesce("root", "session_id"), at, F.col("session_id"))


def usage_subjects(usage: DataFrame, sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """usage: (session_id, model, task), each a subject of its session's time.
    Null parts are spelled `None`, as detect.captured_subjects(null_part) does."""
    part = lambda c: F.coalesce(F.col(c), F.lit("None"))
    df = _of_session(usage, sessions, roots)
    return _subject(df, "model_usage", F.concat_ws(":", part("session_id"), part("model"), part("task")), "state.db:session_model_usage", F.coalesce("root", "session_id"), F.col("_started"), F.col("session_id"))


def execution_subjects(executions: DataFrame) -> DataFrame:
    """executions: (id, job_id, claimed_at, finished_at)."""
    return _subject(executions, "execution", F.col("id"), "cron:executions.db", F.col("job_id"), F.coalesce(_nonzero("claimed_at"), S.to_epoch("finished_at")))


def task_subjects(tasks: DataFrame) -> DataFrame:
    """tasks: (board, id, session_id, created_at, started_at).  Ids are told
    apart by their board."""
    return _subject(tasks, "task", F.concat_ws(":", "board", F.col("id").cast("string")), F.concat(F.lit("kanban:"), "board", F.lit(":tasks")), F.col("id"), F.coalesce(_nonzero("created_at"), S.to_epoch("started_at")), F.col("session_id"))


def run_subjects(runs: DataFrame) -> DataFrame:
    """runs: (board, id, task_id, started_at, ended_at)."""
    return _subject(runs, "task_run", F.concat_ws(":", "board", F.col("id").cast("string")), F.concat(F.lit("kanban:"), "board", F.lit(":task_runs")), F.col("task_id"), F.coalesce(_nonzero("started_at"), S.to_epoch("ended_at")))
