"""Small durable state: cursors and values by key, kept as an append-only table
of writes (key, seq, value); a null value deletes its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOWS = "array<variant>"


def current(writes: DataFrame) -> DataFrame:
    """(key, value): the latest write of each key that is still there."""
    last = writes.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("_w"))
    return last.select("key", F.col("_w.value").alias("value")).filter("value is not null")


def with_prefix(state: DataFrame, prefix: str) -> DataFrame:
    """Keys that start with `prefix`, byte by byte: `%` and `_` are themselves."""
    return state.filter(F.col("key").startswith(F.lit(prefix)))


def deletions(state: DataFrame, keys: DataFrame, seq: int) -> DataFrame:
    """Writes that delete those of `keys` (key) that are there."""
    return state.join(keys.select("key").distinct(), "key", "left_semi").select("key", F.lit(seq).cast("long").alias("seq"), F.lit(None).cast("string").alias("value"))


def number(value: Column, default: float | None = None) -> Column:
    """A double; `default` where the text is none."""
    return F.coalesce(F.trim(value).try_cast("double"), F.lit(default).cast("double"))


def json_of(value: Column, kind: str, default: str) -> Column:
    """The JSON text if it is of `kind` (ARRAY, OBJECT, STRING, BIGINT, ...),
    else `default`, so that a damaged value degrades and does not raise."""
    v = F.try_parse_json(value)
    return F.when(F.schema_of_variant(v).startswith(kind), value).otherwise(F.lit(default))


def window_key(session: Column) -> Column:
    """Where a session's windows are kept: a key of one length for any id."""
    return F.concat(F.lit("invocation_windows:"), F.sha2(session, 256))


def saved_windows(windows: DataFrame, seq: int) -> DataFrame:
    """A write for each session of its windows (session_id, invocation_id,
    started_at, ended_at), oldest first."""
    entry = F.struct("started_at", "invocation_id", "ended_at")
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda w: F.struct(w["invocation_id"].alias("invocation_id"), w["started_at"].alias("started_at"), w["ended_at"].alias("ended_at")))
    made = windows.groupBy("session_id").agg(F.to_json(ordered, {"ignoreNullFields": "false"}).alias("value"))
    return made.select(window_key(F.col("session_id")).alias("key"), F.lit(seq).cast("long").alias("seq"), "value")


def loaded_windows(state: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, invocation_id, started_at, ended_at) of `sessions`
    (session_id).  Values that are no arrays hold no windows; entries without a
    textual invocation_id or a numeric started_at, or with an ended_at that is
    neither null nor a number, are dropped."""
    keyed = sessions.select("session_id", window_key(F.col("session_id")).alias("key")).join(state, "key")
    entries = keyed.select("session_id", F.explode(F.try_variant_get(F.try_parse_json(json_of(F.col("value"), "ARRAY", "[]")), "$", WINDOWS)).alias("e"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("e", f"$.{name}", "variant"))
    numeric = lambda k: k.startswith("DECIMAL") | k.isin("BIGINT", "DOUBLE", "FLOAT")
    end = kind("ended_at")
    good = (kind("invocation_id") == "STRING") & numeric(kind("started_at")) & (end.isNull() | (end == "VOID") | numeric(end))
    pick = lambda name, t: F.try_variant_get("e", f"$.{name}", t).alias(name)
    return entries.filter(F.coalesce(good, F.lit(False))).select("session_id", pick("invocation_id", "string"), pick("started_at", "double"), pick("ended_at", "double"))


def horizon(state: DataFrame, key: str, default: float | None) -> DataFrame:
    """(horizon): the number kept under `key`, one row; `default` without one.
    The install horizon is 0 where unset, the capture horizon null."""
    return state.filter(F.col("key") == key).agg(F.max(number(F.col("value"))).alias("h")).select(F.coalesce("h", F.lit(default).cast("double")).alias("horizon"))
