"""Scalar functions of the ledger as Column expressions.  All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def _col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, however often it is used.
    Nothing else does that inside functions over arrays and branches, where each
    use is an evaluation of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_epoch(value: ColumnLike) -> Column:
    """Epoch seconds (double) of a number or an ISO 8601 text with offset; null
    for null and for text that is neither.  Naive times are UTC."""
    text = _col(value).cast("string")
    return F.coalesce(text.try_cast("double"), F.unix_micros(text.try_cast("timestamp")) / F.lit(1e6))


def epoch_or_zero(value: ColumnLike) -> Column:
    return F.coalesce(_col(value).try_cast("double"), F.lit(0.0))


def iso_utc(epoch: ColumnLike) -> Column:
    """`2026-01-01T00:00:00Z`, or `-` for null, invalid and non-positive values."""
    x = epoch_or_zero(epoch)
    return F.when(x > 0, F.date_format(F.timestamp_seconds(F.floor(x)), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("-"))


def short_number(x: ColumnLike) -> Column:
    """A double as text: epochs above 1e9 as UTC time, others to four places
    without trailing zeros."""
    v = _col(x)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", v), "0+$", ""), r"\.$", "")
    return F.when(v > 1_000_000_000, iso_utc(v)).otherwise(plain)


def short_text(x: ColumnLike) -> Column:
    """At most 40 characters: longer text keeps 39 and an ellipsis."""
    v = _col(x)
    return F.when(F.char_length(v) <= 40, v).otherwise(F.concat(F.substring(v, 1, 39), F.lit("…")))


def utf8_prefix(text: ColumnLike, most: int) -> Column:
    """The longest prefix of `text` of at most `most` bytes that cuts no character."""
    raw = F.encode(_col(text), "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, most - back).cast("string")) for back in range(4) if most >= back]
    return F.when(F.octet_length(raw) <= most, _col(text)).otherwise(F.coalesce(*cuts))


def limited(text: ColumnLike, most: int) -> Column:
    """struct(content, original_bytes, captured_bytes, truncated) under a byte limit."""
    v = _col(text)
    kept = utf8_prefix(v, most)
    size = F.coalesce(F.octet_length(F.encode(v, "UTF-8")), F.lit(0)).cast("long")
    return F.struct(
        kept.alias("content"), size.alias("original_bytes"),
        F.coalesce(F.octet_length(F.encode(kept, "UTF-8")), F.lit(0)).cast("long").alias("captured_bytes"), (size > most).alias("truncated"),
    )


def tool_status(body: ColumnLike) -> Column:
    """Status of a tool's JSON result: `unknown` unless it is an object; by
    exit_code if it has one; `error` if its error is truthy; else its status."""
    v = F.try_parse_json(_col(body))
    kind = F.schema_of_variant(v)
    keys = F.from_json(_col(body), "map<string,string>")
    part = lambda path, as_type: F.try_variant_get(v, path, as_type)
    error = part("$.error", "string")
    truthy = error.isNotNull() & ~error.isin("", "0", "0.0", "false", "[]", "{}", "null")
    status = part("$.status", "string")
    plain = F.when(status.isNull() | status.isin("", "0", "false", "[]", "{}"), F.lit("ok")).otherwise(status)
    return (
        F.when(v.isNull() | ~kind.startswith("OBJECT"), F.lit("unknown"))
        .when(F.coalesce(F.array_contains(F.map_keys(keys), "exit_code"), F.lit(False)), F.when(part("$.exit_code", "double") == 0, F.lit("ok")).otherwise(F.lit("error")))
        .when(truthy, F.lit("error"))
        .otherwise(plain)
    )


def content_hash(value: ColumnLike) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_col(value), 256))


def short_hash(value: ColumnLike) -> Column:
    """The algorithm and twelve digits of `algorithm:digest`; other text as it is."""
    return F.regexp_replace(_col(value), "^([^:]*:)(.{0,12}).*$", "$1$2")


# How a summary names its HTTP status, and the class of each status.
def http_status(summary: ColumnLike) -> Column:
    return F.regexp_extract(_col(summary), r"(?i)\bHTTP\s+(\d{3})\b", 1).try_cast("int")


def error_class(status: ColumnLike) -> Column:
    s = _col(status)
    return (
        F.when(s == 400, "invalid_request").when(s.isin(401, 403), "authentication").when(s == 404, "not_found").when(s == 408, "timeout")
        .when(s == 429, "rate_limited").when(s.between(500, 599), "provider_server").otherwise("unknown")
    )


#: Fixed value: the log line of a failed model call.
FAILURE_LINE = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) ERROR \[([^\]]+)\] agent\.conversation_loop: "
    r"API call failed after (\d+) retries\. (.*?) \| provider=(\S+) model=(\S+)"
)


# The words that tell the reason of a failed start.
def gateway_reason(text: ColumnLike) -> Column:
    """Class of a start failure by the first keyword that its text has."""
    v = F.lower(F.coalesce(_col(text), F.lit("")))
    has = lambda *words: reduce(or_, [v.contains(w) for w in words])
    return (
        F.when(has("already in use", "_lock", "conflict"), "token_conflict").when(has("policy"), "policy_open")
        .when(has("config", "invalid", "not found"), "config_invalid").otherwise("unknown")
    )


def pid_of(text: ColumnLike) -> Column:
    return F.regexp_extract(F.coalesce(_col(text), F.lit("")), r"PID (\d+)", 1).try_cast("long")


def gateway_id(installation: ColumnLike, occurred_at: ColumnLike, offset: ColumnLike) -> Column:
    """A stable id of one boot."""
    seed = F.concat_ws(":", _col(installation), _col(occurred_at).cast("long").cast("string"), _col(offset).cast("string"))
    return F.concat(F.lit("gw-"), F.substring(F.sha2(seed, 256), 1, 16))


def tidy(value: ColumnLike) -> Column:
    return F.coalesce(_col(value).try_cast("double"), F.lit(0.0))


def wire_bytes(plain: ColumnLike) -> Column:
    """Bytes of a text of `plain` bytes once encrypted and in base 64."""
    return (F.lit(4) * F.ceil((_col(plain) + 16) / F.lit(3.0))).cast("long")


def zone_seconds(iso: ColumnLike) -> Column:
    """The offset of an ISO time in seconds; 0 without one, or for `Z`."""
    v = F.coalesce(_col(iso), F.lit(""))
    sign = F.when(F.regexp_extract(v, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    part = lambda i: F.coalesce(F.regexp_extract(v, r"[+-](\d{2}):(\d{2})$", i).try_cast("int"), F.lit(0))
    return sign * (part(1) * 3600 + part(2) * 60)


def hmac_sha256(key: bytes, message: ColumnLike) -> Column:
    """HMAC-SHA256 as binary, from two SHA-256 of padded keys."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(_col(message), "UTF-8")), 256))
    return F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256))


def fingerprint(key: bytes, message: ColumnLike) -> Column:
    """The first 16 bytes of the HMAC in unpadded URL-safe base 64 (22 characters)."""
    raw = F.base64(F.substring(hmac_sha256(key, message), 1, 16))
    return F.translate(F.rtrim(raw, F.lit("=")), "+/", "-_")


def encrypt(value: ColumnLike, key: bytes, nonce: ColumnLike) -> Column:
    """AES-256-GCM: struct(ciphertext with tag, nonce), both base 64."""
    sealed = F.aes_encrypt(F.encode(_col(value), "UTF-8"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), _col(nonce))
    return F.struct(F.base64(F.substring(sealed, 13, 1 << 30)).alias("content_ciphertext"), F.base64(F.substring(sealed, 1, 12)).alias("content_nonce"))


def decrypt(ciphertext: ColumnLike, nonce: ColumnLike, key: bytes) -> Column:
    return F.try_aes_decrypt(F.concat(F.unbase64(_col(nonce)), F.unbase64(_col(ciphertext))), F.lit(bytearray(key)), F.lit("GCM")).cast("string")


# Payload fields shown for each event type, in order.
_TERMINAL = (
    "kind", "end_reason", "usage_semantics", "api_call_count", "input_tokens", "output_tokens", "cache_read_tokens",
    "cache_write_tokens", "reasoning_tokens", "estimated_cost_usd", "actual_cost_usd", "cost_status", "cost_source",
)
SUMMARY_FIELDS = {
    "cron.run_claimed": ("job_id", "status"),
    "cron.run_finished": ("job_id", "status", "ok"),
    "cron.run_missed": ("job_id", "expected_fire_at", "missed_count"),
    "cron.ticker_heartbeat": ("heartbeat", "last_success"),
    "delegation.dispatched": ("delegation_id", "state", "is_batch"),
    "model.usage_recorded": ("model", "input_tokens", "output_tokens", "estimated_cost_usd"),
    "reconcile.gap_detected": ("gap_kind", "subject_type", "subject_id", "missing_sequence"),
    "reconcile.terminal_missing": ("subject_type", "subject_id", "expected_terminal_event_type"),
    "runtime.gateway_start_failed": ("reason_class", "gateway_state", "platform"),
    "session.created": ("kind", "model"),
    "session.ended": _TERMINAL,
    "subagent.child_spawned": ("kind", "model"),
    "subagent.completed": _TERMINAL,
    "tool.call_completed": ("tool_name", "status", "effect_disposition"),
}


# Spellings of the home mode and what they stand for.
HOME_MODES = {"auto": "auto", "host": "real", "isolated": "profile", "profile": "profile", "profile-home": "profile", "profile_home": "profile", "real": "real", "real-home": "real", "real_home": "real", "user": "real"}


def home_mode(value: ColumnLike) -> Column:
    """`auto`, `real` or `profile`; `auto` for null and for what is none."""
    table = F.create_map(*[F.lit(x) for pair in HOME_MODES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.trim(_col(value)))), F.lit("auto"))


def home_mode_of_config(text: ColumnLike) -> Column:
    """The home mode that a configuration file names: the first line `home_mode:`
    inside its top-level block `terminal:`, without comment and quotes."""
    lines = F.filter(F.split(_col(text), r"\r?\n", -1), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    top = lambda x: ~x.rlike(r"^[ \t]")
    step = lambda a, x: F.when(a["done"], a).otherwise(F.struct(
        F.when(top(x), x.rlike(r"^terminal\s*(:|$)")).otherwise(a["within"]).alias("within"),
        (~top(x) & a["within"] & x.rlike(r"^\s*home_mode\s*(:|$)")).alias("done"), x.alias("line"),
    ))
    found = F.aggregate(lines, F.struct(F.lit(False).alias("within"), F.lit(False).alias("done"), F.lit("").alias("line")), step, lambda a: F.when(a["done"], a["line"]))
    value = F.trim(F.regexp_replace(F.regexp_replace(found, r"^\s*home_mode\s*:?", ""), "#.*$", ""))
    return home_mode(F.regexp_replace(value, r"^['\"]+|['\"]+$", ""))


def runtime_stamp(kind: ColumnLike, mode: Column | None = None) -> Column:
    """JSON of a record's runtime: its kind and engine, and the home mode if given."""
    fields = [_col(kind).alias("kind"), F.lit("standard").alias("engine")]
    return F.to_json(F.struct(*fields, *([] if mode is None else [mode.alias("home_mode")])))


def gateway_stamp(channels: Column, gateway_id: Column) -> Column:
    """The stamp of a gateway's record: its channels by name (none if null) and
    its id if it has one."""
    none = F.array().cast("array<string>")
    return F.to_json(F.struct(F.lit("gateway").alias("kind"), F.lit("standard").alias("engine"), F.coalesce(channels, none).alias("channels"), gateway_id.alias("gateway_id")))


def payload_fields(payload: ColumnLike) -> Column:
    """The top-level fields of a JSON object as map<string,variant>, empty for
    other text.  It parses the text: put it into a column of its own before a
    summary names it many times."""
    found = F.try_variant_get(F.try_parse_json(_col(payload)), "$", "map<string,variant>")
    return F.coalesce(found, F.create_map().cast("map<string,variant>"))


def _shown(value: Column, name: Column) -> Column:
    """`name=value` of a field, null where it is absent or null."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    spelled = F.when(kind == "BOOLEAN", F.initcap(text)).when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), short_number(number)).otherwise(short_text(text))
    return F.when(text.isNotNull(), F.concat(name, F.lit("="), spelled))


def payload_summary(event_type: ColumnLike, fields: ColumnLike, content_hash: ColumnLike, partial: ColumnLike) -> Column:
    """The fields (of payload_fields) shown of a payload: those of its type, else
    the first four keys in alphabetical order; then the content hash and `partial`."""
    kind, held = _col(event_type), _col(fields)
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(f) for f in x]) for pair in SUMMARY_FIELDS.items() for x in pair])
    other = F.slice(F.array_sort(F.filter(F.map_keys(held), lambda k: k != "event_type")), 1, 4)
    names = F.coalesce(F.element_at(table, kind), other)
    known = F.element_at(table, kind).isNotNull()
    entry = lambda n: F.coalesce(F.transform(F.array(F.element_at(held, n)), lambda v: _shown(v, n))[0], F.when(~known, F.concat(n, F.lit("=None"))))
    parts = F.transform(names, entry)
    tail = F.array(F.when(_col(content_hash) != "", F.concat(F.lit("hash="), F.substring(_col(content_hash), 1, 14), F.lit("…"))), F.when(_col(partial), F.lit("partial")))
    return F.array_join(F.filter(F.concat(parts, tail), lambda x: x.isNotNull()), " ")


# The sentence for each kind of finding.
def finding_detail(event_type: ColumnLike, payload: ColumnLike) -> Column:
    """One line that says what a finding found."""
    kind, text = _col(event_type), _col(payload)
    field = lambda name: F.coalesce(F.get_json_object(text, f"$.{name}"), F.lit("None"))
    number = lambda name: F.get_json_object(text, f"$.{name}").try_cast("double")
    age = F.coalesce(F.when(number("age_seconds") != 0, number("age_seconds")), number("staleness_seconds"))
    past = lambda x, word: F.when(F.coalesce(x, F.lit(0.0)) != 0, F.concat(F.lit(", ~"), x.cast("long").cast("string"), F.lit(f"s {word}"))).otherwise("")
    sequence = F.concat(F.lit("sequence gap: missing #"), field("missing_sequence"), F.lit(" (between "), field("prev_sequence"), F.lit(" and "), field("next_sequence"), F.lit(")"))
    uncaptured = F.concat(F.lit("uncaptured "), field("subject_type"), F.lit(": "), field("subject_id"), F.lit(" ("), field("source_table"), F.lit(")"))
    return (
        F.when(kind == "reconcile.gap_detected", F.when(field("gap_kind") == "sequence", sequence).otherwise(uncaptured))
        .when(kind == "reconcile.terminal_missing", F.concat(field("subject_type"), F.lit(" "), field("subject_id"), F.lit(" has no "), field("expected_terminal_event_type"), past(age, "past window")))
        .when(kind == "cron.run_missed", F.concat(F.lit("job "), field("job_id"), F.lit(" missed "), field("missed_count"), F.lit(" fire(s) from "), iso_utc(number("expected_fire_at"))))
        .when(kind == "runtime.gateway_start_failed", F.concat(F.coalesce(F.nullif(F.get_json_object(text, "$.platform"), F.lit("")), F.lit("gateway")), F.lit(" failed to start: "), field("reason_class")))
        .when(kind == "reconcile.capture_stale", F.concat(F.lit("capture loop stalled: last success "), iso_utc(number("last_success_at")), past(number("staleness_seconds"), "stale")))
        .otherwise(text)
    )
