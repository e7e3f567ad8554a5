"""Activity: attribution, usage, trees, projections and scans."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import attribution, mappers, tree, usage, views
from ..operators import ledger as book
from ..sources import scans
from .audit import _PAIRS, _paired
from .driver import LEDGER_SQL, epoch, ledger, table

HOURS = 24.0


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.build_windows(_paired(spark, sf_dir))


def invocation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three windows of each session, capped at the next start."""
    capped = attribution.newest_windows(attribution.cap_windows(_windows(spark, sf_dir)), 3)
    return capped.select("session_id", "invocation_id", F.round("started_at", 3).alias("started_at"), F.round("ended_at", 3).alias("ended_at"))


def invocation_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = ledger(spark, sf_dir).filter("event_type in ('tool.call_completed', 'model.call_failed')").select("producer_sequence", "session_id", F.col("occurred_at").alias("at"))
    windows = attribution.cap_windows(_windows(spark, sf_dir))
    return attribution.attribute(activity, windows, "producer_sequence").select("producer_sequence", "invocation_id")


def user_forward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks stand for user rows; events are minutes apart, so the skew is a day."""
    activity = ledger(spark, sf_dir).filter("event_type in ('tool.call_completed', 'model.call_failed')").select("producer_sequence", "session_id", F.col("occurred_at").alias("at"), "event_type")
    windows = attribution.cap_windows(_windows(spark, sf_dir))
    return attribution.attribute(activity, windows, "producer_sequence", F.col("event_type") == "tool.call_completed", skew=HOURS * 3600).select("producer_sequence", "invocation_id")


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).filter("event_type = 'model.usage_recorded'")


def usage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`value` as a cumulative counter of each user."""
    d = usage.deltas(_usage(spark, sf_dir), ["session_id"], "producer_sequence", ["value"])
    return d.select("session_id", "producer_sequence", F.round("delta_value", 4).alias("delta"), (F.size("reset_fields") > 0).alias("reset"))


def usage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event is of the old kind, with absolute counters."""
    old = F.col("event_id") % 3 == 0
    e = _usage(spark, sf_dir).select("session_id", "producer_sequence", F.when(~old, "monotonic_delta").alias("usage_semantics"), F.when(~old, F.col("value") * 2).alias("cumulative_value"), F.when(old, F.col("value")).alias("value"))
    return usage.last_states(e, ["session_id"], "producer_sequence", ["value"]).select("session_id", F.round("value", 4).alias("value"))


def own_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases stand for terminals: every fourth is partial, every fifth says
    deltas; views are usage."""
    e, k = ledger(spark, sf_dir), F.col("event_id")
    ends = e.filter("event_type = 'invocation.completed'").select("session_id", "producer_sequence", (k % 4 == 0).alias("partial"), F.when(k % 5 == 0, "deltas").when(k % 5 == 1, "cumulative_total").alias("usage_semantics"), (k * 3).alias("input_tokens"), k.alias("output_tokens"), F.col("value").alias("estimated_cost_usd"))
    parts = _usage(spark, sf_dir).select("session_id", F.lit(7).alias("input_tokens"), (k % 10).alias("output_tokens"), F.col("value").alias("estimated_cost_usd"))
    return usage.own_usage(ends, parts).select("session_id", "input_tokens", "output_tokens", F.round("cost", 4).alias("cost"))


def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of partial and final purchases of a session the one to go by."""
    e = ledger(spark, sf_dir).filter("event_type = 'invocation.completed'").select("session_id", "producer_sequence", (F.col("event_id") % 4 > 0).alias("partial"))
    return book.authoritative(e, ["session_id"])


def _heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree; keys 0 and 1 are roots."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k > 1, F.expr("c_custkey div 2")).alias("parent"))


def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"), F.sum((F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return tree.subtree_totals(_heap(spark, sf_dir), own, ["orders", "cents"]).select("id", "orders", "cents", "nodes")


def tree_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a circle of three hung off no root and a dangling parent."""
    odd = spark.createDataFrame([(-1, -2), (-2, -3), (-3, -1), (-9, -77), (-10, -9)], "id long, parent long")
    return tree.forest(_heap(spark, sf_dir).unionByName(odd)).select("root", "id", "depth")


def root_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree, two circles, a node on one of them and a missing parent."""
    odd = spark.createDataFrame([(-1, -2), (-2, -1), (-4, -4), (-5, -1), (-9, -77), (-10, -9)], "id long, parent long")
    return tree.roots(_heap(spark, sf_dir).unionByName(odd))


def late_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger(spark, sf_dir).withColumn("parent_session_id", F.when(F.col("event_id") % 4 == 1, (F.col("event_id") % 50).cast("string")))
    return tree.first_parents(e)


def tree_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' tree as text."""
    heap = _heap(spark, sf_dir)
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    totals = tree.subtree_totals(heap, own, ["n"]).select("id", F.col("n").alias("subtree_input"))
    nodes = tree.forest(heap).join(totals, "id").join(own, "id", "left").withColumn("input_tokens", F.coalesce("n", F.lit(0)))
    zero = {c: F.lit(0) for c in ("output_tokens", "cost", "subtree_output", "subtree_cost")}
    shown = nodes.withColumns({"kind": F.lit("session"), "status": F.when(F.col("id") % 2 == 0, "ended").otherwise("open"), **zero}).withColumn("cost", F.lit(0.0)).withColumn("subtree_cost", F.lit(0.0))
    return views.tree_lines(shown).select("root", "id", "line")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), (F.lit(1704067200.0) + F.col("conv_id") * 100 + F.col("turn")).alias("timestamp"), F.when(F.col("turn") % 4 == 1, "tool_calls").otherwise("stop").alias("finish_reason"))


def message_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mappers.message_records(_messages(spark, sf_dir), 200)
    return r.select("dedup_key", "event_type", "session_id", "partial", F.get_json_object("payload", "$.message_phase").alias("phase"), F.get_json_object("payload", "$.content_captured_bytes").cast("long").alias("captured"), F.sha2("content", 256).alias("content_hash"))


def content_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = S.limited("text", 4096)
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("c")).filter("c.truncated").select("doc_id", "c.original_bytes", "c.captured_bytes", F.sha2("c.content", 256).alias("sha"))


def session_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions: status F is final, P ended but not final, O open."""
    at = epoch("o_orderdate")
    s = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "subagent").when(F.col("o_orderkey") % 3 == 1, "cli").alias("source"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).alias("parent_session_id"),
        F.lit("m").alias("model"), F.lit(0).alias("message_count"), F.lit(0).alias("tool_call_count"), at.alias("started_at"), F.when(F.col("o_orderstatus") != "O", at + 60).alias("ended_at"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("end_reason"), F.lit("").alias("profile_name"), F.when(F.col("o_orderstatus") == "P", F.lit(0)).alias("expiry_finalized"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("input_tokens"),
    )
    r = mappers.session_records(s)
    return r.select("dedup_key", "event_type", "profile", F.col("occurred_at").cast("long").alias("occurred_at"), F.get_json_object("payload", "$.kind").alias("kind"), F.get_json_object("payload", "$.input_tokens").cast("long").alias("input_tokens"), F.get_json_object("payload", "$.end_reason").alias("end_reason"))


def execution_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    iso = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss+02:00")
    x = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("job_id"), F.lit("ticker").alias("source"), F.lit(1).alias("pid"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        iso.alias("claimed_at"), iso.alias("started_at"), F.when(F.col("o_orderstatus") != "O", iso).alias("finished_at"), F.when(F.col("o_orderkey") % 5 == 0, "boom").alias("error"),
    )
    r = mappers.execution_records(x)
    return r.select("dedup_key", "event_type", F.col("occurred_at").cast("long").alias("occurred_at"), F.get_json_object("payload", "$.ok").alias("ok"), "content")


def delegation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("delegation_id"), F.lit("o").alias("origin_session"), F.when(k % 2 == 0, F.lit("p")).alias("parent_session_id"), F.lit("done").alias("state"), F.lit("sent").alias("delivery_state"), F.lit(5).alias("owner_pid"), k.cast("double").alias("dispatched_at"),
        F.to_json(F.struct((k % 3 == 0).alias("is_batch"), F.when(k % 4 > 0, F.concat(F.lit("goal "), k.cast("string"))).alias("goal"))).alias("event_json"),
        F.when(k % 5 > 0, F.to_json(F.struct(F.array(F.struct(F.col("s_name").alias("summary"))).alias("results")))).alias("result_json"),
    )
    r = mappers.delegation_records(d)
    return r.select("dedup_key", "session_id", F.get_json_object("payload", "$.is_batch").alias("is_batch"), F.get_json_object("content", "$.goal").alias("goal"), F.get_json_object("content", "$.summaries[0]").alias("summary"))


def hook_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spool lines; errors are broken lines, views an unknown type."""
    kind = F.when(F.col("event_type") == "signup", "agent:start").when(F.col("event_type") == "purchase", "agent:end").when(F.col("event_type") == "click", "gateway:startup").otherwise("other")
    line = F.to_json(F.struct(kind.alias("event_type"), epoch("ts").cast("decimal(20,6)").alias("captured_at"), F.struct(F.col("user_id").cast("string").alias("session_id"), F.lit("chat").alias("platform")).alias("context")))
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "{broken").otherwise(line).alias("value"), F.col("event_id").alias("offset"))
    r = mappers.hook_records(lines, "i1", "g1")
    return r.select("dedup_key", "event_type", "session_id", "invocation_id", "correlation_id", F.get_json_object("payload", "$.gateway_id").alias("gateway_id"))


def log_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as log lines, among other lines."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss,SSS")
    code = F.element_at(F.array(*[F.lit(x) for x in ("HTTP 400 bad", "got http 429", "HTTP 503", "HTTP 404.", "HTTP 401", "no status")]), (F.col("event_id") % 6 + 1).cast("int"))
    line = F.concat(stamp, F.lit(" ERROR ["), F.col("user_id").cast("string"), F.lit("] agent.conversation_loop: API call failed after 3 retries. "), code, F.lit(" | provider=p1 model=m"), (F.col("event_id") % 4).cast("string"))
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", line).otherwise(F.concat(stamp, F.lit(" INFO ok"))).alias("value"))
    r = mappers.failure_records(scans.failure_lines(lines))
    return r.select(F.sha2("dedup_key", 256).alias("key_hash"), "session_id", F.round("occurred_at", 3).alias("occurred_at"), F.get_json_object("payload", "$.error_class").alias("error_class"), F.get_json_object("payload", "$.http_status").cast("int").alias("http_status"), F.get_json_object("payload", "$.model").alias("model"))


def tool_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of every kind over the events."""
    bodies = ['{"exit_code": 0}', '{"exit_code": 2}', '{"error": "x"}', '{"error": ""}', '{"error": null, "status": "done"}', '{"status": ""}', "[1]", "not json", "", '{"exit_code": null}', '{"error": []}', '{"error": {"a": 1}}', "3"]
    e = table(spark, sf_dir, "events").select(F.element_at(F.array(*[F.lit(b) for b in bodies]), (F.col("event_id") % len(bodies) + 1).cast("int")).alias("body"))
    return e.groupBy("body", S.tool_status("body").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def board_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mappers.board_records(*_board(spark, sf_dir))
    return r.select("dedup_key", "event_type", "session_id", F.get_json_object("payload", "$.status").alias("status"), F.get_json_object("payload", "$.holder").alias("holder"), F.get_json_object("payload", "$.attempt_disposition").alias("disposition"))


_KINDS = ("created", "claimed", "completed", "dependency_wait", "gave_up", "commented")
_OUTCOMES = ("completed", "crashed", "reclaimed", "odd")


def _board(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers are tasks, orders runs, line items events of their order's run."""
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    tasks = table(spark, sf_dir, "customer").filter("c_custkey % 5 > 0").select(F.lit("main").alias("board"), F.col("c_custkey").cast("string").alias("id"), F.lit("s").alias("session_id"), F.col("c_mktsegment").alias("status"), F.lit(1).alias("priority"), *[F.lit(None).cast("string").alias(c) for c in mappers.TASK_DETAILS[1:]])
    o, at = table(spark, sf_dir, "orders"), epoch("o_orderdate")
    runs = o.select(
        F.lit("main").alias("board"), F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("task_id"), F.concat(F.lit("h"), F.col("o_orderkey") % 7).alias("claim_lock"), at.alias("claim_expires"), F.lit(1).alias("worker_pid"), F.lit(None).cast("double").alias("last_heartbeat_at"),
        at.alias("started_at"), F.when(F.col("o_orderstatus") != "O", at + 5).alias("ended_at"), F.when(F.col("o_orderstatus") != "O", pick(_OUTCOMES, F.col("o_orderkey"))).alias("outcome"), F.lit(None).cast("string").alias("profile"), F.lit(None).cast("string").alias("step_key"),
    )
    items = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    events = items.select(F.lit("main").alias("board"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").cast("string").alias("task_id"), F.col("l_orderkey").alias("run_id"), pick(_KINDS, F.col("l_orderkey") + F.col("l_linenumber")).alias("kind"), at.alias("created_at"))
    return events, runs, tasks


def _board_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mappers.board_records(*_board(spark, sf_dir))
    fields = "board string, task_id string, run_id bigint, status string, holder string, claim_expires string, run_outcome string, attempt_disposition string"
    parsed = r.select(F.lit("i").alias("installation_id"), F.crc32(F.col("dedup_key").cast("binary")).alias("producer_sequence"), "occurred_at", "event_type", F.from_json("payload", fields).alias("p"))
    return parsed.select("installation_id", "producer_sequence", "occurred_at", "event_type", "p.*")


def task_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.task_attempts(_board_events(spark, sf_dir)).select("task_id", "run_id", F.col("first_seen").cast("long").alias("first_seen"), "holder", "outcome", "disposition")


def task_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.task_board(_board_events(spark, sf_dir)).select("board", "task_id", "terminals", F.col("holder").isNotNull().alias("has_holder"))


def session_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions: recent keys, those open, and all ancestors."""
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), F.when(k > 1, F.expr("c_custkey div 2").cast("string")).alias("parent_session_id"), k.alias("n"), F.when(k % 100 > 0, 1.0).alias("ended_at"), F.lit(1).alias("expiry_finalized"))
    named = s.filter("n = 77").select(F.col("id").alias("session_id"))
    return scans.sessions_to_read(s, F.col("n") % 397 == 5, named).select("id")


def bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages after a mark with 32 rows of overlap, users and tools only."""
    m = _messages(spark, sf_dir)
    return scans.messages(m, 20_000, 32, 60_000, ["user", "assistant"]).select("id", "role")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_counts(ledger(spark, sf_dir))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_type") == "tool.call_completed", F.to_json(F.struct(F.lit("tool").alias("tool_name"), (F.col("event_id") % 7).alias("status"), F.lit("x").alias("ignored")))).otherwise(F.to_json(F.struct(F.concat(F.lit("n"), F.col("event_id")).alias("a"), (F.col("event_id") % 2 == 0).alias("b"), F.lit("long " * 10).alias("c"), F.lit(4).alias("d"), F.lit(5).alias("e"))))
    return ledger(spark, sf_dir).withColumn("payload", F.when(F.col("event_type") == "model.usage_recorded", "{}").otherwise(body)).withColumn("content_hash", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("sha256:"), F.sha2(F.col("event_id").cast("string"), 256)))).withColumn("partial", F.col("event_id") % 5 == 0)


def stream_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.stream_lines(_stream(spark, sf_dir)).select("producer_sequence", "line")


def session_since_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event without a time counts as from time 0."""
    e = ledger(spark, sf_dir).withColumn("occurred_at", F.when(F.col("event_id") % 11 > 0, F.col("occurred_at"))).withColumn("parent_session_id", (F.col("event_id") % 40).cast("string"))
    late = views.select_events(e, session="7", since=1705276800.0).select("producer_sequence", F.lit("late").alias("what"))
    return late.union(views.select_events(e, session="7", since=0.0).select("producer_sequence", F.lit("all")))


QUERIES = {f.__name__: f for f in (
    invocation_windows, invocation_attribution, user_forward_asof, usage_delta, usage_state, own_usage, supersession, tree_rollup, tree_forest, root_session, late_parents, tree_view, message_projection,
    content_truncate, session_projection, execution_projection, delegation_projection, hook_projection, log_failures, tool_status, board_projection, task_attempts, task_board, session_scan, bounded_scan,
    event_counts, stream_view, session_since_filter,
)}

_WINDOWS = f"""{_PAIRS},
    win AS (SELECT session_id, invocation_id, min(occurred_at) FILTER (event_type = 'invocation.started') AS started_at, min(occurred_at) FILTER (event_type = 'invocation.completed') AS ended_at FROM named GROUP BY ALL),
    nxt AS (SELECT *, lead(started_at) OVER (PARTITION BY session_id ORDER BY started_at) AS following FROM win WHERE started_at IS NOT NULL),
    cap AS (SELECT session_id, invocation_id, started_at, CASE WHEN following IS NOT NULL AND (ended_at IS NULL OR ended_at >= following) THEN following ELSE ended_at END AS ended_at FROM nxt)"""
_ACT = "act AS (SELECT producer_sequence, session_id, occurred_at AS t, event_type FROM ledger WHERE event_type IN ('tool.call_completed', 'model.call_failed'))"
_HELD = "held AS (SELECT act.*, CASE WHEN cap.ended_at IS NULL OR t <= cap.ended_at THEN cap.invocation_id END AS back FROM act ASOF LEFT JOIN cap ON act.session_id = cap.session_id AND act.t >= cap.started_at)"
_HEAP = "heap AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer)"
_MSG = "msg AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_id, role, text AS content, turn FROM conversations WHERE role IN ('user', 'assistant') AND text <> '')"


def _prefix(text: str, n: int) -> str:
    """The longest prefix of at most n bytes: characters whose running bytes fit."""
    return f"(SELECT coalesce(max(i), 0) FROM (SELECT unnest(range(greatest(1, {n} // 4), {n} + 1)) AS i) WHERE i <= len({text}) AND octet_length(encode(left({text}, i))) <= {n})"


_BOARD = """
    t AS (SELECT CAST(c_custkey AS VARCHAR) AS task_id, c_mktsegment AS status FROM customer WHERE c_custkey % 5 > 0),
    r AS (SELECT o_orderkey AS run_id, CAST(o_custkey AS VARCHAR) AS task_id, 'h' || (o_orderkey % 7) AS holder, epoch_us(o_orderdate) / 1e6 AS began,
        CASE WHEN o_orderstatus <> 'O' THEN ['completed', 'crashed', 'reclaimed', 'odd'][o_orderkey % 4 + 1] END AS outcome FROM orders),
    ev AS (SELECT l_orderkey * 10 + l_linenumber AS id, r.task_id, r.run_id, began, holder,
        ['created', 'claimed', 'completed', 'dependency_wait', 'gave_up', 'commented'][(l_orderkey + l_linenumber) % 6 + 1] AS kind FROM lineitem JOIN r ON l_orderkey = run_id),
    moved AS (SELECT *, CASE kind WHEN 'created' THEN 'task.created' WHEN 'claimed' THEN 'task.claimed' WHEN 'completed' THEN 'task.completed' WHEN 'dependency_wait' THEN 'task.blocked' ELSE 'task.failed_terminal' END AS event_type FROM ev WHERE kind <> 'commented'),
    disp AS (SELECT *, CASE outcome WHEN 'completed' THEN 'success' WHEN 'crashed' THEN 'failure' WHEN 'reclaimed' THEN 'released' ELSE 'unknown' END AS disposition FROM r WHERE outcome IS NOT NULL)"""

ORACLES = {
    "invocation_windows": f"WITH {_WINDOWS} SELECT session_id, invocation_id, round(started_at, 3) AS started_at, round(ended_at, 3) AS ended_at FROM cap QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY started_at DESC) <= 3",
    "invocation_attribution": f"WITH {_WINDOWS}, {_ACT}, {_HELD} SELECT producer_sequence, back AS invocation_id FROM held",
    "user_forward_asof": f"""WITH {_WINDOWS}, {_ACT}, {_HELD},
        fwd AS (SELECT held.*, cap.started_at, cap.invocation_id AS ahead FROM held ASOF LEFT JOIN cap ON held.session_id = cap.session_id AND held.t <= cap.started_at)
        SELECT producer_sequence, CASE WHEN event_type = 'tool.call_completed' AND started_at - t <= {HOURS * 3600} THEN ahead ELSE back END AS invocation_id FROM fwd""",
    "usage_delta": f"""WITH {LEDGER_SQL}, u AS (SELECT *, lag(value) OVER (PARTITION BY session_id ORDER BY producer_sequence) AS p FROM ledger WHERE event_type = 'model.usage_recorded')
        SELECT session_id, producer_sequence, round(CASE WHEN value < coalesce(p, 0) THEN value ELSE value - coalesce(p, 0) END, 4) AS delta, value < coalesce(p, 0) AS reset FROM u""",
    "usage_state": f"WITH {LEDGER_SQL} SELECT session_id, round(arg_max(CASE WHEN event_id % 3 = 0 THEN value ELSE value * 2 END, producer_sequence), 4) AS value FROM ledger WHERE event_type = 'model.usage_recorded' GROUP BY session_id",
    "own_usage": f"""WITH {LEDGER_SQL},
        e AS (SELECT session_id, arg_max(event_id, producer_sequence) AS k, arg_max(value, producer_sequence) AS v FROM ledger WHERE event_type = 'invocation.completed' GROUP BY 1),
        u AS (SELECT session_id, count(*) * 7 AS i, sum(event_id % 10) AS o, sum(value) AS c FROM ledger WHERE event_type = 'model.usage_recorded' GROUP BY 1),
        j AS (SELECT coalesce(e.session_id, u.session_id) AS session_id, k IS NOT NULL AND k % 4 <> 0 AND k % 5 <> 0 AS whole, k, v, i, o, c FROM e FULL JOIN u ON e.session_id = u.session_id)
        SELECT session_id, CAST(CASE WHEN whole THEN k * 3 ELSE coalesce(i, 0) END AS BIGINT) AS input_tokens, CAST(CASE WHEN whole THEN k ELSE coalesce(o, 0) END AS BIGINT) AS output_tokens, round(CASE WHEN whole THEN v ELSE coalesce(c, 0) END, 4) AS cost FROM j""",
    "supersession": f"WITH {LEDGER_SQL} SELECT session_id, producer_sequence, event_id % 4 > 0 AS partial FROM ledger WHERE event_type = 'invocation.completed' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id % 4 > 0, producer_sequence DESC) = 1",
    "tree_rollup": f"""WITH RECURSIVE {_HEAP}, c AS (SELECT id AS a, id FROM heap UNION SELECT c.a, heap.id FROM c JOIN heap ON heap.parent = c.id),
        own AS (SELECT o_custkey AS id, count(*) AS n, sum(CAST(trunc(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1)
        SELECT a AS id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS orders, CAST(sum(coalesce(cents, 0)) AS BIGINT) AS cents, count(*) AS nodes FROM c LEFT JOIN own USING (id) GROUP BY a""",
    "tree_forest": f"""WITH RECURSIVE {_HEAP}, n AS (SELECT * FROM heap UNION ALL VALUES (-1, -2), (-2, -3), (-3, -1), (-9, -77), (-10, -9)),
        f AS (SELECT id AS root, id, 0 AS depth FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) UNION ALL SELECT f.root, n.id, depth + 1 FROM f JOIN n ON n.parent = f.id) SELECT root, id, depth FROM f""",
    "root_session": f"""WITH RECURSIVE {_HEAP}, n AS (SELECT * FROM heap UNION ALL VALUES (-1, -2), (-2, -1), (-4, -4), (-5, -1), (-9, -77), (-10, -9)),
        w AS (SELECT id, id AS cur, [id] AS path FROM n UNION ALL SELECT w.id, n.parent, list_append(path, n.parent) FROM w JOIN n ON n.id = w.cur WHERE n.parent IS NOT NULL AND NOT list_contains(path, n.parent))
        SELECT id, arg_max(cur, len(path)) AS root FROM w GROUP BY id""",
    "late_parents": f"WITH {LEDGER_SQL} SELECT session_id AS id, arg_min(CAST(event_id % 50 AS VARCHAR), producer_sequence) FILTER (event_id % 4 = 1) AS parent FROM ledger GROUP BY 1",
    "tree_view": f"""WITH RECURSIVE {_HEAP}, n AS (SELECT * FROM heap),
        f AS (SELECT id AS root, id, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT f.root, n.id, depth + 1 FROM f JOIN n ON n.parent = f.id),
        c AS (SELECT id AS a, id FROM n UNION SELECT c.a, n.id FROM c JOIN n ON n.parent = c.id), own AS (SELECT o_custkey AS id, count(*) AS k FROM orders GROUP BY 1),
        s AS (SELECT a AS id, CAST(sum(coalesce(k, 0)) AS BIGINT) AS below FROM c LEFT JOIN own USING (id) GROUP BY a)
        SELECT root, id, repeat('  ', depth) || CASE WHEN depth = 0 THEN '●' ELSE '○' END || ' session ' || id || '  [' || CASE WHEN id % 2 = 0 THEN 'ended' ELSE 'open' END || ']  tokens=' || coalesce(k, 0) || '/0  cost=$0.0000'
            || CASE WHEN depth = 0 THEN '  (subtree tokens=' || below || '/0 cost=$0.0000)' ELSE '' END AS line FROM f JOIN s USING (id) LEFT JOIN own USING (id)""",
    "message_projection": f"""WITH {_MSG}, c AS (SELECT *, octet_length(encode(content)) AS size, CASE WHEN octet_length(encode(content)) <= 200 THEN content ELSE left(content, {_prefix('content', 200)}) END AS cut FROM msg)
        SELECT 'state.db:' || role || ':' || id AS dedup_key, CASE WHEN role = 'user' THEN 'invocation.started' WHEN turn % 4 = 1 THEN 'model.call_succeeded' ELSE 'invocation.completed' END AS event_type, session_id, size > 200 AS partial,
            CASE WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'intermediate' ELSE 'final' END END AS phase, octet_length(encode(cut)) AS captured, sha256(cut) AS content_hash FROM c""",
    "content_truncate": f"""WITH c AS (SELECT doc_id, text, octet_length(encode(text)) AS original_bytes FROM documents WHERE octet_length(encode(text)) > 4096), d AS (SELECT doc_id, original_bytes, left(text, {_prefix('text', 4096)}) AS cut FROM c)
        SELECT doc_id, original_bytes, octet_length(encode(cut)) AS captured_bytes, sha256(cut) AS sha FROM d""",
    "session_projection": """WITH s AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'subagent' WHEN 1 THEN 'cli' ELSE 'unknown' END AS kind, CAST(epoch_us(o_orderdate) / 1e6 AS BIGINT) AS t FROM orders),
        b AS (SELECT *, CASE WHEN kind = 'subagent' THEN 'subagent.child_spawned' ELSE 'session.created' END AS a, CASE WHEN kind = 'subagent' THEN 'subagent.completed' ELSE 'session.ended' END AS z FROM s)
        SELECT 'state.db:' || a || ':' || o_orderkey AS dedup_key, a AS event_type, 'default' AS profile, t AS occurred_at, kind, CAST(NULL AS BIGINT) AS input_tokens, NULL AS end_reason FROM b
        UNION ALL SELECT 'state.db:' || z || ':' || o_orderkey, z, 'default', t + 60, kind, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END FROM b WHERE o_orderstatus = 'F'""",
    "execution_projection": """WITH o AS (SELECT *, CAST(epoch_us(o_orderdate) / 1e6 AS BIGINT) - 7200 AS t FROM orders)
        SELECT 'cron:claimed:' || o_orderkey AS dedup_key, 'cron.run_claimed' AS event_type, t AS occurred_at, NULL AS ok, NULL AS content FROM o
        UNION ALL SELECT 'cron:finished:' || o_orderkey, 'cron.run_finished', t, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN 'true' ELSE 'false' END, CASE WHEN o_orderkey % 5 = 0 THEN 'boom' END FROM o WHERE o_orderstatus <> 'O'""",
    "delegation_projection": """SELECT 'state.db:deleg:' || s_suppkey AS dedup_key, CASE WHEN s_suppkey % 2 = 0 THEN 'p' ELSE 'o' END AS session_id, CASE WHEN s_suppkey % 3 = 0 THEN 'true' ELSE 'false' END AS is_batch,
        CASE WHEN s_suppkey % 4 > 0 THEN 'goal ' || s_suppkey END AS goal, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS summary FROM supplier""",
    "hook_projection": """WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS t, CAST(user_id AS VARCHAR) AS s FROM events WHERE event_type IN ('signup', 'purchase', 'click')),
        a AS (SELECT *, lag(event_type) OVER (PARTITION BY s ORDER BY event_id) AS b, lag(event_id) OVER (PARTITION BY s ORDER BY event_id) AS bi FROM e WHERE event_type <> 'click')
        SELECT 'hook-spool:g1:' || event_id AS dedup_key, CASE event_type WHEN 'signup' THEN 'invocation.started' ELSE 'invocation.completed' END AS event_type, s AS session_id,
            s || ':hook:' || CASE WHEN event_type = 'purchase' AND b = 'signup' THEN bi ELSE event_id END AS invocation_id, s AS correlation_id, NULL AS gateway_id FROM a
        UNION ALL SELECT 'hook-spool:g1:' || event_id, 'runtime.gateway_started', s, NULL, 'gateway:' || event_id, 'gw-' || left(sha256('i1:' || t || ':' || event_id), 16) FROM e WHERE event_type = 'click'""",
    "log_failures": """WITH e AS (SELECT *, ['HTTP 400 bad', 'got http 429', 'HTTP 503', 'HTTP 404.', 'HTTP 401', 'no status'][event_id % 6 + 1] AS code FROM events WHERE event_type = 'error'),
        l AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S,') || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') || ' ERROR [' || user_id || '] agent.conversation_loop: API call failed after 3 retries. ' || code || ' | provider=p1 model=m' || (event_id % 4) AS line FROM e)
        SELECT sha256('gateway-log:model.call_failed:' || user_id || ':' || sha256(line)) AS key_hash, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 / 1000 AS occurred_at,
            ['invalid_request', 'rate_limited', 'provider_server', 'not_found', 'authentication', 'unknown'][event_id % 6 + 1] AS error_class, [400, 429, 503, 404, 401, NULL][event_id % 6 + 1] AS http_status, 'm' || (event_id % 4) AS model FROM l""",
    "tool_status": """WITH b(i, body, status) AS (VALUES (0, '{"exit_code": 0}', 'ok'), (1, '{"exit_code": 2}', 'error'), (2, '{"error": "x"}', 'error'), (3, '{"error": ""}', 'ok'), (4, '{"error": null, "status": "done"}', 'done'), (5, '{"status": ""}', 'ok'),
        (6, '[1]', 'unknown'), (7, 'not json', 'unknown'), (8, '', 'unknown'), (9, '{"exit_code": null}', 'error'), (10, '{"error": []}', 'ok'), (11, '{"error": {"a": 1}}', 'error'), (12, '3', 'unknown'))
        SELECT body, status, count(*) AS n FROM events JOIN b ON event_id % 13 = i GROUP BY ALL""",
    "board_projection": f"""WITH {_BOARD}
        SELECT 'kanban:main:event:' || id AS dedup_key, event_type, CASE WHEN t.task_id IS NOT NULL THEN 's' END AS session_id, status, holder, NULL AS disposition FROM moved LEFT JOIN t USING (task_id)
        UNION ALL SELECT 'kanban:main:run:' || run_id, 'task.attempt_ended', CASE WHEN t.task_id IS NOT NULL THEN 's' END, NULL, holder, disposition FROM disp LEFT JOIN t USING (task_id)""",
    "task_attempts": f"""WITH {_BOARD},
        seen AS (SELECT task_id, run_id, min(x) AS f FROM (SELECT task_id, run_id, began AS x FROM moved UNION ALL SELECT task_id, run_id, began + 5 FROM disp) GROUP BY ALL),
        k AS (SELECT DISTINCT task_id, run_id FROM moved WHERE event_type = 'task.claimed' UNION SELECT task_id, run_id FROM disp)
        SELECT k.task_id, k.run_id, CAST(f AS BIGINT) AS first_seen, 'h' || (k.run_id % 7) AS holder, coalesce(d.outcome, 'running') AS outcome, d.disposition FROM k JOIN seen USING (task_id, run_id) LEFT JOIN disp d USING (run_id)""",
    "task_board": f"""WITH {_BOARD}, e AS (SELECT task_id, event_type FROM moved UNION ALL SELECT task_id, 'task.attempt_ended' FROM disp)
        SELECT 'main' AS board, task_id, count(*) FILTER (event_type IN ('task.completed', 'task.blocked', 'task.failed_terminal')) AS terminals, true AS has_holder FROM e GROUP BY task_id""",
    "session_scan": f"""WITH RECURSIVE {_HEAP}, a AS (SELECT id, parent FROM heap WHERE id % 397 = 5 OR id % 100 = 0 OR id = 77 UNION SELECT heap.id, heap.parent FROM a JOIN heap ON heap.id = a.parent) SELECT DISTINCT CAST(id AS VARCHAR) AS id FROM a""",
    "bounded_scan": "SELECT conv_id * 1000 + turn AS id, role FROM conversations WHERE conv_id * 1000 + turn > 19968 AND conv_id * 1000 + turn <= 60000 AND role IN ('user', 'assistant')",
    "event_counts": f"WITH {LEDGER_SQL} SELECT event_type, count(*) AS events FROM ledger GROUP BY 1",
    "stream_view": f"""WITH {LEDGER_SQL}, l AS (SELECT *, CASE event_type WHEN 'tool.call_completed' THEN 'tool_name=tool status=' || (event_id % 7) WHEN 'model.usage_recorded' THEN ''
            ELSE 'a=n' || event_id || ' b=' || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END || ' c=' || left(repeat('long ', 10), 39) || '… d=4' END AS body FROM ledger),
        p AS (SELECT *, array_to_string(list_filter([nullif(body, ''), CASE WHEN event_id % 3 = 0 THEN 'hash=sha256:' || left(sha256(CAST(event_id AS VARCHAR)), 7) || '…' END, CASE WHEN event_id % 5 = 0 THEN 'partial' END], lambda x: x IS NOT NULL), ' ') AS summary FROM l)
        SELECT producer_sequence, rtrim(lpad(CAST(producer_sequence AS VARCHAR), 6, ' ') || '  ' || strftime(make_timestamp(CAST(floor(occurred_at) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '  ' || rpad(event_type, 26, ' ') || '  ' || rpad(session_id, 24, ' ') || '  ' || summary) AS line FROM p""",
    "session_since_filter": f"""WITH {LEDGER_SQL}, m AS (SELECT *, CASE WHEN event_id % 11 > 0 THEN occurred_at ELSE 0 END AS t FROM ledger WHERE session_id = '7' OR event_id % 40 = 7)
        SELECT producer_sequence, 'late' AS what FROM m WHERE t >= 1705276800 UNION ALL SELECT producer_sequence, 'all' FROM m""",
}
