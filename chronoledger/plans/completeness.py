"""Completeness: coverage of every kind of durable row, schedules of every job,
task boards and findings in all their shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import bound
from ..functions.schedule import cron_fields
from ..operators import coverage, detect, tree, views
from ..sources import scans
from .audit import _INTERVAL
from .driver import NOW_EVENTS, NOW_ORDERS, epoch, table

#: Sessions start an hour apart from here; rows from before HORIZON are not judged.
START, HORIZON = 788918400.0, 788918400.0 + 10 * 3600


def _event(df: DataFrame, event_type: str, session=None, **payload) -> DataFrame:
    """Captured events with a payload of JSON text."""
    from ..operators.mappers import payload_of

    return df.select(F.lit(event_type).alias("event_type"), (F.lit(None) if session is None else session).cast("string").alias("session_id"), payload_of(event_type=F.lit(event_type), **payload).alias("payload"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions; the parent of a key is its half."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), F.when(k > 1, F.expr("c_custkey div 2").cast("string")).alias("parent_session_id"), (F.lit(START) + k * 3600).alias("started_at"))


def _absent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir)
    seen = _event(s.filter("cast(id as bigint) % 7 <> 3"), "session.created", F.col("id"))
    roots = tree.roots(s.select("id", F.col("parent_session_id").alias("parent")))
    return detect.uncaptured(coverage.session_subjects(s, roots), detect.captured_subjects(seen), HORIZON)


def coverage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _absent_sessions(spark, sf_dir).select("subject_type", "subject_id", "source_table", "correlation_id", "session_id", "parent_session_id")


def _talks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, sessions, roots): conversations; an odd one's root is the even one before it."""
    c = table(spark, sf_dir, "conversations")
    n, t = F.col("conv_id"), F.col("turn")
    messages = c.select((n * 1000 + t).alias("id"), n.cast("string").alias("session_id"), "role", F.when(t % 6 != 3, F.col("text")).otherwise("").alias("content"), F.when(t % 5 != 2, F.lit(START) + n * 3600 + t).alias("timestamp"))
    ids = c.select("conv_id").distinct()
    sessions = ids.select(n.cast("string").alias("id"), (F.lit(START) + n * 3600).alias("started_at"))
    roots = ids.select(n.cast("string").alias("id"), (n - n % 2).cast("string").alias("root"))
    return messages, sessions, roots


def _absent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, sessions, roots = _talks(spark, sf_dir)
    seen = _event(messages.filter("id % 9 <> 4"), "tool.call_completed", message_row_id=F.col("id"))
    return detect.uncaptured(coverage.message_subjects(messages, sessions, roots, ["user", "assistant"]), detect.captured_subjects(seen), HORIZON)


def coverage_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without a time go by their session's start."""
    return _absent_messages(spark, sf_dir).select("subject_id", "source_table", "correlation_id", "session_id")


def _absent_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as usage of their order's session; every second one is of no task."""
    i = table(spark, sf_dir, "lineitem")
    usage = i.select(F.col("l_orderkey").cast("string").alias("session_id"), F.concat(F.lit("m"), F.col("l_linenumber") % 3).alias("model"), F.when(F.col("l_linenumber") % 2 == 0, "t").alias("task")).distinct()
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), epoch("o_orderdate").alias("started_at"))
    seen = _event(usage.filter("cast(session_id as bigint) % 11 <> 5"), "model.usage_recorded", F.col("session_id"), model=F.col("model"), task=F.col("task"))
    roots = sessions.select("id", F.col("id").alias("root"))
    return detect.uncaptured(coverage.usage_subjects(usage, sessions, roots), detect.captured_subjects(seen, "None"), 883612800.0)


def coverage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _absent_usage(spark, sf_dir).select("subject_id", "source_table", "session_id")


def _absent_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as executions; a claim at time 0 has none, so its end counts."""
    k, at = F.col("o_orderkey"), epoch("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("job_id"), F.when(k % 4 == 0, 0.0).otherwise(at).alias("claimed_at"), (at + 40 * 86400).alias("finished_at"))
    seen = _event(rows.filter("id % 6 > 0"), "cron.run_claimed", execution_id=F.col("id"))
    return detect.uncaptured(coverage.execution_subjects(rows), detect.captured_subjects(seen), 883612800.0)


def coverage_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _absent_executions(spark, sf_dir).select("subject_id", "source_table", "correlation_id")


def _absent_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks of two boards; some are captured under the other board only."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, "a").otherwise("b").alias("board"), k.cast("string").alias("id"), F.lit("s").alias("session_id"), F.when(k % 3 > 0, F.lit(START) + k * 3600).alias("created_at"), (F.lit(START) + k * 3600 + 7200).alias("started_at"), k)
    board = F.when(k % 16 == 10, "b").otherwise(F.col("board"))
    seen = _event(t.filter("c_custkey % 8 <> 4"), "task.created", board=board, task_id=F.col("id"))
    return detect.uncaptured(coverage.task_subjects(t), detect.captured_subjects(seen), HORIZON)


def coverage_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _absent_tasks(spark, sf_dir).select("subject_id", "source_table", "correlation_id", "session_id")


def _absent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), epoch("o_orderdate")
    r = table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "a").otherwise("b").alias("board"), k.alias("id"), F.col("o_custkey").cast("string").alias("task_id"), F.when(k % 5 > 0, at).alias("started_at"), (at + 86400).alias("ended_at"))
    seen = _event(r.filter("id % 10 <> 7"), "task.claimed", board=F.col("board"), task_id=F.col("task_id"), run_id=F.col("id"))
    return detect.uncaptured(coverage.run_subjects(r), detect.captured_subjects(seen), 883612800.0)


def coverage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _absent_runs(spark, sf_dir).select("subject_id", "source_table", "correlation_id")


def coverage_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds as one table of findings."""
    absent = reduce(DataFrame.unionByName, [f(spark, sf_dir) for f in (_absent_sessions, _absent_messages, _absent_usage, _absent_executions, _absent_tasks, _absent_runs)])
    found = detect.coverage_findings(absent, NOW_EVENTS)
    get = lambda name: F.get_json_object("payload", f"$.{name}").alias(name)
    return found.groupBy(get("subject_type"), get("source_table")).agg(F.count(F.lit(1)).alias("findings"), F.min("dedup_key").alias("first_key"), F.count("session_id").alias("with_session"))


# -- schedules ------------------------------------------------------------------

EXPRESSIONS = ("*/15 6-18 * * 1-5", "0 0 15 * 0", "30 */4 * * *", "5-50/15 8,20 * 1 2-4", "61 * * * *")
ZONES = ("+05:30", "-08:00", "Z")


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def cron_jobs_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are jobs, each with an expression and a zone; their events are fires."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), epoch("ts").alias("at"))
    j = F.col("job_id")
    jobs = e.select("job_id").distinct().select(j, _pick(EXPRESSIONS, j).alias("expression"), F.when(j % 7 > 0, F.concat(F.lit("2023-12-01T00:00:00"), _pick(ZONES, j))).alias("created_at"), F.when(j % 7 == 0, "2024-02-01T00:00:00+01:00").alias("next_run_at"))
    return detect.cron_job_misses(jobs, e, NOW_EVENTS, 7 * 86400.0, 600.0).select("job_id", F.col("first").cast("long").alias("first"), "missed", "tail")


CHECKED = {
    "0 0 * * *": "1,1,31,12,7", "*/7 0-23/5 1,2,2 */3 0-6": "9,5,2,4,7", " 5  4 3 2 1 ": "1,1,1,1,1", "5,10-12 * * * 0,6": "4,24,31,12,2", "60 * * * *": None, "* 24 * * *": None, "* * 0 * *": None,
    "* * * 13 *": None, "* * * * 7": None, "* * * *": None, "5-1 * * * *": None, "*/0 * * * *": None, "a * * * *": None, "": None,
}


def cron_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each field of an expression allows; null if it is no valid
    one.  Expressions are counted first: each one is parsed once, not once a row."""
    k = table(spark, sf_dir, "events").groupBy(_pick(list(CHECKED), F.col("event_id")).alias("expression")).agg(F.count(F.lit(1)).alias("n"))
    sizes = lambda cron: F.concat_ws(",", *[F.size(cron[name]).cast("string") for name in ("minute", "hour", "day", "month", "weekday")])
    return k.select("expression", bound(cron_fields(F.col("expression")), lambda cron: F.when(cron.isNotNull(), sizes(cron))).alias("sizes"), "n")


# -- boards and findings ------------------------------------------------------------

_TASK_KINDS = ("task.created", "task.claimed", "task.blocked", "task.attempt_ended", "task.completed", "task.attempt_ended", "task.failed_terminal")


def _task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as task events: a part is a task, an order a run.  Of items of
    one order and number the first row of the table counts."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    kind = _pick(_TASK_KINDS, o + n)
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_partkey", place).alias("l_partkey"))
    return items.select(
        F.lit("i").alias("installation_id"), (o * 10 + n).alias("producer_sequence"), (F.lit(START) + o).alias("occurred_at"), kind.alias("event_type"), F.when(F.col("l_partkey") % 5 > 0, "main").alias("board"), F.col("l_partkey").cast("string").alias("task_id"), o.alias("run_id"),
        F.when(n % 3 > 0, F.concat(F.lit("st"), n)).alias("status"), F.when(kind.isin("task.claimed", "task.attempt_ended"), F.concat(F.lit("h"), o % 4)).alias("holder"), F.when(kind == "task.claimed", (o + 100).cast("string")).alias("claim_expires"),
        F.when(kind == "task.attempt_ended", "completed").alias("run_outcome"), F.when(kind == "task.attempt_ended", "success").alias("attempt_disposition"),
    )


def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the board."""
    return views.task_board(_task_events(spark, sf_dir)).select("board", "task_id", "status", "holder", "held", F.col("claim_expires").cast("long").alias("claim_expires"), "terminals")


def task_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the board: tasks, holders and attempts."""
    e = _task_events(spark, sf_dir)
    return views.task_lines(views.task_board(e), views.task_attempts(e)).groupBy("task_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("board", "ord", "line"))), lambda x: x["line"])).alias("text"))


def task_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of tasks' ends."""
    n = F.col("run_id") % 5
    e = _task_events(spark, sf_dir).withColumn("kind", F.when(n > 0, F.concat(F.lit("k"), n))).withColumn("block_kind", F.when(n > 2, "needs"))
    lines = views.terminal_lines(e)
    return lines.groupBy("board", "task_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])).alias("text"))


def terminal_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of tasks with the transition behind each."""
    k = F.col("s_suppkey")
    event, kind = _pick(("task.blocked", "task.completed", "task.failed_terminal"), k), F.when(k % 4 > 0, _pick(("blocked", "gave_up", ""), k + 1))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), views.terminal_detail(event, kind, F.when(k % 5 > 0, F.concat(F.lit("b"), k % 3))).alias("detail"))


def finding_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding of each shape for every supplier."""
    k = F.col("s_suppkey")
    body = {
        "reconcile.gap_detected": '{"gap_kind": "uncaptured_row", "subject_type": "task", "subject_id": "a:1", "source_table": "t"}',
        "reconcile.terminal_missing": '{"subject_type": "invocation", "subject_id": "i", "expected_terminal_event_type": "invocation.completed", "age_seconds": 61.5}',
        "cron.run_missed": '{"job_id": "j", "missed_count": 3, "expected_fire_at": 1704067200.0}',
        "runtime.gateway_start_failed": '{"platform": "chat", "reason_class": "token_conflict"}',
        "reconcile.capture_stale": '{"last_success_at": 1704067200.0, "staleness_seconds": 90.2}',
        "session.created": '{"kind": "cli"}',
    }
    kind = _pick(list(body), k)
    e = table(spark, sf_dir, "supplier").select(k.alias("id"), kind.alias("event_type"), F.element_at(F.create_map(*[F.lit(x) for pair in body.items() for x in pair]), kind).alias("payload"))
    return views.findings(e).select("id", "event_type", "detail")


def tree_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees below given nodes, one of them on a circle and one with a
    missing parent: each is a root of its own."""
    odd = spark.createDataFrame([(-1, -2), (-2, -3), (-3, -1), (-9, -77), (-10, -9)], "id long, parent long")
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k > 1, F.expr("c_custkey div 2")).alias("parent")).unionByName(odd)
    return tree.below(nodes, [5, -2, -9]).select("root", "id", "depth")


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each node stands among a tree's lines; a circle has no place."""
    odd = spark.createDataFrame([(-1, -2), (-2, -3), (-3, -1), (-9, -77), (-10, -9)], "id long, parent long")
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k > 1, F.expr("c_custkey div 2")).alias("parent")).unionByName(odd)
    return tree.paths(nodes).select("id", F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, runs): customers as jobs of all kinds in one document, orders as runs."""
    k = F.col("c_custkey")
    iso = lambda t: F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    schedule = F.struct(
        F.element_at(F.array(F.lit("interval"), F.lit("once"), F.lit("cron"), F.lit("other")), (k % 4 + 1).cast("int")).alias("kind"), F.when(k % 4 == 0, F.lit(43200.0)).alias("minutes"),
        F.when((k % 4 == 1) & (k % 3 > 0), iso(F.lit(852076800) + k * 86400)).alias("run_at"), F.when(k % 4 == 2, "").alias("expression"), F.when(k % 4 == 2, "0 0 * * *").alias("cron"),
    )
    job = F.struct(k.cast("string").alias("id"), (k % 10 != 9).alias("enabled"), iso(F.lit(788918400) + k * 3600).alias("created_at"), F.when(k % 4 == 1, iso(F.lit(852076800) + k * 86400)).alias("next_run_at"), schedule.alias("schedule"))
    docs = table(spark, sf_dir, "customer").groupBy((k % 3).alias("g")).agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("value"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("job_id"), epoch("o_orderdate").alias("claimed_epoch"))
    return scans.jobs(docs), runs


def job_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of every kind in one plan."""
    jobs, runs = _jobs(spark, sf_dir)
    found = detect.job_misses(jobs, runs, NOW_ORDERS, 432000.0, 432000.0, 3456000.0)
    told = detect.schedule_findings(found, ticker_stale=False, horizon=800000000.0)
    get = lambda name: F.get_json_object("payload", f"$.{name}")
    return told.select(get("job_id").cast("long").alias("job_id"), get("schedule_kind").alias("kind"), F.col("occurred_at").cast("long").alias("first"), get("missed_count").cast("long").alias("missed"), (get("catch_up") == "true").alias("catch_up"))


QUERIES = {f.__name__: f for f in (
    tree_paths, job_misses, terminal_details, task_ends,
    coverage_sessions, coverage_messages, coverage_usage, coverage_executions, coverage_tasks, coverage_runs, coverage_kinds, cron_jobs_missed, cron_expressions, task_status, task_text, finding_shapes, tree_below,
)}

_SESSIONS = f"""ids AS (SELECT c_custkey AS k, {START} + c_custkey * 3600 AS t FROM customer),
    up AS (SELECT k, k AS node FROM ids UNION ALL SELECT up.k, up.node // 2 FROM up WHERE up.node > 1),
    rooted AS (SELECT k, min(node) AS root FROM up GROUP BY k),
    s1 AS (SELECT CAST(ids.k AS VARCHAR) AS subject_id, CAST(root AS VARCHAR) AS correlation_id, CASE WHEN ids.k > 1 THEN CAST(ids.k // 2 AS VARCHAR) END AS parent_session_id FROM ids JOIN rooted USING (k) WHERE ids.k % 7 = 3 AND t >= {HORIZON})"""
_MESSAGES = f"""s2 AS (SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS subject_id, CAST(conv_id - conv_id % 2 AS VARCHAR) AS correlation_id, CAST(conv_id AS VARCHAR) AS session_id FROM conversations
    WHERE role IN ('user', 'assistant') AND turn % 6 <> 3 AND text <> '' AND (conv_id * 1000 + turn) % 9 = 4 AND {START} + conv_id * 3600 + CASE WHEN turn % 5 = 2 THEN 0 ELSE turn END >= {HORIZON})"""
_USAGE = """s3 AS (SELECT DISTINCT l_orderkey || ':m' || (l_linenumber % 3) || ':' || CASE WHEN l_linenumber % 2 = 0 THEN 't' ELSE 'None' END AS subject_id, CAST(l_orderkey AS VARCHAR) AS session_id
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 11 = 5 AND coalesce(epoch_us(o_orderdate) / 1e6 >= 883612800, true))"""
_EXECUTIONS = """s4 AS (SELECT CAST(o_orderkey AS VARCHAR) AS subject_id, CAST(o_custkey AS VARCHAR) AS correlation_id FROM orders WHERE o_orderkey % 6 = 0 AND epoch_us(o_orderdate) / 1e6 + CASE WHEN o_orderkey % 4 = 0 THEN 40 * 86400 ELSE 0 END >= 883612800)"""
_TASKS = f"""s5 AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS board, c_custkey AS k FROM customer WHERE (c_custkey % 8 = 4 OR c_custkey % 16 = 10) AND {START} + c_custkey * 3600 + CASE WHEN c_custkey % 3 = 0 THEN 7200 ELSE 0 END >= {HORIZON})"""
_RUNS = """s6 AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS board, o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS correlation_id FROM orders WHERE o_orderkey % 10 = 7 AND epoch_us(o_orderdate) / 1e6 + CASE WHEN o_orderkey % 5 = 0 THEN 86400 ELSE 0 END >= 883612800)"""

_TASK = f"""e AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey * 10 + l_linenumber AS seq, {START} + l_orderkey AS t, l_orderkey AS run_id, CASE WHEN l_partkey % 5 > 0 THEN 'main' ELSE '-' END AS board, CAST(l_partkey AS VARCHAR) AS task_id,
        ['task.created', 'task.claimed', 'task.blocked', 'task.attempt_ended', 'task.completed', 'task.attempt_ended', 'task.failed_terminal'][(l_orderkey + l_linenumber) % 7 + 1] AS kind,
        CASE WHEN l_linenumber % 3 > 0 THEN 'st' || l_linenumber ELSE '?' END AS status, 'h' || (l_orderkey % 4) AS h, l_partkey % 5 > 0 AS named FROM lineitem),
    b AS (SELECT board, task_id, coalesce(arg_max(status, seq) FILTER (kind <> 'task.attempt_ended'), '?') AS status, arg_max({{'h': h, 'kind': kind, 'run': run_id}}, seq) FILTER (kind IN ('task.claimed', 'task.attempt_ended')) AS holds,
        count(*) FILTER (kind IN ('task.completed', 'task.blocked', 'task.failed_terminal')) AS terminals FROM e GROUP BY 1, 2),
    board AS (SELECT board, task_id, status, holds.h AS holder, CASE WHEN holds IS NOT NULL THEN holds.kind = 'task.claimed' AND NOT EXISTS (SELECT 1 FROM e WHERE e.board = b.board AND e.task_id = b.task_id AND e.run_id = holds.run AND e.kind = 'task.attempt_ended') END AS held,
        CASE WHEN holds.kind = 'task.claimed' THEN holds.run + 100 END AS claim_expires, terminals FROM b)"""

_CRON_CASE = """CASE j % 5
        WHEN 0 THEN mi % 15 = 0 AND hr BETWEEN 6 AND 18 AND dow BETWEEN 1 AND 5
        WHEN 1 THEN mi = 0 AND hr = 0 AND (dom = 15 OR dow = 0)
        WHEN 2 THEN mi = 30 AND hr % 4 = 0
        WHEN 3 THEN mi IN (5, 20, 35, 50) AND hr IN (8, 20) AND mon = 1 AND dow BETWEEN 2 AND 4
        ELSE false END"""

_JOBS = f"""fr AS (SELECT o_custkey AS j, epoch_us(o_orderdate) / 1e6 AS t FROM orders),
    cj AS (SELECT c_custkey AS j, greatest(coalesce(min(t), 788918400 + c_custkey * 3600), {NOW_ORDERS} - 3456000) AS lower FROM customer LEFT JOIN fr ON fr.j = c_custkey WHERE c_custkey % 4 = 2 AND c_custkey % 10 <> 9 GROUP BY c_custkey),
    mm AS (SELECT unnest(range({int(NOW_ORDERS)} - 3456000, {int(NOW_ORDERS)} + 1, 86400)) AS instant),
    due AS (SELECT j, instant, EXISTS (SELECT 1 FROM fr WHERE fr.j = cj.j AND abs(fr.t - instant) <= 432000) AS hit FROM cj JOIN mm ON instant >= lower),
    isl AS (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY j ORDER BY instant) AS island FROM due),
    told AS (
        SELECT job_id, 'interval' AS kind, first, CAST(missed AS BIGINT) AS missed FROM misses WHERE job_id % 4 = 0 AND job_id % 10 <> 9
        UNION ALL SELECT c_custkey, 'once', 852076800 + c_custkey * 86400, 1 FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 10 <> 9 AND 852076800 + c_custkey * 86400 + 432000 <= {NOW_ORDERS} AND NOT EXISTS (SELECT 1 FROM fr WHERE j = c_custkey AND abs(t - (852076800 + c_custkey * 86400)) <= 432000)
        UNION ALL SELECT j, 'cron', min(instant), count(*) FROM isl WHERE NOT hit AND instant <= {NOW_ORDERS} - 432000 GROUP BY j, island)"""

ORACLES = {
    "terminal_details": """WITH t AS (SELECT s_suppkey AS k, ['task.blocked', 'task.completed', 'task.failed_terminal'][s_suppkey % 3 + 1] AS e, CASE WHEN s_suppkey % 4 > 0 THEN ['blocked', 'gave_up', ''][(s_suppkey + 1) % 3 + 1] END AS kind FROM supplier)
        SELECT k AS id, CASE WHEN e = 'task.blocked' AND k % 5 > 0 THEN e || '  (' || coalesce(kind, 'None') || ', block_kind=b' || (k % 3) || ')' WHEN kind <> '' THEN e || '  (' || kind || ')' ELSE e END AS detail FROM t""",
    "task_ends": f"""WITH {_TASK}, t AS (SELECT board, task_id, seq, '      ' || kind || CASE WHEN kind = 'task.blocked' AND run_id % 5 > 2 THEN '  (k' || (run_id % 5) || ', block_kind=needs)' WHEN run_id % 5 > 0 THEN '  (k' || (run_id % 5) || ')' ELSE '' END AS line FROM e
            WHERE kind IN ('task.completed', 'task.blocked', 'task.failed_terminal'))
        SELECT board, task_id, '    terminals:' || chr(10) || string_agg(line, chr(10) ORDER BY seq) AS text FROM t GROUP BY 1, 2""",
    "tree_paths": """WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer UNION ALL VALUES (-1, -2), (-2, -3), (-3, -1), (-9, -77), (-10, -9)),
        p AS (SELECT id, CAST(id AS VARCHAR) AS path FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, p.path || '/' || n.id FROM p JOIN n ON n.parent = p.id) SELECT id, path FROM p""",
    "job_misses": f"WITH RECURSIVE {_INTERVAL}, {_JOBS} SELECT job_id, kind, CAST(floor(first) AS BIGINT) AS first, missed, missed > 1 AS catch_up FROM told WHERE first >= 800000000",
    "coverage_sessions": f"WITH RECURSIVE {_SESSIONS} SELECT 'session' AS subject_type, subject_id, 'state.db:sessions' AS source_table, correlation_id, subject_id AS session_id, parent_session_id FROM s1",
    "coverage_messages": f"WITH {_MESSAGES} SELECT subject_id, 'state.db:messages' AS source_table, correlation_id, session_id FROM s2",
    "coverage_usage": f"WITH {_USAGE} SELECT subject_id, 'state.db:session_model_usage' AS source_table, session_id FROM s3",
    "coverage_executions": f"WITH {_EXECUTIONS} SELECT subject_id, 'cron:executions.db' AS source_table, correlation_id FROM s4",
    "coverage_tasks": f"WITH {_TASKS} SELECT board || ':' || k AS subject_id, 'kanban:' || board || ':tasks' AS source_table, CAST(k AS VARCHAR) AS correlation_id, 's' AS session_id FROM s5",
    "coverage_runs": f"WITH {_RUNS} SELECT board || ':' || k AS subject_id, 'kanban:' || board || ':task_runs' AS source_table, correlation_id FROM s6",
    "coverage_kinds": f"""WITH RECURSIVE {_SESSIONS}, {_MESSAGES}, {_USAGE}, {_EXECUTIONS}, {_TASKS}, {_RUNS},
        u AS (SELECT 'session' AS subject_type, 'state.db:sessions' AS source_table, subject_id, subject_id AS session_id FROM s1 UNION ALL SELECT 'message', 'state.db:messages', subject_id, session_id FROM s2
            UNION ALL SELECT 'model_usage', 'state.db:session_model_usage', subject_id, session_id FROM s3 UNION ALL SELECT 'execution', 'cron:executions.db', subject_id, NULL FROM s4
            UNION ALL SELECT 'task', 'kanban:' || board || ':tasks', board || ':' || k, 's' FROM s5 UNION ALL SELECT 'task_run', 'kanban:' || board || ':task_runs', board || ':' || k, NULL FROM s6)
        SELECT subject_type, source_table, count(*) AS findings, min('reconcile:cover:' || subject_type || ':' || subject_id) AS first_key, count(session_id) AS with_session FROM u GROUP BY ALL""",
    "cron_jobs_missed": f"""WITH f AS (SELECT user_id AS j, epoch_us(ts) / 1e6 AS t FROM events),
        jobs AS (SELECT j, greatest(min(t), {NOW_EVENTS} - 604800) AS lower, CASE WHEN j % 7 = 0 THEN 3600 ELSE [19800, -28800, 0][j % 3 + 1] END AS zone FROM f GROUP BY j),
        m AS (SELECT unnest(range({int(NOW_EVENTS)} - 604800, {int(NOW_EVENTS)} + 1, 60)) AS instant),
        w AS (SELECT j, instant, instant + zone AS w FROM jobs JOIN m ON instant >= lower),
        p AS (SELECT j, instant, (w // 60) % 60 AS mi, (w // 3600) % 24 AS hr, (w // 86400 + 4) % 7 AS dow, day(make_timestamp(w * 1000000)) AS dom, month(make_timestamp(w * 1000000)) AS mon FROM w),
        due AS (SELECT j, instant FROM p WHERE {_CRON_CASE}),
        hit AS (SELECT j, instant, EXISTS (SELECT 1 FROM f WHERE f.j = due.j AND abs(f.t - due.instant) <= 600) AS hit FROM due),
        isl AS (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY j ORDER BY instant) AS island, max(instant) OVER (PARTITION BY j) AS last, sum(CAST(hit AS INT)) OVER (PARTITION BY j) AS newest FROM hit)
        SELECT j AS job_id, CAST(min(instant) AS BIGINT) AS first, count(*) AS missed, island = any_value(newest) AND any_value(last) >= {NOW_EVENTS} - 60 AS tail
        FROM isl WHERE NOT hit AND instant <= {NOW_EVENTS} - 600 GROUP BY j, island""",
    "cron_expressions": "SELECT expression, sizes, count(*) AS n FROM events JOIN (VALUES " + ", ".join(f"({i}, '{x}', {'NULL' if v is None else repr(v)})" for i, (x, v) in enumerate(CHECKED.items())) + f") c(i, expression, sizes) ON event_id % {len(CHECKED)} = i GROUP BY ALL",
    "task_status": f"WITH {_TASK} SELECT * FROM board",
    "task_text": f"""WITH {_TASK},
        runs AS (SELECT task_id, CASE WHEN named THEN 'main' END AS board, run_id, min(t) AS t, arg_max(h, seq) FILTER (kind = 'task.claimed') AS c, arg_max(h, seq) FILTER (kind = 'task.attempt_ended') AS z, count(*) FILTER (kind IN ('task.claimed', 'task.attempt_ended')) AS n FROM e GROUP BY ALL),
        lines AS (SELECT board, task_id, 0 AS part, 0.0 AS t, 0 AS run, '▣ task ' || task_id || '  [' || status || ']  board=' || board AS line FROM board
            UNION ALL SELECT board, task_id, 1, 0.0, 0, '    holder ' || holder || '  [' || CASE WHEN held THEN 'held' ELSE 'released' END || ']' || coalesce('  expires=' || claim_expires, '') FROM board WHERE holder IS NOT NULL
            UNION ALL SELECT board, task_id, 2, t, run_id, '      run ' || run_id || '  ' || coalesce(z, c) || '  ' || CASE WHEN z IS NOT NULL THEN 'completed/success' ELSE 'running' END FROM runs WHERE n > 0 AND board IS NOT NULL)
        SELECT task_id, string_agg(line, chr(10) ORDER BY board, part, t, run) AS text FROM lines GROUP BY task_id""",
    "finding_shapes": """SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'reconcile.gap_detected' WHEN 1 THEN 'reconcile.terminal_missing' WHEN 2 THEN 'cron.run_missed' WHEN 3 THEN 'runtime.gateway_start_failed' ELSE 'reconcile.capture_stale' END AS event_type,
        CASE s_suppkey % 6 WHEN 0 THEN 'uncaptured task: a:1 (t)' WHEN 1 THEN 'invocation i has no invocation.completed, ~61s past window' WHEN 2 THEN 'job j missed 3 fire(s) from 2024-01-01T00:00:00Z' WHEN 3 THEN 'chat failed to start: token_conflict'
            ELSE 'capture loop stalled: last success 2024-01-01T00:00:00Z, ~90s stale' END AS detail FROM supplier WHERE s_suppkey % 6 < 5""",
    "tree_below": """WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer UNION ALL VALUES (-1, -2), (-2, -3), (-3, -1), (-9, -77), (-10, -9)),
        f AS (SELECT id AS root, id, 0 AS depth, [id] AS path FROM n WHERE id IN (5, -2, -9) UNION ALL SELECT f.root, n.id, depth + 1, list_append(path, n.id) FROM f JOIN n ON n.parent = f.id WHERE NOT list_contains(path, n.id)) SELECT root, id, depth FROM f""",
}
