"""Audits: gaps, coverage, terminals, leases, schedules, runtime."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..functions.schedule import parse_cron
from ..operators import attribution, detect, views
from ..sources import scans
from .driver import INSTALLATION, LEDGER_SQL, NOW_EVENTS, NOW_ORDERS, epoch, high_water, ledger, table

GAP_LIMIT = 10_000
TIMEOUT = 6 * 3600.0


def _gaps(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    events = ledger(spark, sf_dir)
    return detect.sequence_gaps(detect.stored_sequences(events, events.limit(0)), high_water(spark, sf_dir), limit)


def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gaps only, as a page of them is shown."""
    return _gaps(spark, sf_dir, GAP_LIMIT).select("missing_sequence", "prev_sequence", "next_sequence")


def pruned_not_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second of the missing sequences is on record as pruned."""
    events = ledger(spark, sf_dir)
    pruned = table(spark, sf_dir, "events").filter("event_id % 194 = 13").select(F.lit(INSTALLATION).alias("installation_id"), (F.col("event_id") + 1).alias("producer_sequence"))
    return detect.sequence_gaps(detect.stored_sequences(events, pruned), high_water(spark, sf_dir)).select("missing_sequence", "prev_sequence", "next_sequence")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ledger(spark, sf_dir).filter(F.col("event_type").startswith("invocation."))
    paired = attribution.pair_starts(own, "session_id", "producer_sequence", F.col("event_type") == "invocation.started")
    started = F.coalesce("paired_with", "producer_sequence").cast("string")
    return paired.withColumn("invocation_id", F.concat_ws(":", "session_id", F.lit("hook"), started))


def invocation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).filter("event_type = 'invocation.completed'").select("session_id", "producer_sequence", "paired_with")


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.missing_terminals(_paired(spark, sf_dir), NOW_EVENTS, TIMEOUT)


def terminal_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir).select("invocation_id", "session_id", F.round("age_seconds", 3).alias("age_seconds"))


def _orders_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    durable = table(spark, sf_dir, "orders").select(
        F.lit("execution").alias("subject_type"), F.col("o_orderkey").cast("string").alias("subject_id"), F.lit("orders").alias("source_table"),
        F.col("o_custkey").cast("string").alias("correlation_id"), F.lit(None).cast("string").alias("session_id"), epoch("o_orderdate").alias("at"),
    )
    seen = table(spark, sf_dir, "lineitem").select(F.lit("execution").alias("subject_type"), F.col("l_orderkey").cast("string").alias("subject_id")).distinct()
    return detect.uncaptured(durable, seen, horizon=0.0)


def coverage_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_absent(spark, sf_dir).select("subject_type", "subject_id", "correlation_id")


def coverage_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only orders from 1998 on are judged."""
    return _orders_absent(spark, sf_dir).filter(~detect.occurred_before(883612800.0, F.col("at"))).select("subject_id")


def coverage_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even subjects were first seen missing long ago, subjects divisible by
    four just now; the others never, so they wait."""
    absent = _orders_absent(spark, sf_dir)
    key = F.col("subject_id").cast("long")
    seen = absent.filter(key % 2 == 0).select("subject_type", "subject_id", F.when(key % 4 == 0, F.lit(NOW_ORDERS - 10)).otherwise(F.lit(NOW_ORDERS - 600)).alias("first_seen"))
    ready, kept = detect.with_grace(absent, seen, NOW_ORDERS, 300.0)
    return ready.select("subject_id", F.lit("ready").alias("state")).union(kept.select("subject_id", F.concat(F.lit("since "), F.col("first_seen").cast("long").cast("string"))))


def coverage_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that events cover, of three kinds at once."""
    e = ledger(spark, sf_dir)
    payload = F.to_json(F.struct(
        F.when(F.col("event_type") == "tool.call_completed", F.col("event_id")).alias("message_row_id"),
        F.when(F.col("event_type") == "model.usage_recorded", F.concat(F.lit("m"), F.col("event_id") % 5)).alias("model"),
        F.when((F.col("event_type") == "model.usage_recorded") & (F.col("event_id") % 3 > 0), F.lit("t")).alias("task"),
    ))
    return detect.captured_subjects(e.withColumn("payload", payload))


def dead_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dead(spark, sf_dir).select("id", "task_id", "claim_lock", F.col("claim_expires").cast("long").alias("claim_expires"))


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = epoch("o_orderdate")
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("task_id"), F.lit("main").alias("board"), F.concat(F.lit("host:"), F.col("o_custkey").cast("string")).alias("claim_lock"),
        (at + 86400).alias("claim_expires"), F.when(F.col("o_orderkey") % 3 == 0, at + 1000 * 86400).alias("last_heartbeat_at"), at.alias("started_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("outcome"),
    )
    return detect.dead_leases(runs, NOW_ORDERS, 300.0, 3600.0)


def _order_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.array_sort(F.collect_list(epoch("o_orderdate"))).alias("fires"))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")).join(fires, "job_id", "left")
    created = F.lit(788918400.0) + F.col("job_id") * 3600
    return jobs.select("job_id", F.coalesce("fires", F.array().cast("array<double>")).alias("fires"), created.cast("double").alias("created"), F.lit(30 * 86400.0).alias("step"), F.lit(5 * 86400.0).alias("slack"))


def interval_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.interval_misses(_order_fires(spark, sf_dir), NOW_ORDERS).select("job_id", F.col("first").cast("long").alias("first"), "missed", "tail")


def once_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = _order_fires(spark, sf_dir).withColumn("run_at", F.lit(852076800.0) + F.col("job_id") * 86400)
    return detect.once_misses(due, NOW_ORDERS).select("job_id", F.col("first").cast("long").alias("first"))


CRON = "*/15 6-18 * * 1-5"


def cron_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are jobs, their events are fires."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), epoch("ts").alias("at"))
    jobs = e.select("job_id").distinct().withColumn("created", F.lit(None).cast("double"))
    return detect.cron_misses(jobs, e, parse_cron(CRON), NOW_EVENTS, 7 * 86400.0, 600.0).select("job_id", F.col("first").cast("long").alias("first"), "missed", "tail")


def cron_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day rule: with both days restricted either names the instant."""
    from ..functions.schedule import minutes_between

    span = spark.range(1).select(F.explode(minutes_between(F.lit(1704067200.5), F.lit(NOW_EVENTS))).alias("instant"))
    named = {"either": parse_cron("0 0 15 * 0"), "day": parse_cron("0 0 15 * *"), "weekday": parse_cron("30 12 * * 5"), "steps": parse_cron("5-50/15 */8 1,2 1 *")}
    return reduce(DataFrame.union, [span.filter(c.admits(F.col("instant"))).select(F.lit(n).alias("rule"), "instant") for n, c in named.items()])


def gateway_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State documents made of suppliers: failed starts with a reason, and
    platforms whose token another process holds."""
    s = table(spark, sf_dir, "supplier")
    reason = F.element_at(F.array(*[F.lit(x) for x in ("Port already in use", "bad CONFIG value", "policy denied", "boom")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    info = F.struct(F.when(F.col("s_suppkey") % 3 == 0, "token_lock").otherwise("ok").alias("error_code"), F.when(F.col("s_suppkey") % 6 == 0, F.concat(F.lit("held by PID "), F.col("s_suppkey").cast("string"))).alias("error_message"))
    doc = F.to_json(F.struct(F.when(F.col("s_suppkey") % 2 == 0, "startup_failed").otherwise("running").alias("gateway_state"), reason.alias("exit_reason"), F.lit("2024-01-30T00:00:00+02:00").alias("updated_at"), F.create_map(F.lit("chat"), info).alias("platforms")))
    found = detect.gateway_findings(s.select(doc.alias("value")), NOW_EVENTS)
    return found.groupBy("correlation_id", F.get_json_object("payload", "$.reason_class").alias("reason_class"), F.get_json_object("payload", "$.conflicting_pid").alias("pid"), F.col("occurred_at").cast("long").alias("occurred_at")).agg(F.count(F.lit(1)).alias("findings"))


def runtime_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event is the ticker's heartbeat and the capture's last success."""
    last = ledger(spark, sf_dir).agg(F.max("occurred_at").alias("value"))
    both = detect.ticker_findings(last, NOW_EVENTS + 3600, 300.0).unionByName(detect.capture_findings(last, INSTALLATION, NOW_EVENTS + 3600, 120.0))
    return both.select("event_type", "dedup_key")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors' findings as one table."""
    misses = detect.interval_misses(_order_fires(spark, sf_dir), NOW_ORDERS)
    parts = [
        detect.gap_findings(_gaps(spark, sf_dir), NOW_EVENTS), detect.coverage_findings(_orders_absent(spark, sf_dir), NOW_EVENTS), detect.terminal_findings(_missing(spark, sf_dir), NOW_EVENTS),
        detect.lease_findings(_dead(spark, sf_dir), NOW_ORDERS), detect.schedule_findings(misses, ticker_stale=True),
    ]
    return reduce(DataFrame.unionByName, parts)


def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.findings(_findings(spark, sf_dir))
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("dedup_key").alias("keys"), F.min("detail").alias("first_detail"))


def finding_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.gap_findings(_gaps(spark, sf_dir), NOW_EVENTS).unionByName(detect.coverage_findings(_orders_absent(spark, sf_dir), NOW_EVENTS))
    return views.findings(found).select("dedup_key", "detail")


def capture_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polled events from before the horizon are dropped; heartbeats and hooks pass."""
    e = ledger(spark, sf_dir)
    method = F.when(F.col("event_type") == "model.call_failed", "poll:cron:heartbeat").when(F.col("event_type") == "tool.call_completed", "hook:agent").otherwise("poll:state.db")
    return e.withColumn("method", method).filter(detect.after_capture_horizon(F.col("method"), F.col("occurred_at"), 1705276800.0)).groupBy("method").agg(F.count(F.lit(1)).alias("events"))


def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of a document made of suppliers."""
    k = F.col("s_suppkey")
    job = F.struct(k.cast("string").alias("id"), F.when(k % 7 != 0, k % 5 != 0).alias("enabled"), F.when(k % 3 == 0, "paused").alias("state"), F.struct((k % 4).alias("times"), (k % 6).alias("completed")).alias("repeat"))
    docs = table(spark, sf_dir, "supplier").groupBy((k % 3).alias("g")).agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("value"))
    return scans.active_jobs(scans.jobs(docs)).select(F.col("id").cast("long").alias("id"))


QUERIES = {f.__name__: f for f in (
    seq_gaps, pruned_not_lost, invocation_pairs, terminal_missing, coverage_orders, coverage_horizon, coverage_grace, coverage_subjects, dead_leases, interval_missed, once_missed,
    cron_missed, cron_instants, gateway_findings, runtime_stale, findings_report, finding_details, capture_horizon, active_jobs,
)}

_GAPS = f"""{LEDGER_SQL},
    marks AS (SELECT 0 AS s UNION ALL SELECT producer_sequence FROM ledger UNION ALL SELECT max(event_id) + 2 FROM events),
    near AS (SELECT s, lag(s) OVER (ORDER BY s) AS p FROM marks),
    gaps AS (SELECT p AS prev_sequence, s AS next_sequence, unnest(range(p + 1, s)) AS missing_sequence FROM near WHERE s > p + 1)"""

_PAIRS = f"""{LEDGER_SQL},
    inv AS (SELECT *, lag(event_type) OVER w AS before, lag(producer_sequence) OVER w AS before_seq FROM ledger WHERE event_type LIKE 'invocation.%' WINDOW w AS (PARTITION BY session_id ORDER BY producer_sequence)),
    paired AS (SELECT *, CASE WHEN event_type = 'invocation.completed' AND before = 'invocation.started' THEN before_seq END AS paired_with FROM inv),
    named AS (SELECT *, session_id || ':hook:' || coalesce(paired_with, producer_sequence) AS invocation_id FROM paired),
    missing AS (SELECT * FROM named s WHERE event_type = 'invocation.started' AND {NOW_EVENTS} - occurred_at > {TIMEOUT}
        AND NOT EXISTS (SELECT 1 FROM named e WHERE e.event_type = 'invocation.completed' AND e.invocation_id = s.invocation_id))"""

_ABSENT = "absent AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) / 1e6 AS placed FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))"

_DEAD = f"""dead AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS task_id, 'host:' || o_custkey AS claim_lock, CAST(epoch_us(o_orderdate) / 1e6 + 86400 AS BIGINT) AS claim_expires
    FROM orders WHERE o_orderstatus = 'O' AND {NOW_ORDERS} - (epoch_us(o_orderdate) / 1e6 + 86400) > 300
      AND NOT (o_orderkey % 3 = 0 AND {NOW_ORDERS} - (epoch_us(o_orderdate) / 1e6 + 86400000) <= 3600))"""

# The state machine of interval jobs, a state for each step: e expected, i fires used, n misses.
_INTERVAL = f"""
    fired AS (SELECT o_custkey AS j, list(epoch_us(o_orderdate) / 1e6 ORDER BY o_orderdate) AS f FROM orders GROUP BY o_custkey),
    jobs AS (SELECT c_custkey AS j, coalesce(f, []) AS f, 788918400.0 + c_custkey * 3600.0 AS created FROM customer LEFT JOIN fired ON j = c_custkey),
    walk(j, f, e, i, n, first, out_first, out_n, out_tail, live) AS (
        SELECT j, f, f[1] + 2592000.0, 1, 0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0, false, true FROM jobs WHERE len(f) > 0
        UNION ALL
        SELECT j, f,
            CASE WHEN i <= len(f) AND f[i] < e - 432000 THEN e WHEN i <= len(f) AND f[i] <= e + 432000 THEN f[i] + 2592000.0 WHEN e <= {NOW_ORDERS} - 432000 THEN e + 2592000.0 ELSE e END,
            CASE WHEN i <= len(f) AND f[i] <= e + 432000 THEN i + 1 ELSE i END,
            CASE WHEN i <= len(f) AND f[i] < e - 432000 THEN n WHEN i <= len(f) AND f[i] <= e + 432000 THEN 0 WHEN e <= {NOW_ORDERS} - 432000 THEN n + 1 ELSE n END,
            CASE WHEN i <= len(f) AND f[i] < e - 432000 THEN first WHEN i <= len(f) AND f[i] <= e + 432000 THEN NULL WHEN e <= {NOW_ORDERS} - 432000 AND n = 0 THEN e ELSE first END,
            CASE WHEN i <= len(f) AND f[i] >= e - 432000 AND f[i] <= e + 432000 AND n > 0 THEN first END,
            CASE WHEN i <= len(f) AND f[i] >= e - 432000 AND f[i] <= e + 432000 AND n > 0 THEN n ELSE 0 END,
            false,
            (i <= len(f) AND f[i] <= e + 432000) OR e <= {NOW_ORDERS} - 432000
        FROM walk WHERE live AND e <= {NOW_ORDERS} + 432000),
    ends AS (SELECT j, arg_max(n, e * 1000000 + i) AS n, arg_max(first, e * 1000000 + i) AS first FROM walk GROUP BY j),
    misses AS (
        SELECT j AS job_id, out_first AS first, out_n AS missed, false AS tail FROM walk WHERE out_n > 0
        UNION ALL SELECT j, first, n, true FROM ends WHERE n > 0
        UNION ALL SELECT j, created + 2592000.0, greatest(1, floor(({NOW_ORDERS} - 432000 - created) / 2592000.0)), true FROM jobs WHERE len(f) = 0 AND {NOW_ORDERS} - 432000 >= created + 2592000.0)"""

ORACLES = {
    "seq_gaps": f"WITH {_GAPS} SELECT missing_sequence, prev_sequence, next_sequence FROM gaps ORDER BY 1 LIMIT {GAP_LIMIT}",
    "pruned_not_lost": f"""WITH {LEDGER_SQL},
        marks AS (SELECT 0 AS s UNION SELECT producer_sequence FROM ledger UNION SELECT event_id + 1 FROM events WHERE event_id % 194 = 13 UNION SELECT max(event_id) + 2 FROM events),
        near AS (SELECT s, lag(s) OVER (ORDER BY s) AS p FROM marks)
        SELECT p AS prev_sequence, s AS next_sequence, unnest(range(p + 1, s)) AS missing_sequence FROM near WHERE s > p + 1""",
    "invocation_pairs": f"WITH {_PAIRS} SELECT session_id, producer_sequence, paired_with FROM paired WHERE event_type = 'invocation.completed'",
    "terminal_missing": f"WITH {_PAIRS} SELECT invocation_id, session_id, round({NOW_EVENTS} - occurred_at, 3) AS age_seconds FROM missing",
    "coverage_orders": f"WITH {_ABSENT} SELECT 'execution' AS subject_type, CAST(o_orderkey AS VARCHAR) AS subject_id, CAST(o_custkey AS VARCHAR) AS correlation_id FROM absent",
    "coverage_horizon": f"WITH {_ABSENT} SELECT CAST(o_orderkey AS VARCHAR) AS subject_id FROM absent WHERE placed >= 883612800",
    "coverage_grace": f"""WITH {_ABSENT} SELECT CAST(o_orderkey AS VARCHAR) AS subject_id, 'ready' AS state FROM absent WHERE o_orderkey % 4 = 2
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'since ' || CAST({NOW_ORDERS} - CASE WHEN o_orderkey % 4 = 0 THEN 10 WHEN o_orderkey % 4 = 2 THEN 600 ELSE 0 END AS BIGINT) FROM absent""",
    "coverage_subjects": f"""WITH {LEDGER_SQL}
        SELECT 'message' AS subject_type, CAST(event_id AS VARCHAR) AS subject_id FROM ledger WHERE event_type = 'tool.call_completed'
        UNION SELECT 'model_usage', session_id || ':m' || (event_id % 5) || ':t' FROM ledger WHERE event_type = 'model.usage_recorded' AND event_id % 3 > 0""",
    "dead_leases": f"WITH {_DEAD} SELECT * FROM dead",
    "interval_missed": f"WITH RECURSIVE {_INTERVAL} SELECT job_id, CAST(floor(first) AS BIGINT) AS first, CAST(missed AS BIGINT) AS missed, tail FROM misses",
    "once_missed": f"""SELECT c_custkey AS job_id, CAST(852076800 + c_custkey * 86400 AS BIGINT) AS first FROM customer
        WHERE 852076800 + c_custkey * 86400 + 432000 <= {NOW_ORDERS}
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND abs(epoch_us(o_orderdate) / 1e6 - (852076800 + c_custkey * 86400)) <= 432000)""",
    "cron_missed": f"""WITH f AS (SELECT user_id AS j, epoch_us(ts) / 1e6 AS t FROM events),
        jobs AS (SELECT j, greatest(min(t), {NOW_EVENTS} - 604800) AS lower FROM f GROUP BY j),
        m AS (SELECT unnest(range(1704067200, {int(NOW_EVENTS)} + 1, 60)) AS instant),
        due AS (SELECT j, instant FROM jobs JOIN m ON instant >= lower
            WHERE (instant // 60) % 60 % 15 = 0 AND (instant // 3600) % 24 BETWEEN 6 AND 18 AND (instant // 86400 + 4) % 7 BETWEEN 1 AND 5),
        hit AS (SELECT j, instant, EXISTS (SELECT 1 FROM f WHERE f.j = due.j AND abs(f.t - due.instant) <= 600) AS hit FROM due),
        isl AS (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY j ORDER BY instant) AS island, max(instant) OVER (PARTITION BY j) AS last, sum(CAST(hit AS INT)) OVER (PARTITION BY j) AS newest FROM hit)
        SELECT j AS job_id, CAST(min(instant) AS BIGINT) AS first, count(*) AS missed, island = any_value(newest) AND any_value(last) >= {NOW_EVENTS} - 60 AS tail
        FROM isl WHERE NOT hit AND instant <= {NOW_EVENTS} - 600 GROUP BY j, island""",
    "cron_instants": f"""WITH m AS (SELECT unnest(range(1704067260, {int(NOW_EVENTS)} + 1, 60)) AS instant),
        p AS (SELECT instant, make_timestamp(instant * 1000000) AS t FROM m)
        SELECT 'either' AS rule, instant FROM p WHERE minute(t) = 0 AND hour(t) = 0 AND (day(t) = 15 OR dayofweek(t) = 0)
        UNION ALL SELECT 'day', instant FROM p WHERE minute(t) = 0 AND hour(t) = 0 AND day(t) = 15
        UNION ALL SELECT 'weekday', instant FROM p WHERE minute(t) = 30 AND hour(t) = 12 AND dayofweek(t) = 5
        UNION ALL SELECT 'steps', instant FROM p WHERE minute(t) IN (5, 20, 35, 50) AND hour(t) IN (0, 8, 16) AND day(t) IN (1, 2) AND month(t) = 1""",
    "gateway_findings": """WITH f AS (
        SELECT 'gateway' AS correlation_id, CASE s_suppkey % 4 WHEN 0 THEN 'token_conflict' WHEN 1 THEN 'config_invalid' WHEN 2 THEN 'policy_open' ELSE 'unknown' END AS reason_class, NULL AS pid FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'gateway:chat', 'token_conflict', CASE WHEN s_suppkey % 6 = 0 THEN CAST(s_suppkey AS VARCHAR) END FROM supplier WHERE s_suppkey % 3 = 0)
        SELECT correlation_id, reason_class, pid, CAST(1706565600 AS BIGINT) AS occurred_at, count(*) AS findings FROM f GROUP BY ALL""",
    "runtime_stale": f"""WITH {LEDGER_SQL}, l AS (SELECT CAST(floor(max(occurred_at)) AS BIGINT) AS v FROM ledger)
        SELECT 'reconcile.terminal_missing' AS event_type, 'reconcile:ticker_stale:' || v AS dedup_key FROM l UNION ALL SELECT 'reconcile.capture_stale', 'reconcile:capture_stale:' || v FROM l""",
    "findings_report": f"""WITH RECURSIVE {_INTERVAL}, {_GAPS}, inv_dummy AS (SELECT 1), {_PAIRS.replace(LEDGER_SQL + ',', '')}, {_ABSENT}, {_DEAD},
        f AS (
            SELECT 'reconcile.gap_detected' AS event_type, 'reconcile:seq:{INSTALLATION}:' || missing_sequence AS k, 'sequence gap: missing #' || missing_sequence || ' (between ' || prev_sequence || ' and ' || next_sequence || ')' AS detail FROM gaps
            UNION ALL SELECT 'reconcile.gap_detected', 'reconcile:cover:execution:' || o_orderkey, 'uncaptured execution: ' || o_orderkey || ' (orders)' FROM absent
            UNION ALL SELECT 'reconcile.terminal_missing', 'reconcile:terminal:invocation:' || invocation_id, 'invocation ' || invocation_id || ' has no invocation.completed, ~' || CAST(floor({NOW_EVENTS} - occurred_at) AS BIGINT) || 's past window' FROM missing
            UNION ALL SELECT 'reconcile.terminal_missing', 'reconcile:terminal:task_run:main:' || id, 'task_run ' || id || ' has no task.attempt_ended, ~' || CAST({NOW_ORDERS} - claim_expires AS BIGINT) || 's past window' FROM dead
            UNION ALL SELECT 'cron.run_missed', 'reconcile:missed:' || job_id || ':' || CAST(floor(first) AS BIGINT), 'job ' || job_id || ' missed ' || CAST(missed AS BIGINT) || ' fire(s) from ' || strftime(make_timestamp(CAST(floor(first) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') FROM misses WHERE NOT tail)
        SELECT event_type, count(*) AS findings, count(DISTINCT k) AS keys, min(detail) AS first_detail FROM f GROUP BY event_type""",
    "finding_details": f"""WITH {_GAPS}, {_ABSENT}
        SELECT 'reconcile:seq:{INSTALLATION}:' || missing_sequence AS dedup_key, 'sequence gap: missing #' || missing_sequence || ' (between ' || prev_sequence || ' and ' || next_sequence || ')' AS detail FROM gaps
        UNION ALL SELECT 'reconcile:cover:execution:' || o_orderkey, 'uncaptured execution: ' || o_orderkey || ' (orders)' FROM absent""",
    "capture_horizon": f"""WITH {LEDGER_SQL}, m AS (SELECT CASE event_type WHEN 'model.call_failed' THEN 'poll:cron:heartbeat' WHEN 'tool.call_completed' THEN 'hook:agent' ELSE 'poll:state.db' END AS method, occurred_at FROM ledger)
        SELECT method, count(*) AS events FROM m WHERE method <> 'poll:state.db' OR occurred_at >= 1705276800 GROUP BY method""",
    "active_jobs": """SELECT s_suppkey AS id FROM supplier WHERE (s_suppkey % 7 = 0 OR s_suppkey % 5 <> 0) AND s_suppkey % 3 <> 0 AND NOT (s_suppkey % 6 >= s_suppkey % 4)""",
}
