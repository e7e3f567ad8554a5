"""Text views, passes, lookups and source scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import lookups, mappers, security, store, views
from ..sources import scans
from ..streaming import passes
from . import activity, audit, knowledge
from .driver import INSTALLATION, LEDGER_SQL, NOW_EVENTS, ledger, table


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap and coverage findings as the text of a report."""
    from ..operators import detect

    found = detect.gap_findings(audit._gaps(spark, sf_dir), NOW_EVENTS).unionByName(detect.coverage_findings(audit._orders_absent(spark, sf_dir), NOW_EVENTS))
    events = found.withColumn("installation_id", F.lit(INSTALLATION)).withColumn("producer_sequence", F.crc32(F.col("dedup_key").cast("binary")))
    return views.report_lines(events).select(F.col("ord.part").alias("part"), "line")


def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = activity._board_events(spark, sf_dir)
    lines = views.task_lines(views.task_board(e), views.task_attempts(e))
    return lines.filter("ord.part = 2").select("task_id", "line")


def security_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = security.fingerprinted(knowledge._matches(spark, sf_dir), knowledge.SECRET).withColumn("first_event", F.col("doc_id").cast("string"))
    lines = views.security_lines(security.secret_groups(found, F.struct("doc_id", "byte_start", "type")))
    return lines.select(F.regexp_replace("line", " fingerprint=.*", "").alias("line"))


def version_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = store.version_chain(knowledge._states(spark, sf_dir)).select("artifact_id", "seq", "tombstone", "manifest_hash", F.lit("scan").alias("origin"), F.lit(1704067200.0).alias("occurred_at"))
    shipped = chain.filter("seq % 3 > 0")
    return views.version_lines(chain.withColumn("manifest_hash", F.coalesce("manifest_hash", F.lit("none"))), shipped).select("artifact_id", "seq", "line")


def pass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources, of which one cannot be read and one is off."""
    sources = {
        "messages": lambda: mappers.message_records(activity._messages(spark, sf_dir), 65_536),
        "broken": lambda: table(spark, sf_dir, "no_such_table"),
        "off": lambda: mappers.message_records(activity._messages(spark, sf_dir), 10),
        "executions": lambda: mappers.record(ledger(spark, sf_dir), event_type=F.col("event_type"), dedup_key=F.col("event_id").cast("string")),
    }
    records, health = passes.run_pass(spark, sources, NOW_EVENTS, {"off": False})
    read = passes.counts(records).select(F.concat(F.lit("event "), "event_type").alias("what"), F.col("events").alias("n"))
    return read.union(health.select(F.concat(F.lit("source "), "source"), F.col("ok").cast("long")))


def usage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of the sessions that an error touched."""
    e = ledger(spark, sf_dir)
    return scans.usage_to_read(e.filter("event_type = 'model.usage_recorded'"), e.filter("event_type = 'model.call_failed' and value > 15")).select("producer_sequence", "session_id")


def board_run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs after a mark, named by an event, or open before."""
    _, runs, _ = activity._board(spark, sf_dir)
    named = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' and l_quantity = 1").select(F.lit("main").alias("board"), F.col("l_orderkey").alias("id"))
    return scans.board_runs(runs, 9_000, 64, named, runs.filter("outcome is null")).select("id")


def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers read as sessions of a newer schema: what lacks is a default."""
    return scans.tolerant(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "id"), {"id": ("string", None), "message_count": ("bigint", 0), "expiry_finalized": ("int", 1), "model": ("string", None)})


def board_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two boards, one with a column less."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    return scans.boards({"a": t, "b": t.select("id")}).groupBy("board").agg(F.count(F.lit(1)).alias("tasks"), F.count("status").alias("known"))


def audit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained events, then what is left of the lost ones as if pruned."""
    pruned = table(spark, sf_dir, "events").filter("event_id % 97 = 13").select(F.lit(INSTALLATION).alias("installation_id"), (F.col("event_id") + 1).alias("producer_sequence"))
    both = lookups.summaries(ledger(spark, sf_dir), pruned)
    return both.groupBy(F.col("event_type").isNull().alias("pruned")).agg(F.count(F.lit(1)).alias("events"), F.max("producer_sequence").alias("last"))


def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger(spark, sf_dir).withColumn("dedup_key", F.concat(F.lit("k:"), F.col("event_id").cast("string")))
    return lookups.event_by_key(e, "k:77").select("producer_sequence", "event_type")


def version_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with the events that carried them, foreground ones first."""
    chain = store.version_chain(knowledge._states(spark, sf_dir)).select("artifact_id", "seq", F.lit("scan").alias("origin"))
    carried = chain.filter("seq % 3 > 0").select("artifact_id", "seq", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("event_id"))
    return lookups.attributed(chain, carried.withColumn("foreground", (F.col("event_id") == 2) & (F.col("seq") % 2 == 0)))


def compaction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that supersede another, each twice; some are told already."""
    k = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select(k.alias("assistant_id"), F.lit("c").alias("call_id"), k.cast("string").alias("source"), F.when(k % 3 == 0, (k + 1).cast("string")).when(k % 3 == 1, "").alias("absorbed_into"))
    known = m.filter("assistant_id % 6 = 0").select(F.concat(F.lit("state.db:knowledge-compacted:"), F.col("assistant_id").cast("string"), F.lit(":c")).alias("dedup_key"))
    return lookups.compaction_edges(m.union(m), known)


QUERIES = {f.__name__: f for f in (report_lines, task_lines, security_lines, version_lines, pass_counts, usage_scan, board_run_scan, tolerant_scan, board_union, audit_summaries, event_lookup, version_links, compaction_edges)}

ORACLES = {
    "report_lines": f"""WITH {audit._GAPS}, {audit._ABSENT},
        f AS (SELECT 'sequence gap: missing #' || missing_sequence || ' (between ' || prev_sequence || ' and ' || next_sequence || ')' AS detail FROM gaps UNION ALL SELECT 'uncaptured execution: ' || o_orderkey || ' (orders)' FROM absent)
        SELECT 0 AS part, count(*) || ' finding(s):' AS line FROM f UNION ALL SELECT 1, '  ' || rpad('reconcile.gap_detected', 28, ' ') || '  ' || detail FROM f UNION ALL SELECT 2, 'summary: reconcile.gap_detected=' || count(*) FROM f""",
    "task_lines": f"""WITH {activity._BOARD}, k AS (SELECT DISTINCT task_id, run_id FROM moved WHERE event_type = 'task.claimed' UNION SELECT task_id, run_id FROM disp)
        SELECT k.task_id, '      run ' || k.run_id || '  h' || (k.run_id % 7) || '  ' || coalesce(d.outcome || '/' || d.disposition, 'running') AS line FROM k LEFT JOIN disp d USING (run_id)""",
    "security_lines": f"""WITH {knowledge._SECRETS}, p AS (SELECT 'assigned_secret' AS type, * FROM pos UNION ALL SELECT 'access_key', doc_id, w, octet_length(encode(left(text, strpos(text, w) - 1))) FROM (SELECT doc_id, text, regexp_extract(text, '\\b(AKIA[0-9A-Z]{{16}})\\b', 1) AS w FROM documents) WHERE w <> ''),
        g AS (SELECT type, value, min(doc_id) AS d, arg_min(byte_start, doc_id * 1000000 + byte_start) AS b, count(*) AS n FROM p GROUP BY ALL)
        SELECT '  ' || type || '  target=body bytes=' || b || ':' || (b + len(value)) || ' first_event=' || d || ' occurrences=' || n AS line FROM g""",
    "version_lines": f"""WITH {knowledge._CHAIN} SELECT artifact_id, seq, 'v' || seq || '  ' || rpad('scan', 10, ' ') || '  2024-01-01T00:00:00Z  ' || CASE WHEN tombstone THEN 'none' ELSE 'sha256:' || left(sha256(e), 12) END
        || '  ' || CASE WHEN seq % 3 > 0 THEN 'event✓' ELSE 'event✗' END || CASE WHEN tombstone THEN ' tombstone' ELSE '' END AS line FROM (SELECT chain.*, st.event_type AS e FROM chain JOIN st USING (artifact_id, at_seq))""",
    "pass_counts": f"""WITH {LEDGER_SQL}, {activity._MSG}, e AS (SELECT event_type AS t FROM ledger UNION ALL SELECT CASE WHEN role = 'user' THEN 'invocation.started' WHEN turn % 4 = 1 THEN 'model.call_succeeded' ELSE 'invocation.completed' END FROM msg)
        SELECT 'event ' || t AS what, count(*) AS n FROM e GROUP BY t UNION ALL VALUES ('source messages', 1), ('source broken', 0), ('source executions', 1)""",
    "usage_scan": f"WITH {LEDGER_SQL} SELECT producer_sequence, session_id FROM ledger WHERE event_type = 'model.usage_recorded' AND session_id IN (SELECT session_id FROM ledger WHERE event_type = 'model.call_failed' AND value > 15)",
    "board_run_scan": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 8936 OR o_orderstatus = 'O' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity = 1)",
    "tolerant_scan": "SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(0 AS BIGINT) AS message_count, 1 AS expiry_finalized, CAST(NULL AS VARCHAR) AS model FROM supplier",
    "board_union": "SELECT 'a' AS board, count(*) AS tasks, count(*) AS known FROM customer UNION ALL SELECT 'b', count(*), 0 FROM customer",
    "audit_summaries": "SELECT event_id % 97 = 13 AS pruned, count(*) AS events, max(event_id) + 1 AS last FROM events GROUP BY 1",
    "event_lookup": f"WITH {LEDGER_SQL} SELECT producer_sequence, event_type FROM ledger WHERE event_id = 77",
    "version_links": f"WITH {knowledge._CHAIN} SELECT artifact_id, seq, CASE WHEN seq % 3 > 0 AND seq % 2 = 0 THEN 'foreground' ELSE 'scan' END AS origin, CASE WHEN seq % 3 > 0 THEN CASE WHEN seq % 2 = 0 THEN 2 ELSE 3 END END AS linked_event FROM chain",
    "compaction_edges": "SELECT 'state.db:knowledge-compacted:' || c_custkey || ':c' AS dedup_key, CAST(c_custkey AS VARCHAR) AS source, CAST(c_custkey + 1 AS VARCHAR) AS target FROM customer WHERE c_custkey % 6 = 3",
}
