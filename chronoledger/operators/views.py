"""Read views: relational results first, text lines last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from ..schema import FINDINGS, TASK_EVENTS, TASK_TERMINALS


def select_events(events: DataFrame, session: str | None = None, since: float | None = None) -> DataFrame:
    """Events that a session takes part in, at or after `since` (a missing time
    is 0)."""
    if since is not None:
        events = events.filter(S.epoch_or_zero("occurred_at") >= since)
    if session is not None:
        events = events.filter((F.col("correlation_id") == session) | (F.col("session_id") == session) | (F.col("parent_session_id") == session))
    return events


def stream_order() -> list[Column]:
    return [F.coalesce("installation_id", F.lit("")), F.coalesce("producer_sequence", F.lit(0))]


def stream_lines(events: DataFrame) -> DataFrame:
    """(installation_id, producer_sequence, line): one line for each event."""
    events = events.withColumn("_fields", S.payload_fields("payload"))
    summary = S.payload_summary("event_type", "_fields", "content_hash", "partial")
    line = F.concat(
        F.lpad(F.col("producer_sequence").cast("string"), F.greatest(F.lit(6), F.char_length(F.col("producer_sequence").cast("string"))), F.lit(" ")), F.lit("  "), S.iso_utc("occurred_at"), F.lit("  "),
        _padded(F.coalesce("event_type", F.lit("?")), 26), F.lit("  "), _padded(F.coalesce(F.nullif("session_id", F.lit("")), F.lit("-")), 24), F.lit("  "), summary,
    )
    return events.select("installation_id", "producer_sequence", F.rtrim(line).alias("line"))


def _padded(x: Column, width: int) -> Column:
    return F.rpad(x, F.greatest(F.lit(width), F.char_length(x)), F.lit(" "))


def findings(events: DataFrame) -> DataFrame:
    """Reconciler findings with what they found in words."""
    return events.filter(F.col("event_type").isin(*FINDINGS)).withColumn("detail", S.finding_detail("event_type", "payload"))


def findings_by_type(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(*FINDINGS)).groupBy("event_type").agg(F.count(F.lit(1)).alias("findings"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def task_attempts(events: DataFrame) -> DataFrame:
    """(board, task_id, run_id, first_seen, holder, outcome, disposition) of each
    attempt, claims and ends matched by run; `running` without an end."""
    key = ["board", "task_id", "run_id"]
    last = lambda kind: F.max_by(F.struct("holder", "run_outcome", "attempt_disposition"), F.when(F.col("event_type") == kind, F.struct(*stream_order())))
    # Whether a key is whole is asked of the group: a filter on its fields would reach
    # the payloads that they come from and parse each once more a field.
    whole = F.max(F.col("run_id").isNotNull() & F.col("board").isNotNull() & F.col("task_id").isNotNull())
    both = events.groupBy(*key).agg(F.min(S.epoch_or_zero("occurred_at")).alias("first_seen"), last("task.claimed").alias("claim"), last("task.attempt_ended").alias("end"), whole.alias("whole")).filter("whole and (claim is not null or end is not null)")
    done = F.col("end").isNotNull()
    return both.select(
        *key, "first_seen", F.coalesce(F.when(done, F.col("end.holder")).otherwise(F.col("claim.holder")), F.lit("?")).alias("holder"),
        F.when(done, F.coalesce("end.run_outcome", F.lit("?"))).otherwise("running").alias("outcome"), F.when(done, F.coalesce("end.attempt_disposition", F.lit("?"))).alias("disposition"),
    )


def task_board(events: DataFrame) -> DataFrame:
    """(board, task_id, status, holder, held, claim_expires, terminals) of each
    task: status of the newest event that is no attempt's end, and the latest
    holder, who holds it unless the claim's run has ended."""
    own = events.filter(F.col("event_type").isin(*TASK_EVENTS)).withColumn("board", F.coalesce(F.nullif("board", F.lit("")), F.lit("-"))).withColumn("task_id", F.coalesce(F.nullif("task_id", F.lit("")), F.lit("-")))
    order = F.struct(*stream_order())
    said = F.when(F.col("event_type") != "task.attempt_ended", order)
    taken = F.when(F.col("holder").isNotNull(), F.struct(S.epoch_or_zero("occurred_at").alias("t"), order.alias("o")))
    # By run first: whether a run has ended is known where its claim is.
    runs = own.groupBy("board", "task_id", "run_id").agg(
        F.max_by(F.coalesce(F.nullif("status", F.lit("")), F.lit("?")), said).alias("status"), F.max(said).alias("said"),
        F.max_by(F.struct("holder", "event_type", "claim_expires"), taken).alias("h"), F.max(taken).alias("taken"),
        (F.max(F.col("event_type") == "task.attempt_ended") & F.col("run_id").isNotNull()).alias("ended"), F.count(F.when(F.col("event_type").isin(*TASK_TERMINALS), 1)).alias("terminals"),
    )
    tasks = runs.groupBy("board", "task_id").agg(F.coalesce(F.max_by("status", "said"), F.lit("?")).alias("status"), F.max_by(F.struct("h.*", "ended"), "taken").alias("h"), F.sum("terminals").alias("terminals"))
    held = (F.col("h.event_type") == "task.claimed") & ~F.col("h.ended")
    return tasks.select("board", "task_id", "status", F.col("h.holder").alias("holder"), F.when(F.col("h.holder").isNotNull(), held).alias("held"), F.when(F.col("h.holder").isNotNull(), F.col("h.claim_expires")).alias("claim_expires"), "terminals")


def terminal_detail(event_type: Column, kind: Column, block_kind: Column) -> Column:
    """A task's terminal with the transition behind it."""
    return (
        F.when((event_type == "task.blocked") & (F.coalesce(block_kind, F.lit("")) != ""), F.concat(event_type, F.lit("  ("), F.coalesce(kind, F.lit("None")), F.lit(", block_kind="), block_kind, F.lit(")")))
        .when(F.coalesce(kind, F.lit("")) != "", F.concat(event_type, F.lit("  ("), kind, F.lit(")"))).otherwise(event_type)
    )


def terminal_lines(events: DataFrame) -> DataFrame:
    """(board, task_id, ord, line) of tasks' ends, after the lines of task_lines: a
    head and a line for each end in stream order.  events: with kind and block_kind."""
    ends = events.filter(F.col("event_type").isin(*TASK_TERMINALS)).select(
        F.coalesce(F.nullif("board", F.lit("")), F.lit("-")).alias("board"), F.coalesce(F.nullif("task_id", F.lit("")), F.lit("-")).alias("task_id"), F.coalesce("producer_sequence", F.lit(0)).cast("long").alias("at"),
        terminal_detail(F.col("event_type"), F.col("kind"), F.col("block_kind")).alias("detail"),
    )
    place = lambda part, run: F.struct(F.lit(part).alias("part"), F.struct(F.lit(0.0).alias("t"), run.alias("run")).alias("at")).alias("ord")
    head = ends.select("board", "task_id").distinct().select("board", "task_id", place(3, F.lit(0).cast("long")), F.lit("    terminals:").alias("line"))
    return head.unionByName(ends.select("board", "task_id", place(4, F.col("at")), F.concat(F.lit("      "), "detail").alias("line")))


def tree_lines(nodes: DataFrame) -> DataFrame:
    """(root, id, depth, line) of sessions (root, id, depth, kind, status,
    input_tokens, output_tokens, cost, subtree_input, subtree_output,
    subtree_cost); roots show their subtree as well."""
    money = lambda c: F.format_string("%.4f", F.col(c))
    text = lambda c: F.col(c).cast("string")
    head = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("depth") == 0, "●").otherwise("○"), F.lit(" "), "kind", F.lit(" "), text("id"), F.lit("  ["), "status", F.lit("]  tokens="), text("input_tokens"), F.lit("/"), text("output_tokens"), F.lit("  cost=$"), money("cost"))
    below = F.concat(F.lit("  (subtree tokens="), text("subtree_input"), F.lit("/"), text("subtree_output"), F.lit(" cost=$"), money("subtree_cost"), F.lit(")"))
    return nodes.select("root", "id", "depth", F.concat(head, F.when(F.col("depth") == 0, below).otherwise("")).alias("line"))


def version_lines(versions: DataFrame, shipped: DataFrame) -> DataFrame:
    """(artifact_id, seq, line) of a version history; shipped: (artifact_id, seq)
    of versions that an event carried."""
    known = versions.join(shipped.select("artifact_id", "seq", F.lit(True).alias("event")).distinct(), ["artifact_id", "seq"], "left")
    line = F.concat(
        F.lit("v"), F.col("seq").cast("string"), F.lit("  "), _padded(F.col("origin"), 10), F.lit("  "), S.iso_utc("occurred_at"), F.lit("  "), S.short_hash("manifest_hash"), F.lit("  "),
        F.when(F.col("event"), "event✓").otherwise("event✗"), F.when(F.col("tombstone"), " tombstone").otherwise(""),
    )
    return known.select("artifact_id", "seq", line.alias("line"))


def report_lines(events: DataFrame) -> DataFrame:
    """(ord, line) of the findings report: a head, a line for each finding in
    stream order, and a summary; one line if there is nothing to report."""
    found = findings(events)
    detail = found.select(F.struct(F.lit(1).alias("part"), F.coalesce("installation_id", F.lit("")).alias("i"), F.coalesce("producer_sequence", F.lit(0)).alias("s")).alias("ord"), F.concat(F.lit("  "), _padded(F.col("event_type"), 28), F.lit("  "), F.col("detail")).alias("line"))
    counts = findings_by_type(events)
    total = counts.agg(F.coalesce(F.sum("findings"), F.lit(0)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "findings"))), lambda c: F.concat(c["event_type"], F.lit("="), c["findings"].cast("string"))), ", ").alias("types"))
    at = lambda part: F.struct(F.lit(part).alias("part"), F.lit("").alias("i"), F.lit(0).cast("long").alias("s"))
    head = total.select(at(0).alias("ord"), F.when(F.col("n") == 0, "clean: no gaps, missing terminals, or missed cron runs").otherwise(F.concat(F.col("n").cast("string"), F.lit(" finding(s):"))).alias("line"))
    foot = total.filter("n > 0").select(at(2).alias("ord"), F.concat(F.lit("summary: "), F.col("types")).alias("line"))
    return head.unionByName(detail).unionByName(foot)


def security_lines(groups: DataFrame) -> DataFrame:
    """(fingerprint, line) of secret groups, without any part of the secret."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(F.lit("  "), text("type"), F.lit("  target="), text("target"), F.lit(" bytes="), text("byte_start"), F.lit(":"), text("byte_end"), F.lit(" first_event="), text("first_event"), F.lit(" occurrences="), text("occurrences"), F.lit(" fingerprint="), F.col("fingerprint"))
    return groups.select("fingerprint", line.alias("line"))


def task_lines(board: DataFrame, attempts: DataFrame) -> DataFrame:
    """(board, task_id, ord, line): a task, its holder, and its attempts from the
    first seen on."""
    text = lambda c: F.col(c).cast("string")
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("run"))
    task = board.select("board", "task_id", F.struct(F.lit(0).alias("part"), zero.alias("at")).alias("ord"), F.concat(F.lit("▣ task "), "task_id", F.lit("  ["), "status", F.lit("]  board="), "board").alias("line"))
    lease = F.when(F.col("claim_expires").isNotNull(), F.concat(F.lit("  expires="), text("claim_expires"))).otherwise("")
    holder = board.filter("holder is not null").select("board", "task_id", F.struct(F.lit(1).alias("part"), zero.alias("at")).alias("ord"), F.concat(F.lit("    holder "), "holder", F.lit("  ["), F.when(F.col("held"), "held").otherwise("released"), F.lit("]"), lease).alias("line"))
    outcome = F.when(F.col("outcome") == "running", F.col("outcome")).otherwise(F.concat("outcome", F.lit("/"), "disposition"))
    runs = attempts.select("board", "task_id", F.struct(F.lit(2).alias("part"), F.struct(F.col("first_seen").cast("double").alias("t"), F.col("run_id").cast("long").alias("run")).alias("at")).alias("ord"), F.concat(F.lit("      run "), text("run_id"), F.lit("  "), "holder", F.lit("  "), outcome).alias("line"))
    return task.unionByName(holder).unionByName(runs)
