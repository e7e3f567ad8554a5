"""Detectors: pure functions of ledger, tombstones, sources and a given `now`
to findings with a stable dedup_key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions.schedule import Cron, cron_fields, instants_of
from ..sources.scans import active_jobs
from .lineage import cut
from .mappers import payload_of

#: Sequences that one bucket of the gap scan covers.
GAP_BUCKET = 1_000_000

#: Sequences of one gap that are told at a time.
GAP_PIECE = 100_000

FINDING = ("event_type", "occurred_at", "correlation_id", "session_id", "partial", "payload", "dedup_key")


def finding(df: DataFrame, event_type: str, occurred_at: Column, correlation: Column, dedup_key: Column, partial: bool = True, session: Column | None = None, **details: Column) -> DataFrame:
    return df.select(
        F.lit(event_type).alias("event_type"), occurred_at.cast("double").alias("occurred_at"), correlation.cast("string").alias("correlation_id"),
        (F.lit(None) if session is None else session).cast("string").alias("session_id"), F.lit(partial).alias("partial"),
        payload_of(event_type=F.lit(event_type), **details).alias("payload"), dedup_key.alias("dedup_key"),
    )


def occurred_before(horizon: float, at: Column) -> Column:
    """Whether a time is known and before the horizon."""
    return F.coalesce(S.to_epoch(at) < horizon, F.lit(False))


def after_capture_horizon(method: Column, occurred_at: Column, horizon: float) -> Column:
    """False for polled events from before the horizon.  Heartbeats and events
    without a time pass."""
    at = S.epoch_or_zero(occurred_at)
    return ~(method.startswith("poll:") & (method != "poll:cron:heartbeat") & (at > 0) & (at < horizon))


def stored_sequences(retained: DataFrame, pruned: DataFrame, through: int | None = None) -> DataFrame:
    """(installation_id, seq), each once, of both tables up to `through`."""
    pick = lambda df: df.select("installation_id", F.col("producer_sequence").alias("seq"))
    both = pick(retained).union(pick(pruned))
    return (both if through is None else both.filter(F.col("seq") <= through)).distinct()


def sequence_gaps(stored: DataFrame, high_water: DataFrame, limit: int | None = None, bucket: int = GAP_BUCKET, piece: int = GAP_PIECE) -> DataFrame:
    """The missing sequences from 1 to the high water, all or the first `limit`,
    each with its neighbours: (installation_id, missing_sequence, prev_sequence,
    next_sequence).

    stored: (installation_id, seq) distinct.  high_water: (installation_id,
    high).  Neighbours are looked up within buckets of the sequence and, for a
    bucket's first, in a table of one row per bucket: no task gets a whole
    installation.
    """
    marked = high_water.select("installation_id", (F.col("high") + 1).alias("seq"))
    rows = stored.join(high_water, "installation_id").filter("seq between 1 and high").select("installation_id", "seq").unionByName(marked)
    rows = rows.withColumn("b", F.expr(f"seq div {bucket}"))
    earlier = Window.partitionBy("installation_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("installation_id", "b").agg(F.max("seq").alias("last")).select("installation_id", "b", F.coalesce(F.max("last").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("installation_id", "b").orderBy("seq")
    near = rows.join(ends, ["installation_id", "b"]).withColumn("prev", F.coalesce(F.lag("seq").over(within), F.col("before"))).filter("seq > prev + 1")
    gaps = near.select("installation_id", F.col("prev").alias("prev_sequence"), F.col("seq").alias("next_sequence"))
    # Of a long gap the pieces come first, so no row holds all of its sequences.
    until = F.col("next_sequence") - 1 if limit is None else F.least(F.col("next_sequence") - 1, F.col("prev_sequence") + limit)
    pieces = gaps.select("*", until.alias("_until"), F.explode(F.sequence(F.col("prev_sequence") + 1, until, F.lit(piece).cast("long"))).alias("_from"))
    missing = pieces.select("installation_id", "prev_sequence", "next_sequence", F.explode(F.sequence(F.col("_from"), F.least("_until", F.col("_from") + piece - 1))).alias("missing_sequence"))
    if limit is None:
        return missing.select("installation_id", "missing_sequence", "prev_sequence", "next_sequence")
    return missing.orderBy("missing_sequence", "installation_id").limit(limit).select("installation_id", "missing_sequence", "prev_sequence", "next_sequence")


def gap_findings(gaps: DataFrame, now: float) -> DataFrame:
    """A lost sequence is a fact, so these are not partial."""
    return finding(
        gaps, "reconcile.gap_detected", F.lit(now), F.col("installation_id"), F.concat_ws(":", F.lit("reconcile:seq"), "installation_id", F.col("missing_sequence").cast("string")), partial=False,
        gap_kind=F.lit("sequence"), missing_sequence=F.col("missing_sequence"), prev_sequence=F.col("prev_sequence"), next_sequence=F.col("next_sequence"),
    )


def captured_subjects(events: DataFrame, null_part: str | None = None) -> DataFrame:
    """(subject_type, subject_id) that events cover, each once.  Any event with a
    message_row_id covers that message.  Parts of a composite id that are null
    make it null, and null ids cover nothing; only usage is known with null parts
    too, if `null_part` says how they are spelled."""
    # A payload is parsed once for all names.
    names = ("message_row_id", "model", "task", "execution_id", "board", "task_id", "run_id")
    events = events.select("event_type", "session_id", F.json_tuple("payload", *names).alias(*[f"_{name}" for name in names]))
    kind, get = F.col("event_type"), lambda name: F.col(f"_{name}")
    pair = lambda a, b: F.concat(a, F.lit(":"), b)
    part = lambda x: x if null_part is None else F.coalesce(x, F.lit(null_part))
    task = kind.startswith("task.")
    covers = {
        "session": F.when(kind.isin("session.created", "subagent.child_spawned"), F.col("session_id")),
        "message": get("message_row_id"),
        "model_usage": F.when(kind == "model.usage_recorded", F.concat(part(F.col("session_id")), F.lit(":"), part(get("model")), F.lit(":"), part(get("task")))),
        "execution": F.when(kind == "cron.run_claimed", get("execution_id")),
        "task": F.when(task, pair(get("board"), get("task_id"))),
        "task_run": F.when(task, pair(get("board"), get("run_id"))),
    }
    subjects = F.array(*[F.struct(F.lit(name).alias("subject_type"), subject.alias("subject_id")) for name, subject in covers.items()])
    return events.select(F.inline(F.filter(subjects, lambda s: s["subject_id"].isNotNull()))).distinct()


def uncaptured(durable: DataFrame, captured: DataFrame, horizon: float = 0.0) -> DataFrame:
    """Durable rows (subject_type, subject_id, source_table, correlation_id,
    session_id, at) that no event covers and that are not from before the
    horizon.  A null id is never covered."""
    return durable.filter(~occurred_before(horizon, F.col("at"))).join(captured, ["subject_type", "subject_id"], "left_anti")


def with_grace(absent: DataFrame, seen: DataFrame, now: float, grace: float) -> tuple[DataFrame, DataFrame]:
    """(ready, seen): absent rows seen first at least `grace` ago, and the table
    of first sightings (subject_type, subject_id, first_seen) to keep.  Rows that
    are no longer absent lose their sighting; without grace all are ready."""
    keys = ["subject_type", "subject_id"]
    joined = absent.join(seen.select(*keys, "first_seen"), keys, "left")
    kept = joined.select(*keys, F.coalesce("first_seen", F.lit(now)).alias("first_seen"))
    ready = joined if grace <= 0 else joined.filter(F.lit(now) - F.col("first_seen") >= grace)
    return ready.drop("first_seen"), kept


def coverage_findings(ready: DataFrame, now: float) -> DataFrame:
    return finding(
        ready, "reconcile.gap_detected", F.lit(now), F.col("correlation_id"), F.concat_ws(":", F.lit("reconcile:cover"), "subject_type", "subject_id"), session=F.col("session_id"),
        gap_kind=F.lit("uncaptured_row"), subject_type=F.col("subject_type"), subject_id=F.col("subject_id"), source_table=F.col("source_table"),
    )


def missing_terminals(events: DataFrame, now: float, timeout: float, horizon: float = 0.0) -> DataFrame:
    """First starts of invocations without an end, older than `timeout` and not
    from before the horizon: (invocation_id, occurred_at, session_id,
    correlation_id, age_seconds).  Starts without a time are not judged."""
    own = events.filter("invocation_id is not null")
    starts = own.filter("event_type = 'invocation.started'").groupBy("invocation_id").agg(F.min_by(F.struct("occurred_at", "session_id", "correlation_id"), F.struct("arrival", "producer_sequence")).alias("s")).select("invocation_id", "s.*")
    ends = own.filter("event_type = 'invocation.completed'").select("invocation_id").distinct()
    age = F.lit(now) - F.col("occurred_at")
    return starts.join(ends, "invocation_id", "left_anti").filter((F.col("occurred_at") >= horizon) & (age > timeout)).withColumn("age_seconds", age)


def terminal_findings(missing: DataFrame, now: float) -> DataFrame:
    return finding(
        missing, "reconcile.terminal_missing", F.lit(now), F.col("correlation_id"), F.concat(F.lit("reconcile:terminal:invocation:"), F.col("invocation_id")), session=F.col("session_id"),
        subject_type=F.lit("invocation"), subject_id=F.col("invocation_id"), start_event_type=F.lit("invocation.started"), expected_terminal_event_type=F.lit("invocation.completed"), start_occurred_at=F.col("occurred_at"), age_seconds=F.col("age_seconds"),
    )


def dead_leases(runs: DataFrame, now: float, grace: float, stale: float) -> DataFrame:
    """Open runs whose claim expired more than `grace` ago and whose last
    heartbeat, if any, is older than `stale`."""
    alive = F.coalesce(F.lit(now) - F.col("last_heartbeat_at") <= stale, F.lit(False))
    return runs.filter(F.col("outcome").isNull() & (F.lit(now) - F.col("claim_expires") > grace) & ~alive)


def lease_findings(dead: DataFrame, now: float) -> DataFrame:
    run = F.col("id").cast("string")
    return finding(
        dead, "reconcile.terminal_missing", F.lit(now), F.col("task_id"), F.concat_ws(":", F.lit("reconcile:terminal:task_run"), "board", run),
        subject_type=F.lit("task_run"), subject_id=run, start_event_type=F.lit("task.claimed"), expected_terminal_event_type=F.lit("task.attempt_ended"), board=F.col("board"), task_id=F.col("task_id"), run_id=F.col("id"),
        holder=F.col("claim_lock"), claim_expires=F.col("claim_expires"), last_heartbeat_at=F.col("last_heartbeat_at"), start_occurred_at=F.col("started_at"), age_seconds=F.lit(now) - F.col("claim_expires"),
    )


# -- schedules ---------------------------------------------------------------

_RUNS = "array<struct<first:double,missed:bigint,tail:boolean>>"


def interval_misses(jobs: DataFrame, now: float) -> DataFrame:
    """Missed fires of interval jobs: (job_id, first, missed, tail).

    jobs: (job_id, fires: sorted array<double>, created, step, slack).  Each
    real fire near the expected time moves the next expectation to itself plus
    the step; fires between the bands are passed over without moving it.  A row
    for each run of misses in a row; the last one is a tail if it is still open.

    The state machine is a fold over the fires: between two fires that it
    accepts the number of misses follows by division, so its length is that of
    the fires, not of the time that has passed.
    """
    fires, step, slack = F.col("fires"), F.col("step"), F.col("slack")
    deadline = F.lit(now) - slack

    def advance(a: Column, f: Column) -> Column:
        """One fire: misses until the expectation reaches it, then accept or pass over."""
        # Expectations e with e + slack < f are missed, as long as they are due.
        gap = F.greatest(F.lit(0.0), F.ceil((f - slack - a["e"]) / step))
        due = F.greatest(F.lit(0.0), F.floor((deadline - a["e"]) / step) + 1)
        passed = F.least(gap, due)
        e = a["e"] + passed * step
        n = a["n"] + passed.cast("bigint")
        first = F.when((a["n"] == 0) & (passed > 0), a["e"]).otherwise(a["first"])
        stopped = a["stopped"] | (e > F.lit(now) + slack) | (passed < gap)
        hit = ~stopped & (f >= e - slack) & (f <= e + slack)
        closed = F.when(hit & (n > 0), F.concat(a["runs"], F.array(F.struct(first.alias("first"), n.alias("missed"), F.lit(False).alias("tail"))))).otherwise(a["runs"])
        moved = F.struct(F.when(hit, f + step).otherwise(e).alias("e"), F.when(hit, F.lit(0)).otherwise(n).cast("bigint").alias("n"), F.when(hit, F.lit(None)).otherwise(first).cast("double").alias("first"), stopped.alias("stopped"), closed.cast(_RUNS).alias("runs"))
        return F.when(a["stopped"], a).otherwise(moved)

    def close(a: Column) -> Column:
        due = F.when(a["stopped"], F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.floor((deadline - a["e"]) / step) + 1))
        n, first = a["n"] + due.cast("bigint"), F.when((a["n"] == 0) & (due > 0), a["e"]).otherwise(a["first"])
        return F.when(n > 0, F.concat(a["runs"], F.array(F.struct(first.alias("first"), n.alias("missed"), F.lit(True).alias("tail"))))).otherwise(a["runs"]).cast(_RUNS)

    start = F.struct((F.get(fires, F.lit(0)) + step).alias("e"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("first"), F.lit(False).alias("stopped"), F.array().cast(_RUNS).alias("runs"))
    walked = F.aggregate(fires, start, advance, close)
    first = F.col("created") + step
    never = F.when(F.col("created").isNotNull() & (deadline >= first), F.array(F.struct(first.alias("first"), F.greatest(F.lit(1), F.floor((deadline - F.col("created")) / step)).cast("bigint").alias("missed"), F.lit(True).alias("tail")))).otherwise(F.array()).cast(_RUNS)
    runs = F.when(F.size(fires) > 0, walked).otherwise(never)
    return jobs.select("job_id", F.inline(runs))


def once_misses(jobs: DataFrame, now: float) -> DataFrame:
    """Jobs due once (job_id, run_at, slack, fires) that did not fire near their time."""
    near = F.exists("fires", lambda f: F.abs(f - F.col("run_at")) <= F.col("slack"))
    return jobs.filter((F.col("run_at") + F.col("slack") <= now) & ~near).select("job_id", F.col("run_at").alias("first"), F.lit(1).cast("long").alias("missed"), F.lit(False).alias("tail"))


def cron_misses(jobs: DataFrame, fires: DataFrame, cron: Cron, now: float, lookback: float, slack: float, zone_seconds: int = 0) -> DataFrame:
    """Missed instants of jobs with one cron expression: (job_id, first, missed,
    tail), a row for each run of misses between hits.

    jobs: (job_id, created).  fires: (job_id, at).  Expected instants start at
    the first fire (or the creation), at most `lookback` ago.  A hit is a fire
    within `slack`.  Instants later than now - slack are no misses and no breaks.
    """
    first = fires.groupBy("job_id").agg(F.min("at").alias("first_fire"))
    anchored = jobs.join(first, "job_id", "left").withColumn("lower", F.greatest(F.coalesce("first_fire", "created"), F.lit(now - lookback))).filter("lower is not null")
    due = anchored.select("job_id", F.explode(instants_of(cron.values(), F.col("lower"), F.lit(now), F.lit(zone_seconds))).alias("instant"))
    return _runs_of_misses(due, fires, now, slack)


def _runs_of_misses(due: DataFrame, fires: DataFrame, now: float, slack: float) -> DataFrame:
    """(job_id, first, missed, tail) of expected instants (job_id, instant).

    Instants and fires are sorted together by job, so the nearest fire on either
    side is known without a join, and the runs follow in the same order: one
    shuffle.
    """
    marks = due.select("job_id", F.col("instant").cast("double").alias("t"), "instant").unionByName(fires.filter("at is not null").select("job_id", F.col("at").cast("double").alias("t"), F.lit(None).cast("bigint").alias("instant"))).filter("job_id is not null")
    fire = F.when(F.col("instant").isNull(), F.col("t"))
    # Of one time fires come first, seen from either side.
    back = Window.partitionBy("job_id").orderBy("t", F.col("instant").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("job_id").orderBy(F.desc("t"), F.col("instant").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = marks.withColumn("before", F.last(fire, ignorenulls=True).over(back)).withColumn("after", F.last(fire, ignorenulls=True).over(ahead)).filter("instant is not null")
    close = lambda c: F.coalesce(F.abs(F.col(c) - F.col("instant")) <= slack, F.lit(False))
    hit = near.select("job_id", "instant", (close("before") | close("after")).alias("hit"))
    w, whole = Window.partitionBy("job_id").orderBy("instant"), Window.partitionBy("job_id")
    judged = hit.withColumn("island", F.sum(F.col("hit").cast("int")).over(w)).withColumn("last", F.max("instant").over(whole)).withColumn("newest", F.sum(F.col("hit").cast("int")).over(whole))
    islands = judged.filter(~F.col("hit") & (F.col("instant") <= now - slack)).groupBy("job_id", "island").agg(F.min("instant").cast("double").alias("first"), F.count(F.lit(1)).alias("missed"), F.max("last").alias("last"), F.max("newest").alias("newest"))
    return islands.select("job_id", "first", "missed", ((F.col("island") == F.col("newest")) & (F.col("last") >= now - 60)).alias("tail"))


def cron_job_misses(jobs: DataFrame, fires: DataFrame, now: float, lookback: float, slack: float) -> DataFrame:
    """cron_misses of jobs that each have an expression and a zone of their own:
    (job_id, first, missed, tail), all in one plan.

    jobs: (job_id, expression, created_at, next_run_at: ISO texts).  The zone is
    the offset of created_at, else of next_run_at, else UTC.  Jobs whose
    expression is no valid one expect nothing.  The instants of a job are made of
    the days, hours and minutes that its fields allow, not filtered from all
    minutes.
    """
    first = fires.groupBy("job_id").agg(F.min("at").alias("first_fire"))
    offset = lambda c: F.when(F.col(c).rlike(r"(Z|[+-]\d\d:?\d\d)$"), S.zone_seconds(c))
    # Without a valid expression there are no instants; a filter would parse it twice.
    known = jobs.withColumn("cron", cron_fields(F.col("expression"))).withColumn("zone", F.coalesce(offset("created_at"), offset("next_run_at"), F.lit(0)))
    anchored = known.join(first, "job_id", "left").withColumn("lower", F.greatest(F.coalesce("first_fire", S.to_epoch("created_at")), F.lit(now - lookback))).filter("lower is not null")
    due = anchored.select("job_id", F.explode(instants_of(F.col("cron"), F.col("lower"), F.lit(now), F.col("zone"))).alias("instant"))
    return _runs_of_misses(due, fires, now, slack)


def job_misses(jobs: DataFrame, runs: DataFrame, now: float, slack: float, once_slack: float, lookback: float) -> DataFrame:
    """(job_id, kind, first, missed, tail) of all jobs that are active, each by
    its kind of schedule; other kinds, and schedules that say nothing, expect
    nothing.  jobs: of scans.jobs.  runs: (job_id, claimed_epoch).  Jobs are
    written once: their document is a text that one task parses, and each kind
    would parse it anew."""
    active = cut(active_jobs(jobs).withColumnRenamed("id", "job_id").withColumn("kind", F.col("schedule.kind")))
    fires = runs.filter("claimed_epoch is not null").select("job_id", F.col("claimed_epoch").alias("at"))
    listed = fires.groupBy("job_id").agg(F.array_sort(F.collect_list("at")).alias("fires"))
    none = F.array().cast("array<double>")
    of = lambda kind: active.filter(F.col("kind") == kind).join(listed, "job_id", "left").withColumn("fires", F.coalesce("fires", none))
    text = lambda name: F.nullif(F.col(f"schedule.{name}"), F.lit(""))
    every = of("interval").filter("schedule.minutes > 0").select("job_id", "fires", S.to_epoch("created_at").alias("created"), (F.col("schedule.minutes") * 60).alias("step"), F.lit(slack).alias("slack"))
    once = of("once").select("job_id", "fires", S.to_epoch(F.coalesce(text("run_at"), "next_run_at")).alias("run_at"), F.lit(once_slack).alias("slack"))
    cron = active.filter("kind = 'cron'").select("job_id", F.coalesce(text("expression"), text("cron"), text("expr")).alias("expression"), "created_at", "next_run_at")
    parts = {"interval": interval_misses(every, now), "once": once_misses(once, now), "cron": cron_job_misses(cron, fires, now, lookback, slack)}
    out = None
    for kind, found in parts.items():
        tagged = found.select("job_id", F.lit(kind).alias("kind"), "first", "missed", "tail")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def schedule_findings(misses: DataFrame, ticker_stale: bool, horizon: float = 0.0) -> DataFrame:
    """A finding for each run of misses, at the time of its first; tails are not
    told while the ticker is dead, nor what was due before the horizon."""
    told = misses.filter(F.col("first") >= horizon)
    told = told.filter(~F.col("tail")) if ticker_stale else told
    kind = F.col("kind") if "kind" in misses.columns else F.lit(None).cast("string")
    return finding(
        told, "cron.run_missed", F.col("first"), F.col("job_id"), F.concat_ws(":", F.lit("reconcile:missed"), F.col("job_id").cast("string"), F.col("first").cast("long").cast("string")),
        job_id=F.col("job_id").cast("string"), expected_fire_at=F.col("first"), missed_count=F.col("missed"), schedule_kind=kind, catch_up=F.col("missed") > 1,
    )


# -- runtime -------------------------------------------------------------------

def ticker_findings(heartbeat: DataFrame, now: float, stale: float) -> DataFrame:
    """heartbeat: (value), null if there is none."""
    late = heartbeat.filter(F.lit(now) - F.col("value") > stale)
    return finding(late, "reconcile.terminal_missing", F.lit(now), F.lit("cron:ticker"), F.concat(F.lit("reconcile:ticker_stale:"), F.col("value").cast("long").cast("string")), subject_type=F.lit("cron_ticker"), subject_id=F.lit("cron:ticker"), start_event_type=F.lit("cron.ticker_heartbeat"), expected_terminal_event_type=F.lit("cron.ticker_heartbeat"), heartbeat=F.col("value"), staleness_seconds=F.lit(now) - F.col("value"))


def capture_findings(last_success: DataFrame, installation: str, now: float, threshold: float) -> DataFrame:
    late = last_success.filter(F.lit(now) - F.col("value") > threshold)
    return finding(late, "reconcile.capture_stale", F.lit(now), F.lit(installation), F.concat(F.lit("reconcile:capture_stale:"), F.col("value").cast("long").cast("string")), last_success_at=F.col("value"), staleness_seconds=F.lit(now) - F.col("value"), threshold_seconds=F.lit(threshold))


GATEWAY_STATE = "gateway_state string, exit_reason string, updated_at string, platforms map<string,struct<state:string,error_code:string,error_message:string,updated_at:string>>"


def gateway_findings(states: DataFrame, now: float, column: str = "value") -> DataFrame:
    """From state documents: a failed start, and each platform whose token
    another process holds."""
    parsed = states.select(F.from_json(column, GATEWAY_STATE).alias("s")).select("s.*").withColumn("at", F.coalesce(S.to_epoch("updated_at"), F.lit(0.0)))
    failed = finding(
        parsed.filter("gateway_state = 'startup_failed'"), "runtime.gateway_start_failed", F.when(F.col("at") != 0, F.col("at")).otherwise(F.lit(now)), F.lit("gateway"),
        F.concat(F.lit("reconcile:gateway_start_failed:startup_failed:"), F.col("at").cast("long").cast("string")), reason_class=S.gateway_reason("exit_reason"), gateway_state=F.col("gateway_state"),
    )
    each = parsed.select("gateway_state", "at", F.explode("platforms").alias("platform", "info")).withColumn("code", F.coalesce("info.error_code", F.lit(""))).withColumn("message", F.coalesce("info.error_message", F.lit("")))
    taken = each.filter(F.col("code").endswith("_lock") | F.col("message").contains("already in use")).withColumn("pid", S.pid_of("message"))
    nonzero = lambda x: F.when(x != 0, x)
    conflicts = finding(
        taken, "runtime.gateway_start_failed", F.coalesce(nonzero(S.to_epoch("info.updated_at")), nonzero(F.col("at")), F.lit(now)), F.concat(F.lit("gateway:"), F.col("platform")),
        F.concat_ws(":", F.lit("reconcile:gateway_start_failed:token_conflict"), "platform", F.coalesce(F.col("pid").cast("string"), F.lit("unknown"))),
        reason_class=F.lit("token_conflict"), gateway_state=F.col("gateway_state"), platform=F.col("platform"), error_code=F.nullif(F.col("code"), F.lit("")), conflicting_pid=F.col("pid"),
    )
    return failed.unionByName(conflicts)


def absent_gateway_findings(last_start: DataFrame) -> DataFrame:
    """Without a state document: the last start that is on record (last)."""
    known = last_start.filter("last is not null")
    return finding(known, "runtime.gateway_start_failed", F.col("last"), F.lit("gateway"), F.concat(F.lit("reconcile:gateway_start_failed:absent:"), F.col("last").cast("long").cast("string")), reason_class=F.lit("absent"), last_start_at=F.col("last"))


# -- knowledge -------------------------------------------------------------------

def drifted(disk: DataFrame, latest: DataFrame) -> DataFrame:
    """Artifacts on disk (artifact_id, disk_hash, skipped) whose latest stored
    version (artifact_id, manifest_hash, skipped_files) differs in either."""
    return disk.join(latest, "artifact_id").filter(~F.col("disk_hash").eqNullSafe(F.col("manifest_hash")) | ~F.col("skipped").eqNullSafe(F.col("skipped_files")))


def drift_findings(disk: DataFrame, latest: DataFrame, now: float, grace: float) -> DataFrame:
    """Findings about artifacts whose disk differs from the store for longer than
    `grace`.  disk: (artifact_id, kind, disk_hash, skipped, changed_at), without
    empty artifacts.  latest: (artifact_id, manifest_hash, skipped_files,
    tombstone); artifacts without a version drift too, and a tombstone has no hash."""
    known = latest.select("artifact_id", F.when(~F.col("tombstone"), F.col("manifest_hash")).alias("manifest_hash"), "skipped_files")
    both = disk.join(known, "artifact_id", "left")
    differs = ~F.col("disk_hash").eqNullSafe(F.col("manifest_hash")) | ~F.coalesce("skipped", F.array().cast("array<string>")).eqNullSafe(F.coalesce("skipped_files", F.array().cast("array<string>")))
    late = both.filter(differs & (F.lit(now) - F.col("changed_at") > grace))
    return finding(
        late, "reconcile.gap_detected", F.lit(now), F.concat(F.lit("knowledge:"), "artifact_id"), F.concat_ws(":", F.lit("reconcile:knowledge"), "artifact_id", "disk_hash"),
        gap_kind=F.lit("uncaptured_knowledge"), subject_type=F.col("kind"), subject_id=F.col("artifact_id"), source_table=F.lit("fs:knowledge"), disk_manifest_hash=F.col("disk_hash"), stored_manifest_hash=F.col("manifest_hash"),
    )


def healed(findings: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions (artifact_id, seq, manifest_hash, origin) that bring the store up
    to the disk, numbered after each artifact's last; a second run finds no drift
    and makes none."""
    last = versions.groupBy("artifact_id").agg(F.max("seq").alias("_last"))
    get = lambda name: F.get_json_object("payload", f"$.{name}")
    own = findings.select(get("subject_id").alias("artifact_id"), get("disk_manifest_hash").alias("manifest_hash"))
    return own.join(last, "artifact_id", "left").select("artifact_id", (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("seq"), "manifest_hash", F.lit("heal").alias("origin"))


def unemitted(versions: DataFrame, cursors: DataFrame) -> DataFrame:
    """Versions (artifact_id, seq) beyond what the artifact's cursor (artifact_id,
    emitted) has shipped; without a cursor all are."""
    return versions.join(cursors, "artifact_id", "left").filter(F.col("seq") > F.coalesce(F.col("emitted"), F.lit(0))).drop("emitted")
