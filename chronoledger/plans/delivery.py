"""Delivery and state: appends that refuse and remember, shipping, tails of
files, stamps, and small durable state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import knowledge as knowledge_path
from ..operators import ledger as book
from ..operators import mappers, retention, security, settings, shipping, state, status, store
from ..operators.lineage import cut, shared_dir
from ..sources import scans
from ..streaming.sink import source_counts
from .activity import _WINDOWS, _windows
from .driver import INSTALLATION, LEDGER_SQL, all_events, epoch, ledger, table
from .knowledge import SECRET, _FILES, _sized

# -- appends ------------------------------------------------------------------------


def ledger_append_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the ledger or its tombstones have are not appended again."""
    e = all_events(spark, sf_dir).select("installation_id", "arrival", F.expr("concat('k', arrival div 2)").alias("dedup_key"))
    n = F.substring("dedup_key", 2, 20).cast("long")
    known, pruned = e.filter(n % 6 == 0).select("dedup_key"), e.filter(n % 6 == 1).select("dedup_key")
    high = spark.createDataFrame([(INSTALLATION, 77)], "installation_id string, high bigint")
    return book.sequenced(book.fresh_records(e, known, pruned), high, bucket=1000).select("dedup_key", "producer_sequence")


def append_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose envelope breaks a rule take no sequence.  Both kinds are read
    from the verdicts as they were written, so each envelope is judged once."""
    from .knowledge import envelope_checks

    told = cut(envelope_checks(spark, sf_dir)).select(F.lit(INSTALLATION).alias("installation_id"), "event_id", F.col("event_id").alias("arrival"), F.col("event_id").cast("string").alias("dedup_key"), "first_violation")
    high = spark.createDataFrame([], "installation_id string, high bigint")
    new = book.sequenced(book.fresh_records(told.filter("first_violation is null")), high, bucket=500)
    return new.select("event_id", "producer_sequence", F.lit(None).cast("string").alias("first_violation")).unionByName(told.filter("first_violation is not null").select("event_id", F.lit(None).cast("long").alias("producer_sequence"), "first_violation"))


def retention_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pruned events leave behind: of the payload the audited fields only."""
    k = F.col("event_id")
    body = F.to_json(F.struct(F.col("event_type"), F.when(k % 3 == 0, k).alias("message_row_id"), F.when(k % 3 == 1, F.concat(F.lit("m"), k % 4)).alias("model"), F.lit("secret text").alias("content"), F.when(k % 2 == 0, "b").alias("board")))
    e = ledger(spark, sf_dir).select("installation_id", "producer_sequence", k.cast("string").alias("event_id"), F.concat(F.lit("k"), k).alias("dedup_key"), F.col("occurred_at").alias("recorded_at"), "event_type", "session_id", "parent_session_id", F.lit(None).cast("string").alias("invocation_id"), body.alias("payload"))
    going = retention.prune_set(_sized(spark, sf_dir), 1 << 40, cutoff=1704931200.0)
    left, tombstones = retention.prune(e, going)
    return tombstones.select("producer_sequence", "session_id", "payload").unionByName(left.agg(F.count(F.lit(1)).alias("producer_sequence"), F.lit("left").alias("session_id"), F.lit(None).cast("string").alias("payload")))


def companion_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding about each failed call, caused by it."""
    e = ledger(spark, sf_dir).filter("event_type = 'model.call_failed'").withColumn("profile", F.lit("default")).withColumn("dedup_key", F.concat(F.lit("e:"), "event_id"))
    made = book.companions(e, "security.secret_detected", F.to_json(F.struct(F.col("event_id").alias("of"))), "secret")
    return made.select("event_type", "session_id", "correlation_id", F.col("causation_id").cast("long").alias("causation_id"), "payload", "dedup_key")


# -- shipping ------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("installation_id"), (F.col("doc_id") + 1).alias("producer_sequence"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("bytes"))


def _cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second source has been shipped up to 100."""
    n = F.substring("installation_id", 4, 9).cast("int")
    return _records(spark, sf_dir).select("installation_id").distinct().filter(n % 2 == 0).withColumn("cursor", F.lit(100).cast("long"))


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipping.plan_batches(_records(spark, sf_dir), _cursors(spark, sf_dir), 20, 65_536, 50, max_batches=2)


def batch_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two batches of each source beyond its cursor."""
    return _planned(spark, sf_dir).select("installation_id", "batch", "first", "last", "records", "bytes")


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements of every kind, by source and batch."""
    n, b = F.substring("installation_id", 4, 9).cast("int"), F.col("batch")
    planned = _planned(spark, sf_dir)
    acks = planned.filter(~((n % 7 == 1) & (b == 1))).select(
        "installation_id", "batch", F.when((n % 7 == 2) & (b == 1), F.lit(-1)).otherwise(F.col("records") - b).cast("long").alias("accepted"),
        F.when((n % 7 == 2) & (b == 1), F.col("records") + 1).when((n % 7 == 3) & (b == 0), F.lit(5)).otherwise(b).cast("long").alias("duplicates"), (F.col("last") - F.when((n % 7 == 4) & (b == 1), 1).otherwise(0)).alias("high_water"),
    )
    return shipping.judged(planned, acks)


def ship_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir).select("installation_id", "batch", "records", "refused")


def ship_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor moves up to the first batch that is refused."""
    before, told = _cursors(spark, sf_dir), _told(spark, sf_dir)
    high = _records(spark, sf_dir).groupBy("installation_id").agg(F.max("producer_sequence").alias("high"))
    return shipping.outcome(before, shipping.advanced(told, before), told, high)


STATUSES = (200, 204, 301, 400, 401, 403, 404, 429, 500, 503, 599, 600, None)


def retry_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status, with and without a login page, and the wait after it."""
    k = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s).cast("int") for s in STATUSES]), (k % len(STATUSES) + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(status.alias("status"), (k % 5 == 0).alias("login"), (k % 9 + 1).alias("attempt"))
    return e.groupBy("status", "login", shipping.retry_class(F.col("status"), F.col("login")).alias("class"), "attempt", shipping.delay_ceiling(F.col("attempt")).alias("ceiling")).agg(F.count(F.lit(1)).alias("n"))


def key_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content keys in batches of seven; the first batch is then marked shipped."""
    k = F.col("s_suppkey")
    keys = table(spark, sf_dir, "supplier").select(F.lit(INSTALLATION).alias("installation_id"), k.alias("key_version"), F.col("s_acctbal").alias("created_at"), F.when(k % 3 > 0, 1.0).alias("shipped_at"))
    batches = shipping.key_batches(keys, 7)
    after = shipping.mark_shipped(keys, batches.filter("batch = 0"), 9.0)
    return after.join(batches.select("key_version", "batch"), "key_version", "left").select("key_version", "shipped_at", "batch")


# -- sources ---------------------------------------------------------------------------


def poll_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages beyond a mark at half of the table, up to its high water, with 32
    ids of overlap."""
    m = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    high = scans.high_water(m, "id", 0)
    return scans.messages(m, high // 2, 32, high, ["user", "assistant"]).select("id", "role")


def _spools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each user: a line for each event, the last one cut short."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("é"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.lit(" x")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return e.groupBy(F.col("user_id").cast("string").alias("file")).agg(F.when(F.first("user_id") % 2 == 0, "g0").otherwise("g1").alias("generation"), body.alias("content"))


def _tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors at byte 40, of which those of every third file are of another
    generation and those of every fifth beyond the end."""
    f, n = _spools(spark, sf_dir), F.col("file").cast("long")
    return f.select("file", F.when(n % 3 == 0, "old").otherwise(F.col("generation")).alias("generation"), F.when(n % 5 == 0, F.lit(1 << 40)).otherwise(F.lit(40)).cast("long").alias("offset"))


def spool_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New whole lines of spools and where they are."""
    return scans.tail_lines(_spools(spark, sf_dir), _tails(spark, sf_dir)).select("file", "offset", "until", "value")


def spool_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = _spools(spark, sf_dir), _tails(spark, sf_dir)
    return scans.tail_cursors(f, scans.tail_lines(f, c), c).select("file", "generation", "offset")


def spool_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spool files written and read as files: whole lines with their bytes."""
    path = f"{shared_dir(spark).rstrip('/')}/spool-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(F.col("event_type"), F.col("event_id").alias("n"), F.lit("é").alias("text")))
    table(spark, sf_dir, "events").select(line.alias("value")).repartition(3).write.text(path)
    lines = scans.spool_lines(spark, path, r"^(part)")
    kept = scans.json_objects(lines, "event_type string, n long")
    return kept.select("generation", F.col("object.n").alias("n"), F.col("object.event_type").alias("event_type"), (F.col("until") - F.col("offset")).cast("long").alias("bytes"))


def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold one number, no number, and none at all."""
    first = table(spark, sf_dir, "events").agg(F.max("event_id").cast("string").alias("v"))
    files = {"one": first.select(F.concat(F.lit(" "), "v", F.lit(".25 ")).alias("value")), "word": first.select(F.lit("soon").alias("value")), "two": first.select(F.explode(F.array("v", "v")).alias("value")), "none": first.limit(0).select(F.col("v").alias("value"))}
    out = None
    for name, lines in files.items():
        one = scans.single_float(lines).select(F.lit(name).alias("file"), "value")
        out = one if out is None else out.unionByName(one)
    return out


# -- stamps ---------------------------------------------------------------------------

MODES = ("auto", " Host ", "isolated", "profile-home", "REAL", "user", "nonsense", "")


def runtime_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtimes of records: agents with their home mode, gateways with channels."""
    k = F.col("s_suppkey")
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), (k % len(MODES) + 1).cast("int"))
    agent = S.runtime_stamp(F.lit("model"), S.home_mode(F.when(k % 11 > 0, mode)))
    gateway = S.gateway_stamp(F.when(k % 3 > 0, F.array(F.lit("chat"), F.concat(F.lit("c"), k % 3))), F.when(k % 2 == 0, F.concat(F.lit("g"), k)))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 5 > 0, agent).otherwise(gateway).alias("runtime"))


CONFIGS = {
    "terminal:\n  home_mode: host\n": "real", "# c\nother:\n  home_mode: host\nterminal:\n  a: 1\n  # home_mode: user\n  home_mode: 'isolated' # why\nlast: 1\n": "profile", "home_mode: real\n": "auto", "terminal:\nhome_mode: real\n": "auto",
    "terminal:\n  home_mode:\n": "auto", "terminal: # x\n\thome_mode: \"USER\"\n  home_mode: auto\n": "real", "": "auto",
}


def config_home_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home mode that configuration files name."""
    k = F.col("s_suppkey")
    text = F.element_at(F.array(*[F.lit(c) for c in CONFIGS]), (k % len(CONFIGS) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), S.home_mode_of_config(text).alias("mode"))


# -- state ----------------------------------------------------------------------------


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write for each event; every fifth deletes, every seventh is no JSON."""
    k = F.col("event_id")
    key = F.concat(F.when(F.col("user_id") % 2 == 0, "cur_").otherwise("curX"), "user_id")
    value = F.when(k % 7 == 0, "{broken").when(k % 3 == 0, F.concat(F.lit("["), k, F.lit("]"))).otherwise(k.cast("string"))
    return table(spark, sf_dir, "events").select(key.alias("key"), k.alias("seq"), F.when(k % 5 > 0, value).alias("value"))


def meta_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current values under a prefix, as number and as JSON array."""
    now = state.with_prefix(state.current(_writes(spark, sf_dir)), "cur_")
    return now.select("key", "value", state.number(F.col("value"), -1.0).alias("number"), state.json_of(F.col("value"), "ARRAY", "[]").alias("listed"))


def meta_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after a bulk deletion by prefix."""
    writes = _writes(spark, sf_dir)
    now = state.current(writes)
    gone = state.deletions(now, state.with_prefix(now, "curX1").unionByName(spark.createDataFrame([("unknown", "")], "key string, value string")), 1 << 40)
    return state.current(writes.unionByName(gone)).agg(F.count(F.lit(1)).alias("keys"), F.max("key").alias("last"))


def windows_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows saved and loaded; damaged values and entries are left out."""
    w = _windows(spark, sf_dir).select("session_id", "invocation_id", "started_at", "ended_at").filter("started_at is not null")
    n = F.col("session_id").cast("long")
    saved = state.saved_windows(w.filter(n % 4 > 0), 1)
    odd = w.filter(n % 4 == 0).groupBy("session_id").agg(F.min("invocation_id").alias("i")).select(state.window_key(F.col("session_id")).alias("key"), F.lit(1).cast("long").alias("seq"), F.when(F.substring("session_id", -1, 1) == "0", "{}").otherwise(F.concat(F.lit('[{"invocation_id": 5, "started_at": 1}, 7, {"invocation_id": "'), "i", F.lit('", "started_at": 1.5, "ended_at": null}, {"invocation_id": "x", "started_at": "1"}]'))).alias("value"))
    back = state.loaded_windows(state.current(saved.unionByName(odd)), w.select("session_id").distinct())
    return back.select("session_id", "invocation_id", F.round("started_at", 3).alias("started_at"), F.round("ended_at", 3).alias("ended_at"))


def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The install horizon is 0 where unset, the capture horizon null."""
    top = table(spark, sf_dir, "events").agg(F.max("event_id").cast("string").alias("value")).select(F.lit("installed_at").alias("key"), "value")
    ask = {"installed": ("installed_at", 0.0), "missing": ("nowhere", 0.0), "capture": ("capture_from", None)}
    out = None
    for name, (key, default) in ask.items():
        one = state.horizon(top, key, default).select(F.lit(name).alias("name"), "horizon")
        out = one if out is None else out.unionByName(one)
    return out


# -- store and secrets ------------------------------------------------------------------


def memory_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks add entries to a user's memory; only even users' results count them,
    so only theirs become known."""
    e = ledger(spark, sf_dir).filter("event_type = 'tool.call_completed'")
    u, k = F.col("session_id").cast("long"), F.col("event_id")
    args = F.when(k % 10 == 9, "[1]").otherwise(F.to_json(F.struct(F.concat(F.lit("c"), k % 4).alias("content"))))
    m = e.select(F.col("session_id").alias("artifact_id"), F.lit("memory").alias("kind"), F.lit("memory").alias("name"), F.col("producer_sequence").alias("at"), F.lit("add").alias("action"), args.alias("arguments"), F.when(u % 2 == 0, '{"entry_count": 1}').otherwise("{broken").alias("result"))
    return store.after_states(m).select("artifact_id", "at", F.get_json_object("files", "$['MEMORY.md']").alias("text"))


def version_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions beyond a cursor, with the bytes of their blobs."""
    from ..operators import lookups

    f = table(spark, sf_dir, "documents").select(F.col("source").alias("artifact_id"), F.expr("doc_id div 20 % 2 + 1").alias("seq"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"))
    versions = f.groupBy("artifact_id", "seq").agg(F.sum("size").cast("long").alias("bytes"))
    cursors = versions.filter("seq = 1 and artifact_id <> 'src2'").select("artifact_id", "seq")
    return lookups.versions_after(versions, cursors)


def blob_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the second versions with their blobs, of which some are not stored."""
    from ..operators import lookups
    from .knowledge import _files

    f = _files(spark, sf_dir)
    versions = store.manifests(f).filter("version = 1").withColumn("seq", F.col("version") + 1)
    blobs = table(spark, sf_dir, "documents").filter("doc_id % 6 > 0").select(S.content_hash("text").alias("blob_hash"), F.col("text").alias("content")).dropDuplicates(["blob_hash"])
    return lookups.version_blobs(versions, blobs).select("artifact_id", "path", "size", F.sha2("content", 256).alias("sha"))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts as they were first seen, whatever came later."""
    from ..operators import lookups

    e = ledger(spark, sf_dir).select(F.col("session_id").alias("artifact_id"), F.col("event_type").alias("name"), F.col("occurred_at").alias("first_seen"))
    early = F.col("first_seen") < 1705276800.0
    return lookups.first_artifacts(e.filter(early), e.filter(~early)).select("artifact_id", "name", F.round("first_seen", 3).alias("first_seen"))


def secret_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of every rule, with their bytes and fingerprints."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("é key AKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "Z"), F.lit(' and "token": "v'), F.lpad((F.col("doc_id") % 50).cast("string"), 9, "0"), F.lit('"\n-----BEGIN RSA PRIVATE KEY-----')).alias("text"))
    found = security.fingerprinted(security.secret_matches(security.scan_targets(d, {"body": "text"}, "doc_id"), "doc_id"), SECRET)
    return found.select("doc_id", "type", "byte_start", "byte_end", "fingerprint")


def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline with entries added and removed; malformed ones are not taken."""
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("t").alias("type"), F.rpad(F.concat(F.lit("f-_"), F.col("s_suppkey")), F.when(F.col("s_suppkey") % 5 == 0, 21).otherwise(22), F.lit("A")).alias("fingerprint"))
    base = security.update_baseline(d.filter("k % 3 = 0 and k % 5 > 0"), add=d.filter("k % 2 = 0"), remove=d.filter("k % 7 = 0"))
    return base.select("fingerprint")


def hook_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks of all six kinds: sessions start, end and reset by their key."""
    kinds = ("session:start", "agent:start", "agent:end", "session:end", "session:start", "session:reset", "gateway:startup")
    k = F.col("event_id")
    hook = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % len(kinds) + 1).cast("int"))
    line = F.to_json(F.struct(hook.alias("event_type"), k.cast("double").alias("captured_at"), F.struct(F.when(~hook.isin("session:end", "session:reset"), F.col("user_id").cast("string")).alias("session_id"), F.lit("one").alias("session_key"), F.lit("chat").alias("platform")).alias("context")))
    r = mappers.hook_records(table(spark, sf_dir, "events").select(line.alias("value"), k.alias("offset")), "i1", "g1")
    return r.select("dedup_key", "event_type", "session_id", "partial", F.get_json_object("payload", "$.reason").alias("reason"), F.get_json_object("payload", "$.surface").alias("surface"))


def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference that is used twice: each parent takes the chunks right before it."""
    d = table(spark, sf_dir, "documents").filter("octet_length(text) > 4096").select("doc_id", F.col("text").alias("content"), F.expr("concat('r', doc_id div 2)").alias("dedup_key"))
    own = d.select("doc_id", F.col("doc_id").cast("string").alias("dedup_key"), "content")
    base = F.col("doc_id") * 1000
    made = mappers.content_chunks(own, 4096).withColumn("doc_id", F.col("content_ref").cast("long"))
    chunks = made.select(F.expr("concat('r', doc_id div 2)").alias("content_ref"), "chunk", "chunks", "data", (base - F.col("chunks") + F.col("chunk")).alias("producer_sequence"))
    counts = made.groupBy("doc_id").agg(F.max("chunks").alias("chunk_count"))
    parents = d.join(counts, "doc_id").select("doc_id", F.col("dedup_key").alias("content_ref"), base.alias("producer_sequence"), "chunk_count", F.octet_length(F.encode("content", "UTF-8")).alias("total_bytes"), S.content_hash("content").alias("content_hash"))
    one = parents.withColumn("_n", F.row_number().over(Window.partitionBy("content_ref").orderBy(F.desc("doc_id")))).filter("_n = 1")
    return mappers.reassembled(chunks, one).select("content_ref", "ok", F.sha2("content", 256).alias("sha"))


# -- settings, status and the rest ---------------------------------------------------------

FILE = {"capture": {"max_content_bytes": 1000, "sources": {"cron": False}}, "sync": {"max_bytes": 2048.0, "interval_seconds": 5}, "retention": {"max_age_days": None}}
ENVIRONMENT = {"CHRONOLEDGER_CAPTURE_MAX_CONTENT_BYTES": "2000", "CHRONOLEDGER_RETENTION_ENABLED": "TRUE", "CHRONOLEDGER_CAPTURE_MESSAGE_ROLES": '["user"]', "CHRONOLEDGER_SYNC_MAX_RECORDS": ""}


def settings_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The environment over a file over the defaults."""
    return settings.table(spark, settings.load(FILE, ENVIRONMENT))


def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report: users are sources, their errors failed passes."""
    e = table(spark, sf_dir, "events")
    now = 1706659200.0
    passes = lambda key: e.select(key.cast("string").alias("source"), epoch("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    builds = spark.range(1).select(F.lit("b1").alias("installed"), F.lit("b1").alias("package"), F.lit("b0").alias("hook"))
    capture = e.agg((F.max(epoch("ts")).cast("long")).cast("string").alias("value"))
    lag = e.agg(F.max("event_id").alias("high"), F.expr("max(event_id) div 2").alias("cursor"))
    report = status.full_report(builds, capture, status.health_states(passes(F.col("user_id") % 8)), ["1", "2"], status.health_states(passes(F.lit(0))), lag, now, 7200.0, 1200.0)
    return report.unionByName(status.healthy(report).select(F.lit("all").alias("item"), F.when(F.col("healthy"), "OK").otherwise("NOT OK").alias("verdict"), F.lit(True).alias("required"), F.lit(None).cast("long").alias("detail")))


def drift_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against documents: fresh changes wait, the others are found and healed."""
    from ..operators import detect

    l, k = table(spark, sf_dir, "labels"), F.col("doc_id")
    some = lambda x: F.array(F.concat(F.lit("f"), x))
    disk = l.select(k.cast("string").alias("artifact_id"), F.lit("skill").alias("kind"), F.lit("h1").alias("disk_hash"), F.when(k % 5 == 0, some(F.lit(1))).alias("skipped"), (F.lit(1000.0) - k % 7 * 100).alias("changed_at"))
    latest = l.filter(k % 11 > 0).select(k.cast("string").alias("artifact_id"), F.concat(F.lit("h"), F.col("quality")).alias("manifest_hash"), F.when(k % 5 == 0, some(F.col("toxic"))).alias("skipped_files"), (k % 13 == 0).alias("tombstone"))
    found = detect.drift_findings(disk, latest, 1000.0, 300.0)
    versions = latest.select("artifact_id", (F.length("artifact_id") + 1).cast("long").alias("seq"))
    return detect.healed(found, versions).join(found.select(F.substring("correlation_id", 11, 99).alias("artifact_id"), "dedup_key"), "artifact_id").select("artifact_id", "seq", "manifest_hash", "dedup_key")


def migrated_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table two versions old."""
    steps = {"1": ("2", lambda df: df.withColumn("skipped", F.lit("[]"))), "2": ("3", lambda df: df.withColumnRenamed("hash", "manifest_hash")), "0": ("9", lambda df: df.limit(0))}
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("hash"))
    return settings.migrated(old, "1", "3", steps).select("seq", "manifest_hash", "skipped")


def ledger_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger from a time on, from a sequence on, and one without times."""
    e = ledger(spark, sf_dir).select("installation_id", "producer_sequence", F.when(F.col("event_id") % 11 > 0, F.col("occurred_at")).alias("occurred_at"))
    late = scans.ledger(e, INSTALLATION, after=100, since=book.parse_since("2024-01-15T00:00:00")).select("producer_sequence", F.lit("late").alias("what"))
    every = scans.ledger(e, since=book.parse_since("0")).select("producer_sequence", F.lit("all").alias("what"))
    return late.unionByName(every).unionByName(scans.ledger(e, "another").select("producer_sequence", F.lit("none").alias("what")))


def gateway_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a state document the last start on record is told."""
    from ..operators import detect

    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 7, (F.col("event_id") + 1700000000).cast("string")).otherwise("noise").alias("value"))
    found = detect.absent_gateway_findings(scans.last_epoch(lines, "event_id"))
    return found.select("event_type", F.col("occurred_at").cast("long").alias("occurred_at"), "correlation_id", "dedup_key", F.get_json_object("payload", "$.reason_class").alias("reason_class"))


def execution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose times are ISO texts, numbers or neither; one column is missing."""
    k = F.col("o_orderkey")
    at = F.when(k % 3 == 0, F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(k % 3 == 1, epoch("o_orderdate").cast("long").cast("string")).otherwise("soon")
    return scans.executions(table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("job_id"), at.alias("claimed_at"))).select("id", "job_id", F.col("claimed_epoch").cast("long").alias("claimed"), F.col("finished_epoch").cast("long").alias("finished"), "status")


def scan_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with two targets under a budget of 3000 bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("b"), F.substring("text", 1, 20).alias("a"))
    targets = security.scan_targets(d, {"body": "b", "arguments": "a"}, "doc_id")
    kept, told = security.budgeted(targets, "doc_id", 3000)
    counts = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("scanned"))
    return told.join(counts, "doc_id", "left").select("doc_id", "status", F.coalesce("scanned", F.lit(0)).alias("scanned"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases as knowledge calls of one skill a user: purchases
    delete it, every seventh call failed, every ninth is another tool's."""
    k = F.col("event_id")
    e = ledger(spark, sf_dir).filter("event_type in ('tool.call_completed', 'invocation.completed')").select(k, F.col("session_id").alias("s"), (F.col("event_type") == "invocation.completed").alias("gone"))
    args = F.to_json(F.struct(F.when(F.col("gone"), "delete").otherwise("create").alias("action"), F.lit("n").alias("name"), F.col("s").alias("category"), F.repeat(F.lit("long "), F.when(k % 6 == 0, 30).otherwise((k % 2 + 1).cast("int"))).alias("content")))
    call = F.to_json(F.array(F.struct(F.concat(F.lit("c"), k).alias("id"), F.struct(F.when(k % 9 == 0, "other").otherwise("skill_manage").alias("name"), args.alias("arguments")).alias("function"))))
    none = F.lit(None).cast("string")
    asked = e.select((k * 2).alias("id"), F.col("s").alias("session_id"), F.lit("assistant").alias("role"), none.alias("tool_call_id"), call.alias("tool_calls"), none.alias("content"))
    told = e.select((k * 2 + 1).alias("id"), F.col("s").alias("session_id"), F.lit("tool").alias("role"), F.concat(F.lit("c"), k).alias("tool_call_id"), none.alias("tool_calls"), F.when(k % 7 == 0, '{"success": false}').otherwise('{"success": true}').alias("content"))
    return asked.unionByName(told)


def knowledge_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of all skills, from calls to events; files above 100 bytes are skipped."""
    artifacts = spark.createDataFrame([], "artifact_id string, name string, tombstone boolean, first_seen double")
    versions, events = knowledge_path.captured(_calls(spark, sf_dir), artifacts, max_file=100)
    size = F.get_json_object("bundle", "$.files[0].byte_count").cast("long")
    return versions.join(events, ["artifact_id", "seq"]).select("artifact_id", "seq", "at", "tombstone", F.size("skipped").alias("skipped"), "action", size.alias("bytes"))


def delegation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are new since a mark, read with 32 of overlap."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    high = scans.high_water(o, "id", 0)
    return scans.bounded(o, "id", high - high // 4, 32, high).select("id")


def appended_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass appended, by type: two of three events were there before."""
    e = ledger(spark, sf_dir)
    return source_counts(e.filter("event_id % 3 > 0"), e)


def tidy_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as they come, with 0 for what is none."""
    k = F.col("event_id")
    raw = F.element_at(F.array(*[F.lit(x) for x in ("1.5", " 7 ", "x", "", "-2e3", None)]), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(raw.alias("raw"), S.tidy(raw).alias("value")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    appended_counts, tidy_numbers,
    knowledge_versions, blob_lookup, delegation_scan, spool_read, settings_resolved, status_report, drift_grace, migrated_versions, ledger_since, gateway_absent, execution_rows, scan_budget,
    ledger_append_pruned, append_rejects, retention_tombstones, companion_findings, batch_limit, ship_acknowledged, ship_outcome, retry_classes, key_batches, poll_scan, spool_tail, spool_cursors, heartbeat,
    runtime_stamps, config_home_mode, meta_state, meta_deleted, windows_state, horizons, memory_states, version_lookups, first_seen, secret_rules, suppressions, hook_kinds, chunk_ranges,
)}

_SHIP = """r AS (SELECT source, doc_id + 1 AS seq, octet_length(encode(text)) AS size, CAST(substr(source, 4) AS INT) AS sn FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS i FROM r WHERE NOT (sn % 2 = 0 AND seq <= 100)),
    w AS (SELECT source, sn, seq, size, i, 0 AS batch, 1 AS n, 50 + size AS used FROM o WHERE i = 1
        UNION ALL SELECT o.source, o.sn, o.seq, o.size, o.i, CASE WHEN w.n >= 20 OR w.used + o.size + 1 > 65536 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.n >= 20 OR w.used + o.size + 1 > 65536 THEN 1 ELSE w.n + 1 END,
            CASE WHEN w.n >= 20 OR w.used + o.size + 1 > 65536 THEN 50 + o.size ELSE w.used + o.size + 1 END FROM w JOIN o ON o.source = w.source AND o.i = w.i + 1),
    b AS (SELECT source AS installation_id, sn, CAST(batch AS BIGINT) AS batch, min(seq) AS first, max(seq) AS last, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM w WHERE batch < 2 GROUP BY ALL),
    told AS (SELECT *, CASE WHEN sn % 7 = 1 AND batch = 1 THEN 'no acknowledgement' WHEN sn % 7 = 2 AND batch = 1 THEN 'negative count' WHEN sn % 7 = 3 AND batch = 0 THEN 'incomplete' WHEN sn % 7 = 4 AND batch = 1 THEN 'high water below the batch' END AS refused FROM b)"""

_HOOK = """e AS (SELECT event_id AS k, CAST(user_id AS VARCHAR) AS u, ['session:start', 'agent:start', 'agent:end', 'session:end', 'session:start', 'session:reset', 'gateway:startup'][event_id % 7 + 1] AS hook FROM events),
    s AS (SELECT *, last_value(CASE WHEN hook = 'session:start' THEN u END IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started FROM e)"""

_SECRET_PADS = tuple(bytes(b ^ x for b in SECRET.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


def _mac(message: str) -> str:
    inner, outer = (f"unhex('{pad}')" for pad in _SECRET_PADS)
    return f"replace(replace(left(to_base64(unhex(left(sha256({outer} || unhex(sha256({inner} || encode({message})))), 32))), 22), '+', '-'), '/', '_')"


_CONFIG_MODES = ", ".join(f"'{m}'" for m in CONFIGS.values())

ORACLES = {
    "appended_counts": f"WITH {LEDGER_SQL} SELECT event_type, count(*) AS events FROM ledger WHERE event_id % 3 = 0 GROUP BY 1",
    "tidy_numbers": """SELECT ['1.5', ' 7 ', 'x', '', '-2e3', NULL][event_id % 6 + 1] AS raw, CAST(CASE event_id % 6 WHEN 0 THEN 1.5 WHEN 1 THEN 7 WHEN 4 THEN -2000 ELSE 0 END AS DOUBLE) AS value, count(*) AS n FROM events GROUP BY ALL""",
    "knowledge_versions": f"""WITH {LEDGER_SQL}, c AS (SELECT session_id AS s, event_id AS k, event_type = 'invocation.completed' AS gone, CASE WHEN event_id % 6 = 0 THEN 150 ELSE 5 * (event_id % 2 + 1) END AS size FROM ledger
            WHERE event_type IN ('tool.call_completed', 'invocation.completed') AND event_id % 9 > 0 AND event_id % 7 > 0),
        t AS (SELECT s, k, CASE WHEN gone THEN 0 ELSE size END AS state FROM c), d AS (SELECT *, lag(state) OVER (PARTITION BY s ORDER BY k) AS before FROM t),
        v AS (SELECT s, k, state, row_number() OVER (PARTITION BY s ORDER BY k) AS seq FROM d WHERE state IS DISTINCT FROM before)
        SELECT 'skill:' || s || '/n' AS artifact_id, seq, k * 2 + 1 AS at, state = 0 AS tombstone, CASE WHEN state > 100 THEN 1 ELSE 0 END AS skipped, CASE WHEN state = 0 THEN 'delete' WHEN seq = 1 THEN 'create' ELSE 'update' END AS action, CASE WHEN state BETWEEN 1 AND 100 THEN state END AS bytes FROM v""",
    "spool_read": """SELECT 'part' AS generation, event_id AS n, event_type, octet_length(encode('{"event_type":"' || event_type || '","n":' || event_id || ',"text":"é"}')) + 1 AS bytes FROM events""",
    "blob_lookup": f"""WITH {_FILES}, b AS (SELECT DISTINCT text FROM documents WHERE doc_id % 6 > 0)
        SELECT artifact_id, path, CASE WHEN b.text IS NOT NULL THEN size END AS size, sha256(b.text) AS sha FROM f LEFT JOIN b ON b.text = f.text WHERE version = 1""",
    "delegation_scan": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) - max(o_orderkey) // 4 - 32 FROM orders)",
    "settings_resolved": """SELECT * FROM (VALUES ('capture', 'interval_seconds', '15.0', 'default'), ('capture', 'max_content_bytes', '2000', 'environment'), ('capture', 'message_roles', '["user"]', 'environment'),
        ('capture', 'required_sources', '["hook","state_db"]', 'default'), ('capture', 'sources', '{"cron":false}', 'file'), ('knowledge', 'history', '"full"', 'default'), ('knowledge', 'max_artifact_bytes', '8388608', 'default'),
        ('knowledge', 'max_file_bytes', '4194304', 'default'), ('knowledge', 'max_file_count', '256', 'default'), ('knowledge', 'max_versions', 'null', 'default'), ('reconcile', 'audit_interval_seconds', '3600.0', 'default'),
        ('reconcile', 'interval_seconds', '60.0', 'default'), ('retention', 'enabled', 'true', 'environment'), ('retention', 'max_age_days', 'null', 'file'), ('retention', 'max_bytes', 'null', 'default'),
        ('retention', 'require_delivered', 'true', 'default'), ('retention', 'vacuum', '"auto"', 'default'), ('security', 'secret_scan_baseline', '"secret-scan-baseline.json"', 'default'), ('security', 'secret_scan_deadline_ms', '250', 'default'),
        ('security', 'secret_scan_enabled', 'true', 'default'), ('security', 'secret_scan_max_bytes', '8388608', 'default'), ('sync', 'interval_seconds', '5.0', 'file'), ('sync', 'max_batches_per_tick', '1', 'default'),
        ('sync', 'max_bytes', '2048', 'file'), ('sync', 'max_records', '500', 'default')) t(section, key, value, origin)""",
    "status_report": """WITH p AS (SELECT CAST(user_id % 8 AS VARCHAR) AS source, epoch_us(ts) / 1e6 AS t, event_type <> 'error' AS ok FROM events UNION ALL SELECT 'all', epoch_us(ts) / 1e6, event_type <> 'error' FROM events),
        l AS (SELECT source, max(t) FILTER (ok) AS good FROM p GROUP BY 1), s AS (SELECT l.source, good, count(*) FILTER (good IS NULL OR t > good) AS failures FROM l JOIN p USING (source) GROUP BY ALL),
        v AS (SELECT source, failures, CASE WHEN failures > 0 THEN 'BROKEN' WHEN good IS NULL THEN 'NO SUCCESS' WHEN 1706659200 - good > 7200 THEN 'STALE' ELSE 'OK' END AS verdict FROM s),
        h AS (SELECT floor(max(epoch_us(ts) / 1e6)) AS c, max(event_id) AS high FROM events),
        r AS (SELECT 'build' AS item, 'MISMATCH' AS verdict, true AS required, CAST(NULL AS BIGINT) AS detail UNION ALL SELECT 'capture', CASE WHEN 1706659200 - c > 7200 THEN 'STALE' ELSE 'OK' END, true, CAST(1706659200 - c AS BIGINT) FROM h
            UNION ALL SELECT 'source ' || source, verdict, source IN ('1', '2'), failures FROM v WHERE source <> 'all' UNION ALL SELECT 'reconcile', verdict, true, failures FROM v WHERE source = 'all' UNION ALL SELECT 'pending', 'OK', false, high - high // 2 FROM h)
        SELECT * FROM r UNION ALL SELECT 'all', CASE WHEN bool_and(verdict = 'OK' OR NOT required) THEN 'OK' ELSE 'NOT OK' END, true, NULL FROM r""",
    "drift_grace": """SELECT CAST(doc_id AS VARCHAR) AS artifact_id, CAST(CASE WHEN doc_id % 11 > 0 THEN len(CAST(doc_id AS VARCHAR)) + 2 ELSE 1 END AS BIGINT) AS seq, 'h1' AS manifest_hash, 'reconcile:knowledge:' || doc_id || ':h1' AS dedup_key FROM labels
        WHERE doc_id % 7 > 3 AND (doc_id % 11 = 0 OR doc_id % 13 = 0 OR quality <> 1 OR (doc_id % 5 = 0 AND toxic <> 1))""",
    "migrated_versions": "SELECT s_suppkey AS seq, s_name AS manifest_hash, '[]' AS skipped FROM supplier",
    "ledger_since": f"""WITH {LEDGER_SQL} SELECT producer_sequence, 'late' AS what FROM ledger WHERE event_id % 11 > 0 AND occurred_at >= 1705276800 AND producer_sequence > 100 UNION ALL SELECT producer_sequence, 'all' FROM ledger""",
    "gateway_absent": "SELECT 'runtime.gateway_start_failed' AS event_type, max(event_id) + 1700000000 AS occurred_at, 'gateway' AS correlation_id, 'reconcile:gateway_start_failed:absent:' || (max(event_id) + 1700000000) AS dedup_key, 'absent' AS reason_class FROM events WHERE event_id % 50 = 7",
    "execution_rows": "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS job_id, CASE o_orderkey % 3 WHEN 0 THEN epoch_us(o_orderdate) // 1000000 - 7200 WHEN 1 THEN epoch_us(o_orderdate) // 1000000 END AS claimed, CAST(NULL AS BIGINT) AS finished, CAST(NULL AS VARCHAR) AS status FROM orders",
    "scan_budget": """WITH d AS (SELECT doc_id, octet_length(encode(left(text, 20))) AS a, octet_length(encode(text)) AS b FROM documents WHERE text <> '')
        SELECT doc_id, CASE WHEN a + b <= 3000 THEN 'complete' ELSE 'partial' END AS status, CASE WHEN a + b <= 3000 THEN 2 ELSE 1 END AS scanned FROM d""",
    "ledger_append_pruned": f"""WITH {LEDGER_SQL}, k AS (SELECT producer_sequence // 2 AS n, min(producer_sequence) AS arrival FROM all_events GROUP BY 1)
        SELECT 'k' || n AS dedup_key, 77 + row_number() OVER (ORDER BY arrival) AS producer_sequence FROM k WHERE n % 6 > 1""",
    "append_rejects": """WITH v AS (SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'unsupported schema_version' WHEN 2 THEN 'missing event_id' WHEN 3 THEN 'unknown event_type' WHEN 4 THEN 'content without content_nonce' WHEN 5 THEN 'key_version without content'
        WHEN 6 THEN 'unknown fields: surprise' WHEN 7 THEN 'no object' WHEN 8 THEN 'partial is no boolean' END AS first_violation FROM events)
        SELECT event_id, CASE WHEN first_violation IS NULL THEN row_number() OVER (PARTITION BY first_violation IS NULL ORDER BY event_id) END AS producer_sequence, first_violation FROM v""",
    "retention_tombstones": f"""WITH {LEDGER_SQL}, p AS (SELECT *, event_id AS k FROM ledger WHERE occurred_at < 1704931200)
        SELECT producer_sequence, session_id, '{{' || CASE WHEN k % 2 = 0 THEN '"board":"b",' ELSE '' END || '"event_type":"' || event_type || '"' || CASE k % 3 WHEN 0 THEN ',"message_row_id":' || k WHEN 1 THEN ',"model":"m' || (k % 4) || '"' ELSE '' END || '}}' AS payload FROM p
        UNION ALL SELECT count(*), 'left', NULL FROM ledger WHERE occurred_at >= 1704931200""",
    "companion_findings": f"""WITH {LEDGER_SQL} SELECT 'security.secret_detected' AS event_type, session_id, session_id AS correlation_id, event_id AS causation_id, '{{"of":' || event_id || '}}' AS payload, 'e:' || event_id || ':secret' AS dedup_key FROM ledger WHERE event_type = 'model.call_failed'""",
    "batch_limit": f"WITH RECURSIVE {_SHIP} SELECT installation_id, batch, first, last, records, bytes FROM b",
    "ship_acknowledged": f"WITH RECURSIVE {_SHIP} SELECT installation_id, batch, records, refused FROM told",
    "ship_outcome": f"""WITH RECURSIVE {_SHIP}, stop AS (SELECT installation_id, min(batch) FILTER (refused IS NOT NULL) AS stop, arg_min(refused, batch) FILTER (refused IS NOT NULL) AS why FROM told GROUP BY 1),
        moved AS (SELECT installation_id, max(last) AS upto FROM told JOIN stop USING (installation_id) WHERE stop IS NULL OR batch < stop GROUP BY 1),
        i AS (SELECT source AS installation_id, any_value(sn) AS sn, max(seq) AS high FROM r GROUP BY 1), j AS (SELECT i.*, CASE WHEN sn % 2 = 0 THEN 100 ELSE 0 END AS was, upto, stop.why, stop.installation_id IS NOT NULL AS sent FROM i LEFT JOIN moved USING (installation_id) LEFT JOIN stop USING (installation_id))
        SELECT installation_id, coalesce(why, CASE WHEN sent THEN 'done' ELSE 'idle' END) AS outcome, greatest(was, coalesce(upto, 0)) - was AS acked, greatest(was, coalesce(upto, 0)) AS cursor, high - greatest(was, coalesce(upto, 0)) AS pending FROM j""",
    "retry_classes": """WITH e AS (SELECT [200, 204, 301, 400, 401, 403, 404, 429, 500, 503, 599, 600, NULL][event_id % 13 + 1] AS status, event_id % 5 = 0 AS login, event_id % 9 + 1 AS attempt FROM events)
        SELECT status, login, CASE WHEN login THEN 'auth' WHEN status IS NULL THEN 'retryable' WHEN status < 300 THEN 'ok' WHEN status IN (401, 403) THEN 'auth' WHEN status IN (429, 500, 503, 599) THEN 'retryable' ELSE 'terminal' END AS class,
            attempt, CAST(CASE WHEN attempt < 7 THEN 0.5 * (1 << (attempt - 1)) ELSE 30.0 END AS DOUBLE) AS ceiling, count(*) AS n FROM e GROUP BY ALL""",
    "key_batches": """WITH k AS (SELECT s_suppkey, (row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) // 7 AS batch FROM supplier WHERE s_suppkey % 3 = 0)
        SELECT s_suppkey AS key_version, CAST(CASE WHEN s_suppkey % 3 > 0 THEN 1.0 WHEN batch = 0 THEN 9.0 END AS DOUBLE) AS shipped_at, batch FROM supplier LEFT JOIN k USING (s_suppkey)""",
    "poll_scan": "WITH m AS (SELECT conv_id * 1000 + turn AS id, role FROM conversations) SELECT id, role FROM m WHERE id > (SELECT max(id) // 2 - 32 FROM m) AND role IN ('user', 'assistant')",
    "spool_tail": """WITH l AS (SELECT user_id AS u, event_id, 'é' || event_id || CASE WHEN event_id % 4 = 0 THEN '' ELSE ' x' END AS value, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS last FROM events),
        p AS (SELECT *, CAST(sum(octet_length(encode(value)) + 1) OVER (PARTITION BY u ORDER BY event_id) AS BIGINT) AS until, CAST(sum(octet_length(encode(value)) + 1) OVER (PARTITION BY u) AS BIGINT) - 1 AS size FROM l)
        SELECT CAST(u AS VARCHAR) AS file, until - octet_length(encode(value)) - 1 AS "offset", until, value FROM p WHERE NOT last AND until - octet_length(encode(value)) - 1 >= CASE WHEN u % 3 = 0 OR u % 5 = 0 OR size < 40 THEN 0 ELSE 40 END""",
    "spool_cursors": """WITH l AS (SELECT user_id AS u, event_id, octet_length(encode('é' || event_id || CASE WHEN event_id % 4 = 0 THEN '' ELSE ' x' END)) + 1 AS n, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS last FROM events),
        p AS (SELECT u, n, last, sum(n) OVER (PARTITION BY u ORDER BY event_id) AS until, sum(n) OVER (PARTITION BY u) - 1 AS size FROM l),
        f AS (SELECT u, any_value(size) AS size, max(until) FILTER (NOT last AND until - n >= CASE WHEN u % 3 = 0 OR u % 5 = 0 OR size < 40 THEN 0 ELSE 40 END) AS until FROM p GROUP BY u)
        SELECT CAST(u AS VARCHAR) AS file, CASE WHEN u % 2 = 0 THEN 'g0' ELSE 'g1' END AS generation, CAST(coalesce(until, CASE WHEN u % 3 > 0 AND u % 5 > 0 AND size >= 40 THEN 40 END, 0) AS BIGINT) AS "offset" FROM f""",
    "heartbeat": "SELECT 'one' AS file, CAST(max(event_id) + 0.25 AS DOUBLE) AS value FROM events UNION ALL VALUES ('word', NULL), ('two', NULL), ('none', NULL)",
    "runtime_stamps": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 > 0 THEN '{"kind":"model","engine":"standard","home_mode":"' || CASE WHEN s_suppkey % 11 = 0 THEN 'auto' ELSE ['auto', 'real', 'profile', 'profile', 'real', 'real', 'auto', 'auto'][s_suppkey % 8 + 1] END || '"}'
        ELSE '{"kind":"gateway","engine":"standard","channels":[' || CASE WHEN s_suppkey % 3 > 0 THEN '"chat","c' || (s_suppkey % 3) || '"' ELSE '' END || ']' || CASE WHEN s_suppkey % 2 = 0 THEN ',"gateway_id":"g' || s_suppkey || '"' ELSE '' END || '}' END AS runtime FROM supplier""",
    "config_home_mode": f"SELECT s_suppkey AS id, [{_CONFIG_MODES}][s_suppkey % {len(CONFIGS)} + 1] AS mode FROM supplier",
    "meta_state": """WITH l AS (SELECT user_id AS u, max(event_id) AS k FROM events GROUP BY 1), v AS (SELECT 'cur_' || u AS key, k, CASE WHEN k % 7 = 0 THEN '{broken' WHEN k % 3 = 0 THEN '[' || k || ']' ELSE CAST(k AS VARCHAR) END AS value FROM l WHERE u % 2 = 0 AND k % 5 > 0)
        SELECT key, value, coalesce(TRY_CAST(value AS DOUBLE), -1.0) AS number, CASE WHEN value LIKE '[%' THEN value ELSE '[]' END AS listed FROM v""",
    "meta_deleted": """WITH l AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'cur_' ELSE 'curX' END || user_id AS key, max(event_id) AS k FROM events GROUP BY 1) SELECT count(*) AS keys, max(key) AS last FROM l WHERE k % 5 > 0 AND NOT starts_with(key, 'curX1')""",
    "windows_state": f"""WITH {_WINDOWS}, a AS (SELECT session_id, invocation_id, round(started_at, 3) AS started_at, round(ended_at, 3) AS ended_at FROM win WHERE started_at IS NOT NULL)
        SELECT * FROM a WHERE CAST(session_id AS BIGINT) % 4 > 0 UNION ALL SELECT session_id, min(invocation_id), 1.5, NULL FROM a WHERE CAST(session_id AS BIGINT) % 4 = 0 AND session_id NOT LIKE '%0' GROUP BY 1""",
    "horizons": "SELECT 'installed' AS name, CAST(max(event_id) AS DOUBLE) AS horizon FROM events UNION ALL VALUES ('missing', 0.0), ('capture', NULL)",
    "memory_states": f"""WITH {LEDGER_SQL}, c AS (SELECT session_id AS s, producer_sequence AS seq, CASE WHEN event_id % 10 <> 9 THEN 'c' || (event_id % 4) END AS c, row_number() OVER (PARTITION BY session_id ORDER BY producer_sequence) AS i FROM ledger WHERE event_type = 'tool.call_completed'),
        runs AS (SELECT *, sum(CASE WHEN c IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY seq) AS run FROM c),
        f AS (SELECT r.s, r.seq, x.c, min(x.seq) AS first FROM runs r JOIN runs x ON x.s = r.s AND x.run = r.run AND x.seq <= r.seq AND x.c IS NOT NULL WHERE r.c IS NOT NULL AND CAST(r.s AS BIGINT) % 2 = 0 GROUP BY ALL),
        t AS (SELECT s, seq, string_agg(c, chr(10) || '§' || chr(10) ORDER BY first) AS text FROM f GROUP BY ALL)
        SELECT c.s AS artifact_id, c.seq AS at, text FROM c LEFT JOIN t ON t.s = c.s AND t.seq = c.seq""",
    "version_lookups": f"WITH {_FILES}, v AS (SELECT artifact_id, version + 1 AS seq, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY ALL), c AS (SELECT artifact_id FROM v WHERE seq = 1 AND artifact_id <> 'src2') SELECT * FROM v WHERE seq > 1 OR artifact_id NOT IN (SELECT artifact_id FROM c)",
    "first_seen": f"WITH {LEDGER_SQL} SELECT session_id AS artifact_id, arg_min(event_type, occurred_at) AS name, round(min(occurred_at), 3) AS first_seen FROM ledger GROUP BY 1",
    "secret_rules": f"""WITH d AS (SELECT doc_id, 'AKIA' || lpad(CAST(doc_id AS VARCHAR), 16, 'Z') AS a, 'v' || lpad(CAST(doc_id % 50 AS VARCHAR), 9, '0') AS t FROM documents),
        m AS (SELECT doc_id, 'access_key' AS type, 7 AS byte_start, 27 AS byte_end, a AS v FROM d UNION ALL SELECT doc_id, 'assigned_secret', 42, 52, t FROM d UNION ALL SELECT doc_id, 'private_key', 54, 85, '-----BEGIN RSA PRIVATE KEY-----' FROM d)
        SELECT doc_id, type, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end, {_mac("type || ':' || v")} AS fingerprint FROM m""",
    "suppressions": "SELECT rpad('f-_' || s_suppkey, 22, 'A') AS fingerprint FROM supplier WHERE s_suppkey % 5 > 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 2 = 0) AND s_suppkey % 7 > 0",
    "hook_kinds": f"""WITH {_HOOK} SELECT 'hook-spool:g1:' || k AS dedup_key, CASE hook WHEN 'session:start' THEN 'session.created' WHEN 'agent:start' THEN 'invocation.started' WHEN 'agent:end' THEN 'invocation.completed' WHEN 'gateway:startup' THEN 'runtime.gateway_started' ELSE 'session.ended' END AS event_type,
        CASE WHEN hook IN ('session:end', 'session:reset') THEN started ELSE u END AS session_id, hook NOT IN ('session:start', 'gateway:startup') AS partial, CASE hook WHEN 'session:reset' THEN 'reset' WHEN 'session:end' THEN 'end' END AS reason, CASE WHEN hook = 'session:start' THEN 'chat' END AS surface FROM s""",
    "chunk_ranges": "SELECT 'r' || (doc_id // 2) AS content_ref, true AS ok, sha256(arg_max(text, doc_id)) AS sha FROM documents WHERE octet_length(encode(text)) > 4096 GROUP BY 1",
}
