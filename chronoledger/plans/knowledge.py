"""The version store, retention, shipping, security, status and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import detect, ledger as book, mappers, retention, security, status, store
from ..sources import scans
from .driver import INSTALLATION, LEDGER_SQL, NOW_EVENTS, all_events, epoch, ledger, table

# -- store -------------------------------------------------------------------


def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as blobs; those of every tenth document are stored already."""
    docs = table(spark, sf_dir, "documents")
    stored = docs.filter("doc_id % 10 = 0").select(S.content_hash("text").alias("blob_hash")).distinct()
    return store.new_blobs(docs.select(F.col("text").alias("content")), stored).select("blob_hash")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source in two versions, a part of them at the
    same paths."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("artifact_id"), F.expr("doc_id div 20 % 2").alias("version"), F.concat(F.lit("f"), F.expr("doc_id div 40 + doc_id div 20 % 2 * 3").cast("string"), F.lit("-"), F.expr("doc_id % 20").cast("string")).alias("path"), S.content_hash("text").alias("blob_hash"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"))


def manifest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.manifests(_files(spark, sf_dir)).select("artifact_id", "version", "manifest_hash", "n_files", "bytes")


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return store.manifest_diff(f.filter("version = 0"), f.filter("version = 1"))


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = store.manifests(_files(spark, sf_dir)).withColumnRenamed("version", "seq")
    return store.last_diff(versions)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of a user as a state of an artifact, by its type."""
    e = ledger(spark, sf_dir)
    return e.select(F.col("session_id").alias("artifact_id"), F.col("producer_sequence").alias("at"), F.when(F.col("event_type") != "model.call_failed", S.content_hash("event_type")).alias("manifest_hash"), F.lit("[]").alias("skipped"), (F.col("event_type") == "model.call_failed").alias("tombstone"))


def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.version_chain(_states(spark, sf_dir)).select("artifact_id", "at", "seq", "tombstone")


def version_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest_versions(store.version_chain(_states(spark, sf_dir)), store.retained("max_versions", 3)).select("artifact_id", "seq")


def blob_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of all files once only the second version is kept."""
    f = _files(spark, sf_dir)
    return store.orphan_blobs(f.select("blob_hash").distinct(), store.manifests(f.filter("version = 1")))


def restore_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    versions = store.manifests(f).withColumnRenamed("version", "seq").withColumn("tombstone", F.col("artifact_id") == "src1")
    blobs = table(spark, sf_dir, "documents").select(S.content_hash("text").alias("blob_hash"), F.col("text").alias("content")).dropDuplicates(["blob_hash"])
    return store.restore(versions, blobs).select("artifact_id", "path", F.sha2("content", 256).alias("sha"))


def resource_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 files, 6000 bytes a file, 20000 an artifact."""
    d = table(spark, sf_dir, "documents")
    f = d.select(F.col("source").alias("artifact_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"))
    return store.limit_files(f, 20, 6000, 20_000).groupBy("artifact_id", F.coalesce("skipped", F.lit("kept")).alias("state")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


def disk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = store.manifests(_files(spark, sf_dir))
    disk = m.filter("version = 1 and artifact_id <> 'src3'").select("artifact_id", F.col("manifest_hash").alias("disk_hash"))
    latest = m.filter("version = 0 and artifact_id <> 'src4'").select("artifact_id", "manifest_hash", (F.col("artifact_id") == "src5").alias("tombstone"))
    return store.captured_changes(disk, latest)


def knowledge_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against labels: stored quality and toxicity stand for hashes."""
    l = table(spark, sf_dir, "labels")
    disk = l.select(F.col("doc_id").alias("artifact_id"), F.lit(1).alias("disk_hash"), F.when(F.col("doc_id") % 2 == 0, F.lit(0)).alias("skipped"))
    latest = l.select(F.col("doc_id").alias("artifact_id"), F.col("quality").alias("manifest_hash"), F.when(F.col("doc_id") % 2 == 0, F.col("toxic")).alias("skipped_files"))
    return detect.drifted(disk, latest).select("artifact_id")


def knowledge_unemitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = store.version_chain(_states(spark, sf_dir)).select("artifact_id", "seq")
    cursors = versions.groupBy("artifact_id").agg((F.max("seq") - 2).alias("emitted")).filter(F.col("artifact_id").cast("long") % 3 > 0)
    return detect.unemitted(versions, cursors)


def version_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    versions = store.manifests(f).withColumn("seq", F.col("version") + 1).withColumn("tombstone", F.lit(False))
    blobs = table(spark, sf_dir, "documents").select(S.content_hash("text").alias("blob_hash"), F.col("text").alias("content")).dropDuplicates(["blob_hash"])
    made = store.version_events(versions, blobs)
    first = F.from_json("bundle", "files array<struct<path:string,byte_count:bigint,content_b64:string>>")["files"]
    return made.select("artifact_id", "seq", "action", F.size(first).cast("long").alias("n_files"), F.get(first, F.lit(0))["path"].alias("first_path"), F.octet_length(F.unbase64(F.get(first, F.lit(0))["content_b64"])).cast("long").alias("first_bytes"))


def stat_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    listing = d.select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("modified"), F.col("n_chars").alias("length"))
    known = d.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).alias("modified"), F.col("n_chars").alias("length")).filter("path not like '%9'")
    return store.changed_files(listing, known).select("path")


def knowledge_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of every kind, classified and resolved."""
    k = F.col("s_suppkey")
    args = ['{"action": "create", "name": "n1"}', '{"action": "patch", "name": "n2"}', '{"action": "fly", "name": "n1"}', '{"action": "add", "target": "user"}', '{"operations": [{"action": "add"}, {"action": "remove"}]}', '{"operations": [{"action": "no"}]}', '{"action": "add", "target": "moon"}']
    calls = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 7 < 3, "skill_manage").otherwise("memory").alias("tool_name"), F.element_at(F.array(*[F.lit(a) for a in args]), (k % 7 + 1).cast("int")).alias("arguments"), F.when(k % 5 == 0, '{"success": false}').when(k % 5 == 1, '{"success": true, "staged": true}').otherwise('{"success": true}').alias("result"))
    found = store.classify_mutations(calls).withColumn("category", F.when(F.col("id") % 2 == 0, "c"))
    artifacts = spark.createDataFrame([("skill:a/n1", "n1", True, 9.0), ("skill:b/n1", "n1", False, 1.0), ("skill:c/n1", "n1", False, 5.0)], "artifact_id string, name string, tombstone boolean, first_seen double")
    return store.resolve_artifact(found, artifacts).select("id", "kind", "action", "artifact_id", F.concat_ws("+", "operation_actions").alias("operations"))


def tool_call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a tool result; the assistant turns before it called it
    by the conversation's id."""
    c = table(spark, sf_dir, "conversations")
    call = F.to_json(F.array(F.struct(F.concat(F.lit("c"), F.col("turn") % 4).alias("id"), F.struct(F.lit("memory").alias("name"), F.lit("{}").alias("arguments")).alias("function"))))
    m = c.select(F.col("turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "user", F.concat(F.lit("c"), (F.col("turn") + 1) % 4)).alias("tool_call_id"), F.when(F.col("role") == "assistant", call).alias("tool_calls"))
    return store.pair_tool_calls(m).select("session_id", "id", "assistant_id", "name")


def after_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as edits of one skill and one memory."""
    e = ledger(spark, sf_dir)
    step = {"invocation.started": ("create", '{"content": "a b a"}'), "invocation.completed": ("write_file", '{"file_path": "x.md", "file_content": "y"}'), "tool.call_completed": ("patch", '{"old_string": "b", "new_string": "b b"}'), "model.usage_recorded": ("remove_file", '{"file_path": "x.md"}'), "model.call_failed": ("edit", '{"content": "b"}')}
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for kind, v in step.items() for x in (kind, v[i])]), F.col("event_type"))
    m = e.select(F.col("session_id").alias("artifact_id"), F.lit("skill").alias("kind"), F.lit("n").alias("name"), F.col("producer_sequence").alias("at"), pick(0).alias("action"), pick(1).alias("arguments"))
    return store.after_states(m)


# -- ledger, retention, shipping --------------------------------------------------

def content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("dedup_key"), F.col("text").alias("content"))
    return mappers.content_chunks(d, 4096).select("content_ref", "chunk", "chunks", "bytes", F.sha2("data", 256).alias("sha"))


def content_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every seventh document are lost."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("dedup_key"), F.col("text").alias("content"), "doc_id")
    chunks = mappers.content_chunks(d, 4096).filter("not (cast(content_ref as bigint) % 7 = 0 and chunk = 1)")
    parents = d.select(F.col("dedup_key").alias("content_ref"), F.octet_length(F.encode("content", "UTF-8")).alias("total_bytes"), S.content_hash("content").alias("content_hash")).filter("total_bytes > 4096")
    return mappers.reassembled(chunks, parents).select("content_ref", "ok", F.sha2("content", 256).alias("sha"))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, each also a second time under the key of its half."""
    e = all_events(spark, sf_dir).select("installation_id", "arrival", F.expr("concat('k', arrival div 2)").alias("dedup_key"), "event_type")
    return e


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys of three are new; numbering goes on from 500."""
    known = _batch(spark, sf_dir).filter("arrival % 6 = 0").select("dedup_key")
    high = spark.createDataFrame([(INSTALLATION, 500)], "installation_id string, high bigint")
    return book.sequenced(book.fresh_records(_batch(spark, sf_dir), known), high, bucket=1000).select("dedup_key", "arrival", "producer_sequence")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("installation_id", "producer_sequence", F.col("occurred_at").alias("recorded_at"), (F.octet_length("props") + F.octet_length("event_type") + 100).cast("long").alias("bytes"))


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered up to three quarters; ten days of age, half of the bytes."""
    e = _sized(spark, sf_dir)
    facts = e.agg(F.max("producer_sequence").alias("m"), F.sum("bytes").alias("b")).first()
    return retention.prune_set(e, int(facts["m"] * 3 // 4), cutoff=1704931200.0, max_bytes=int(facts["b"] // 2)).select("producer_sequence", "reason")


def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _sized(spark, sf_dir)
    high = e.groupBy("installation_id").agg(F.max("producer_sequence").alias("high"))
    cursor = e.groupBy("installation_id").agg((F.min("producer_sequence") + 99).alias("cursor"))
    return book.stats(e, high, cursor)


def ship_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 50 records or 64 KiB, after a base of 50 bytes."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("installation_id"), F.col("doc_id").alias("producer_sequence"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("bytes"))
    return retention.ship_batches(d, 50, 65_536, 50)


def sink_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.expr("event_id div 2").alias("event_id"))
    return retention.accept(e, e.filter("event_id % 3 = 0").distinct())[1]


def unshipped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key_version"), F.col("s_acctbal").alias("created_at"), F.when(F.col("s_suppkey") % 3 > 0, 1.0).alias("shipped_at"))
    return retention.unshipped_keys(k).select("key_version")


def envelope_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid envelopes, and those that each lack or break one thing."""
    k = F.col("event_id")
    body = F.struct(
        F.when(k % 10 == 1, "2").otherwise("1").alias("schema_version"), F.when(k % 10 != 2, k.cast("string")).alias("event_id"), k.alias("producer_sequence"), F.lit(1.5).alias("occurred_at"), F.lit(2.5).alias("recorded_at"),
        F.lit("i").alias("installation_id"), F.lit("t").alias("tenant_id"), F.lit("default").alias("profile"), F.create_map(F.lit("a"), F.lit("b")).alias("runtime"), F.lit("c").alias("correlation_id"), F.lit("s").alias("source"), F.lit("m").alias("capture_method"),
        F.struct(F.when(k % 10 == 3, "no.such").otherwise("session.created").alias("event_type")).alias("payload"), F.when(k % 10 == 4, "x").alias("content_ciphertext"), F.when(k % 10 == 5, "x").alias("key_version"), F.when(k % 10 == 6, 1).alias("surprise"), F.lit(False).alias("partial"),
    )
    text = F.when(k % 10 == 7, "[]").when(k % 10 == 8, F.replace(F.to_json(body), F.lit('"partial":false'), F.lit('"partial":"no"'))).otherwise(F.to_json(body))
    e = table(spark, sf_dir, "events").select(k, text.alias("envelope"))
    return e.select("event_id", F.get(book.violations(F.col("envelope")), F.lit(0)).alias("first_violation"))


# -- security, status, scalars ------------------------------------------------------

SECRET = b"a key of this installation"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = security.scan_targets(table(spark, sf_dir, "documents"), {"body": "text"}, "doc_id")
    return security.secret_matches(targets, "doc_id")


def secret_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).filter("type = 'assigned_secret'").select("doc_id", "byte_start", "byte_end", "value")


def secret_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by fingerprint, without those of documents labelled toxic."""
    found = security.fingerprinted(_matches(spark, sf_dir), SECRET)
    baseline = found.join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi")
    groups = security.secret_groups(security.unsuppressed(found, baseline).withColumn("first_event", F.col("doc_id").cast("string")), F.struct("doc_id", "byte_start", "type"))
    return groups.select("type", "first_event", "byte_start", "occurrences", F.char_length("fingerprint").cast("long").alias("fingerprint_length"))


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as sources, errors of a user as failed passes."""
    e = table(spark, sf_dir, "events")
    passes = e.select((F.col("user_id") % 8).cast("string").alias("source"), epoch("ts").alias("at"), ((F.col("event_type") != "error") & (F.col("user_id") % 8 > 0)).alias("ok"))
    return status.report(status.health_states(passes), ["1", "2"], NOW_EVENTS, 12 * 3600.0).select("source", "failures", "verdict", "required", "healthy")


def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select(F.element_at(F.array(*[F.lit(x) for x in ("a/b", "a//b", "../x", "a/./b", "", "ok.md", "a\\b", "/abs", "tail/", "x" * 513)]), (F.col("page_id") % 10 + 1).cast("int")).alias("path"))
    return d.filter(scans.safe_path(F.col("path"))).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def tracked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a file listing below their source; two sources are excluded."""
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 9 == 0, F.lit("../")).otherwise(F.lit("")), F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    excluded = spark.createDataFrame([("src1",), ("src2",)], "name string")
    return scans.artifact_files(d, excluded, 5).select("name", "rel")


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", S.iso_utc(epoch("ts")).alias("iso"), S.short_hash(S.content_hash(F.col("event_id").cast("string"))).alias("short"), S.short_text(F.repeat(F.lit("ab"), (F.col("event_id") % 30).cast("int"))).alias("text"),
        S.wire_bytes(F.col("event_id") % 100).alias("wire"), S.zone_seconds(F.element_at(F.array(F.lit("2024-01-01T00:00:00+05:30"), F.lit("2024-01-01T00:00:00-08:00"), F.lit("2024-01-01T00:00:00Z")), (F.col("event_id") % 3 + 1).cast("int"))).alias("zone"),
        S.to_epoch(F.when(F.col("event_id") % 2 == 0, "1970-01-01T01:00:00+01:00").when(F.col("event_id") % 5 == 0, "12.5").otherwise("soon")).alias("at"),
    )


def content_crypto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encrypted and decrypted again, and with a wrong key."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", S.encrypt("text", b"k" * 32, F.unhex(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 24))).alias("c"))
    back = S.decrypt(F.col("c.content_ciphertext"), F.col("c.content_nonce"), b"k" * 32)
    wrong = S.decrypt(F.col("c.content_ciphertext"), F.col("c.content_nonce"), b"w" * 32)
    return d.select("doc_id", (back == F.col("text")).alias("same"), wrong.isNull().alias("refused"), F.octet_length(F.unbase64("c.content_ciphertext")).cast("long").alias("sealed_bytes"))


def last_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line that is a number."""
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 7, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".5 "))).otherwise("noise").alias("value"))
    return scans.last_epoch(lines, "event_id")


QUERIES = {f.__name__: f for f in (
    blob_dedup, manifest_hashes, manifest_diff, version_diff, version_chain, version_retention, blob_gc, restore_version, resource_caps, disk_changes, knowledge_drift, knowledge_unemitted, version_events, stat_changes,
    knowledge_calls, tool_call_pairs, after_states, content_chunks, content_reassembly, ledger_append, retention_prune, ledger_stats, ship_batches, sink_accept, unshipped_keys, envelope_checks, secret_matches,
    secret_groups, health_report, safe_paths, tracked_files, scalar_functions, content_crypto, last_start,
)}

_FILES = """f AS (SELECT source AS artifact_id, doc_id // 20 % 2 AS version, 'f' || (doc_id // 40 + doc_id // 20 % 2 * 3) || '-' || (doc_id % 20) AS path, 'sha256:' || sha256(text) AS blob_hash, octet_length(encode(text)) AS size, text FROM documents)"""
_HASHES = f"""{_FILES}, m AS (SELECT artifact_id, version, 'sha256:' || sha256('[' || string_agg('{{"blob_hash":"' || blob_hash || '","path":"' || path || '"}}', ',' ORDER BY path) || ']') AS manifest_hash, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY ALL)"""
_CHAIN = f"""{LEDGER_SQL}, st AS (SELECT session_id AS artifact_id, producer_sequence AS at_seq, event_type, lag(event_type) OVER (PARTITION BY session_id ORDER BY producer_sequence) AS before FROM ledger),
    chain AS (SELECT artifact_id, at_seq, row_number() OVER (PARTITION BY artifact_id ORDER BY at_seq) AS seq, event_type = 'model.call_failed' AS tombstone FROM st WHERE event_type IS DISTINCT FROM before)"""
_DIFF = """SELECT artifact_id, path, CASE WHEN b.blob_hash IS NULL THEN '+' WHEN a.blob_hash IS NULL THEN '-' ELSE '~' END AS change
    FROM (SELECT * FROM f WHERE version = 0) b FULL JOIN (SELECT * FROM f WHERE version = 1) a USING (artifact_id, path) WHERE a.blob_hash IS DISTINCT FROM b.blob_hash"""
_SIZED = f"{LEDGER_SQL}, z AS (SELECT l.producer_sequence, l.occurred_at AS recorded_at, octet_length(encode(e.props)) + octet_length(encode(l.event_type)) + 100 AS bytes FROM ledger l JOIN events e USING (event_id))"
_SECRETS = r"""hit AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '(?i)\b(?:api_?key|passwd|password|secret|token)\b["'']?\s*[:=]\s*["'']?([A-Za-z0-9+/_.=-]{8,})', 0)) AS whole,
        unnest(regexp_extract_all(text, '(?i)\b(?:api_?key|passwd|password|secret|token)\b["'']?\s*[:=]\s*["'']?([A-Za-z0-9+/_.=-]{8,})', 1)) AS value FROM documents),
    nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, whole) AS n FROM hit),
    pos AS (SELECT doc_id, value, CAST(list_sum(list_transform(list_slice(string_split(text, whole), 1, n), lambda g: octet_length(encode(g)))) + (n - 1) * octet_length(encode(whole)) + octet_length(encode(left(whole, strpos(whole, value) - 1))) AS BIGINT) AS byte_start FROM nth)"""

ORACLES = {
    "blob_dedup": "SELECT DISTINCT 'sha256:' || sha256(text) AS blob_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)",
    "manifest_hashes": f"WITH {_HASHES} SELECT * FROM m",
    "manifest_diff": f"WITH {_FILES} {_DIFF}",
    "version_diff": f"WITH {_FILES} SELECT * FROM ({_DIFF}) WHERE artifact_id IN (SELECT artifact_id FROM f GROUP BY 1 HAVING count(DISTINCT version) = 2)",
    "version_chain": f"WITH {_CHAIN} SELECT artifact_id, at_seq AS at, seq, tombstone FROM chain",
    "version_retention": f"WITH {_CHAIN} SELECT artifact_id, seq FROM chain QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY seq DESC) <= 3",
    "blob_gc": f"WITH {_FILES} SELECT blob_hash FROM f EXCEPT SELECT blob_hash FROM f WHERE version = 1",
    "restore_version": f"WITH {_FILES}, l AS (SELECT artifact_id, max(version) AS version FROM f GROUP BY 1) SELECT artifact_id, path, sha256(text) AS sha FROM f JOIN l USING (artifact_id, version) WHERE artifact_id <> 'src1'",
    "resource_caps": """WITH RECURSIVE o AS (SELECT source, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
        w AS (SELECT source, i, size, CASE WHEN size > 6000 THEN 'max_file_bytes' WHEN size > 20000 THEN 'max_artifact_bytes' END AS why, CASE WHEN size > 6000 THEN 0 ELSE size END AS used FROM o WHERE i = 1
            UNION ALL SELECT o.source, o.i, o.size, CASE WHEN o.i > 20 THEN 'max_file_count' WHEN o.size > 6000 THEN 'max_file_bytes' WHEN w.used + o.size > 20000 THEN 'max_artifact_bytes' END,
                CASE WHEN o.i > 20 OR o.size > 6000 OR w.used + o.size > 20000 THEN w.used ELSE w.used + o.size END FROM w JOIN o ON o.source = w.source AND o.i = w.i + 1)
        SELECT source AS artifact_id, coalesce(why, 'kept') AS state, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM w GROUP BY ALL""",
    "disk_changes": f"""WITH {_HASHES}, d AS (SELECT artifact_id, manifest_hash AS a FROM m WHERE version = 1 AND artifact_id <> 'src3'), l AS (SELECT artifact_id, manifest_hash AS b, artifact_id = 'src5' AS gone FROM m WHERE version = 0 AND artifact_id <> 'src4'),
        j AS (SELECT artifact_id, CASE WHEN b IS NULL THEN 'create' WHEN a IS NULL AND NOT gone THEN 'delete' WHEN a IS NOT NULL AND (gone OR a <> b) THEN 'update' END AS change FROM d FULL JOIN l USING (artifact_id)) SELECT * FROM j WHERE change IS NOT NULL""",
    "knowledge_drift": "SELECT doc_id AS artifact_id FROM labels WHERE quality <> 1 OR (doc_id % 2 = 0 AND toxic <> 0)",
    "knowledge_unemitted": f"WITH {_CHAIN}, c AS (SELECT artifact_id, max(seq) - 2 AS emitted FROM chain WHERE CAST(artifact_id AS BIGINT) % 3 > 0 GROUP BY 1) SELECT artifact_id, seq FROM chain LEFT JOIN c USING (artifact_id) WHERE seq > coalesce(emitted, 0)",
    "version_events": f"WITH {_FILES} SELECT artifact_id, version + 1 AS seq, CASE WHEN version = 0 THEN 'create' ELSE 'update' END AS action, count(*) AS n_files, min(path) AS first_path, arg_min(size, path) AS first_bytes FROM f GROUP BY ALL",
    "stat_changes": "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 7 = 0 OR doc_id % 10 = 9",
    "knowledge_calls": """WITH c AS (SELECT s_suppkey AS id, s_suppkey % 7 AS k FROM supplier WHERE s_suppkey % 5 > 1 AND s_suppkey % 7 IN (0, 1, 3, 4))
        SELECT id, CASE WHEN k < 3 THEN 'skill' ELSE 'memory' END AS kind, CASE k WHEN 0 THEN 'create' WHEN 1 THEN 'patch' WHEN 3 THEN 'add' ELSE 'batch' END AS action,
            CASE WHEN id % 2 = 0 THEN 'skill:c/' ELSE 'skill:' END || CASE k WHEN 0 THEN CASE WHEN id % 2 = 0 THEN 'n1' ELSE 'c/n1' END WHEN 1 THEN 'n2' WHEN 3 THEN 'user' ELSE 'memory' END AS artifact_id, CASE WHEN k = 4 THEN 'add+remove' ELSE '' END AS operations FROM c""",
    "tool_call_pairs": """SELECT CAST(r.conv_id AS VARCHAR) AS session_id, r.turn AS id, max(a.turn) AS assistant_id, 'memory' AS name FROM conversations r JOIN conversations a ON a.conv_id = r.conv_id AND a.role = 'assistant' AND r.role = 'user' AND a.turn < r.turn AND a.turn % 4 = (r.turn + 1) % 4 GROUP BY ALL""",
    "content_chunks": """WITH d AS (SELECT doc_id, encode(text) AS b, CAST(ceil(octet_length(encode(text)) / 4096.0) AS INT) AS n FROM documents WHERE octet_length(encode(text)) > 4096), c AS (SELECT doc_id, b, n, unnest(range(0, n)) AS i FROM d),
        h AS (SELECT *, substr(hex(b), i * 8192 + 1, 8192) AS x FROM c)
        SELECT CAST(doc_id AS VARCHAR) AS content_ref, CAST(i AS INT) AS chunk, n AS chunks, len(x) // 2 AS bytes, sha256(unhex(x)) AS sha FROM h""",
    "content_reassembly": "SELECT CAST(doc_id AS VARCHAR) AS content_ref, doc_id % 7 <> 0 AS ok, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS sha FROM documents WHERE octet_length(encode(text)) > 4096",
    "ledger_append": f"""WITH {LEDGER_SQL}, k AS (SELECT 'k' || (producer_sequence // 2) AS dedup_key, min(producer_sequence) AS arrival FROM all_events GROUP BY 1),
        n AS (SELECT * FROM k WHERE dedup_key NOT IN (SELECT 'k' || (producer_sequence // 2) FROM all_events WHERE producer_sequence % 6 = 0)) SELECT dedup_key, arrival, 500 + row_number() OVER (ORDER BY arrival) AS producer_sequence FROM n""",
    "retention_prune": f"""WITH {_SIZED}, t AS (SELECT max(producer_sequence) * 3 // 4 AS d, CAST(sum(bytes) AS BIGINT) // 2 AS cap FROM z),
        a AS (SELECT z.*, d, cap, producer_sequence <= d AND recorded_at < 1704931200 AS old FROM z, t),
        r AS (SELECT *, sum(bytes) OVER () - (sum(bytes) OVER (ORDER BY producer_sequence) - bytes) AS remaining FROM a WHERE NOT old)
        SELECT producer_sequence, 'age' AS reason FROM a WHERE old UNION ALL SELECT producer_sequence, 'size' FROM r WHERE producer_sequence <= d AND remaining > cap""",
    "ledger_stats": f"WITH {_SIZED} SELECT '{INSTALLATION}' AS installation_id, count(*) AS events, min(producer_sequence) AS first_sequence, max(producer_sequence) AS last_sequence, CAST(sum(bytes) AS BIGINT) AS bytes, max(producer_sequence) AS high_water, max(producer_sequence) - min(producer_sequence) - 99 AS pending FROM z",
    "ship_batches": """WITH RECURSIVE o AS (SELECT source, doc_id, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
        w AS (SELECT source, doc_id, i, 0 AS batch, 1 AS n, 50 + size AS used FROM o WHERE i = 1
            UNION ALL SELECT o.source, o.doc_id, o.i, CASE WHEN w.n >= 50 OR w.used + o.size + 1 > 65536 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.n >= 50 OR w.used + o.size + 1 > 65536 THEN 1 ELSE w.n + 1 END,
                CASE WHEN w.n >= 50 OR w.used + o.size + 1 > 65536 THEN 50 + o.size ELSE w.used + o.size + 1 END FROM w JOIN o ON o.source = w.source AND o.i = w.i + 1)
        SELECT source AS installation_id, doc_id AS producer_sequence, CAST(batch AS BIGINT) AS batch FROM w""",
    "sink_accept": "SELECT count(DISTINCT event_id // 2) FILTER (event_id // 2 % 3 <> 0) AS accepted, count(*) - count(DISTINCT event_id // 2) FILTER (event_id // 2 % 3 <> 0) AS duplicates FROM events",
    "unshipped_keys": "SELECT s_suppkey AS key_version FROM supplier WHERE s_suppkey % 3 = 0",
    "envelope_checks": """SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'unsupported schema_version' WHEN 2 THEN 'missing event_id' WHEN 3 THEN 'unknown event_type' WHEN 4 THEN 'content without content_nonce' WHEN 5 THEN 'key_version without content'
        WHEN 6 THEN 'unknown fields: surprise' WHEN 7 THEN 'no object' WHEN 8 THEN 'partial is no boolean' END AS first_violation FROM events""",
    "secret_matches": f"WITH {_SECRETS} SELECT doc_id, byte_start, byte_start + octet_length(encode(value)) AS byte_end, value FROM pos",
    "secret_groups": f"""WITH {_SECRETS}, p AS (SELECT * FROM pos UNION ALL SELECT doc_id, w, octet_length(encode(left(text, strpos(text, w) - 1))) FROM (SELECT doc_id, text, regexp_extract(text, '\\b(AKIA[0-9A-Z]{{16}})\\b', 1) AS w FROM documents) WHERE w <> ''),
        s AS (SELECT DISTINCT value FROM p JOIN labels USING (doc_id) WHERE toxic = 1), g AS (SELECT CASE WHEN value LIKE 'AKIA%' AND len(value) = 20 THEN 'access_key' ELSE 'assigned_secret' END AS type, * FROM p WHERE value NOT IN (SELECT value FROM s))
        SELECT type, CAST(min(doc_id) AS VARCHAR) AS first_event, arg_min(byte_start, doc_id) AS byte_start, count(*) AS occurrences, CAST(22 AS BIGINT) AS fingerprint_length FROM g GROUP BY type, value""",
    "health_report": f"""WITH p AS (SELECT CAST(user_id % 8 AS VARCHAR) AS source, epoch_us(ts) / 1e6 AS t, event_type <> 'error' AND user_id % 8 > 0 AS ok FROM events),
        l AS (SELECT source, max(t) FILTER (ok) AS good FROM p GROUP BY 1), s AS (SELECT l.source, good, count(*) FILTER (good IS NULL OR t > good) AS failures FROM l JOIN p USING (source) GROUP BY ALL),
        v AS (SELECT *, CASE WHEN failures > 0 THEN 'BROKEN' WHEN good IS NULL THEN 'NO SUCCESS' WHEN {NOW_EVENTS} - good > 43200 THEN 'STALE' ELSE 'OK' END AS verdict, source IN ('1', '2') AS required FROM s)
        SELECT source, failures, verdict, required, bool_and(verdict = 'OK' OR NOT required) OVER () AS healthy FROM v""",
    "safe_paths": "SELECT CASE page_id % 10 WHEN 0 THEN 'a/b' ELSE 'ok.md' END AS path, count(*) AS n FROM pages WHERE page_id % 10 IN (0, 5) GROUP BY 1",
    "tracked_files": "SELECT source AS name, 'f' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS rel FROM documents WHERE doc_id % 9 <> 0 AND source NOT IN ('src1', 'src2') QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5",
    "scalar_functions": """SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, 'sha256:' || left(sha256(CAST(event_id AS VARCHAR)), 12) AS short,
        CASE WHEN event_id % 30 <= 20 THEN repeat('ab', event_id % 30) ELSE left(repeat('ab', 30), 39) || '…' END AS text, CAST(4 * ceil((event_id % 100 + 16) / 3.0) AS BIGINT) AS wire, [19800, -28800, 0][event_id % 3 + 1] AS zone,
        CAST(CASE WHEN event_id % 2 = 0 THEN 0.0 WHEN event_id % 5 = 0 THEN 12.5 END AS DOUBLE) AS at FROM events""",
    "content_crypto": "SELECT doc_id, true AS same, true AS refused, octet_length(encode(text)) + 16 AS sealed_bytes FROM documents",
    "last_start": "SELECT CAST(max(event_id) + 0.5 AS DOUBLE) AS last FROM events WHERE event_id % 50 = 7",
}
