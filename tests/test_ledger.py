"""Append, retention, store, views and scalars."""

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from chronoledger.functions import scalars as S
from chronoledger.operators import ledger as book, retention, security, shipping, store, tree, usage, views
from chronoledger.operators.mappers import content_chunks, reassembled
from chronoledger.sources import scans


def column(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def golden(**changes):
    base = dict(
        schema_version="1", event_id="e", producer_sequence=1, occurred_at=1.5, recorded_at=2, installation_id="i", tenant_id="t", profile="default", runtime={}, correlation_id="c", source="s", capture_method="m",
        payload={"event_type": "session.created"}, partial=False,
    )
    return json.dumps({k: v for k, v in (base | changes).items() if v != "ABSENT"})


def test_envelope_validation(spark):
    cases = {
        golden(): [], golden(session_id=None): [], golden(event_id="ABSENT"): ["missing event_id"], golden(event_id=None): ["missing event_id"], golden(producer_sequence=True): ["producer_sequence is no integer"],
        golden(producer_sequence=1.5): ["producer_sequence is no integer"], golden(occurred_at=7): [], golden(partial=1): ["partial is no boolean"], golden(schema_version="2"): ["unsupported schema_version"], golden(odd=1): ["unknown fields: odd"],
        golden(content_hash="h"): ["content_hash without content"], golden(content_ciphertext="x", content_nonce="n", content_hash="h", key_version="k"): [], golden(payload={}): ["event_type is no string"],
        golden(payload={"event_type": 3}): ["event_type is no string"], golden(payload={"event_type": "x.y"}): ["unknown event_type"], "[]": ["no object"], "nope": ["no object"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.v for r in df.select("t", book.violations(F.col("t")).alias("v")).collect()} == cases


def test_append_numbers_without_holes(spark):
    rng = random.Random(3)
    arrivals = rng.sample(range(5000), 300)
    batch = spark.createDataFrame([("ab"[a % 2], a, f"k{a % 250}") for a in arrivals], "installation_id string, arrival long, dedup_key string")
    known = spark.createDataFrame([("k1",), ("k2",)], "dedup_key string")
    high = spark.createDataFrame([("a", 10)], "installation_id string, high long")
    got = book.sequenced(book.fresh_records(batch, known), high, bucket=100).collect()
    firsts = {}
    for a in sorted(arrivals):
        firsts.setdefault(f"k{a % 250}", a)
    assert {r.dedup_key: r.arrival for r in got} == {k: a for k, a in firsts.items() if k not in ("k1", "k2")}
    for inst, start in (("a", 10), ("b", 0)):
        own = sorted((r.arrival, r.producer_sequence) for r in got if r.installation_id == inst)
        assert [s for _, s in own] == list(range(start + 1, start + 1 + len(own)))
    marks = {r.installation_id: r.high for r in book.next_high_water(high, spark.createDataFrame(got)).collect()}
    assert marks["a"] == max(r.producer_sequence for r in got if r.installation_id == "a")


def test_prune_by_age_and_size(spark):
    e = spark.createDataFrame([("i", k, r, 100) for k, r in ((1, 1.0), (2, 50.0), (3, 1.0), (4, 1.0))], "installation_id string, producer_sequence long, recorded_at double, bytes long")
    assert sorted(r.producer_sequence for r in retention.prune_set(e, 3, cutoff=10.0).collect()) == [1, 3]
    assert [r.producer_sequence for r in retention.prune_set(e, 3, max_bytes=300).collect()] == [1]
    assert retention.prune_set(e, 3, max_bytes=400).count() == 0
    assert sorted(r.producer_sequence for r in retention.prune_set(e, 3, max_bytes=0).collect()) == [1, 2, 3]
    assert sorted((r.producer_sequence, r.reason) for r in retention.prune_set(e, 4, cutoff=1.5, max_bytes=50).collect()) == [(1, "age"), (2, "size"), (3, "age"), (4, "age")]


def test_running_totals_over_buckets(spark):
    rng = random.Random(5)
    rows = [("ab"[k % 2], k, rng.randrange(9)) for k in range(200)]
    got = retention.running_total(spark.createDataFrame(rows, "key string, at long, v long"), "key", "at", "v", "total", bucket=17).collect()
    for key in "ab":
        total = 0
        for r in sorted((r for r in got if r.key == key), key=lambda r: r.at):
            total += r.v
            assert r.total == total


def test_batches_against_a_loop(spark):
    rng = random.Random(6)
    rows = [("i", k, rng.choice([1, 10, 90, 300])) for k in range(200)]
    want, batch, n, used = {}, 0, 0, 0
    for _, k, size in rows:
        if n and (n >= 7 or used + size + 1 > 256):
            batch, n = batch + 1, 0
        used = 20 + size if n == 0 else used + size + 1
        n += 1
        want[k] = batch
    df = spark.createDataFrame(rows, "installation_id string, producer_sequence long, bytes long")
    assert {r.producer_sequence: r.batch for r in retention.ship_batches(df, 7, 256, 20).collect()} == want


def test_chunks_and_reassembly(spark):
    texts = {"a": "é" * 500, "b": "short", "c": "x" * 1001, "d": "y" * 700}
    df = spark.createDataFrame(list(texts.items()), "dedup_key string, content string")
    chunks = content_chunks(df, 250).filter("not (content_ref = 'd' and chunk = 2)")
    parents = df.filter("dedup_key <> 'b'").select(F.col("dedup_key").alias("content_ref"), F.octet_length(F.encode("content", "UTF-8")).alias("total_bytes"), S.content_hash("content").alias("content_hash"))
    got = {r.content_ref: (r.ok, r.content and bytes(r.content).decode()) for r in reassembled(chunks, parents).collect()}
    assert got == {"a": (True, texts["a"]), "c": (True, texts["c"]), "d": (False, None)}


def test_manifest_hash_is_that_of_canonical_json(spark):
    entries = [("b.md", "sha256:2"), ("a.md", "sha256:1")]
    df = spark.createDataFrame([(entries,)], f"m {store.MANIFEST}")
    canonical = json.dumps([{"blob_hash": h, "path": p} for p, h in sorted(entries)], separators=(",", ":"))
    assert df.select(store.manifest_hash(F.col("m")).alias("h")).first().h == "sha256:" + hashlib.sha256(canonical.encode()).hexdigest()


def test_version_chain_and_tombstones(spark):
    states = [("a", 1, "h1", False), ("a", 2, "h1", False), ("a", 3, None, True), ("a", 4, None, True), ("a", 5, "h1", False)]
    df = spark.createDataFrame([(a, t, h, "[]", x) for a, t, h, x in states], "artifact_id string, at long, manifest_hash string, skipped string, tombstone boolean")
    assert [(r.at, r.seq) for r in store.version_chain(df).orderBy("seq").collect()] == [(1, 1), (3, 2), (5, 3)]
    assert store.newest_versions(store.version_chain(df), 0).count() == 1


def test_folds_of_edits():
    f = store.fold_skill(None, "create", {"content": "a b"})
    assert store.fold_skill(f, "patch", {"old_string": "b", "new_string": "c"}) == {"SKILL.md": "a c"}
    assert store.fold_skill({"SKILL.md": "a a"}, "patch", {"old_string": "a", "new_string": "b"}) is None
    assert store.fold_skill({"SKILL.md": "a a"}, "patch", {"old_string": "a", "new_string": "b", "replace_all": True}) == {"SKILL.md": "b b"}
    assert store.fold_skill(f, "remove_file", {"file_path": "x"}) is None and store.fold_skill(f, "delete", {}) == {}
    assert store.fold_memory(["one", "two"], [{"action": "add", "content": " one "}, {"action": "remove", "old_text": "tw"}]) == ["one"]
    assert store.fold_memory(["one", "only"], [{"action": "replace", "old_text": "on", "content": "x"}]) is None
    assert store.fold_memory([], [{"action": "add", "content": "  "}]) is None


def test_after_states_of_memories_and_bad_arguments(spark):
    """By hand: unknown until a result counts the entries, and after what cannot be told."""
    calls = [
        ("m1", "memory", "add", '{"content": "one"}', None, None), ("m1", "memory", "add", '{"content": "two"}', '{"entry_count": 1}', "two"), ("m1", "memory", "add", '{"content": "twos"}', None, "two\n§\ntwos"),
        ("m1", "memory", "remove", '{"old_text": "two"}', None, None), ("m1", "memory", "add", '{"content": "three"}', None, None), ("m1", "memory", "add", '{"content": "four"}', '{"entry_count": 3}', None),
        ("m1", "memory", "add", "{broken", '{"entry_count": 1}', None), ("m1", "memory", "add", "[1]", "[2]", None), ("m1", "memory", "add", '{"operations": [7]}', None, None), ("m1", "memory", "add", '{"operations": [{"action": "add", "content": "x"}, {"action": "add", "content": "y"}]}', '{"entry_count": 2}', "x\n§\ny"),
        ("s1", "skill", "patch", '{"old_string": "a", "new_string": "b"}', None, None), ("s1", "skill", "create", '{"content": "a"}', None, "a"), ("s1", "skill", "edit", "{broken", None, None), ("s1", "skill", "edit", '{"content": "c"}', None, None), ("s1", "skill", "create", '{"content": "d"}', None, "d"),
    ]
    df = spark.createDataFrame([(a, k, "memory" if k == "memory" else "n", i, action, args, result) for i, (a, k, action, args, result, _) in enumerate(calls)], "artifact_id string, kind string, name string, at long, action string, arguments string, result string")
    got = {r.at: r.files for r in store.after_states(df).collect()}
    file = {"m1": "MEMORY.md", "s1": "SKILL.md"}
    assert {i: None if f is None else json.loads(f)[file[calls[i][0]]] for i, f in got.items()} == {i: c[-1] for i, c in enumerate(calls)}


def test_limits_of_an_artifact_with_very_many_files(spark):
    df = spark.range(5000).select(F.lit("a").alias("artifact_id"), F.lpad(F.col("id").cast("string"), 6, "0").alias("path"), (F.col("id") % 7).alias("size"))
    got = store.limit_files(df, 10, 5, 18).collect()
    state = {r.path: r.skipped for r in got}
    assert len(state) == 5000 and sum(v == "max_file_count" for v in state.values()) == 4990
    used, want = 0, {}
    for i in range(10):
        size = i % 7
        want[f"{i:06}"] = "max_file_bytes" if size > 5 else "max_artifact_bytes" if used + size > 18 else None
        used += size if want[f"{i:06}"] is None else 0
    assert {p: state[p] for p in want} == want


def test_deep_trees_and_circles_roll_up(spark):
    """A chain of 300, a bush, two circles with what hangs on them, and a missing parent."""
    up = {i: i - 1 for i in range(2, 301)} | {1: None} | {1000 + i: 1000 + i // 3 for i in range(1, 90)} | {1000: None}
    up |= {2001: 2002, 2002: 2003, 2003: 2001, 2004: 2001, 2005: 2004, 3001: 3001, 3002: 3001, 4001: 9999, 4002: 4001}
    below = {n: set() for n in up}
    for n in up:
        at, seen = n, set()
        while at in up and at not in seen:
            seen.add(at)
            below[at].add(n)
            at = up[at]
    nodes = spark.createDataFrame(list(up.items()), "id long, parent long")
    own = spark.createDataFrame([(n, n % 11) for n in up if n % 4], "id long, v long")
    got = {r.id: (r.v, r.nodes) for r in tree.subtree_totals(nodes, own, ["v"]).collect()}
    assert got == {n: (sum(x % 11 for x in b if x % 4), len(b)) for n, b in below.items()}
    roots = {r.id: r.root for r in tree.roots(nodes).collect()}
    assert len(roots) == len(up) and roots[300] == 1 and roots[1080] == 1000 and roots[4002] == 9999 and roots[2001] == 2003 and roots[3002] == 3001


def test_shipping_goes_on_where_it_stopped(spark):
    records = spark.createDataFrame([(i, n, 10 * (n % 4) + 1) for i in ("a", "b") for n in range(1, 31)], "installation_id string, producer_sequence long, bytes long")
    high = records.groupBy("installation_id").agg(F.max("producer_sequence").alias("high"))
    cursors = spark.createDataFrame([], "installation_id string, cursor long")
    sent, fail = [], {"b"}

    def send(rows):
        name, last = rows[0]["installation_id"], rows[-1]["producer_sequence"]
        if name in fail and last > 7:
            raise OSError("no route")
        sent.append((name, [r["producer_sequence"] for r in rows]))
        return {"accepted": len(rows), "duplicates": 0, "high_water": last}

    told = {}
    for turn in range(4):
        cursors, out = shipping.ship_pass(spark, records, cursors, high, send, max_batches=2, max_records=5)
        told[turn] = {r.installation_id: (r.outcome, r.acked, r.cursor, r.pending) for r in out.collect()}
        cursors = spark.createDataFrame(cursors.collect(), "installation_id string, cursor long")
        if turn == 1:
            fail.clear()
    assert told[0] == {"a": ("done", 10, 10, 20), "b": ("no acknowledgement", 5, 5, 25)}
    assert told[1]["b"] == ("no acknowledgement", 0, 5, 25) and told[2]["a"][2] == 30 and told[3]["a"] == ("idle", 0, 30, 0)
    assert [n for name, rows in sent if name == "a" for n in rows] == list(range(1, 31))
    assert [n for name, rows in sent if name == "b" for n in rows] == list(range(1, 26))


def test_retries_wait_longer_and_end():
    waits, calls = [], []

    def send(rows):
        calls.append(rows)
        raise shipping.Retryable("busy")

    with pytest.raises(shipping.Retryable):
        shipping.Retrying(send, attempts=5, sleep=waits.append, draw=lambda: 1.0)([])
    assert waits == [0.5, 1.0, 2.0, 4.0] and len(calls) == 5
    with pytest.raises(ValueError):
        shipping.Retrying(lambda rows: (_ for _ in ()).throw(ValueError("bad")), sleep=waits.append)([])
    assert len(waits) == 4


def test_batches_of_a_long_backlog(spark):
    """100 000 records of one installation, the first batches and all of them."""
    df = spark.range(1, 100_001).select(F.lit("i").alias("installation_id"), F.col("id").alias("producer_sequence"), (F.col("id") % 90 + 1).alias("bytes"))
    want, n, used, batch = {}, 0, 0, 0
    for i in range(1, 100_001):
        size = i % 90 + 1
        if n and (n >= 40 or used + size + 1 > 1500):
            batch, n = batch + 1, 0
        used = 10 + size if n == 0 else used + size + 1
        n += 1
        want[i] = batch
    whole = {r.producer_sequence: r.batch for r in retention.ship_batches(df, 40, 1500, 10).collect()}
    assert whole == want
    few = {r.producer_sequence: r.batch for r in retention.ship_batches(df, 40, 1500, 10, max_batches=3).collect()}
    assert few == {i: b for i, b in want.items() if b < 3}


def test_usage_deltas(spark):
    rows = [("s", 1.0, 5.0), ("s", 1.0, 5.0), ("s", 2.0, 9.0), ("s", 3.0, 2.0), ("s", 4.0, None)]
    got = usage.deltas(spark.createDataFrame(rows, "k string, last_seen double, n double"), ["k"], "last_seen", ["n"]).orderBy("last_seen").collect()
    assert [(r.delta_n, r.reset_fields) for r in got] == [(5.0, []), (4.0, []), (2.0, ["n"]), (0.0, ["n"])]


def test_trees_of_any_depth(spark):
    n = 700
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id long, parent long")
    assert {r.root for r in tree.roots(chain).collect()} == {0}
    assert {r.id: r.depth for r in tree.forest(chain).collect()} == {i: i for i in range(n)}


def test_stream_lines(spark):
    payload = {"event_type": "session.created", "kind": "cli", "model": "m" * 60}
    rows = [("i", 7, "session.created", 1784415000.0, "s1", json.dumps(payload), "sha256:" + "ab" * 32, True), ("i", 8, "odd.type", None, None, '{"b": 1.5, "a": null, "c": true, "event_type": "x"}', None, False)]
    df = spark.createDataFrame(rows, "installation_id string, producer_sequence long, event_type string, occurred_at double, session_id string, payload string, content_hash string, partial boolean")
    lines = [r.line for r in views.stream_lines(df).orderBy("producer_sequence").collect()]
    assert lines[0] == f"     7  2026-07-18T22:50:00Z  {'session.created':<26}  {'s1':<24}  kind=cli model={'m' * 39}… hash=sha256:abababa… partial"
    assert lines[1] == f"     8  -  {'odd.type':<26}  {'-':<24}  a=None b=1.5 c=True"


def test_scalars(spark):
    assert column(spark, S.to_epoch(F.lit("1970-01-01T00:00:10+00:00"))) == 10.0 and column(spark, S.to_epoch(F.lit("x"))) is None
    assert column(spark, S.iso_utc(F.lit(0.0))) == "-" and column(spark, S.iso_utc(F.lit("x"))) == "-"
    assert column(spark, S.short_number(F.lit(0.5))) == "0.5" and column(spark, S.short_number(F.lit(3.0))) == "3" and column(spark, S.short_number(F.lit(100.0))) == "100"
    for n in range(0, 9):
        assert column(spark, S.utf8_prefix(F.lit("aé日👍"), n)) == "aé日👍".encode()[:n].decode("utf-8", "ignore")
    assert column(spark, S.zone_seconds(F.lit("2026-01-01T00:00:00-05:30"))) == -19800
    message = "type:value"
    for key in (b"k", b"k" * 100):
        assert bytes(column(spark, S.hmac_sha256(key, F.lit(message)))) == hmac.new(key, message.encode(), "sha256").digest()
    assert len(column(spark, S.fingerprint(b"k", F.lit("x")))) == 22


def test_secret_offsets_and_suppression(spark):
    df = spark.createDataFrame([(1, 'é token = "abcdefgh1" and token=abcdefgh1'), (2, "nothing")], "id long, body string")
    found = security.secret_matches(security.scan_targets(df, {"body": "body"}, "id"), "id").collect()
    raw = 'é token = "abcdefgh1" and token=abcdefgh1'.encode()
    assert len(found) == 2 and all(raw[r.byte_start : r.byte_end].decode() == r.value == "abcdefgh1" for r in found)
    printed = security.fingerprinted(spark.createDataFrame(found), b"key")
    assert printed.select("fingerprint").distinct().count() == 1 and security.unsuppressed(printed, printed).count() == 0
    baseline = security.update_baseline(printed, add=spark.createDataFrame([("t", "bad")], "type string, fingerprint string"))
    assert baseline.count() == 1


def test_sessions_to_read_has_ancestors_of_any_depth(spark):
    rows = [(str(i), str(i - 1), 1.0) for i in range(300)] + [("a", "b", None), ("b", "c", 1.0), ("c", "b", 1.0), ("x", None, 1.0)]
    s = spark.createDataFrame(rows, "id string, parent_session_id string, ended_at double").withColumn("expiry_finalized", F.lit(1))
    named = spark.createDataFrame([("299",)], "session_id string")
    got = [r.id for r in scans.sessions_to_read(s, F.lit(False), named).collect()]
    assert sorted(got) == sorted({r[0] for r in rows} - {"x"})


def test_messages_up_to_the_high_water_are_all_that_is_new(spark):
    m = spark.createDataFrame([(i, "user") for i in (5, 70, 90_000)], "id long, role string")
    ids = lambda mark: sorted(r.id for r in scans.messages(m, mark, 10, scans.high_water(m, "id", mark), ["user"]).collect())
    assert ids(0) == [5, 70, 90_000] and ids(75) == [70, 90_000] and ids(100_000) == []
    assert scans.high_water(m.limit(0), "id", 7) == 7
