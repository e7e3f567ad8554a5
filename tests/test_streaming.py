"""Streams give what batches give."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoledger.operators import attribution
from chronoledger.operators.mappers import hook_records
from chronoledger.streaming.processors import CounterDeltas, GraceSightings, KeepWindows, OpenSubjects, PairInvocations, run_stateful
from chronoledger.streaming.sink import LedgerSink

SCHEMA = "installation_id string, arrival long, dedup_key string, event_type string"


def lines(n):
    return [{"installation_id": "i", "arrival": k, "dedup_key": f"k{k % 70}", "event_type": "t"} for k in range(n)]


@pytest.mark.parametrize("files", [1, 3, 10])
def test_micro_batches_give_one_ledger(spark, tmp_path, files):
    rows = lines(100)
    (tmp_path / "in").mkdir()
    for f in range(files):
        part = rows[f * 100 // files : (f + 1) * 100 // files]
        (tmp_path / "in" / f"{f:03}.json").write_text("\n".join(map(json.dumps, part)))
    sink = LedgerSink(spark, str(tmp_path / "ledger"), SCHEMA)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    sink.start(stream, str(tmp_path / "checkpoint")).awaitTermination(120)
    got = sink.ledger().collect()
    assert sorted(r.producer_sequence for r in got) == list(range(1, 71))
    assert sorted(r.dedup_key for r in got) == sorted(f"k{k}" for k in range(70))
    assert sink.high_water().first().high == 70


def test_a_batch_tried_again_takes_the_same_sequences(spark, tmp_path):
    sink = LedgerSink(spark, str(tmp_path / "ledger"), SCHEMA)
    batch = lambda a, b: spark.createDataFrame([tuple(x.values()) for x in lines(60)[a:b]], SCHEMA)
    sink.append(batch(0, 20), 0)
    sink.append(batch(10, 40), 1)
    before = sorted((r.dedup_key, r.producer_sequence) for r in sink.ledger().collect())
    sink.append(batch(10, 40), 1)
    assert sorted((r.dedup_key, r.producer_sequence) for r in sink.ledger().collect()) == before
    sink.append(batch(30, 60), 2)
    assert sorted(r.producer_sequence for r in sink.ledger().collect()) == list(range(1, 61))


def test_tombstones_and_invalid_rows_take_no_sequence(spark, tmp_path):
    pruned = spark.createDataFrame([("k3",), ("k4",)], "dedup_key string")
    schema = SCHEMA + ", envelope string, capture_method string, occurred_at double"
    sink = LedgerSink(spark, str(tmp_path / "ledger"), schema, tombstones=lambda: pruned, envelope="envelope", horizon=100.0)
    good = json.dumps({
        "schema_version": "1", "event_id": "e", "producer_sequence": 1, "occurred_at": 1.5, "recorded_at": 2.5, "installation_id": "i", "tenant_id": "t", "profile": "p", "runtime": {}, "correlation_id": "c",
        "source": "s", "capture_method": "m", "payload": {"event_type": "session.created"}, "partial": False,
    })
    rows = [("i", k, f"k{k}", "t", "{}" if k % 5 == 0 else good, "poll:state.db", 50.0 if k == 9 else 150.0) for k in range(20)]
    sink.append(spark.createDataFrame(rows[:10], schema), 0)
    sink.append(spark.createDataFrame(rows[8:], schema), 1)
    assert sorted(r.dedup_key for r in sink.rejects().collect()) == ["k0", "k10", "k15", "k5"]
    got = sorted((r.producer_sequence, r.dedup_key) for r in sink.ledger().collect())
    assert [s for s, _ in got] == list(range(1, len(got) + 1))
    assert {k for _, k in got} == {f"k{k}" for k in range(20) if k % 5 and k not in (3, 4, 9)}


def test_compacted_keys_are_still_known(spark, tmp_path):
    sink = LedgerSink(spark, str(tmp_path / "ledger"), SCHEMA)
    batch = lambda a, b: spark.createDataFrame([tuple(x.values()) for x in lines(60)[a:b]], SCHEMA)
    for n in range(4):
        sink.append(batch(10 * n, 10 * n + 15), n)
    sink.compact()
    sink.compact()
    assert sink._complete("keys", "upto") == [2] and sink._keys(4).count() == 45
    sink.append(batch(0, 60), 4)
    sink.append(batch(30, 45), 3)  # a retry of a batch that the index does not hold
    got = sink.ledger()
    assert sorted(r.producer_sequence for r in got.collect()) == list(range(1, 61)) and got.select("dedup_key").distinct().count() == 60


def test_a_source_that_fails_while_it_is_read_is_left_out(spark):
    from chronoledger.streaming.passes import run_pass

    good = lambda: spark.range(5).select(F.lit("t").alias("event_type"))
    bad = lambda: spark.range(5).select(F.raise_error(F.lit("damaged file")).cast("string").alias("event_type"))
    records, health = run_pass(spark, {"good": good, "bad": bad, "off": bad}, 1.0, {"off": False})
    assert records.count() == 5
    assert {r.source: r.ok for r in health.collect()} == {"good": True, "bad": False}


class Held:
    """A value or a list that a processor keeps for one key."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.value or []) if isinstance(self.value, (list, type(None))) else self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class Handle:
    def getValueState(self, name, schema):
        return Held()

    getListState = getValueState


def fed(processor, key, batches, columns):
    processor.init(Handle())
    return [tuple(r) for b in batches for out in processor.handleInputRows((key,), iter([pd.DataFrame(b, columns=columns)]), None) for r in out.itertuples(index=False)]


def test_absent_subjects_are_told_once_after_the_grace():
    batches = [[("s", 10.0, True)], [("s", 300.0, True), ("s", 309.0, True)], [("s", 310.0, True), ("s", 900.0, True)], [("s", 901.0, False), ("s", 902.0, True)], [("s", 1202.0, True)]]
    assert fed(GraceSightings(300.0), "s", batches, ["subject", "at", "absent"]) == [("s", 10.0, 310.0), ("s", 902.0, 1202.0)]


def test_newest_windows_are_kept():
    columns = ["session_id", "invocation_id", "started_at", "ended_at"]
    batches = [[("s", "a", 1.0, None), ("s", "b", 2.0, None)], [("s", "a", None, 1.5), ("s", "c", 3.0, 4.0)], [("s", "d", 5.0, None)], [("s", "b", 2.0, 9.0)]]
    got = fed(KeepWindows(2), "s", batches, columns)
    assert [(r[1], r[2], None if pd.isna(r[3]) else r[3]) for r in got] == [("a", 1.0, None), ("b", 2.0, None), ("c", 3.0, 4.0), ("d", 5.0, None)]


def test_what_closes_was_open_since(spark):
    batches = [[("s", 1.0, True), ("s", 2.0, True)], [("s", 5.0, False), ("s", 6.0, False)], [("s", 9.0, False), ("s", 8.0, True)], [("s", 10.0, True)]]
    assert fed(OpenSubjects(), "s", batches, ["subject", "at", "open"]) == [("s", 1.0, 5.0), ("s", 8.0, 9.0)]


def test_spool_files_stream_into_the_ledger(spark, tmp_path):
    """Text files as they appear, broken lines among them, through the readers into the sink."""
    from chronoledger.sources import scans

    (tmp_path / "in").mkdir()
    for f in range(2):
        rows = [json.dumps(x) for x in lines(60)[f * 30 : f * 30 + 30]] + ["{broken", "", "[1]"]
        (tmp_path / "in" / f"{f}.jsonl").write_text("\n".join(rows) + "\n")
    stream = scans.spool(spark, str(tmp_path / "in"), streaming=True)
    sink = LedgerSink(spark, str(tmp_path / "ledger"), SCHEMA)
    sink.start(scans.json_objects(stream, SCHEMA).select("object.*"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(r.dedup_key for r in sink.ledger().collect()) == sorted(f"k{k}" for k in range(60))
    assert scans.spool(spark, str(tmp_path / "in")).select("file").distinct().count() == 2


def test_hook_lines(spark):
    text = [
        '{"event_type": "session:start", "captured_at": 5, "context": {"session_id": "s", "session_key": "k", "platform": "chat"}}', "", "{broken", '{"event_type": "other"}', '"text"',
        '{"event_type": "agent:start", "captured_at": 6, "context": {"session_id": "s"}}', '{"event_type": "agent:end", "captured_at": 7, "context": {"session_id": "s"}}',
        '{"event_type": "session:reset", "captured_at": 8, "context": {"session_key": "k"}}', '{"event_type": "agent:end"}',
    ]
    df = spark.createDataFrame([(t, i * 10) for i, t in enumerate(text)], "value string, offset long")
    got = {r.dedup_key: r for r in hook_records(df, "i", "g").collect()}
    assert sorted(got) == ["hook-spool:g:0", "hook-spool:g:50", "hook-spool:g:60", "hook-spool:g:70", "hook-spool:g:80"]
    assert got["hook-spool:g:50"].invocation_id == got["hook-spool:g:60"].invocation_id == "s:hook:50"
    assert got["hook-spool:g:80"].invocation_id == "unknown:hook:80"
    assert got["hook-spool:g:70"].session_id == "s" and json.loads(got["hook-spool:g:70"].payload)["reason"] == "reset"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stateful_pairing_and_deltas(spark, tmp_path, rocks):
    rows = [(f"s{k % 3}", k, (k * 7) % 5 < 2, float((k * 13) % 11)) for k in range(90)]
    (tmp_path / "in").mkdir()
    for f in range(3):
        (tmp_path / "in" / f"{f}.json").write_text("\n".join(json.dumps(dict(zip(("session_id", "seq", "is_start", "value"), r, strict=True))) for r in rows[f * 30 : f * 30 + 30]))
        os.utime(tmp_path / "in" / f"{f}.json", (1_700_000_000 + f * 60,) * 2)  # files are read in the order of their times
    schema = "session_id string, seq long, is_start boolean, value double"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    try:
        paired = run(run_stateful(stream(), "session_id", PairInvocations()), "paired")
    except Exception as e:  # the Python state API needs protobuf
        if "protobuf" in str(e).lower():
            pytest.skip("no protobuf here")
        raise
    batch = attribution.pair_starts(spark.createDataFrame(rows, schema), "session_id", "seq", F.col("is_start"))
    assert sorted((r.seq, r.paired_with or -1) for r in paired) == sorted((r.seq, r.paired_with or -1) for r in batch.collect())
    deltas = run(run_stateful(stream().select(F.col("session_id").alias("key"), "seq", "value"), "key", CounterDeltas()), "deltas")
    last, want = {}, []
    for s, seq, _, v in rows:
        if last.get(s) != v:
            want.append((seq, v if s in last and v < last[s] else v - last.get(s, 0.0)))
        last[s] = v
    assert sorted((r.seq, r.delta) for r in deltas) == want
