"""Steps whose cost must follow their input, and results that no limit cuts."""

import json
import random

from pyspark.sql import functions as F

from chronoledger.operators import ledger as book
from chronoledger.sources import scans


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_envelope_is_parsed_once(spark):
    """it was parsed about a hundred times."""
    text = plan_of(spark.range(1).select(book.violations(F.col("id").cast("string")).alias("told")))
    assert text.lower().replace("_", "").count("parsejson(") == 1 and text.count("get_json_object(") <= 1


def test_null_companions_of_content_are_absent(spark):
    cases = {'{"content_ciphertext": null, "key_version": "k"}': "key_version without content", '{"content_ciphertext": {}, "content_nonce": null, "content_hash": "h", "key_version": "k"}': "content without content_nonce"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert all(cases[r.t] in r.v for r in df.select("t", book.violations(F.col("t")).alias("v")).collect())


def test_spool_lines_of_files_in_many_parts(spark, tmp_path):
    """a file was one row of one task, and split again for each of its lines."""
    texts = {"part-a.jsonl": "".join(f'{{"n": {i}, "t": "é{"x" * (i % 37)}"}}\n' for i in range(3000)), "part-b.jsonl": "one\n\nzwei é\r\nthree", "part-c.jsonl": "", "other.jsonl": "no line yet"}
    (tmp_path / "sub").mkdir()
    for i, (name, text) in enumerate(texts.items()):
        (tmp_path / ("sub" if i % 2 else ".") / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = scans.spool_lines(spark, str(tmp_path), "^(part)")
        got = sorted((r.file, r.generation, r.offset, r.until, r.value) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for name, text in texts.items():
        at = 0
        for line in text.encode().split(b"\n")[:-1]:
            want.append((name, "part" if name.startswith("part") else "", at, at + len(line) + 1, line.decode()))
            at += len(line) + 1
    assert got == sorted(want)


def test_tails_split_a_file_once(spark):
    files = spark.createDataFrame([("a", "g", "".join(f"{i}\n" for i in range(5000)))], "file string, generation string, content string")
    lines = scans.tail_lines(files)
    assert lines.count() == 5000 and plan_of(lines).count("split(") == 1


def test_gaps_without_a_limit_are_all_told(spark):
    """Only the first 10 000 were."""
    from chronoledger.operators import detect

    stored = spark.range(0, 60_000, 2).select(F.lit("i").alias("installation_id"), F.col("id").alias("seq"))
    marks = spark.createDataFrame([("i", 2_060_000)], "installation_id string, high long")
    got = detect.sequence_gaps(stored, marks, piece=1000)
    # Odd numbers between those that are there, then one long gap up to the mark.
    assert got.agg(F.count("*"), F.countDistinct("missing_sequence"), F.max("missing_sequence")).first() == (30_000 - 1 + 2_060_000 - 59_998, 30_000 - 1 + 2_060_000 - 59_998, 2_060_000)
    assert got.filter("missing_sequence = 59997").first()[2:] == (59_996, 59_998)
    assert got.filter("missing_sequence = 1000000").first()[2:] == (59_998, 2_060_001)
    assert got.groupBy("missing_sequence").count().filter("count > 1").isEmpty()


def test_of_repeated_line_items_the_first_row_counts(spark, tmp_path):
    """it was whichever came first, often that of the largest file."""
    from chronoledger.plans import completeness

    schema = "l_orderkey long, l_partkey long, l_linenumber int"
    for name, rows in (("a", [(1, 7, 1), (1, 8, 1)]), ("b", [(1, 9, 1)] + [(k, k, 1) for k in range(2, 3000)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    (tmp_path / "lineitem.parquet").mkdir()
    for name in "ab":
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    events = completeness._task_events(spark, str(tmp_path))
    assert events.count() == 2999 and events.filter("run_id = 1").first().task_id == "7"


def test_trees_take_a_row_a_node(spark, monkeypatch):
    """all pairs of nodes and ancestors were made."""
    from chronoledger.operators import tree

    monkeypatch.setattr(tree, "closure", None)
    rng = random.Random(5)
    parent = {i: (rng.randrange(i) if i % 50 else (None if i % 100 else 10_000 + i)) for i in range(400)}
    parent |= {-1: -2, -2: -3, -3: -1, -4: -1, -5: -4, -6: -6, -7: -6}
    df = spark.createDataFrame(list(parent.items()), "id long, parent long")

    def path(i):
        out = [i]
        while parent[out[-1]] in parent:
            out.append(parent[out[-1]])
            if len(out) > len(parent):
                return None
        return out[::-1]

    want = {i: path(i) for i in parent if path(i)}
    assert {r.id: (r.root, r.depth) for r in tree.forest(df).collect()} == {i: (p[0], len(p) - 1) for i, p in want.items()}
    assert {r.id: r.path for r in tree.paths(df).collect()} == want


def test_health_of_a_source_with_many_passes(spark):
    """all passes of a source were sorted in one task."""
    from chronoledger.operators import status

    rows = [("a", 1.0, False), ("a", 2.0, True), ("a", 3.0, False), ("a", 4.0, False), ("b", 1.0, False), ("c", 1.0, False), ("c", 2.0, True), (None, 5.0, False)]
    states = status.health_states(spark.createDataFrame(rows, "source string, at double, ok boolean"))
    assert {tuple(r) for r in states.collect()} == {("a", 2.0, 4.0, 2), ("b", None, 1.0, 1), ("c", 2.0, 2.0, 0), (None, None, 5.0, 1)}
    assert "Window" not in plan_of(states)


def test_session_ends_look_back_over_buckets(spark, monkeypatch):
    """All lines of a key were sorted in one task."""
    from chronoledger.operators import mappers

    monkeypatch.setattr(mappers, "HOOK_BUCKET", 7, raising=False)
    rng = random.Random(9)
    rows, started, want = [], {}, {}
    for at in range(300):
        hook, key = rng.choice(("session:start", "session:end", "session:reset", "agent:start", "gateway:startup")), rng.choice(("k", "l", "", None))
        session = f"s{at}" if rng.random() < 0.3 else None
        rows.append((json.dumps({"event_type": hook, "context": {"session_id": session, "session_key": key}}), at))
        want[at] = started.get(key) if hook in ("session:end", "session:reset") else session
        if hook == "session:start" and session and key:
            started[key] = session
    got = mappers.hook_records(spark.createDataFrame(rows, "value string, offset long"), "i", "g")
    assert {int(r.dedup_key.split(":")[-1]): r.session_id for r in got.collect()} == want
    assert all("session_key" not in line or "_b" in line for line in plan_of(got).splitlines() if "Window [last(" in line and "specifiedwindowframe(RowFrame, unboundedpreceding$(), -1)" in line and "_started" not in line)


def test_expressions_are_split_once(spark):
    """each comparison of a field split the expression anew."""
    from chronoledger.functions.schedule import cron_fields

    text = plan_of(spark.range(1).select(cron_fields(F.col("id").cast("string")).alias("cron")))
    assert text.count("regexp_replace(") == 1 and text.count("split(") == 6


def test_runs_of_misses_take_no_join(spark):
    """fires were made three of each and joined by buckets, then twice more."""
    from chronoledger.operators import detect

    rng = random.Random(2)
    due = [(j, 60 * i) for j in "ab" for i in range(60)] + [(None, 60)]
    fires = [(j, rng.uniform(-100, 3700)) for j in "ab" for _ in range(25)] + [("a", 60.0), ("a", 130.0), ("c", 5.0), (None, 60.0), ("b", None)]
    now, slack = 3600.0, 10.0
    runs = detect._runs_of_misses(spark.createDataFrame(due, "job_id string, instant long"), spark.createDataFrame(fires, "job_id string, at double"), now, slack)
    want = set()
    for j in "ab":
        hit = [any(k == j and at is not None and abs(at - t) <= slack for k, at in fires) for i, t in due if i == j]
        island, held = 0, {}
        for (_, t), h in zip([d for d in due if d[0] == j], hit, strict=True):
            island += h
            if not h and t <= now - slack:
                held.setdefault(island, []).append(t)
        want |= {(j, float(ts[0]), len(ts), i == island and 3540 >= now - 60) for i, ts in held.items()}
    assert {tuple(r) for r in runs.collect()} == want
    assert "Join" not in plan_of(runs)


def test_payloads_are_parsed_once(spark):
    """coverage parsed a payload for each name, attempts for each key."""
    from chronoledger.operators import detect, views

    events = spark.range(3).select(F.lit("task.claimed").alias("event_type"), F.lit("s").alias("session_id"), F.concat(F.lit('{"board": "b", "task_id": "t", "run_id": '), F.col("id"), F.lit("}")).alias("payload"))
    subjects = detect.captured_subjects(events)
    assert {tuple(r) for r in subjects.collect()} == {("task", "b:t"), ("task_run", "b:0"), ("task_run", "b:1"), ("task_run", "b:2")}
    assert "get_json_object" not in plan_of(subjects)
    names = "board string, task_id string, run_id bigint, holder string, run_outcome string, attempt_disposition string"
    parsed = events.select("event_type", F.lit("i").alias("installation_id"), F.col("session_id"), F.lit(1).alias("producer_sequence"), F.lit(1.5).alias("occurred_at"), F.from_json("payload", names).alias("p")).select("*", "p.*")
    attempts = views.task_attempts(parsed)
    assert sorted(r.run_id for r in attempts.collect()) == [0, 1, 2]
    assert not any("from_json" in line for line in plan_of(attempts).splitlines() if "Filter" in line)


def test_edits_fold_over_batches(spark):
    """each artifact was a table of pandas of its own."""
    from chronoledger.operators import store

    rows = [(f"a{k % 3}", "skill", "n", k, "create" if k < 3 else "edit", json.dumps({"content": str(k)})) for k in range(40)] + [(None, "skill", "n", 5, "edit", "{}")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        states = store.after_states(spark.createDataFrame(rows, "artifact_id string, kind string, name string, at long, action string, arguments string"))
        got = {(r.artifact_id, r.at): r.files for r in states.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(a, at): json.dumps({"SKILL.md": str(at)}) if a else None for a, _, _, at, _, _ in rows}
    assert "GroupsIn" not in plan_of(states)
