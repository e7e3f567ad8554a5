"""Settings, schedules as columns, and the composed knowledge path."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chronoledger.functions.schedule import BOUNDS, cron_fields, instants_of, parse_cron
from chronoledger.operators import knowledge, lineage, settings
from chronoledger.sources import scans


def value(found, section, key):
    return next((s.value, s.origin) for s in found if (s.section, s.key) == (section, key))


def test_environment_over_file_over_default():
    found = settings.load({"sync": {"max_records": 7, "max_bytes": 9}}, {"CHRONOLEDGER_SYNC_MAX_BYTES": "11", "CHRONOLEDGER_SYNC_MAX_RECORDS": ""})
    assert value(found, "sync", "max_records") == (7, "file") and value(found, "sync", "max_bytes") == (11, "environment") and value(found, "sync", "max_batches_per_tick") == (1, "default")
    assert settings.enabled(found, "cron") and settings.required(found, "hook") and not settings.required(found, "cron")
    off = settings.load({"capture": {"sources": {"hook": False}}})
    assert not settings.enabled(off, "hook") and not settings.required(off, "hook")
    with pytest.raises(settings.Unsettled):
        settings.enabled(off, "radio")


@pytest.mark.parametrize("section,key,bad", [
    ("sync", "max_records", 0), ("sync", "max_records", True), ("sync", "max_records", 1.5), ("sync", "max_records", "x"), ("sync", "max_records", None), ("sync", "max_bytes", (4 << 20) + 1), ("sync", "interval_seconds", -1),
    ("retention", "enabled", "yes"), ("retention", "max_age_days", 0), ("knowledge", "history", "some"), ("security", "secret_scan_baseline", "a/b"), ("security", "secret_scan_baseline", ".."),
    ("capture", "message_roles", "user"), ("capture", "message_roles", [""]), ("capture", "required_sources", ["hook", "hook"]), ("capture", "required_sources", ["radio"]), ("capture", "sources", {"radio": True}), ("capture", "sources", {"hook": 1}),
])
def test_bad_values_are_named(section, key, bad):
    with pytest.raises(settings.Unsettled, match=f"{section}.{key}"):
        settings.load({section: {key: bad}})


def test_migrations_go_step_by_step_or_not_at_all(spark):
    df = spark.range(2).toDF("a")
    steps = {"1": ("2", lambda d: d.withColumn("b", F.lit(1))), "2": ("3", lambda d: d.withColumn("c", F.col("b") + 1)), "7": ("8", lambda d: d), "8": ("7", lambda d: d)}
    assert settings.migrated(df, "1", "3", steps).columns == ["a", "b", "c"] and settings.migrated(df, "3", "3", steps).columns == ["a"]
    for old in ("0", "7"):
        with pytest.raises(settings.Unsettled):
            settings.migrated(df, old, "3", steps)


def test_cron_columns_are_those_of_the_parser(spark):
    rng = random.Random(9)

    def item(low, high):
        a, b = sorted((rng.randint(low - 1, high + 1), rng.randint(low, high)))
        return rng.choice(["*", str(a), f"{a}-{b}", f"*/{rng.randint(0, 9)}", f"{a}-{b}/{rng.randint(1, 5)}", f"{b}/2"])

    texts = [" ".join(",".join(item(low, high) for _ in range(rng.choice([1, 1, 2]))) for _, low, high in BOUNDS) for _ in range(400)] + ["", "* * * *", "a b c d e", "*  *\t* * *"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("cron", cron_fields(F.col("t")))
    lower, upper, zone = 1_704_000_123.5, 1_704_400_000.0, -5400
    got = {r.i: (r.cron, r.at) for r in df.select("i", "cron", instants_of(F.col("cron"), F.lit(lower), F.lit(upper), F.lit(zone)).alias("at")).collect()}
    every = spark.range(1).select(F.explode(F.sequence(F.lit(1_704_000_180).cast("long"), F.lit(1_704_400_000).cast("long"), F.lit(60).cast("long"))).alias("t"))
    for i, text in enumerate(texts):
        cron = parse_cron(text)
        assert (cron is None) == (got[i][0] is None), text
        if cron is not None:
            assert tuple(tuple(x) for x in got[i][0]) == (cron.minute, cron.hour, cron.day, cron.month, cron.weekday), text
    for i in [j for j, t in enumerate(texts) if parse_cron(t)][:12]:
        assert got[i][1] == [r.t for r in every.filter(parse_cron(texts[i]).admits(F.col("t"), zone)).orderBy("t").collect()], texts[i]


def test_calls_become_versions_and_bundles(spark):
    calls = [
        ("memory", {"action": "add", "content": "one"}, {"success": True, "entry_count": 1}), ("memory", {"action": "add", "content": "one"}, {"success": True}), ("memory", {"action": "add", "content": "two"}, {"success": True, "staged": True}),
        ("memory", {"action": "replace", "old_text": "one", "content": "uno"}, {"success": True}), ("skill_manage", {"action": "create", "name": "s", "content": "x" * 50}, {"success": True}),
        ("skill_manage", {"action": "write_file", "name": "s", "file_path": "a.md", "file_content": "y"}, {"success": True}), ("skill_manage", {"action": "delete", "name": "s"}, {"success": True}),
    ]
    rows = []
    for n, (tool, args, result) in enumerate(calls):
        rows.append((2 * n, "s", "assistant", None, json.dumps([{"id": f"c{n}", "function": {"name": tool, "arguments": json.dumps(args)}}]), None))
        rows.append((2 * n + 1, "s", "tool", f"c{n}", None, json.dumps(result)))
    messages = spark.createDataFrame(rows, "id long, session_id string, role string, tool_call_id string, tool_calls string, content string")
    none = spark.createDataFrame([], "artifact_id string, name string, tombstone boolean, first_seen double")
    versions, events = knowledge.captured(messages, none, max_file=40)
    got = {(r.artifact_id, r.seq): (r.at, [e["path"] for e in r.manifest], [tuple(x) for x in r.skipped], r.tombstone) for r in versions.collect()}
    assert got == {
        ("memory:memory", 1): (1, ["MEMORY.md"], [], False), ("memory:memory", 2): (7, ["MEMORY.md"], [], False),
        ("skill:s", 1): (9, [], [("SKILL.md", "max_file_bytes")], False), ("skill:s", 2): (11, ["a.md"], [("SKILL.md", "max_file_bytes")], False), ("skill:s", 3): (13, [], [], True),
    }
    told = {(r.artifact_id, r.seq): (r.action, [f["path"] for f in json.loads(r.bundle)["files"]]) for r in events.collect()}
    assert told[("skill:s", 2)] == ("update", ["a.md"]) and told[("skill:s", 3)] == ("delete", []) and told[("memory:memory", 1)] == ("create", ["MEMORY.md"])


def test_tails_take_whole_lines_once(spark):
    schema = "file string, generation string, content string"
    first = spark.createDataFrame([("a", "g", "one\nzwei é\nthr"), ("b", "g", "no line yet"), ("c", "g", "")], schema)
    lines = scans.tail_lines(first)
    assert sorted((r.file, r.offset, r.value) for r in lines.collect()) == [("a", 0, "one"), ("a", 4, "zwei é")]
    marks = scans.tail_cursors(first, lines)
    assert sorted(map(tuple, marks.collect())) == [("a", "g", 12), ("b", "g", 0), ("c", "g", 0)]
    then = spark.createDataFrame([("a", "g", "one\nzwei é\nthree\n"), ("b", "h", "new\n"), ("c", "g", "x\n")], schema)
    again = scans.tail_lines(then, marks)
    assert sorted((r.file, r.offset, r.value) for r in again.collect()) == [("a", 12, "three"), ("b", 0, "new"), ("c", 0, "x")]
    cut = spark.createDataFrame([("a", "g", "s\n")], schema)  # truncated below its cursor
    assert [(r.offset, r.value) for r in scans.tail_lines(cut, scans.tail_cursors(then, again, marks)).collect()] == [(0, "s")]


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())
