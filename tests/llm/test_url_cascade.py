import re

import pytest

from chronoledger.llm import url_cascade as U
from chronoledger.llm.common import Stage

RULES = U.parse_rules(["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/", "block deep.a.b.org"])
URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://EXAMPLE.COM/en/x?y#z", "http://www.example.com/en/1", "http://m.www.example.com/en/", "http://notexample.com/en/",
    "http://example.com/EN/", "http://example.com?/en/", "http://x.net/es/1", "http://net/es", "http://a.net#/fr/", "ftp://y.net/fr/../", "a://b://c.com/", "http://deep.a.b.org", "http://x.deep.a.b.org/any", "http://a.b.org/",
    "http://user@example.com:80/en/", "http://.com/", "http://com./", "http://ÉX.com/é", "http://" + "a." * 300 + "com/" + "p" * 5000,
]


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best.key if best else None, best.action if best else "allow"


def test_verdicts_are_those_of_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:7])], "page_id long, url string, key string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df, RULES).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS + URLS[:7])}


def test_long_lists_take_several_cascades(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BYTES", 8)
    monkeypatch.setattr(U, "TOGETHER", 2)
    df = spark.createDataFrame([(i % 9, u) for i, u in enumerate(URLS + URLS[:7])], "page_id long, url string")
    rules = U.rule_table(spark, RULES)
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in U.judge_urls(df, rules).collect())
    want = [(i % 9, *brute(u)) for i, u in enumerate(URLS + URLS[:7])]
    assert got == sorted((i, h, p, k or "", v) for i, h, p, k, v in want)


def test_cascade_is_exact_over_its_universe(spark):
    every = [f"key{i}" for i in range(3000)]
    listed = set(every[::7])
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = U.build(frame(sorted(listed) * 2), frame(every + every[:50]), Stage(spark, "test"))
    assert len(cascade.levels) > 1
    assert all((k in cascade) == (k in listed) for k in every)


def test_empty_lists_and_tables(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in U.judge_urls(df, []).collect()] == ["allow"]
    assert U.judge_urls(df.limit(0), RULES).count() == 0


def test_bad_rules():
    with pytest.raises(ValueError):
        U.parse_rules(["maybe com/"])


def test_filters_of_several_chunks_have_every_key(spark, monkeypatch):
    monkeypatch.setattr(U, "CHUNK", 16)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)], "key string").repartition(3)
    bloom = U._bloom(keys, 500, 0.01, 3)
    assert all(f"k{i}" in bloom for i in range(500)) and sum(f"x{i}" in bloom for i in range(1000)) < 60
