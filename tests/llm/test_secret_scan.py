import math
import random
import re

from pyspark.sql import Row, functions as F

from chronoledger.llm import secret_scan as X

from .fixtures import clashing, corpus, frame, table

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ODD = [
    'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" é', "TOKEN:short password: longenough1", "é password='abcdefgh' 日 secret=\"x\" apikey=12345678 API_KEY:abcdefghi", "tokentoken=abcdefgh=ijk",
    "AKIA AKIAABCDEFGHIJKL AKIAAKIAAKIAAKIA AKIAABCDEFGHIJK", "deadbeef" * 4, "deadbeef" * 3 + "DEADBEEF", "x" + "0" * 31 + "g" + "0" * 32, "secret : = abcdefgh", "password=\nabcdefgh", "secret=abcdefgh" * 900,
]


def base(text):
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    k = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    h = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(a + k + h)


def test_base_spans_are_those_of_brute_force(spark, tmp_path):
    rows = corpus() + [(9000 + i, t, None) for i, t in enumerate(ODD)]
    got = {r.doc_id: [tuple(s) for s in r.spans if s["rank"] < 3] for r in X.scan(table(clashing(spark, rows), tmp_path)).collect()}
    assert got == {k: base(t or "") for k, t, _ in rows}


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 511, 512, 513, 1600)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x array<int>").select(X.running_sums(F.col("x"))).collect()]
    assert got == [[sum(x[: i + 1]) for i in range(len(x))] for x in rows]


def two_sided(z):
    x = min(abs(z), 8.0)
    return max(1e-15, 2 / (1 + math.exp(1.5976 * x + 0.07056 * x**3)))


def statistic(value, alphabet):
    """The three tests, each by its definition."""
    idx, k, n = [alphabet.index(c) for c in value], len(alphabet), len(value)
    chi = sum((idx.count(j) - n / k) ** 2 / (n / k) for j in range(k))
    z_chi = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [2 * j >= k for j in idx]
    a, b = sum(high), n - sum(high)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    z_runs = 8.0 if 2 * a * b <= n else (runs - 1 - 2 * a * b / n) / math.sqrt(2 * a * b * (2 * a * b - n) / (n * n * (n - 1)))
    mean = sum(idx) / n
    spread = sum((x - mean) ** 2 for x in idx)
    lag = sum((x - mean) * (y - mean) for x, y in zip(idx, idx[1:]))
    z_lag = 8.0 if spread < 1e-9 else (lag / spread + 1 / n) * math.sqrt(n)
    return -2 * sum(math.log(two_sided(z)) for z in (z_chi, z_runs, z_lag))


def test_battery_is_that_of_the_definitions(spark):
    rng = random.Random(6)
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    values = ["".join(rng.choice(alphabet[: rng.choice([2, 9, 62])]) for _ in range(rng.randrange(16, 90))) for _ in range(80)] + ["0" * 20, "0Z" * 12, alphabet]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int")
    got = [r[0] for r in df.orderBy("i").select(X.battery(F.col("v"), F.lit(alphabet))).collect()]
    assert all(math.isclose(g, statistic(v, alphabet), rel_tol=1e-6, abs_tol=1e-6) for g, v in zip(got, values, strict=True))


def plain_cutoffs(counts, share):
    """Each candidate on its own, sorted by p."""
    each = [(r.band, r.step) for r in counts if not r.decoy for _ in range(r.n)]
    decoys = [(r.band, r.step) for r in counts if r.decoy for _ in range(r.n)]
    p = []
    for band, step in each:
        near = [s for b, s in decoys if b <= band]
        p.append(((1 + sum(s <= step for s in near)) / (1 + len(near)), band, step))
    p.sort()
    last = max((i for i, x in enumerate(p) if x[0] <= share * (i + 1) / len(p)), default=-1)
    found, level = {}, p[last][0] if last >= 0 else -1.0
    for value, band, step in p:
        if value <= level and any(b <= band for b, _ in decoys):
            found[band] = max(found.get(band, -1), step)
    return found


def test_step_up_is_that_of_sorted_p_values():
    rng = random.Random(7)
    for _ in range(60):
        counts = {}
        for _ in range(rng.randrange(1, 120)):
            decoy = rng.random() < 0.7
            step = rng.randrange(60, X.STEPS) if decoy else rng.choice([rng.randrange(0, 60), rng.randrange(0, X.STEPS)])
            key = (rng.randrange(len(X.BANDS)), step, decoy)
            counts[key] = counts.get(key, 0) + rng.randrange(1, 4)
        rows = [Row(band=b, step=s, decoy=d, n=n) for (b, s, d), n in counts.items()]
        if any(not r.decoy for r in rows):
            assert X.cutoffs(rows) == plain_cutoffs(rows, X.FALSE_SHARE)


def test_battery_tells_random_from_words(spark):
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    plain = ["0000000011111111" * 2, "ab" * 20, "0123456789abcdef" * 3, "a" * 40]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(hexes + plain)], "v string, i int")
    got = [r[0] for r in df.orderBy("i").select(X.battery(F.col("v"), F.lit("0123456789abcdef"))).collect()]
    assert sum(x < 16.8 for x in got[:60]) >= 54  # the 99th percentile of six degrees
    assert min(got[60:]) > 20


def test_random_strings_are_found_among_words_and_words_are_left_alone(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice(["ation", "ing", "the", "ness", "over", "ment"]) for _ in range(5)) for _ in range(3000)]
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48)) for _ in range(40)]
    rows = [(i, " ".join(rng.sample(vocabulary, 40)) + (f" {keys[i]} é" if i < 40 else ""), None) for i in range(80)]
    got = {r.doc_id: r.spans for r in X.scan(table(frame(spark, rows), tmp_path)).collect()}
    found = sum(any(s["rank"] == 3 and rows[i][1][s["start"] : s["end"]] == keys[i] for s in got[i]) for i in range(40))
    assert found >= 30  # the rest look too regular by chance
    assert all(not got[i] for i in range(40, 80))


def test_glued_runs_are_cut_and_each_part_is_tested(spark):
    key, std, url = "9aK3xQ7mZ2pL8vT4wB6nRs", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzQ8T", "T0_aB3dEf6hIj-KlMn9pQrSt"
    texts = [f"PRIVATE_KEY={key}==", f"sig={std}", f"/v1/hooks/{url}", f"my-name/{std}", "aB3dEf/GhI_jKlMn+pQ-rSt", f"{key}="]
    got = [r for r in spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").orderBy("i").select("t", X.candidates(F.col("t")).alias("c")).collect()]
    places = [[r.t[s["start"] : s["end"]] for s in r.c] for r in got]
    assert places[:2] == [[f"{key}=="], [std]] and places[4:] == [[texts[4]], [f"{key}="]]
    assert url in places[2] and texts[2] in places[2] and len(set(places[2])) == len(places[2])
    assert f"name/{std}" in places[3]
    assert not any(s["decoy"] for r in got for s in r.c)


def test_random_letters_and_glued_keys_are_found(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["ation", "ing", "the", "ness", "over", "ment"]) for _ in range(5)) for _ in range(3000)]
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [lambda: ("", draw(lower, 40)), lambda: ("", draw(lower + upper, 40)), lambda: ("PRIVATE_KEY=", draw(lower + upper + "0123456789", 48)), lambda: ("/v1/hooks/", "T0_" + draw(lower + upper + "0123456789", 45))]
    keys = [kinds[i % 4]() for i in range(40)]
    rows = [(i, " ".join(rng.sample(vocabulary, 40)) + (f" {''.join(keys[i])} é" if i < 40 else ""), None) for i in range(80)]
    got = {r.doc_id: [s for s in r.spans if s["rank"] == 3] for r in X.scan(table(frame(spark, rows), tmp_path)).collect()}
    found = [sum(any(rows[i][1][s["start"] : s["end"]].endswith(keys[i][1]) for s in got[i]) for i in range(k, 40, 4)) for k in range(4)]
    assert min(found) >= 6, found  # the rest look too regular by chance
    assert all(not got[i] for i in range(40, 80))


def test_overlapping_findings_are_joined(spark):
    spans = [(1, 3, 5), (1, 3, 20), (7, 3, 9), (18, 3, 30), (30, 3, 40), (50, 3, 60)]
    df = spark.createDataFrame([(spans,)], "s array<struct<start:int,rank:int,end:int>>")
    assert [tuple(x) for x in df.select(X._joined(F.col("s"))).first()[0]] == [(1, 3, 30), (30, 3, 40), (50, 3, 60)]


def test_only_tested_runs_count_as_hypotheses(spark):
    texts = ["4845168114407329 " * 3, "=" * 40, "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"]
    got = [r[0] for r in spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").orderBy("i").select(X.candidates(F.col("t"))).collect()]
    assert [len(x) for x in got] == [0, 0, 1]


def test_step_up_bounds_findings():
    count = lambda band, step, decoy, n: Row(band=band, step=step, decoy=decoy, n=n)
    decoys = [count(0, s, True, 10) for s in range(100, 200)]
    assert X.cutoffs(decoys + [count(3, 10, False, 5)]) == {3: 10}
    assert X.cutoffs(decoys + [count(3, 150, False, 5)]) == {}
    assert X.cutoffs([count(3, 10, False, 5)]) == {}


def test_empty_table(spark, tmp_path):
    assert X.scan(table(frame(spark, []), tmp_path)).count() == 0
