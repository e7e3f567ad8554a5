import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronoledger.llm import jaccard_join as J
from chronoledger.llm.shingles import shingle_sets

from .fixtures import clashing, corpus, frame, table


def brute_sets(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, num, den):
    sets = [brute_sets(t, width) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, key), key)
    return sorted((key, len(sets[i]), least[find(i)]) for i, (key, _, _) in enumerate(rows))


def mutated(seed, groups=6, size=14, length=60):
    """Groups of texts that differ from a common one in few or many words, and a
    passage that all share."""
    rng = random.Random(seed)
    rows, common = [], [f"c{i}" for i in range(30)]
    for g in range(groups):
        n = rng.choice([5, 12, length, 3 * length])
        base = [f"g{g}w{rng.randrange(10_000)}" for _ in range(n)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, n // 15))):
                words[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
            rows.append(common + words if rng.random() < 0.5 else words)
    keys = rng.sample(range(10_000), len(rows))
    return [(k, " ".join(w), None) for k, w in zip(keys, rows, strict=True)]


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 4, 5)])
@pytest.mark.parametrize("boundary", [None, 1, 10_000])
def test_components_are_those_of_all_links(spark, tmp_path, monkeypatch, width, num, den, boundary):
    """Also with every set light, and with every set heavy."""
    if boundary is not None:
        monkeypatch.setattr(J, "choose_boundary", lambda *a: boundary if boundary == 1 else 40)
    rows = mutated(width) + [(k + 20_000, t, s) for k, t, s in corpus(45, seed=3)]
    got = J.similarity_classes(table(clashing(spark, rows), tmp_path), width, num, den)
    assert sorted(map(tuple, got.collect())) == brute(rows, width, num, den)


def test_lists_are_scanned_without_hubs(spark, tmp_path, monkeypatch):
    """Most links of these families are left to the scan between components."""
    monkeypatch.setattr(J, "HUB_LISTS", 1)
    monkeypatch.setattr(J, "HUB_ROUNDS", 0)
    monkeypatch.setattr(J, "LOOK_BACK", 1)
    rows = mutated(1, groups=3, size=40)
    got = J.similarity_classes(table(frame(spark, rows), tmp_path), 5, 4, 5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4, 5)


def test_a_pair_is_a_candidate_once(spark, tmp_path, monkeypatch):
    """Sets that share all their lists without linking meet in one of them."""
    seen, real, rng = [], J._pairs, random.Random(4)
    monkeypatch.setattr(J, "_pairs", lambda near, m, h: seen.append(near.count()) or real(near, m, h))
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(30):  # 12 of 400 words differ from the base: about 0.78 between two
        words = list(base)
        for at in rng.sample(range(0, 400, 6), 12):
            words[at] = f"new{k}.{at}"
        rows.append((k, " ".join(words), None))
    got = J.similarity_classes(table(frame(spark, rows), tmp_path), 5, 4, 5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4, 5)
    assert seen[-1] <= 2 * 30 * 29 // 2


def test_lists_of_huge_sets(spark, tmp_path):
    rows = [(7, i, 1 << 30, i) for i in range(5)] + [(8, 1, 1 << 30, 0), (8, 2, 1 << 30, 1 << 28), (9, 1, 10, 0), (9, 2, 13, 0), (9, 2, 13, 0)] + [(10, 1, 10, 0), (10, 2, 13, 0)]
    posted = spark.createDataFrame(rows, "sig long, node long, n int, pos int")
    join = J._Join(table(frame(spark, []), tmp_path), 5, 4, 5, None)
    assert sorted(r.sig for r in join._of_several(posted).collect()) == [7, 9]


def test_sets_are_the_words_sets():
    texts = [t for _, t, _ in corpus()] + ["a\x0bb\x0cc d\re", "\u00a0x y", "İ K ſ"]
    got = list(shingle_sets(pa.array(texts, pa.string()), 4))
    assert [len(x) for x in got] == [len(brute_sets(t, 4)) for t in texts]
    by_set = {}
    for t, x in zip(texts, got, strict=True):
        assert by_set.setdefault(brute_sets(t, 4), x.tobytes()) == x.tobytes()


def test_prefixes_meet():
    """Linked sets share c of their first |x| - o + c elements in any order."""
    rng = random.Random(5)
    for _ in range(500):
        n = rng.randrange(2, 60)
        x = rng.sample(range(1000), n)
        y = [v for v in x if rng.random() < 0.95] + rng.sample(range(1000, 1100), rng.randrange(0, 4))
        if 100 * len(set(x) & set(y)) < 85 * len(set(x) | set(y)):
            continue
        order = list(range(1100))
        rng.shuffle(order)
        for c in (1, 2):
            if len(set(x) & set(y)) >= c:
                p = [set(sorted(s, key=lambda v: order[v])[: J.prefix_length(len(s), c, 85, 100)]) for s in (x, y)]
                assert len(p[0] & p[1]) >= c


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 300, 3000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for drop in range(0, max(1, n // 5), max(1, n // 20)):
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, drop // 2, dtype=np.uint64)]))
            if len(y) and J.links(x, y, 85, 100):
                assert J.may_link(J._bitmap(x), J._bitmap(y), len(x), len(y), 85, 100)


def test_boundary_follows_cost():
    sizes = {n: 100 for n in range(2, 200)}
    assert J.choose_boundary(sizes, 0.0, 85, 100) < J.choose_boundary(sizes, 50.0, 85, 100)


def test_drop_keeps_one_of_each_component(spark, tmp_path):
    rows = mutated(9)
    docs = table(clashing(spark, rows), tmp_path)
    want = sorted({c for _, _, c in brute(rows, 5, 4, 5)})
    left = J.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in left.collect()) == want and left.columns == docs.columns


def test_edges_of_the_domain(spark, tmp_path):
    assert J.similarity_classes(table(frame(spark, []), tmp_path, "a")).count() == 0
    rows = [(1, None, None), (2, "", None), (3, "one", None), (4, "ONE", None), (4, "one", None), (5, "one two", None), (None, "one", None)]
    got = Counter(map(tuple, J.similarity_classes(table(frame(spark, rows), tmp_path, "b")).collect()))
    assert got == Counter([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (4, 1, 3), (5, 1, 5), (None, 1, 3)])
