import hashlib
from collections import Counter, defaultdict

from chronoledger.llm import exact_dedup
from chronoledger.llm.common import Stage

from .fixtures import clashing, corpus, frame, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(text):
    return (text or "").translate(LOWER)


def test_groups_are_those_of_equal_texts(spark, tmp_path):
    rows = corpus()
    groups = defaultdict(list)
    for key, text, _ in rows:
        groups[normal(text)].append(key)
    want = Counter((k, max(groups[normal(t)]), len(groups[normal(t)]), k == max(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for k, t, _ in rows)
    got = exact_dedup.exact_duplicates(table(clashing(spark, rows), tmp_path)).collect()
    assert Counter(map(tuple, got)) == want


def test_texts_that_differ_late_have_different_names(spark, tmp_path):
    size = exact_dedup.BLOCK_CHARS
    texts = ["x" * size * k + tail for k in (1, 2, 3, 7) for tail in ("", "a", "b", "é")] + ["ab" * size * 3, "ba" * size * 3]
    docs = table(frame(spark, [(i, t, None) for i, t in enumerate(texts + texts[:3])]), tmp_path)
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert [got[i].keep_id for i in range(3)] == [len(texts) + i for i in range(3)]
    assert all(got[i].group_size == 1 for i in range(3, len(texts)))


def test_names_hold_when_fingerprints_collide(spark, tmp_path):
    """With few bits distinct blocks share a fingerprint; other seeds are then taken."""
    rows = corpus()
    docs = table(frame(spark, rows), tmp_path)
    stage = Stage(spark, "test")
    kept, names = exact_dedup.block_identities(docs.withColumnRenamed("doc_id", "_key"), stage, "text", fingerprint_bits=2)
    got = defaultdict(set)
    for r in kept.join(names, "_rid").collect():
        got[r.n_blocks, r.name].add(r._key)
    want = defaultdict(set)
    for key, text, _ in rows:
        want[normal(text)].add(key)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_repeated_rows_and_null_keys_keep_one(spark, tmp_path):
    rows = [(1, "t", "a"), (1, "t", "a"), (1, "T", "a"), (None, "t", "a"), (None, "u", "b"), (None, "u", "b")]
    docs = table(frame(spark, rows), tmp_path)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sum(r.kept for r in got) == 2 and len(got) == 6
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, (r.text or "").lower()) for r in left.collect()) == Counter([(1, "t"), (None, "u")])


def test_null_empty_and_nul_texts_under_one_key(spark, tmp_path):
    rows = [(1, None, "a"), (1, "\0", "a"), (1, "", "a"), (2, "", "b")]
    docs = table(clashing(spark, rows), tmp_path)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, "\0"), (2, "")]) and left.columns == docs.columns
    alone = table(frame(spark, rows[:3]), tmp_path, "alone")
    assert Counter((r.doc_id, r.text or "") for r in exact_dedup.drop_exact_duplicates(alone).collect()) == Counter([(1, "\0"), (1, "")])


def test_drop_keeps_the_rows_that_stay(spark, tmp_path):
    rows = corpus()
    docs = table(clashing(spark, rows), tmp_path)
    best = {}
    for key, text, _ in rows:
        best[normal(text)] = max(best.get(normal(text), -1), key)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted(best.values()) and left.columns == docs.columns


def test_empty_table(spark, tmp_path):
    assert exact_dedup.exact_duplicates(table(frame(spark, []), tmp_path)).count() == 0
    assert exact_dedup.drop_exact_duplicates(table(frame(spark, []), tmp_path)).count() == 0
