import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers as vocab
import tiktoken

import corpus_pipeline
from chronoledger.llm import bpe, mixing

from .fixtures import clashing, corpus, frame, table
from .test_jaccard_join import brute, mutated
from .test_quality_rules import counts, good


def keeps(text):
    n, chars, symbols, dup, repeat = counts(text)
    letters, caps = len(re.findall(r"[^\W\d_]", text)), sum(c.isupper() for c in text)
    return not (n < 50 or symbols * 10 > n or text.count("!") * 5 > n or caps * 2 > letters or letters * 2 < chars or chars < 2 * n or chars > 25 * n or dup * 2 > len(text.split("\n")) or repeat * 2 > n)


def test_run_is_that_of_brute_force(spark, tmp_path):
    rows = [(k, re.sub(r"(\d)", lambda m: "abcdefghij"[int(m[1])], t), s) for k, t, s in mutated(4, groups=8)]
    rows += [(20_000 + i, t, "src1") for i, t in enumerate([None, "", "few words", good(), good().replace("word", "WORD"), good(), good(120), "#$% " * 60])]
    rows = [(k, t, f"src{k % 5}") for k, t, _ in rows]
    table(frame(spark, rows), tmp_path, "documents.parquet")

    kept = [r for r in rows if keeps(r[1] or "")]
    assert 0 < len(kept) < len(rows)
    same = defaultdict(list)
    for r in kept:
        same[re.sub("[A-Z]", lambda c: c[0].lower(), r[1])].append(r)
    kept = [max(group) for group in same.values()]
    firsts = {c for _, _, c in brute(kept, 5, 4, 5)}
    kept = [r for r in kept if r[0] in firsts]
    encoding = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=bpe.read_ranks(vocab.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((k, s, tuple(encoding.encode_ordinary(t))) for k, t, s in kept)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, tuple(r.token_ids)) for r in got) == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = table(frame(spark, []), tmp_path)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_stages_take_nulls_repeats_clashes_and_long_texts(spark, tmp_path):
    """Null keys and sources, repeated rows, one row of a million characters, and
    columns that stages use inside."""
    long = " ".join(f"word{''.join(chr(97 + int(c)) for c in str(i))} follows." for i in range(60_000))
    rows = corpus(60) + [(None, good(), None), (None, good(), None), (1, good(90), "src1"), (1, good(90), "src1"), (8000, long, "src2"), (8001, None, None)]
    docs = table(clashing(spark, rows), tmp_path)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = table(step(spark, docs, str(tmp_path)), tmp_path, name)
        assert docs.columns == clashing(spark, rows[:1]).columns
    left = [r.doc_id for r in docs.collect()]
    assert left.count(1) == 1 and left.count(8000) == 1 and left.count(None) == 1 and 8001 not in left
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1) for r in out) == sorted((x or -1) for x in left)
    long_row = next(r for r in out if r.doc_id == 8000)
    assert long_row.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_mixture_survives_the_reread(spark, tmp_path, monkeypatch):
    weights = {"src0": 3, "src1": 1}
    monkeypatch.setattr(corpus_pipeline, "MIX_WEIGHTS", weights)
    monkeypatch.setattr(corpus_pipeline, "MIX_BLOCK_BYTES", 500)
    rows = corpus()
    docs = table(frame(spark, rows), tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    mixed = table(stages["pfair_mixing"](spark, docs, str(tmp_path)), tmp_path, "mixed")
    got = stages["byte_bpe"](spark, mixed, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _, _ in rows)
    assert {(r.doc_id, r.slot, r.start_byte) for r in got} == {(r.doc_id, r.slot, r.start_byte) for r in mixing.mix(docs, weights, 500, corpus_pipeline.MIX_OTHER).collect()}

    blocks = Counter()
    for _, t, s in rows:
        blocks[s if s in weights else mixing.OTHER] += len((t or "").encode()) + 1
    every = {**weights, mixing.OTHER: corpus_pipeline.MIX_OTHER}
    limit = mixing.phases(every, {s: -(-b // 500) for s, b in blocks.items()})[1]["start"]
    order = mixing.period(every)
    first = [r for r in got if r.slot < limit]
    assert first and all((r.source if r.source in weights else mixing.OTHER) == order[r.slot % len(order)] for r in first)


def test_tokens_are_decoded_to_the_bytes_of_the_text(spark, tmp_path):
    rows = corpus() + [(9000, "é日本 🎉 a\u0301", "src1")]
    docs = table(frame(spark, rows), tmp_path)
    got = dict(corpus_pipeline.STAGES)["byte_bpe"](spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t, _ in rows)
