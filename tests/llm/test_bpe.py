import hashlib

import public_tokenizers as vocab
import pytest
import tiktoken

from chronoledger.llm import bpe

from .fixtures import clashing, corpus, frame

PATH = vocab.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  a  b ", "\r\n\t x", "it's I'LL we're", "日本語 тест ñandú", "👩‍👩‍👧 🇫🇷", "a\u0301e\u0301", "1234567 ٣٤٥", "\u00a0x\u2028y\u0085z", "x" * 3000, "<|endoftext|>", "\x00\x01", "word " * 40000, "日本語、テスト。" * 20000, "тест\n" * 30000, "x" * 150000 + "é"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_those_of_the_rank_file(name):
    path = vocab.path(name)
    ranks = bpe.read_ranks(path)
    want = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.codec(path, vocab.PATTERN)
    texts = ODD + [t or "" for _, t, _ in corpus()]
    for text, (ids, _) in zip(texts, codec.encode(texts), strict=True):
        assert ids == want.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_offsets_cover_whole_characters():
    codec = bpe.codec(PATH, vocab.PATTERN)
    for text in ("naïve 日本 👍 end", "plain words " * 9000):
        (ids, spans), = codec.encode([text])
        assert len(ids) == len(spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
        for i, (start, end) in zip(ids, spans, strict=True):
            assert codec.bytes_of[i] in text[start:end].encode()


def test_ids_cut_inside_a_character_decode_to_its_bytes(spark):
    codec = bpe.codec(PATH, vocab.PATTERN)
    (ids, _), = codec.encode(["日"])
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    rows = {r.doc_id: r for r in bpe.decode_tokens(df, PATH, vocab.PATTERN).collect()}
    assert bytes(rows[1].decoded_bytes) == codec.bytes_of[ids[0]] and "\ufffd" in rows[1].decoded_text
    assert rows[2].decoded_text == rows[3].decoded_text == ""


def test_round_trip_of_a_table(spark, reference):
    rows = corpus() + [(5000 + i, t, None) for i, t in enumerate(ODD)]
    got = bpe.digest_round_trip(clashing(spark, rows), PATH, vocab.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for key, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((key, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert sorted(map(tuple, got)) == sorted(want)


def test_encode_keeps_columns_and_empty_tables(spark):
    df = clashing(spark, corpus(9))
    out = bpe.encode_texts(df, PATH, vocab.PATTERN)
    assert out.columns == [c for c in df.columns if c != "token_ids"] + ["token_ids", "token_starts", "token_ends"]
    assert out.count() == df.count()
    assert bpe.encode_texts(frame(spark, []), PATH, vocab.PATTERN).count() == 0


def test_a_rank_file_without_its_merges_is_refused():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300}
    with pytest.raises(ValueError):
        bpe.recover_merges(ranks)
