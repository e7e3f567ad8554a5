"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library does the merges; its model is built from a rank file
(base64 token, rank) by recovering the pair each token was merged from.  Every
byte is shown to the model as one printable character (the byte table), so any
text has ids, and decoding reads the table backwards.  A token may end inside a
character: decoding joins the bytes of all tokens before it reads characters.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType

from .common import with_fields

#: Texts are encoded in pieces of about so many characters, cut where the
#: pattern has a boundary whatever stands around it: before a single space
#: between two printable ASCII characters, or, where a text has none, after a
#: match of the pattern that does not end in a blank (the pattern looks ahead
#: for blanks only).  The library holds a piece, which is longer only where a
#: single match is.
PIECE_CHARS = 1 << 16
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


def byte_table() -> list[str]:
    """The character for each byte: itself if it is printable Latin-1, else the
    next free character from U+0100 on, in the order of the bytes."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def recover_merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of several bytes is made of, by rank: merging
    its bytes by the tokens of lower rank leaves exactly two parts."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                raise ValueError(f"{token!r} has no merge of lower rank")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


class Codec:
    """Encodes and decodes texts by one rank file and one splitting pattern.

    It goes to the workers as its vocabulary and merges (3 MB for 50,000
    tokens), recovered once on the driver; each worker makes the model of them
    once.  So the rank file need not be on the workers' machines.
    """

    def __init__(self, path: str, pattern: str):
        ranks, shown = read_ranks(path), byte_table()
        as_text = lambda token: "".join(shown[b] for b in token)
        self.__setstate__(({as_text(t): r for t, r in ranks.items()}, [(as_text(a), as_text(b)) for a, b in recover_merges(ranks)], pattern))

    def __getstate__(self) -> tuple[dict[str, int], list[tuple[str, str]], str]:
        return self.parts

    def __setstate__(self, parts: tuple[dict[str, int], list[tuple[str, str]], str]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.parts = vocab, merges, pattern = parts
        self.matches, shown = regex.compile(pattern), byte_table()
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        back = {c: b for b, c in enumerate(shown)}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}

    def pieces(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, piece) of `text`; no token reaches over a cut."""
        start = 0
        while len(text) - start > PIECE_CHARS:
            cut = _CUT.search(text, start + PIECE_CHARS, start + 2 * PIECE_CHARS)
            at = cut.start() if cut else self._match_end(text, start)
            yield start, text[start:at]
            start = at
        if start < len(text) or not text:
            yield start, text[start:]

    def _match_end(self, text: str, start: int) -> int:
        """The end of the first match beyond a piece from `start` that does not
        end in a blank, or of the text."""
        ends = (m.end() for m in self.matches.finditer(text, start))
        return next((e for e in ends if e - start >= PIECE_CHARS and not text[e - 1].isspace()), len(text))

    def encode(self, texts: list[str], offsets: bool = True) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
        """Ids of each text, and the characters [start, end) each comes from.

        A token that ends inside a character has that whole character in its
        span, as has the token that goes on with it.
        """
        run = self.model.encode_batch if offsets else self.model.encode_batch_fast
        for text in texts:
            ids: list[int] = []
            spans: list[tuple[int, int]] = []
            for start, piece in self.pieces(text):
                got = run([piece], add_special_tokens=False)[0]
                ids += got.ids
                if offsets:
                    spans += [(start + a, start + b) for a, b in got.offsets]
            yield ids, spans

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The model of a rank file that the driver reads."""
    return Codec(path, pattern)


def _shared(spark: SparkSession, path: str, pattern: str):
    """The model as a broadcast: workers read no path."""
    return spark.sparkContext.broadcast(codec(path, pattern))


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """`docs` with token_ids, and token_starts and token_ends (code points) if
    `offsets`; a null text encodes as an empty one.  Columns of `docs` with
    these names are replaced."""
    added = ["token_ids", *(["token_starts", "token_ends"] if offsets else [])]
    kept = docs.drop(*added)
    ints = pa.list_(pa.int32())
    out = with_fields(kept.schema, *[(name, ArrayType(IntegerType())) for name in added])
    model = _shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for part in _small(batch, text):
                got = list(own.encode([x or "" for x in part.column(text).to_pylist()], offsets))
                cols = [pa.array([ids for ids, _ in got], ints)]
                if offsets:
                    cols += [pa.array([[s[k] for s in spans] for _, spans in got], ints) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *added])

    return kept.mapInArrow(run, out)


def decode_tokens(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """`docs` with decoded_bytes (binary) and decoded_text of the column `ids`.

    Bytes that are no UTF-8 (ids cut inside a character) show as U+FFFD in the
    text; the bytes are exact.  Null ids decode to an empty text.
    """
    added = ["decoded_bytes", "decoded_text"]
    kept = docs.drop(*added)
    model = _shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for part in _small(batch, ids):
                raw = [own.decode(x or []) for x in part.column(ids).to_pylist()]
                cols = [pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *added])

    return kept.mapInArrow(run, with_fields(kept.schema, ("decoded_bytes", BinaryType()), ("decoded_text", StringType())))


def digest_round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes its ids, and returns the digests of both.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by single
    spaces), decoded_sha256 (of the decoded bytes).  The ids never leave the
    worker: only 150 bytes a document go back.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    schema = with_fields(narrow.select("doc_id").schema, ("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType()))
    model = _shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in _small(batch, "_text"):
                n, a, b = [], [], []
                for ids, _ in own.encode([x or "" for x in part.column("_text").to_pylist()], False):
                    n.append(len(ids))
                    a.append(digest(" ".join(map(str, ids)).encode()))
                    b.append(digest(own.decode(ids)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=schema.names)

    return narrow.mapInArrow(run, schema)


def _small(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of about `most` bytes of `column`, one row at least."""
    per = max(1, batch.column(column).nbytes // max(1, batch.num_rows))
    step = max(1, most // per)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
