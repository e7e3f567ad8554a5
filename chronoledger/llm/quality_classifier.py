"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text: counts and
shapes (FEATURES), and the shares of hashed words and of hashed runs of three
bytes, so that it learns vocabulary and spelling too.  Of a good and
a bad document the good one is preferred with probability sigmoid(difference of
strengths); the weights maximise the likelihood of such preference pairs, which
is logistic loss on differences of features.  The cut between good and bad is a
quantile of the strengths of the labelled sample: the share of bad labels in it.
Scores are strengths on a logistic scale on which the cut lies at CUT.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructType

from .shingles import batches_of, word_hashes

#: At most so many labelled documents are fitted on: those whose keys have the
#: smallest hashes.  The fit gets no better beyond; the driver holds 22 MB.
MAX_LABELLED = 20_000

#: Preference pairs drawn from the labelled sample (32 MB), and steps of the fit.
PAIRS, STEPS, RATE, RIDGE = 30_000, 300, 0.5, 1e-3

#: Buckets of hashed words and of hashed runs of three bytes.  Each hashed
#: feature is one of many, so together they weigh as SHARE of a feature each.
WORD_BUCKETS, BYTE_BUCKETS, SHARE = 128, 128, 0.25

#: Documents scored at least this are predicted good.
CUT = 0.3

FEATURES = (
    "words", "word_length", "symbols", "exclamations", "capitals", "digits", "stops", "other_marks", "high_bytes",
    "lines", "repeated_next", "new_words", "new_triples",
)

_SETS = {
    "symbols": b"#*$%&|<>", "exclamations": b"!", "capitals": bytes(range(65, 91)), "digits": b"0123456789",
    "stops": b".,;:?", "other_marks": b"()[]{}@^~`_+=\\/\"'-", "high_bytes": bytes(range(128, 256)), "lines": b"\n",
}
_TABLE = np.stack([np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for v in _SETS.values()]).astype(np.float64)


WIDTH = len(FEATURES) + WORD_BUCKETS + BYTE_BUCKETS


def features_of(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES and the square roots of the shares of each bucket, for
    each text; zeros for null ones and those without words."""
    h, offsets = word_hashes(texts)
    bodies = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    # The buffer is that of the whole batch, of which `texts` may be a slice.
    raw, ends = np.frombuffer(bodies.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    out = np.zeros((len(texts), WIDTH), np.float32)
    low = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint32)
    runs = ((low[:-2] << np.uint32(16)) ^ (low[1:-1] << np.uint32(8)) ^ low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(25) if len(low) > 2 else low[:0]
    words, at = (h & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), len(FEATURES)
    triples = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:] if len(h) > 2 else h[:0]
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        n = b - a
        if not n:
            continue
        counts = _TABLE @ np.bincount(raw[ends[i] : ends[i + 1]], minlength=256)
        size = float(ends[i + 1] - ends[i])
        mine = h[a:b]
        row = out[i]
        row[0] = math.log1p(n)
        row[1] = math.log1p(size / n)
        row[2:10] = np.log1p(counts / n * 4)
        row[4] = counts[2] / size
        row[8] = counts[6] / size
        row[10] = float((mine[1:] == mine[:-1]).sum()) / n
        row[11] = len(np.unique(mine)) / n ** 0.9
        row[12] = len(np.unique(triples[a : b - 2])) / (n - 2) if n > 2 else 1.0
        row[at : at + WORD_BUCKETS] = np.sqrt(np.bincount(words[a:b], minlength=WORD_BUCKETS) / n)
        if size > 2:
            row[at + WORD_BUCKETS :] = np.sqrt(np.bincount(runs[ends[i] : ends[i + 1] - 2], minlength=BYTE_BUCKETS) / (size - 2))
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - self.mean) / self.scale) @ self.weights
        z = (strength - self.cut) / self.spread + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray) -> Model:
    """The model of features `x` and labels `good` (booleans).  With labels of
    one kind only there are no pairs: every score is then 0.5."""
    k = x.shape[1]
    weigh = np.where(np.arange(k) < len(FEATURES), 1.0, SHARE)
    if good.all() or not good.any():
        return Model(np.zeros(k), np.ones(k), np.zeros(k), math.log(CUT / (1 - CUT)), 1.0)
    mean, scale = x.mean(0, dtype=np.float64), (x.std(0, dtype=np.float64) + 1e-9) / weigh
    # What the sample never shows says nothing of other texts.
    scale = np.where(x.std(0) < 1e-6, np.inf, scale)
    z = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(0)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    diff = z[rng.choice(up, PAIRS)] - z[rng.choice(down, PAIRS)]
    w = np.zeros(k)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        w += RATE * (diff.T @ p / len(diff) - RIDGE * w)
    strength = z.astype(np.float64) @ w
    # The cut lies midway between the two neighbours of the quantile.
    ranked, at = np.sort(strength), int((~good).sum())
    cut = float((ranked[at - 1] + ranked[at]) / 2)
    return Model(mean, scale, w, cut, float(strength.std()) / 4 + 1e-9)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits on the documents that `labels` (key, label 0 or 1) names, at most
    MAX_LABELLED.  A key with labels of both kinds counts as bad; of rows that
    repeat a key each counts, within the bound."""
    some = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg((F.min(label) > 0).alias("_good"))
    some = some.orderBy(F.xxhash64("_k"), "_k").limit(MAX_LABELLED)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(some), F.col("_key") == F.col("_k")).select("_text", "_good", F.xxhash64("_key").alias("_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "_text"):
                found = features_of(batch.column("_text"))
                yield pa.RecordBatch.from_arrays([batch.column("_hash"), pa.array([x.tobytes() for x in found], pa.binary()), batch.column("_good")], names=["hash", "x", "good"])

    made = texts.mapInArrow(run, StructType().add("hash", LongType()).add("x", BinaryType()).add("good", BooleanType()))
    rows = made.orderBy("hash", "x", "good").limit(MAX_LABELLED).collect()
    if not rows:
        return fit(np.zeros((0, WIDTH), np.float32), np.zeros(0, bool))
    return fit(np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]), np.array([r["good"] for r in rows]))


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs`; null texts as empty."""
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    schema = StructType([narrow.schema["doc_id"]]).add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "_text"):
                s = model.score(features_of(batch.column("_text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=schema.names)

    return narrow.mapInArrow(run, schema)
