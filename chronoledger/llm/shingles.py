"""Sets of word shingles of whole texts, computed over Arrow batches.

Words are what stands between the ASCII blanks after A to Z are lower-cased.  A
shingle is `width` words in a row; a text of fewer words has its whole sequence
as its one shingle, and a text without words has none.  Shingles are 64-bit
hashes of the words' 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of `h` over all (xor-shift and odd multipliers)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, index of the first word of each text and
    the end); nulls have no words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    split = pa.concat_arrays([split]) if isinstance(split, pa.ChunkedArray) else split
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return (each[coded.indices.to_numpy()] if len(each) else each), offsets


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles (uint64) of each text in turn."""
    h, offsets = word_hashes(texts)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _ODD + h[k : len(h) - width + 1 + k] if len(rolled) else rolled
    rolled = _mixed(rolled)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = (np.array([short]) * _ODD + x)[0]
            yield _mixed(np.array([short]) ^ _ODD)
        else:
            yield np.empty(0, np.uint64)


def batches_of(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of about `most` bytes of `column`, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # workers are reused, and keep what they don't give back
