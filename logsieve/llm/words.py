"""Words, n-grams and their 64-bit hashes for whole Arrow batches, in numpy passes over the UTF-8 bytes.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text:
`[0-9a-z\\u0080-\\U0010ffff]+`.  Nothing here depends on where a text stands in its batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the numpy passes take at once; a single longer text makes a longer slice.
SLICE = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x + _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def slices(n_bytes: np.ndarray, most: int = SLICE):
    """(from, to) row ranges of at most `most` bytes, or of one row."""
    ends, start = np.cumsum(n_bytes, dtype=np.int64), 0
    while start < len(n_bytes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def lowered(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.utf8_lower(pc.fill_null(texts, ""))


def parts(texts: pa.Array, most: int = SLICE):
    """(first row, slice of texts) of bounded size."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(n, most):
        yield a, texts.slice(a, b - a)


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for n texts the n + 1 offsets into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = _IS_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offs[:-1][offs[:-1] < len(data)]
    first[edges] = word[edges]
    edges = offs[1:] - 1
    edges = edges[edges >= 0]
    last[edges] = word[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    up, down = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, and n + 1 offsets."""
    data, offs = as_bytes(texts)
    starts, ends, at = spans(data, offs)
    return span_hashes(data, starts, ends), at


def gram_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and n + 1 offsets.  A text of fewer words, but some,
    has one gram: all its words."""
    counts = np.diff(at)
    short = (counts > 0) & (counts < n)
    out_n = np.where(short, 1, np.maximum(counts - n + 1, 0))
    out_at = np.concatenate([[0], np.cumsum(out_n)])
    total = int(out_at[-1])
    text_of = np.repeat(np.arange(len(counts)), out_n)
    begin = at[:-1][text_of] + (np.arange(total) - out_at[:-1][text_of])
    length = np.minimum(counts[text_of], n)
    acc = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        w = padded[begin + k]
        if short.any():
            w = np.where(k < length, w, np.uint64(0))
        acc = acc * _GRAM + w
    return mix(acc + length.astype(np.uint64)), out_at
