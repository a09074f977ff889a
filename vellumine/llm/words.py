"""Word and word-window hashes of whole Arrow text columns, without a loop over words.

A word is a maximal run of bytes that are no separators, inside one document.
Its hash is a polynomial over a random 64-bit value per byte, taken from prefix
sums, so the cost is a few nanoseconds a byte whatever the vocabulary.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from vellumine.llm.common import doc_chunks, text_bytes

U = np.uint64
SPACES = b" \t\n\r\f\v"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Powers:
    """Powers of an odd number modulo 2**64, and their inverses, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n2 = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(n2, U(b), U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = Powers(_BASE), Powers(_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_class(separators: bytes) -> np.ndarray:
    ok = np.ones(256, bool)
    ok[np.frombuffer(separators, np.uint8)] = False
    return ok


class Words(NamedTuple):
    hashes: np.ndarray  #: uint64, one per word
    bounds: np.ndarray  #: int64, documents + 1: document d has words bounds[d]:bounds[d + 1]
    start: np.ndarray  #: int64 byte offsets in ``data``
    end: np.ndarray
    data: np.ndarray  #: the bytes, as hashed


def _hash(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return np.empty(0, U), np.zeros(len(offs), np.int64), e, e
    word = is_word[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    first = offs[:-1][offs[:-1] < n]
    before[first] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    up, down = _byte_powers(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(BYTE[data] * up, out=sums[1:])
    h = (sums[end] - sums[start]) * down[start] + (end - start).astype(U)
    return mix(h), np.searchsorted(start, offs), start, end


def hash_words(col: pa.Array | pa.ChunkedArray, is_word: np.ndarray, lower: bool = True) -> Words:
    """Every word of every document of a text column."""
    data, offs = text_bytes(col, lower)
    hs, bs, ss, es, done = [], [np.zeros(1, np.int64)], [], [], 0
    for lo, hi in doc_chunks(data, offs):
        base = offs[lo]
        h, b, s, e = _hash(data[base : offs[hi]], offs[lo : hi + 1] - base, is_word)
        hs.append(h)
        bs.append(b[1:] + done)
        ss.append(s + base)
        es.append(e + base)
        done += len(h)
    cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
    return Words(cat(hs, U), np.concatenate(bs), cat(ss, np.int64), cat(es, np.int64), data)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, also across documents; see ``inside``."""
    n = len(hashes)
    if n < size:
        return np.empty(0, U)
    up, down = _word_powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1] + U(size))


def span_hash(hashes: np.ndarray) -> int:
    """Hash of one whole sequence, equal to its window hash of the same size."""
    return int(window_hashes(hashes, len(hashes))[0])


def inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """Mask over window positions: those that end within their document."""
    n = int(bounds[-1])
    if n < size:
        return np.zeros(0, bool)
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(n)
    return left[: n - size + 1] >= size


def word_document(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
