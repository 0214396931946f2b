"""Whole Arrow string columns as word and window hashes, with numpy over the raw UTF-8 buffers.

Runs inside Spark's Arrow tasks. Texts are taken in slices of about half a MB, so memory follows the
longest single text rather than the batch. Words are runs of anything but the bytes 0x20 and
0x09-0x0D, which never occur inside a multi-byte character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: Bytes of a word that are taken as they are, eight to a lane; longer words give their digest instead.
LANES = 4
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_rng = np.random.Generator(np.random.PCG64(20240607))
ODD = [int(x) | 5 for x in _rng.integers(1, 2**63, 4, dtype=np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (murmur's constants), so that all bits count."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets of each; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lanes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words (begin, size) of the bytes data as LANES rows of 64-bit numbers: the bytes themselves,
    or, of words beyond 8 * LANES bytes, their 256-bit digest. Two words of the same size have the
    same lanes only if they are equal (or their digests are)."""
    out = np.zeros((LANES, len(begin)), np.uint64)
    if not len(begin):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
    rows = slice(None)
    for k in range(LANES):
        if k:
            rows = np.flatnonzero(size > 8 * k)
            if not len(rows):
                break
        rest = np.minimum(size[rows] - 8 * k, 8).astype(np.uint64)
        out[k, rows] = eight[begin[rows] + 8 * k] & (np.uint64(2**64 - 1) >> (np.uint64(64) - (rest << np.uint64(3))))
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        own = data[begin[i] : begin[i] + size[i]].tobytes()
        out[:, i] = np.frombuffer(hashlib.blake2b(own, digest_size=8 * LANES).digest(), "<u8")
    return out


def folded(lanes_: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word from its lanes and size; seeds give independent ones."""
    odd = np.uint64(ODD[seed % len(ODD)])
    out = mix(lanes_[0] ^ (size.astype(np.uint64) * odd), seed)
    for k in range(1, LANES):
        rows = np.flatnonzero(size > 8 * k)
        if not len(rows):
            break
        out[rows] = mix((out[rows] ^ lanes_[k, rows]) * odd, seed)
    return out


class Words:
    """Words of documents first .. first+n-1; word k of document d is at[d]+k. ``hash`` and
    ``other`` are independent 64-bit hashes of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.first, self.n = first, len(offsets) - 1
        inside = IS_WORD[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        begin[cuts] = inside[cuts]
        end[cuts - 1] = inside[cuts - 1]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.at = np.searchsorted(self.begin, offsets)
        self.size = self.end - self.begin
        self._lanes = lanes(data, self.begin, self.size)
        self.hash = folded(self._lanes, self.size, 1)
        self.count = np.diff(self.at)

    @property
    def other(self) -> np.ndarray:
        return folded(self._lanes, self.size, 2)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n), self.count)


def slices(texts: pa.Array) -> Iterator[Words]:
    """Words of consecutive documents, about SLICE_BYTES of text at a time."""
    data, offsets = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def joined(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each pair; the shift keeps it from being a polynomial, whose values repeat."""
    return (a ^ (a >> np.uint64(32))) * np.uint64(ODD[seed % len(ODD)]) + b


def grams(words: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """A hash of each k consecutive values (over document bounds too); empty if there are fewer.
    Runs of one, two, four ... values are doubled, and those that make up k joined."""
    n, size = len(words) - k + 1, 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    own, out, done = words, None, 0
    while True:
        if k & size:
            part = own[done : done + n]
            out = part if out is None else joined(out, part, seed)
            done += size
        if size * 2 > k:
            return mix(out, seed)
        own = joined(own[:-size], own[size:], seed + 1)
        size *= 2


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive values."""
    n, size = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[k - size : k - size + n])
