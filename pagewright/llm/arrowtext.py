"""Vectorised text primitives over Arrow batches.

Everything here works on the UTF-8 buffer of an Arrow string array with NumPy, a slice of a few hundred
kilobytes at a time: no Python object is made for a word, and memory stays bounded whatever the batch size.
A single text longer than the slice is still handled whole.

A *word* is a maximal run of ASCII letters, digits and non-ASCII bytes after Unicode lower-casing, so case and
ASCII punctuation never matter. Its identity is a 64-bit polynomial hash of the bytes, finalised by a mixer.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
KIND = np.where(WORD, 1, 2).astype(np.int8)
KIND[:33] = 0


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + 1)
        a, b = np.full(size, _BASE), np.full(size, _BASE_INV)
        a[0] = b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i], scaled by ``span_hash``, identifying the bytes i..j."""
    pw, _ = _powers(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(p))
    return mix((p[end] - p[start]) * inv[start])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding about ``limit`` bytes each, one row at least."""
    n = len(texts)
    if n == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array, nulls as empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: hash, byte span, and for row i the words rows[i]..rows[i+1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray
    data: np.ndarray
    prefix: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def words(texts: pa.Array) -> Words:
    return _runs(*raw(pc.utf8_lower(texts)), WORD)


def words_sql(text: str) -> str:
    """The list of a text's words in DuckDB."""
    return rf"regexp_extract_all(lower({text}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


def tokens(texts: pa.Array) -> Words:
    """Words with their case kept, and runs of other visible ASCII, each a token."""
    return _runs(*raw(texts), KIND)


def _runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs, within a row, of bytes of one kind other than 0."""
    if len(data):
        k = kind[data]
        m = k != 0
        begins, ends = m.copy(), m.copy()
        same = k[1:] == k[:-1]
        begins[1:] &= ~same
        ends[:-1] &= ~same
        inner = offsets[(offsets > 0) & (offsets < len(data))]  # a row's edge also parts words
        begins[inner] = m[inner]
        ends[inner - 1] = m[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    else:
        start = end = np.zeros(0, np.int64)
    p = prefix_hash(data)
    return Words(span_hash(p, start, end), start, end, np.searchsorted(start, offsets), data, p)


def shingles(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words that lie within a row, in order, and their row offsets."""
    count = np.maximum(np.diff(rows) - (n - 1), 0)
    out_rows = np.concatenate(([0], np.cumsum(count)))
    if len(h) < n:
        return np.zeros(0, np.uint64), out_rows
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        acc *= _BASE
        acc += h[j : len(h) - n + 1 + j]
    acc = mix(acc)
    keep = np.ones(len(acc), bool)
    edges = rows[1:-1]
    for j in range(1, n):  # a run that begins j words before a row's edge crosses it
        at = edges - j
        keep[at[(at >= 0) & (at < len(acc))]] = False
    if n > 1:  # the bounds above also mark words of rows before, which are shorter than n themselves
        keep &= np.repeat(rows[1:], np.diff(rows))[: len(acc)] >= np.arange(len(acc)) + n
    return acc[keep], out_rows


class Index:
    """Exact look-up of 64-bit keys: open addressing, vectorised on both sides."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys.astype(np.uint64))
        self.n = len(keys)
        bits = max(4, int(np.ceil(np.log2(max(1, self.n) * 3))))
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.key, self.pos = np.zeros(self.size, np.uint64), np.full(self.size, -1, np.int32)
        self.probes = 0
        todo = np.arange(self.n, dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            self.probes += 1
            free = self.pos[slot[todo]] < 0
            first = todo[free][np.unique(slot[todo[free]], return_index=True)[1]]
            self.key[slot[first]], self.pos[slot[first]] = keys[first], first
            todo = todo[self.key[slot[todo]] != keys[todo]] if self.n else todo
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
        self.keys = keys

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position among the sorted keys, or -1."""
        slot = self._slot(h)
        out = np.where(self.key[slot] == h, self.pos[slot], np.int32(-1))
        if self.probes > 1:
            todo = np.flatnonzero((out < 0) & (self.pos[slot] >= 0))
            for _ in range(self.probes - 1):
                if not len(todo):
                    break
                slot[todo] = (slot[todo] + 1) & (self.size - 1)
                at = slot[todo]
                hit = (self.pos[at] >= 0) & (self.key[at] == h[todo])
                out[todo[hit]] = self.pos[at[hit]]
                todo = todo[~hit & (self.pos[at] >= 0)]
        return out
