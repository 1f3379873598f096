"""Vectorised text primitives over Arrow batches.

A batch of texts is viewed as one byte array plus document offsets; words, lines and hashes of
all its documents come from a few numpy passes, without a Python object per word.
Null texts are empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)

SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False

ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Texts:
    """Concatenated UTF-8 bytes of some documents; offsets has one entry more than documents."""

    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(buf[o[0] : o[-1]], o - o[0])


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of up to `most` bytes of text each, or of one row, so that memory follows the part, not the batch."""
    column = batch.column(batch.schema.get_field_index(text))
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, n = 0, batch.num_rows
    total = np.concatenate([[0], np.cumsum(size)])
    while at < n:
        to = int(np.searchsorted(total, total[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """start and end: byte positions; first: index of each document's first word, one entry more than documents."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def spans_of(mask: np.ndarray, t: Texts) -> Words:
    """Maximal runs of marked bytes, broken at documents' borders."""
    n = len(mask)
    edge = np.zeros(n + 1, dtype=bool)
    edge[t.offsets] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = mask[:-1]
        after[:-1] = mask[1:]
    start = np.flatnonzero(mask & (~before | edge[:-1]))
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return Words(start, end, np.searchsorted(start, t.offsets))


def words_of(t: Texts, table: np.ndarray = SPACE_WORDS) -> Words:
    return spans_of(table[t.buf], t)


def lines_of(t: Texts) -> Words:
    """Lines between newlines; an empty text has one empty line, as with a split."""
    cut = np.flatnonzero(t.buf == 10)
    n = len(t)
    start = np.sort(np.concatenate([t.offsets[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([t.offsets[1:], cut]), kind="stable")
    first = np.searchsorted(cut, t.offsets) + np.arange(n + 1)
    return Words(start, end, first)


def names(t: Texts, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each span among spans of its length: its bytes themselves up to 16 of them, else a cryptographic digest."""
    size = w.end - w.start
    if not len(size):
        return np.zeros(0, _U), np.zeros(0, _U)
    padded = np.concatenate([t.buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(t.buf) + 1, "<u8", padded, 0, (1,))
    head = eight[w.start] & _LOW[np.minimum(size, 8)]
    tail = np.where(size > 8, eight[np.maximum(w.end - 8, 0)], _U(0))
    far = np.flatnonzero(size > 16)
    if len(far):
        raw = b"".join(hashlib.blake2b(t.buf[i:j], digest_size=16).digest() for i, j in zip(w.start[far].tolist(), w.end[far].tolist(), strict=True))
        head[far], tail[far] = np.frombuffer(raw, "<u8").reshape(-1, 2).T
    return head, tail


def hashed(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of names and lengths."""
    return mix(mix(head + size * _U(0x9E3779B97F4A7C15)) ^ mix(tail + _U(0x51ED270B7F4A7C15)))


def hashes(t: Texts, w: Words) -> np.ndarray:
    """A 64-bit hash of each span's bytes. No sum of bytes or words is part of it, so no pattern of repeats makes spans equal."""
    head, tail = names(t, w)
    return hashed(head, tail, (w.end - w.start).astype(_U))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of h[i:i+k] at i, over the whole array; callers leave out those that cross documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _U(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    return mix(out)


def inside(w: Words, k: int) -> np.ndarray:
    """Whether a window of k words that starts at a word stays in its document (for the first len - k + 1 words)."""
    n = len(w.start) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    last = np.repeat(w.first[1:], w.counts())[:n]
    return np.arange(n) + k <= last


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Marks at[i] .. at[i] + k - 1 among n."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:-1]) > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    return total[bounds[1:]] - total[bounds[:-1]]
