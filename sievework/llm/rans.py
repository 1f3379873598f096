"""Static range asymmetric numeral system over interleaved lanes.

A block is coded by many 64-bit states side by side: token i belongs to lane i mod lanes, so a step
codes one token of every lane in a few array operations. States stay in [2^31, 2^63) and pass 32-bit
words to one shared stream. The states at the end of coding are the block's checkpoint: with them a
block decodes alone, in any order with others.
"""

from __future__ import annotations

import numpy as np

SCALE = 20
_LOW = np.uint64(1 << 31)
_SHIFT = np.uint64(SCALE)
_MASK = np.uint64((1 << SCALE) - 1)
_LIMIT = np.uint64(63 - SCALE)
_WORD = np.uint64(32)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^SCALE; a symbol that occurs keeps at least 1."""
    whole, total = int(counts.sum()), 1 << SCALE
    if not whole:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > total:
        raise ValueError("more symbols than the table can hold")
    out = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * total / whole), 0).astype(np.int64)
    while (over := int(out.sum()) - total) > 0:
        i = int(out.argmax())
        out[i] -= min(over, max(1, int(out[i]) // 2))
    out[int(out.argmax())] += total - int(out.sum())
    return out


class Table:
    """Frequencies of symbols with their cumulated sums and the decoder's slots."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.low = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)

    @classmethod
    def of(cls, tokens: np.ndarray) -> Table:
        counts = np.bincount(tokens)
        symbols = np.flatnonzero(counts)
        return cls(symbols, frequencies(counts[symbols]))

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.symbols[-1]) + 1 if len(self.symbols) else 1
        f, c = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        f[self.symbols], c[self.symbols] = self.freq, self.low
        return f, c

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))


def encode(tokens: np.ndarray, f: np.ndarray, c: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(states, words) of one block."""
    x = np.full(lanes, _LOW)
    out = []
    for at in range((len(tokens) - 1) // lanes * lanes, -1, -lanes):
        s = tokens[at : at + lanes]
        fs, y = f[s], x[: len(s)]
        over = y >= (fs << _LIMIT)
        if over.any():
            out.append(y[over].astype(np.uint32))
            y[over] >>= _WORD
        q = y // fs
        x[: len(s)] = (q << _SHIFT) + (y - q * fs) + c[s]
    return x, np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)


def decode(states: np.ndarray, words: np.ndarray, n: int, table: Table, slots: np.ndarray) -> np.ndarray:
    """The n tokens of one block."""
    lanes, x, at = len(states), states.copy(), 0
    out = np.empty(n, np.uint32)
    for i in range(0, n, lanes):
        k = min(lanes, n - i)
        y = x[:k]
        slot = y & _MASK
        s = slots[slot]
        out[i : i + k] = table.symbols[s]
        y = table.freq[s] * (y >> _SHIFT) + slot - table.low[s]
        few = np.flatnonzero(y < _LOW)
        if len(few):
            y[few] = (y[few] << _WORD) | words[at : at + len(few)].astype(np.uint64)
            at += len(few)
        x[:k] = y
    if at != len(words) or (x != _LOW).any():
        raise ValueError("block doesn't end where it began")
    return out
