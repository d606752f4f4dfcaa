"""Vectorised text kernels over the buffers of Arrow string columns: words, lines, hashes, shingles.

All work on UTF-8 bytes. Every byte of a non-ASCII character is 0x80 or more, so classes that hold
all or no non-ASCII characters give the same words on bytes as on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call sees at most, unless one text alone is longer.
SLICE_BYTES = 2 << 20

_MULTIPLIER = 0x9E3779B97F4A7C1B  # = 3 mod 8, so that powers of it lose few low bits
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are not in [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[0x00:0x30] = NOT_WORD[0x3A:0x61] = NOT_WORD[0x7B:0x80] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if _powers[kind].size < n:
        size = max(n, SLICE_BYTES + 4096)
        step = np.full(size, _MULTIPLIER if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_one(h: int) -> int:
    return int(mix(np.array([h & (2**64 - 1)], np.uint64))[0])


class Texts:
    """The bytes of several texts, one after another: data[offsets[i]:offsets[i + 1]] is text i (null: empty)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        _, at, data = column.buffers()
        off = np.frombuffer(at, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        first, last = int(off[0]), int(off[-1])
        self.data = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
        self.offsets = off - first
        if lower:
            self.data = LOWER[self.data]

    def __len__(self) -> int:
        return self.offsets.size - 1

    def spans(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes that are no separators and in one text: starts, ends, and where each text's runs begin."""
        if not self.data.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        inside = ~separator[self.data]
        edge = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        first[edge] = inside[edge]
        last[:-1] &= ~inside[1:]
        edge = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        last[edge] = inside[edge]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each data[start:end], by one running sum over all bytes."""
        n = self.data.size
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[self.data] * _power("up", n)[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in one text, and where each text's runs begin. short: a text of fewer words, but not none, gives one hash of them all."""
    counts = np.diff(bounds)
    h = np.zeros(words.size, np.uint64)
    step = np.uint64(1)
    for j in range(min(k, words.size)):
        h[: words.size - j] += words[j:] * step
        step = np.uint64(int(step) * _MULTIPLIER & (2**64 - 1))
    text = np.repeat(np.arange(counts.size), counts)
    whole = np.arange(words.size) + k <= bounds[1:][text]
    if not short:
        return mix(h[whole]), np.concatenate(([0], np.cumsum(np.maximum(counts - k + 1, 0))))
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = int(bounds[i]), int(bounds[i + 1])
        value = sum(int(w) * pow(_MULTIPLIER, j, 1 << 64) for j, w in enumerate(words[a:b])) + (b - a) * 0x5851F42D4C957F2D
        h[a] = np.uint64(value & (2**64 - 1))
        whole[a] = True
    return mix(h[whole]), np.concatenate(([0], np.cumsum(np.where(counts >= k, counts - k + 1, np.minimum(counts, 1)))))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or of one row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at).cast(pa.large_string())), 0))
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if batch.num_rows > begin:
            yield batch.slice(begin)
