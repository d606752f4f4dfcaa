"""Packed exchange of hashes: numbers travel through a shuffle in binary blocks, a block for each key range.

A row for each number would cost the shuffle tens of bytes and a microsecond; a block costs its
numbers. Blocks carry a key, by which they are dealt out and sorted, so a task holds the blocks of
one key at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of numbers that a key stands for, about. A task holds the blocks of one key at a time.
KEY_BYTES = 64 << 20

#: Bytes of numbers for a byte of input, about: 16 for each word of compressed text, or less.
NUMBERS = 4

BLOCK = "key int, kind int, payload binary"


def key_count(df: DataFrame, partitions: int) -> int:
    """How many keys to deal the hashes of df's texts by: a multiple of the partitions, by the size that the planner gives for df; one a partition where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return partitions * (-(-size * NUMBERS // (partitions * KEY_BYTES)) or 1 if size < 1 << 60 else 1)


def range_of(h: np.ndarray, keys: int) -> np.ndarray:
    """Which of so many equal ranges of 64-bit hashes each is in."""
    return ((h >> np.uint64(32)) * np.uint64(keys) >> np.uint64(32)).astype(np.int32)


def blocks(kind: int, keys: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """Rows of numbers as one block for each key: the count, then the columns one after another."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    begins = [0, *cuts.tolist()] if keys.size else []
    for a, b in zip(begins, [*cuts.tolist(), keys.size], strict=False):
        yield int(keys[a]), kind, b"".join([np.int64(b - a).tobytes(), *(np.ascontiguousarray(c[a:b]).tobytes() for c in columns)])


def opened(payloads: list[bytes], dtypes: list[str]) -> list[np.ndarray]:
    """The columns of several blocks, joined."""
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for payload in payloads:
        n, at = int(np.frombuffer(payload, np.int64, 1)[0]), 8
        for part, dtype in zip(parts, dtypes, strict=True):
            part.append(np.frombuffer(payload, dtype, n, at))
            at += n * np.dtype(dtype).itemsize
    return [np.concatenate(p) if p else np.zeros(0, d) for p, d in zip(parts, dtypes, strict=True)]


def block_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    key, kind, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["key", "kind", "payload"])


def dealt(df: DataFrame, partitions: int) -> DataFrame:
    """Blocks by key, each key's blocks together in one partition; the keys from 0 on go round the partitions, so that all get equally many."""
    return df.repartitionById(partitions, F.pmod("key", F.lit(partitions))).sortWithinPartitions("key", "kind")


def by_key(batches: Iterator[pa.RecordBatch], work: Callable[[int, dict[int, list[bytes]]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls work with each key's blocks by kind."""
    now, held = None, {}
    for batch in batches:
        for key, kind, payload in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if key != now:
                if held:
                    yield from work(now, held)
                now, held = key, {}
            held.setdefault(kind, []).append(payload)
    if held:
        yield from work(now, held)
