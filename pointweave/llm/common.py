"""Shared plumbing of the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import cut  # noqa: F401  (the corpus operators' own name for it)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 256):
    """Record batches in slices of few rows, so that Python holds few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INV)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _table(f) -> np.ndarray:
    return np.array([f(i) for i in range(256)], bool)


BLANK = _table(lambda i: i == 0x20 or 9 <= i <= 13)
NOT_WORD = _table(lambda i: not (0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80))
#: Bytes of the longest word that the polynomial serves.
LONG = 64
LOWER = np.array([i + 32 if 0x41 <= i <= 0x5A else i for i in range(256)], np.uint8)
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))


def hashed_words(text: bytes, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of an A-Z-lowered UTF-8 text; gap: bytes that end words. Words of up to
    LONG bytes take a polynomial over random byte values, too short for the words that collide under any base
    modulo 2**64 (those take 1,024 bytes); longer ones XXH64. Two of n distinct words collide with odds of n**2 / 2**65."""
    b = LOWER[np.frombuffer(text, np.uint8)]
    word = ~gap[b]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    power, inverse = _powers(len(b))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[b] * power, dtype=np.uint64)))
        h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG):
        h[k] = xxhash.xxh64_intdigest(b[start[k] : end[k]].tobytes(), 7)
    return start, end, h
