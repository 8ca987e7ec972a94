"""Pieces the operators share: text measures, hashes, chunks of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terraced.session import pin

__all__ = ["WORD", "crc_of_id", "hash_words", "mix64", "pin", "unit_hash", "word_count"]

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and return.
WORD = "[^\\x20\\x09-\\x0D]+"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as decimal text; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def unit_hash(seed: int, *columns: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the whole word."""
    x = (x + _GOLDEN).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(256, dtype=np.uint64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(of: int, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), of, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def hash_words(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``data`` in order, the same in every process.

    The hash of a word is its polynomial in a fixed odd base, taken from running
    sums over all bytes, so no word is cut out one by one.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    inside = ~_IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, "up", n), out=total[1:])
    sums = (total[ends] - total[starts]) * _power(_BASE_INVERSE, "down", n)[starts]
    return mix64(sums + (ends - starts).astype(np.uint64))


def in_chunks(frames: Iterator[pd.DataFrame], column: str, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches so that each holds about ``chars`` characters of ``column``, or one long row."""
    for frame in frames:
        sizes = np.array([len(text) if isinstance(text, str) else 0 for text in frame[column]], dtype=np.int64)
        part = (np.cumsum(sizes) // chars).astype(np.int64)
        borders = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *borders], [*borders, len(frame)]):
            if end > start:
                yield frame.iloc[start:end]
