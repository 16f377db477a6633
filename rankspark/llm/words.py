"""Word and shingle hashes of many texts at once in numpy, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # texts are hashed in blocks of about this size, whatever an Arrow batch holds
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * _STEP)
_BASE, _MASK = 0xD1342543DE82EF95, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        both = []
        for base in (_BASE, _INVERSE):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            both.append(p)
        if size > 4 * BLOCK_BYTES:
            return both[0], both[1]
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


@dataclass
class Words:
    """The words of a block: bytes, and per word its span in them, its hash, and the number of its text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray


def hash_words(texts: list[bytes], apart: np.ndarray = _IS_SPACE) -> Words:
    """Words are maximal runs of bytes not in apart (ASCII white space unless given, which must hold the line feed);
    equal words have equal 64-bit hashes everywhere."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = apart[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _STEP)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return Words(data, start, end, h, np.searchsorted(np.cumsum(lengths), start, side="right"))


def blocks(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes; a longer text forms a block of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def batches(source: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of few rows."""
    for batch in source:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def by_text(numbers: np.ndarray, n: int) -> np.ndarray:
    """Borders of the runs of 0..n-1 in a sorted array of text numbers."""
    return np.searchsorted(numbers, np.arange(n + 1))
