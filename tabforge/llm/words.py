"""Words, shingles and their digests for whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
LONG_WORD = 4096
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.Generator(np.random.PCG64(20240601)).integers(
    0, 2**64, 256, dtype=np.uint64, endpoint=False
)
_POWERS: list[np.ndarray] = []
#: The C library's call that returns free pages, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags that are set in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Fixed classes: letters, digits and everything beyond ASCII; everything but ASCII white space.
PLAIN_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SPACED_WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that the texts of a slice have about ``limit`` bytes."""
    _, ends = raw(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """Words of several texts: ``begin``/``end`` in ``data``; text i has words first[i]:first[i + 1]."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Number of the text of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()

    def digests(self) -> np.ndarray:
        """64-bit digest of every word, in blocks so that memory does not follow the text."""
        out = np.empty(len(self.begin), np.uint64)
        sizes = self.end - self.begin
        long = np.flatnonzero(sizes > LONG_WORD)
        edges = np.concatenate(([0], long, long + 1, [len(out)]))
        edges.sort()
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high - low == 1 and sizes[low] > LONG_WORD:
                out[low] = _long_digest(self.word(low))
                continue
            while low < high:
                stop = int(np.searchsorted(self.end[low:high], self.begin[low] + SLICE_BYTES, "right")) + low
                stop = max(stop, low + 1)
                self._block(out, low, stop)
                low = stop
        return out

    def _block(self, out: np.ndarray, low: int, high: int) -> None:
        if not _POWERS:
            size = SLICE_BYTES + LONG_WORD + 1
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                _POWERS.append(np.multiply.accumulate(row))
        start = self.begin[low]
        part = _BYTES[self.data[start : self.end[high - 1]]]
        part *= _POWERS[0][: len(part)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
        b, e = self.begin[low:high] - start, self.end[low:high] - start
        out[low:high] = mix((sums[e] - sums[b]) * _POWERS[1][b] + (e - b).astype(np.uint64))


def _long_digest(word: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def split(texts: pa.Array, table: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of the table's bytes in every text; ``lower`` lower-cases A-Z first."""
    data, ends = raw(texts)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = table[data]
    change = inside[1:] != inside[:-1]
    border = np.zeros(len(data) + 1, bool)
    border[ends] = True
    border = border[:-1]
    begin = np.flatnonzero(inside[1:] & (change | border))
    stops = np.zeros(len(data) + 1, bool)
    stops[:-1] = inside[:-1] & (change | border)
    stops[-1] = inside[-1]
    return Words(data, begin, np.flatnonzero(stops), np.searchsorted(begin, ends))


def roll(digests: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Digest of every run of ``size`` digests, by doubling; the caller drops runs across texts."""
    if len(digests) < size:
        return np.zeros(0, np.uint64)
    base = pow(0xD1342543DE82EF95 + 2 * seed, 1, 2**64) | 1
    step, width, acc, done = digests, 1, None, 0
    while width <= size:
        if size & width:
            if acc is None:
                acc, done = step, width
            else:
                n = len(digests) - done - width + 1
                acc = acc[:n] * _U(pow(base, width, 2**64)) + step[done : done + n]
                done += width
        n = len(step) - width
        if n > 0 and width * 2 <= size:
            step = step[:n] * _U(pow(base, width, 2**64)) + step[width : width + n]
        width *= 2
    return mix(acc[: len(digests) - size + 1] + _U(size))


def starts(first: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a run of ``size`` words of one text begins."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    skip = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(counts.sum()) + skip


def covered(positions: np.ndarray, size: int, total: int) -> np.ndarray:
    """Flags the words inside runs of ``size`` words that begin at ``positions``."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, positions, 1)
    np.add.at(change, np.minimum(positions + size, total), -1)
    return np.cumsum(change[:-1]) > 0


def batches(
    rows: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 * SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The slices of all batches of a partition; after each batch, memory that is free goes back to the system."""
    for batch in rows:
        yield from slices(batch, column, limit)
        del batch
        release()


def release() -> None:
    """Gives free memory back to the system. Arrow's pool and the C library keep it otherwise, and a worker, which lives
    through the tasks of all stages, would hold what its largest batches once needed."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
