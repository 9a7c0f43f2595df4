"""Packs documents into token sequences of bounded length, with a bounded number of open windows.

Each partition is read once. It keeps ``open_windows`` windows open; a document's ids go whole to the window that
they fill best. If none has room, the fullest is emitted: its gap is closed with the head of the document if
the gap has at least ``least_piece`` ids, else it stays as padding. Documents longer than a sequence first
give off full sequences. What is open at the end of the partitions is merged in groups, level by level, and cut to
fill sequences; the very last window is cut into powers of two, which need no padding.

Defined results: ids are whole numbers of 64 bits, or text that spells one (other ids end the job, by Spark's cast); a null or empty text is the end id alone. Repeated rows and null ids are packed like any other row.
An empty table gives an empty result. No other column is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.tokens import TOGETHER, encoder, with_end
from tabforge.llm.words import batches
from tabforge.session import materialise

PIECE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("leftover", pa.bool_()),
        ("worker", pa.int64()),
        ("ids", pa.binary()),
    ]
)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "leftover boolean, worker long, ids binary"
)
#: Partitions whose leftovers one task merges.
FAN_IN = 32
_LEVEL, _WORKER = 58, 30


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


class _Rows:
    """Collects pieces of finished windows and hands them out in batches."""

    def __init__(self, level: int, worker: int):
        self.level, self.worker, self.sequences, self.rows = level, worker, 0, []

    def window(self, pieces: list, leftover: bool = False) -> None:
        number = (self.level << _LEVEL) | (self.worker << _WORKER) | self.sequences
        self.sequences += 1
        at = 0
        for doc_id, start, doc_tokens, ids in pieces:
            size, check = len(ids), crc32(ids)
            data = ids.tobytes()
            self.rows.append((doc_id, start, size, check, doc_tokens, number, at, leftover, self.worker, data))
            at += size

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [()] * len(PIECE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)


def _place(rows: _Rows, windows: list, free: np.ndarray, piece: tuple, limit: int, least: int) -> None:
    """Puts one piece, shorter than a sequence, into the open windows."""
    doc_id, start, tokens, ids = piece
    while len(ids):
        size = len(ids)
        fits = np.flatnonzero(free >= size)
        if len(fits):
            best = fits[np.argmin(free[fits])]
            windows[best].append((doc_id, start, tokens, ids))
            free[best] -= size
            if not free[best]:
                rows.window(windows[best])
                windows[best], free[best] = [], limit
            return
        fullest = int(np.argmin(free))
        gap = int(free[fullest])
        if gap >= least and size - gap >= least:
            windows[fullest].append((doc_id, start, tokens, ids[:gap]))
            start, ids = start + gap, ids[gap:]
        rows.window(windows[fullest])
        windows[fullest], free[fullest] = [], limit


def _pack(path: str, end: int, limit: int, open_windows: int, least: int) -> Callable:
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, windows, free = None, [[] for _ in range(open_windows)], np.full(open_windows, limit)
        for batch in batches(given, limit=TOGETHER):
            rows = rows or _Rows(0, batch.column("worker")[0].as_py())
            made = encoder(path)
            ids, ends = with_end(*made.encode(batch.column("text")), end)
            for n, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = ids[ends[n] : ends[n + 1]]
                whole = len(own) // limit * limit
                for start in range(0, whole, limit):
                    rows.window([(doc_id, start, len(own), own[start : start + limit])])
                if len(own) > whole:
                    _place(rows, windows, free, (doc_id, whole, len(own), own[whole:].copy()), limit, least)
            yield rows.batch()
        if rows:
            for window in windows:
                if window:
                    rows.window(window, leftover=True)
            yield rows.batch()

    return run


def _powers(pieces: list) -> Iterator[list]:
    """Cuts a window into windows whose lengths are powers of two."""
    size = sum(len(p[3]) for p in pieces)
    yield from _cut(pieces, [1 << n for n in range(size.bit_length() - 1, -1, -1) if size >> n & 1])


def _cut(pieces: list, sizes: list[int]) -> Iterator[list]:
    """Deals pieces to windows of the given sizes, cutting at their borders; a rest is the last window."""
    sizes, window, room = iter(sizes), [], 0
    room = next(sizes, None)
    for doc_id, start, tokens, ids in pieces:
        while len(ids):
            head = ids if room is None else ids[:room]
            window.append((doc_id, start, tokens, head))
            start, ids = start + len(head), ids[len(head) :]
            if room is not None:
                room -= len(head)
                if not room:
                    yield window
                    window, room = [], next(sizes, None)
    if window:
        yield window


def _merge(level: int, limit: int, dtype: str, last: bool) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("worker", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        rows = _Rows(level, table.column("group")[0].as_py())
        names = ("doc_id", "start", "doc_tokens", "ids")
        columns = [table.column(n).to_pylist() for n in names]
        pieces = [(d, s, t, np.frombuffer(i, dtype)) for d, s, t, i in zip(*columns, strict=True)]
        total = sum(len(p[3]) for p in pieces)
        for window in _cut(pieces, [limit] * (total // limit)):
            full = sum(len(p[3]) for p in window) == limit
            if full or not last:
                rows.window(window, leftover=not full)
            else:
                for part in _powers(window):
                    rows.window(part)
        return pa.Table.from_batches([rows.batch()])

    return run


def pack(
    docs: DataFrame,
    path: str,
    end_id: int,
    limit: int = 2048,
    open_windows: int = 64,
    least_piece: int = 32,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's ids as little-endian integers of 16 bits (32 for vocabularies beyond 65,536).
    Every id of every document is in exactly one piece, and the offsets of a sequence have no gap. Rows
    never move between machines; only the open windows at the end of each partition do.
    """
    dtype = "<u2" if encoder(path).dtype == np.uint16 else "<u4"
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
        F.spark_partition_id().cast("long").alias("worker"),
    )
    packed = rows.mapInArrow(_pack(path, end_id, limit, open_windows, least_piece), SCHEMA)
    packed = materialise(packed, "packed")
    done, left = [packed.where("not leftover")], packed.where("leftover")
    level = 0
    while True:
        most = left.agg(F.max("worker")).first()[0]
        if most is None:
            break
        level += 1
        group = F.floor(F.col("worker") / FAN_IN).cast("long")
        merged = left.withColumn("group", group).groupBy("group")
        merged = materialise(merged.applyInArrow(_merge(level, limit, dtype, most < FAN_IN), SCHEMA), "merged")
        done.append(merged.where("not leftover"))
        left = merged.where("leftover")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.drop("leftover", "worker")


def padding(length: Column, limit: int = 2048) -> Column:
    """Ids of padding that a sequence of ``length`` ids needs: none at a power of two."""
    return F.when(F.bit_count(length) == 1, 0).otherwise(limit - length)
