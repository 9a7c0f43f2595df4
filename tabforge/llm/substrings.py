"""Removes repeated passages, by prefix-partitioned groups of suffixes.

Words are runs of anything but ASCII white space. A suffix starts at each word with at least ``size`` words from
there to the end of its document. Suffixes are split into groups by their first word; where too many
share it, by their first 2, 4, 8 and at last ``size`` words, so a group fits the memory of a task. No tree is built
(its edges do not fit the disk, see README): a group is put in the order of digests of ``size`` words, and a run of
equal digests stands for the node that a subtree would have at that depth. Runs with several
suffixes are the repeats; neighbouring ones make up the maximal repeats. A suffix
travels as its digest (56 bits, next to the bits that chose its group), its document and its start, in
compressed blocks; words never do, since each would be sent ``size`` times. Among n suffixes in groups of g about
n * g / 2**57 pairs agree by chance: 0.001 at 10**8 suffixes.

A passage that a third of all documents share is one node. Each task sends only its first suffix of a node; its
other ones are repeats whatever other tasks have, and go straight to the result.

Defined results: ids are whole numbers of 64 bits, or text that spells one (other ids end the job, by Spark's cast); null and empty texts have no words. Null ids come before all others. Rows that repeat an id count
as one document, equal words at the same start are not earlier than each other, and a 32-bit hash tells their texts apart. An empty table gives an empty
result. No other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.words import SPACED_WORD, Words, batches, mix, roll, split, starts

#: Suffixes in a group and in a block, about.
GROUP = 1_500_000
CHUNK = 1_500_000
LEVELS = (1, 2, 4, 8)
NULL_ID = np.iinfo(np.int64).min
SPANS = "doc_id long, text_hash int, begin array<long>, end array<long>"
#: Bytes of a path digest that travel; the group stands for further bits.
DIGEST_BYTES = 7


def _bins(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _counter(size: int, bits: int):
    """Suffixes of a partition by level and bin of their prefix."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LEVELS), 1 << bits), np.int64)
        for batch in batches(rows):
            made = split(batch.column("text"), SPACED_WORD)
            digests, begin = made.digests(), starts(made.first, size)
            for n, level in enumerate(LEVELS):
                if level < size and len(begin):
                    counts[n] += np.bincount(_bins(roll(digests, level, 1)[begin], bits), minlength=1 << bits)
        level, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(level.astype(np.int32)), pa.array(place), pa.array(counts[level, place])], ["level", "bin", "n"]
        )

    return run


def _route(digests: np.ndarray, begin: np.ndarray, size: int, bits: int, heavy: list[np.ndarray]) -> np.ndarray:
    """Hash of the shortest prefix that few enough suffixes share."""
    route = roll(digests, size, 1)[begin]
    for n in reversed(range(len(LEVELS))):
        if LEVELS[n] < size:
            shorter = roll(digests, LEVELS[n], 1)[begin]
            route = np.where(heavy[n][_bins(shorter, bits)], route, shorter)
    return route


def _planes(values: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones, and so on: small numbers compress to little."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: bytes, kind: str, count: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8, count * width, at).reshape(width, count)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, digest: np.ndarray | None = None) -> bytes:
    """Suffixes in the order of their documents, as runs of one document, steps within it, and digests."""
    import zstandard

    begins = np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))
    runs = np.flatnonzero(begins)
    step = np.diff(at, prepend=np.uint32(0))
    step[runs] = at[runs]
    rest = [
        _planes(step),
        _planes(np.diff(np.append(runs, len(ids))).astype(np.uint32)),
        _planes(np.diff(ids[runs], prepend=np.int64(0))),
        _planes(hashes[runs]),
    ]
    own = b"" if digest is None else _planes(digest)[len(digest) * (8 - DIGEST_BYTES) :]
    head = np.array([len(ids), len(runs), len(own)], np.int64).tobytes()
    return head + own + zstandard.ZstdCompressor(level=1).compress(b"".join(rest))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """ids, hashes, starts, digests of a block."""
    import zstandard

    count, runs, size = (int(n) for n in np.frombuffer(blob, np.int64, 3))
    digest = None
    if size:
        digest = _from_planes(bytes((8 - DIGEST_BYTES) * count) + blob[24 : 24 + size], "<u8", count, 0)
    rest = zstandard.ZstdDecompressor().decompress(blob[24 + size :])
    step = _from_planes(rest, "<u4", count, 0)
    many = _from_planes(rest, "<u4", runs, 4 * count)
    ids = np.cumsum(_from_planes(rest, "<i8", runs, 4 * (count + runs)))
    hashes = _from_planes(rest, "<i4", runs, 4 * (count + 3 * runs))
    total = np.cumsum(step, dtype=np.int64)
    first = np.cumsum(many, dtype=np.int64) - many
    at = total - np.repeat(total[first] - step[first], many)
    return np.repeat(ids, many), np.repeat(hashes, many), at.astype(np.uint32), digest


def _dealt(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every group with the rows that belong to it, in their order."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(group[low]), order[low:high]


class _Chunk:
    """Suffixes of some documents, which ``blocks`` deals to the groups."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch, made: Words, size: int, bits: int, heavy: list[np.ndarray]) -> None:
        begin = starts(made.first, size)
        if not len(begin):
            return
        digests = made.digests()
        owner = made.owner()[begin]
        ids = np.asarray(batch.column("doc_id").fill_null(int(NULL_ID)))
        hashes = np.asarray(batch.column("text_hash"))
        self.parts.append(
            (
                roll(digests, size)[begin],
                _route(digests, begin, size, bits, heavy),
                ids[owner],
                hashes[owner],
                (begin - made.first[owner]).astype(np.uint32),
            )
        )
        self.size += len(begin)

    def blocks(self, groups: int) -> Iterator[tuple[int, bytes]]:
        digest, route, ids, hashes, at = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        if (ids[1:] < ids[:-1]).any():
            order = np.lexsort((at, ids))
            digest, route, ids, hashes, at = (c[order] for c in (digest, route, ids, hashes, at))
        order = np.argsort(digest, kind="stable")
        again = _later(digest[order], ids[order], at[order])
        repeated = np.zeros(len(order), bool)
        repeated[order[again]] = True
        known = np.flatnonzero(repeated)
        if len(known):
            yield int(route[0] % np.uint64(groups)), _pack(ids[known], hashes[known], at[known])
        rest = np.flatnonzero(~repeated)
        for group, some in _dealt((route[rest] % np.uint64(groups)).astype(np.int32)):
            some = rest[some]
            yield group, _pack(ids[some], hashes[some], at[some], digest[some])


def _later(digest: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Flags, in rows sorted by (digest, id, start), those after the first document and start of their run."""
    if not len(digest):
        return np.zeros(0, bool)
    begins = np.concatenate(([True], digest[1:] != digest[:-1]))
    lead = np.maximum.accumulate(np.where(begins, np.arange(len(digest)), 0))
    return (ids != ids[lead]) | (at != at[lead])


def _deal(size: int, bits: int, heavy: list[np.ndarray], groups: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()

        def out():
            group, blobs = zip(*chunk.blocks(groups), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(blobs, pa.binary())], ["group", "block"])

        for batch in batches(rows):
            chunk.add(batch, split(batch.column("text"), SPACED_WORD), size, bits, heavy)
            if chunk.size >= CHUNK:
                yield out()
        if chunk.size:
            yield out()

    return run


def _repeats(groups: int):
    """The suffixes of a group whose node at full depth has an earlier leaf, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        parts, known = [], []
        for blob in table.column("block").to_pylist():
            made = _unpack(blob)
            (known if made[3] is None else parts).append(made)
        known = [k[:3] for k in known]
        if parts:
            ids, hashes, at, digest = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(digest, kind="stable")
            run = digest[order]
            same = np.zeros(len(run) + 1, bool)
            same[1:-1] = run[1:] == run[:-1]
            order = order[same[1:] | same[:-1]]
            order = order[np.lexsort((at[order], ids[order], digest[order]))]
            order = order[_later(digest[order], ids[order], at[order])]
            known.append((ids[order], hashes[order], at[order]))
        ids, hashes, at = (np.concatenate(c) for c in zip(*known, strict=True))
        order = np.lexsort((at, hashes, ids))
        ids, hashes, at = ids[order], hashes[order], at[order]
        bucket = (mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
        made = [(b, _pack(ids[some], hashes[some], at[some])) for b, some in _dealt(bucket)]
        return pa.table(
            {"bucket": pa.array([b for b, _ in made], pa.int32()), "block": pa.array([b for _, b in made], pa.binary())}
        )

    return run


def _merged(size: int):
    """Spans of repeated words, from all suffixes of the documents of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b)[:3] for b in table.column("block").to_pylist()]
        ids, hashes, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((at, hashes, ids))
        ids, hashes, at = ids[order], hashes[order], at[order].astype(np.int64)
        own = np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))
        begins = own.copy()
        begins[1:] |= at[1:] > at[:-1] + size
        spans = np.flatnonzero(begins)
        last = np.append(spans[1:], len(ids)) - 1
        documents = np.flatnonzero(own[spans])
        offsets = pa.array(np.append(documents, len(spans)).astype(np.int32))
        ids, hashes = ids[spans[documents]], hashes[spans[documents]]
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=ids == NULL_ID),
                "text_hash": pa.array(hashes),
                "begin": pa.ListArray.from_arrays(offsets, pa.array(at[spans])),
                "end": pa.ListArray.from_arrays(offsets, pa.array(at[last] + size)),
            }
        )

    return run


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves the spans out of the texts."""
    for batch in batches(rows):
        made = split(batch.column("text"), SPACED_WORD)
        counts = np.asarray(batch.column("begin").value_lengths().fill_null(0))
        shift = np.repeat(made.first[:-1], counts)
        change = np.zeros(len(made.begin) + 1, np.int64)
        np.add.at(change, np.asarray(batch.column("begin").flatten()) + shift, 1)
        np.add.at(change, np.asarray(batch.column("end").flatten()) + shift, -1)
        kept = np.cumsum(change[:-1]) == 0
        kept_so_far = np.concatenate(([0], np.cumsum(kept)))
        n_kept = kept_so_far[made.first[1:]] - kept_so_far[made.first[:-1]]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(made.counts),
                pa.array(made.counts - n_kept),
                _joined(made, kept, n_kept),
            ],
            ["doc_id", "text_hash", "n_words", "n_removed", "kept"],
        )


def _joined(made: Words, kept: np.ndarray, n_kept: np.ndarray) -> pa.Array:
    """The kept words of every text with one space between them."""
    begin, end = made.begin[kept], made.end[kept].copy()
    lasts = np.cumsum(n_kept)[n_kept > 0] - 1
    end += 1
    end[lasts] -= 1
    change = np.zeros(len(made.data) + 2, np.int8)
    change[begin] += 1
    np.subtract.at(change, end, 1)
    inside = np.cumsum(change[: len(made.data)], dtype=np.int8) > 0
    data = np.where(SPACED_WORD[made.data], made.data, np.uint8(0x20))[inside]
    sizes = np.concatenate(([0], np.cumsum(end - begin)))
    offsets = sizes[np.concatenate(([0], np.cumsum(n_kept)))].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(n_kept), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def remove_repeats(
    docs: DataFrame, size: int = 20, group: int = GROUP, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: doc_id, text_hash, n_words, n_removed, kept (the words left, one space between them).

    A word goes if a run of ``size`` words around it also starts earlier. One scan counts prefixes, one sends the
    suffixes to their groups, and one joins the repeats, a list per document, with the texts.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
        F.hash(F.coalesce(F.col(text_column), F.lit(""))).alias("text_hash"),
    )
    session = docs.sparkSession
    letters = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-letters // (5 * group)))
    bits = max(10, (8 * groups).bit_length())
    counted = rows.select("text").mapInArrow(_counter(size, bits), "level int, bin long, n long")
    crowded = counted.groupBy("level", "bin").agg(F.sum("n").alias("n"))
    limit = max(1, letters // (10 * groups))
    heavy = [np.zeros(1 << bits, bool) for _ in LEVELS]
    for r in crowded.where(F.col("n") > limit).collect():
        heavy[r["level"]][r["bin"]] = True
    dealt = rows.mapInArrow(_deal(size, bits, heavy, groups), "group int, block binary")
    repeats = dealt.groupBy("group").applyInArrow(_repeats(groups), "bucket int, block binary")
    spans = repeats.groupBy("bucket").applyInArrow(_merged(size), SPANS)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "begin", "end")
    on = rows["doc_id"].eqNullSafe(spans["_id"]) & (rows["text_hash"] == spans["_hash"])
    joined = rows.join(spans, on, "left").select("doc_id", "text", "text_hash", "begin", "end")
    return joined.mapInArrow(_cut, "doc_id long, text_hash int, n_words long, n_removed long, kept string")
