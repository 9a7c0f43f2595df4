"""Passages of benchmark items in documents, by a prefix-filtered set join.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. A window is ``window``
consecutive words of an item, or a whole shorter item. The shingles (five words) of the windows are ordered by their
frequency in all documents. A document that contains a window contains each of its shingles, so one prefix
token is necessary: the window's rarest shingle. Documents are joined on these tokens; the token's place in the
window gives the only possible start (positional bound) and the words left in the document must
suffice (length bound); what is left is compared word by word.

The benchmark is dealt by hash into blocks of at most about ``BLOCK`` windows. A block is the broadcast side of
the join, so its size has a bound; a larger benchmark means more blocks, each against all documents.

Defined results: ids keep their type; null and empty texts have no words. Rows that repeat an id are judged by their own text. Items
that repeat an id count once; an item without id marks words but is not listed. Empty tables on either
side are fine. No other column is read, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.frames import restrict, row_key, text_hash
from tabforge.llm.words import PLAIN_WORD, Words, batches, roll, split
from tabforge.session import materialise

SHINGLE = 5
BLOCK = 200_000
_FILTER_BITS = 22
FOUND = "doc_id {kind}, text_hash long, n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


def _windows(size: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            made = split(batch.column("text"), PLAIN_WORD, lower=True)
            items, texts, lengths = [], [], []
            for i, item in enumerate(batch.column("item").to_pylist()):
                first, last = made.first[i], made.first[i + 1]
                own = [made.word(j) for j in range(first, last)]
                for at in range(max(1, len(own) - size + 1) if own else 0):
                    part = own[at : at + size]
                    items.append(item)
                    texts.append(b" ".join(part).decode())
                    lengths.append(len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(texts, pa.string()), pa.array(lengths, pa.int32())],
                ["item", "words", "size"],
            )

    return run


@dataclass
class Block:
    """Windows of a block, each with its prefix token; rows are sorted by token."""

    texts: list[bytes]
    items: list[str | None]
    digest: np.ndarray
    size: np.ndarray
    width: np.ndarray
    place: np.ndarray
    token: np.ndarray

    def lookup(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filter bits, sorted tokens and their rows among the tokens of ``width`` words."""
        rows = np.flatnonzero(self.width == width)
        rows = rows[np.argsort(self.token[rows], kind="stable")]
        return _filter(self.token[rows]), self.token[rows], rows


def _filter(digests: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[_short(digests)] = True
    return bits


def _short(digests: np.ndarray) -> np.ndarray:
    return (digests >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _shingles(texts: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Digest of each window, width of its shingles, digests of its shingles."""
    made = split(pa.array([t.decode() for t in texts], pa.string()), PLAIN_WORD)
    digests = made.digests()
    width = np.minimum(size, SHINGLE)
    whole, tokens = np.zeros(len(texts), np.uint64), []
    for i in range(len(texts)):
        own = digests[made.first[i] : made.first[i + 1]]
        whole[i] = roll(own, len(own))[0]
        tokens.append(roll(own, int(width[i])))
    return whole, width, tokens


def _counter(sorted_tokens: dict[int, np.ndarray]):
    """Counts the given shingles in all documents of a partition."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {w: _filter(t) for w, t in sorted_tokens.items()}
        counts = {w: np.zeros(len(t), np.int64) for w, t in sorted_tokens.items()}
        for batch in batches(rows):
            made = split(batch.column("text"), PLAIN_WORD, lower=True)
            digests = made.digests()
            for width, tokens in sorted_tokens.items():
                rolled = roll(digests, width)
                rolled = rolled[filters[width][_short(rolled)]]
                at = np.minimum(np.searchsorted(tokens, rolled), len(tokens) - 1)
                np.add.at(counts[width], at[tokens[at] == rolled], 1)
        for width, total in counts.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), width, np.int32)), pa.array(seen), pa.array(total[seen])],
                ["width", "number", "n"],
            )

    return run


def _block(docs: DataFrame, windows: list) -> Block:
    """Chooses the rarest shingle of every window, by counts over all documents."""
    texts = [r["words"].encode() for r in windows]
    size = np.array([r["size"] for r in windows], np.int64)
    digest, width, tokens = _shingles(texts, size)
    known = {int(w): np.unique(np.concatenate([t for t, x in zip(tokens, width, strict=True) if x == w])) for w in set(width)}
    counted = docs.select("text").mapInArrow(_counter(known), "width int, number long, n long")
    frequency = {w: np.zeros(len(t), np.int64) for w, t in known.items()}
    for r in counted.groupBy("width", "number").agg(F.sum("n").alias("n")).collect():
        frequency[r["width"]][r["number"]] = r["n"]
    place = np.zeros(len(texts), np.int64)
    for i, (own, w) in enumerate(zip(tokens, width, strict=True)):
        place[i] = np.argmin(frequency[int(w)][np.searchsorted(known[int(w)], own)])
    token = np.array([own[p] for own, p in zip(tokens, place, strict=True)], np.uint64)
    return Block(texts, [r["item"] for r in windows], digest, size, width, place, token)


def _matches(block: Block, lookups: dict, made: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starting word and window of every occurrence in the texts of ``made``."""
    digests, owner = made.digests(), made.owner()
    starts, windows = [], []
    for width, (bits, tokens, rows) in lookups.items():
        rolled = roll(digests, width)
        at = np.flatnonzero(bits[_short(rolled)])
        low = np.searchsorted(tokens, rolled[at], "left")
        many = np.searchsorted(tokens, rolled[at], "right") - low
        total = int(many.sum())
        pick = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        window = rows[pick]
        at = np.repeat(at, many)
        start, document = at - block.place[window], owner[at]
        fits = (start >= made.first[document]) & (start + block.size[window] <= made.first[document + 1])
        start, window = start[fits], window[fits]
        for size in np.unique(block.size[window]):
            same = block.size[window] == size
            own = roll(digests, int(size))[start[same]] == block.digest[window[same]]
            starts.append(start[same][own])
            windows.append(window[same][own])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, window = np.concatenate(starts), np.concatenate(windows)
    exact = np.zeros(len(start), bool)
    for i, (s, w) in enumerate(zip(start, window, strict=True)):
        exact[i] = b" ".join([made.word(j) for j in range(s, s + block.size[w])]) == block.texts[w]
    return start[exact], window[exact]


def _finder(block: Block):
    lookups = {int(w): block.lookup(w) for w in set(block.width)}
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            made = split(batch.column("text"), PLAIN_WORD, lower=True)
            start, window = _matches(block, lookups, made)
            spans: list = [[] for _ in range(batch.num_rows)]
            items: list = [set() for _ in range(batch.num_rows)]
            document = np.searchsorted(made.first, start, "right") - 1
            for i in np.lexsort((start,)):
                d, s, w = document[i], start[i] - made.first[document[i]], window[i]
                end = s + block.size[w]
                if spans[d] and s <= spans[d][-1]["end"]:
                    spans[d][-1]["end"] = max(end, spans[d][-1]["end"])
                else:
                    spans[d].append({"begin": s, "end": end})
                if block.items[w] is not None:
                    items[d].add(block.items[w])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(made.counts),
                    pa.array(spans, pa.list_(span)),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ],
                ["doc_id", "text_hash", "n_words", "spans", "items"],
            )

    return run


def _union_of(spans):
    """Merges overlapping spans of an array, as a column expression."""
    ordered = F.array_sort(spans)
    return F.aggregate(
        ordered,
        F.slice(ordered, 1, 0),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["begin"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - F.lit(1)),
                F.array(F.struct(
                    F.element_at(acc, -1)["begin"].alias("begin"),
                    F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"),
                )),
            )).otherwise(F.concat(acc, F.array(x))),
    )


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    window: int = 10,
    block: int = BLOCK,
) -> DataFrame:
    """Per row of ``docs``: its id, text_hash, n_words, spans of hit words (begin, end exclusive), items found."""
    kind = docs.schema[id_column].dataType
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), text_hash(text_column).alias("text_hash"))
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col("text"))
    windows = items.mapInArrow(_windows(window), "item string, words string, size int").distinct()
    windows = materialise(windows, "benchmark-windows")
    blocks = max(1, -(-windows.count() // block))
    number = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    session, schema = docs.sparkSession, FOUND.format(kind=kind.simpleString())
    found = []
    for n in range(blocks):
        own = _block(rows, windows.where(number == n).collect())
        shared = session.sparkContext.broadcast(own)
        found.append(rows.mapInArrow(lambda it, b=shared: _finder(b.value)(it), schema))
    if blocks == 1:
        return found[0]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    merged = result.groupBy("doc_id", "text_hash", "n_words").agg(
        (F.count(F.lit(1)) / blocks).cast("int").alias("rows"),
        _union_of(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.withColumn("rows", F.explode(F.sequence(F.lit(1), "rows"))).drop("rows")


def hits(spans) -> F.Column:
    """Number of words in spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])


def clean(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that contain no window of the benchmark."""
    found = find(docs, benchmark, id_column, text_column, **options).where(F.size("spans") > 0)
    keys = found.select(row_key("doc_id", F.col("text_hash")).alias("key"))
    return restrict(docs, row_key(id_column, text_hash(text_column)), keys, "left_anti")
