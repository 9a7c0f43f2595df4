"""Quality classifier: a weak-label model over heuristic labellers teaches a hashed linear scorer.

Each heuristic votes good, bad or not at all on a text. Expectation-maximisation over the counts of all vote patterns
(at most 3 to the power of the heuristics, however many documents) estimates how often each heuristic
votes what on good and on bad texts, and the share of good ones; a pattern's posterior is the weak label of
its texts. The scorer is a logistic regression on hashed shapes of the words and lines of a text, such as
"Aa," or "A!!", fitted to the posteriors of a bounded sample: the ``SAMPLE`` rows with the smallest hash of their text,
without texts beyond ``LONGEST`` bytes. No labels are read.

Defined results: ids keep their type; a null or empty text has no words, on which most heuristics do not vote. Null and repeated ids do not
matter. An empty table gives an empty result. Only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tabforge.llm.frames import kind_of, unused
from tabforge.llm.words import SPACED_WORD, Words, batches, byte_class, raw, roll, split

SAMPLE = 12_000
LONGEST = 20_000
BUCKETS = 1 << 14
REJECT_BELOW = 0.5

_UPPER = byte_class((0x41, 0x5A))
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LINE = ~byte_class((0x0A, 0x0A))
#: ASCII characters that running text is free of, mostly.
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~"))
_STOP = np.isin(np.arange(256), list(b".!?:;\"')"))
_MARK = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_AGAIN = np.uint64(0xA9A1)
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A] = ord("0")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of set flags in every text."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[ends[1:]] - sums[ends[:-1]]


def _repeated(made: Words, least: int) -> np.ndarray:
    """Share of the pieces of every text that occurred in it before, among texts with ``least`` pieces; else -1."""
    digests, owner = made.digests(), made.owner()
    order = np.lexsort((digests, owner))
    again = np.zeros(len(order), bool)
    again[1:] = (digests[order][1:] == digests[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    counts = made.counts
    share = np.bincount(owner[order], again, len(counts)) / np.maximum(counts, 1)
    return np.where(counts >= least, share, -1)


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def votes(texts: pa.Array) -> np.ndarray:
    """One row per text, one column per heuristic: 1 good, -1 bad, 0 no vote."""
    data, ends = raw(texts)
    size = np.maximum(np.diff(ends), 1)
    words, lines = split(texts, SPACED_WORD), split(texts, _LINE)
    n_words, n_lines = words.counts, lines.counts
    some = n_words > 0
    letters = _per_text(_LETTER[data], ends)
    symbols = _per_text(_SYMBOL[data], ends) / size
    capitals = _per_text(_UPPER[data], ends) / np.maximum(letters, 1)
    shouts = _per_text(data == ord("!"), ends) / np.maximum(n_words, 1)
    bars = _per_text(data == ord("|"), ends) / np.maximum(n_words, 1)
    word_size = (ends[1:] - ends[:-1]) / np.maximum(n_words, 1)
    line_again, word_again = _repeated(lines, 4), _repeated(words, 100)
    stopped = np.bincount(lines.owner(), _STOP[data[lines.end - 1]] if len(data) else None, len(n_lines))
    stopped = stopped / np.maximum(n_lines, 1)
    doubled = np.zeros(len(data), bool)
    doubled[1:] = (data[1:] == data[:-1]) & _MARK[data[1:]]
    doubled[2:] &= ~doubled[1:-1]
    marks = _per_text(doubled, ends) / np.maximum(n_words, 1)
    digests, owner = words.digests(), words.owner()
    same = np.zeros(len(digests), bool)
    same[1:] = (digests[1:] == digests[:-1]) & (owner[1:] == owner[:-1])
    stutter = np.bincount(owner, same, len(n_words)) / np.maximum(n_words, 1)
    columns = [
        _vote(marks, some & (marks < 0.02), some & (marks > 0.15)),
        _vote(stutter, some & (stutter < 0.02), some & (stutter > 0.08)),
        _vote(symbols, some & (symbols < 0.01), some & (symbols > 0.05)),
        _vote(capitals, some & (capitals < 0.1), some & (capitals > 0.3)),
        _vote(shouts, some & (shouts < 0.02), some & (shouts > 0.15)),
        _vote(bars, some & (bars < 0.01), some & (bars > 0.1)),
        _vote(word_size, some & (word_size > 4) & (word_size < 9), some & ((word_size < 3) | (word_size > 16))),
        _vote(line_again, (line_again >= 0) & (line_again < 0.1), line_again > 0.4),
        _vote(word_again, (word_again >= 0) & (word_again < 0.75), word_again > 0.92),
        _vote(stopped, some & (stopped > 0.6), some & (stopped < 0.2) & (n_words > 20)),
    ]
    return np.column_stack(columns)


def _pattern(found: np.ndarray) -> np.ndarray:
    """The votes of a text as one number."""
    return (found.astype(np.int64) + 1) @ (3 ** np.arange(found.shape[1]))


def _patterns(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches(rows):
        found = votes(batch.column("text"))
        own = np.bincount(_pattern(found), minlength=3 ** found.shape[1])
        total = own if total is None else total + own
    if total is not None:
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pattern", "n"])


@dataclass
class Labels:
    """Weak-label model: share of good texts, and how often each heuristic that votes says good, on bad and good texts.

    Whether a heuristic votes at all says nothing; that mostly depends on the length of the text.
    """

    good: float
    given: np.ndarray

    def posterior(self, found: np.ndarray) -> np.ndarray:
        logs = (found > 0) @ np.log(self.given).T + (found < 0) @ np.log(1 - self.given).T
        odds = logs[:, 1] - logs[:, 0] + np.log(self.good) - np.log(1 - self.good)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def estimate(found: np.ndarray, counts: np.ndarray, rounds: int = 500) -> Labels:
    """Expectation-maximisation from vote patterns and their counts.

    It starts from the belief that a heuristic knows one kind of bad text and votes good on the others, so that
    a text with any bad vote is probably bad.
    """
    posterior = np.where((found < 0).any(axis=1), 0.1, 0.9)
    model = Labels(0.5, np.full((2, found.shape[1]), 0.5))
    for _ in range(rounds):
        weights = np.stack([counts * (1 - posterior), counts * posterior])
        up, down = weights @ (found > 0), weights @ (found < 0)
        good = float(np.clip(weights[1].sum() / max(counts.sum(), 1), 0.01, 0.99))
        model = Labels(good, (up + 0.5) / (up + down + 1))
        new = model.posterior(found)
        if np.abs(new - posterior).max(initial=0) < 1e-6:
            break
        posterior = new
    return model


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of every text: buckets, shares, and where each text's begin.

    A word's shape is its letters, digits and marks with runs shortened to one. Shapes, pairs of neighbouring shapes,
    and words that repeat the word before them count.
    """
    data, ends = raw(texts)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[ends[:-1][ends[:-1] < len(data)]] = True
    offsets = np.concatenate(([0], np.cumsum(keep)))[ends]
    short = pa.Array.from_buffers(
        pa.large_string(), len(ends) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(shape[keep])]
    )
    made = split(short, SPACED_WORD)
    digests, owner = made.digests(), made.owner()
    pairs, inside = roll(digests, 2), owner[1:] == owner[:-1]
    if not len(pairs):
        inside = inside[:0]
    words = split(texts, SPACED_WORD).digests()
    again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    both = np.concatenate([digests, pairs[inside], np.full(again.sum(), _AGAIN)])
    owner = np.concatenate([owner, owner[:-1][inside] if len(pairs) else owner[:0], owner[1:][again]])
    key, count = np.unique(owner * BUCKETS + (both % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    text = key // BUCKETS
    first = np.searchsorted(text, np.arange(len(ends)))
    total = np.bincount(owner, minlength=len(ends) - 1)
    return key % BUCKETS, np.sqrt(count / total[text]), first


def _packed(values: np.ndarray, kind: str, first: np.ndarray) -> pa.Array:
    """Numbers of every text as bytes, which sort as the lists of numbers from 0 do."""
    data = pa.py_buffer(values.astype(kind).tobytes())
    ends = pa.py_buffer((first * np.dtype(kind).itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, ends, data])


def _sampled(labels: Labels):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            bucket, share, first = features(batch.column("text"))
            posterior = pa.array(labels.posterior(votes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [posterior, _packed(bucket, ">i4", first), _packed(share, ">f8", first)], ["posterior", "bucket", "share"]
            )

    return run


@dataclass
class Scorer:
    labels: Labels
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        bucket, share, first = features(texts)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        z = np.bincount(text, self.weights[bucket] * share, len(first) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(labels: Labels, rows: list, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by adaptive gradient steps over the whole sample."""
    y = np.array([r["posterior"] for r in rows])
    text = np.repeat(np.arange(len(rows)), [len(r["bucket"]) // 4 for r in rows])
    bucket = np.frombuffer(b"".join(r["bucket"] for r in rows), ">i4").astype(np.int64)
    share = np.frombuffer(b"".join(r["share"] for r in rows), ">f8").astype(np.float64)
    weights, bias, seen, seen_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds if rows else 0):
        z = np.bincount(text, weights[bucket] * share, len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gradient = np.bincount(bucket, error[text] * share, BUCKETS) / len(rows) + ridge * weights
        seen += gradient**2
        seen_bias += error.mean() ** 2
        weights -= rate * gradient / np.sqrt(seen)
        bias -= rate * error.mean() / np.sqrt(seen_bias)
    return Scorer(labels, weights, bias)


def fit(docs: DataFrame, text_column: str = "text") -> Scorer:
    """Vote patterns of all documents, then the scorer on the sample."""
    texts = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    width = votes(pa.array([""])).shape[1]
    numbers = np.array(sorted(r["pattern"] for r in counted), np.int64)
    found = (numbers[:, None] // 3 ** np.arange(width) % 3 - 1).astype(np.int8)
    by_number = {r["pattern"]: r["n"] for r in counted}
    labels = estimate(found, np.array([by_number[n] for n in numbers.tolist()], np.float64))
    order = F.xxhash64("text")
    chosen = texts.select(order.alias("h"), "text").where(F.octet_length("text") <= LONGEST)
    limit = chosen.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    some = chosen.where(F.col("h") <= limit).dropDuplicates(["h"]) if limit is not None else chosen.limit(0)
    rows = some.select("text").mapInArrow(_sampled(labels), "posterior double, bucket binary, share binary")
    # Bytes, as the driver would need some 60 bytes a number for lists.
    rows = sorted(rows.collect(), key=lambda r: (r["posterior"], r["bucket"], r["share"]))
    return _train(labels, rows)


def _scored(scorer: Scorer):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts = batch.column("text")
            columns = [batch.column("doc_id"), pa.array(scorer.score(texts)), pa.array(scorer.labels.posterior(votes(texts)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "posterior"])

    return run


def score(docs: DataFrame, scorer: Scorer, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, score (1: good), posterior of the weak-label model, rejected."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    scored = rows.mapInArrow(_scored(scorer), f"doc_id {kind_of(rows)}, score double, posterior double")
    return scored.withColumn("rejected", F.col("score") < REJECT_BELOW)


def keep_good(docs: DataFrame, scorer: Scorer, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer does not reject; rows stay where they are read."""
    mark = unused(docs, "quality_score")
    schema = StructType([*docs.schema.fields, StructField(mark, DoubleType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, text_column):
            made = pa.array(scorer.score(batch.column(text_column)))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, mark])

    return docs.mapInArrow(run, schema).where(F.col(mark) >= REJECT_BELOW).drop(mark)
