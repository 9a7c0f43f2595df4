"""Toxicity by compression distance: how much shorter text gets with a dictionary of toxic text.

Two zstandard dictionaries are trained on separate texts: one on those words of toxic documents that are clearly more
frequent there than in ordinary ones, one on all other words of ordinary documents. A word is counted once for each
different word that it stands behind, as copies of a document repeat a word behind the same one; no single label
or quotation decides about a word, and words that ordinary documents use as well can be toxic ones. Each document is cut into windows of ``WINDOW`` words. A window is compressed with the
ordinary dictionary alone and with the toxic one after it; the bytes saved measure how much of it only toxic text
explains. A logistic regression on labelled documents, each seen through dictionaries of the sample's other half,
calibrates the savings of a document's windows to a score.

The fit sees a bounded sample: of each class the ``SAMPLE`` labelled rows with the smallest hash of their id, without
texts beyond ``LONGEST`` bytes. Labels are read only where crc32 of the id as text is no multiple of ``FOLDS``.

Defined results: ids keep their type; null, empty and wordless texts score like a text without savings. Rows with a null id are scored and not
held out; rows that repeat an id are scored by their own text. Labels that are null are left out, those that
repeat an id count as toxic if one does. Without labels of both classes every score is the share of the class
there is, or 0. An empty table gives an empty result. No other column is read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.frames import kind_of
from tabforge.llm.words import PLAIN_WORD, Words, batches, split

WINDOW = 10
SAMPLE = {1: 3000, 0: 6000}
LONGEST = 20_000
FOLDS = 5
LEVEL = 3
TOXIC_BYTES, ORDINARY_BYTES = 2048, 16384
#: A toxic word stands behind this many different words at least, or this share of the toxic documents.
SUPPORT, SUPPORT_SHARE = 4, 0.003
#: Its share among the toxic documents' words is so many times that among the ordinary ones' at least, and so many standard errors more.
TIMES, ERRORS = 2.0, 3.0


def held_out(id_column: str) -> Column:
    fold = F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def windows(made: Words, size: int = WINDOW) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space around each, begin and end of every window in it, and each text's first window."""
    lengths = made.end - made.begin
    ends = np.cumsum(lengths + 1) + 1
    change = np.zeros(len(made.data) + 2, np.int8)
    change[made.begin] += 1
    np.subtract.at(change, made.end, 1)
    inside = np.cumsum(change[: len(made.data)], dtype=np.int8) > 0
    joined = np.full(int(ends[-1]) if len(ends) else 1, 0x20, np.uint8)
    places = np.ones(len(joined), bool)
    places[0] = False
    places[ends - 1] = False
    joined[places] = made.data[inside]
    many = -(-made.counts // size)
    first = np.concatenate(([0], np.cumsum(many)))
    begin_word = (np.arange(first[-1]) - np.repeat(first[:-1], many)) * size + np.repeat(made.first[:-1], many)
    end_word = np.minimum(begin_word + size, np.repeat(made.first[1:], many))
    starts = np.concatenate(([1], ends))
    return joined.tobytes(), starts[begin_word] - 1, ends[end_word - 1], first


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer makes of the samples, or their ends where they are too few for it."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def compressors(self):
        import zstandard

        made = []
        for content in (self.ordinary, self.ordinary + self.toxic):
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )
        return made

    def features(self, made: Words, compressors) -> np.ndarray:
        """Per text: how the bytes that the toxic dictionary saves are spread over its windows."""
        plain, with_toxic = compressors
        joined, begin, end, first = windows(made)
        saved = np.zeros(len(begin))
        for i, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            part = joined[b:e]
            saved[i] = len(plain(part)) - len(with_toxic(part))
        out = np.zeros((len(made.first) - 1, 8))
        for i, (low, high) in enumerate(zip(first[:-1], first[1:], strict=True)):
            own = np.sort(saved[low:high])[::-1] if high > low else np.zeros(1)
            more = np.maximum(own - 2, 0)
            spread = (own >= 5).mean(), np.log1p((own >= 4).sum())
            out[i] = own[0], own[:3].mean(), own.mean(), more.mean(), np.log1p(more.sum()), np.log(len(own)), *spread
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        z = np.column_stack([np.ones(len(features)), (features - self.mean) / self.scale]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _split(texts: list[str]) -> Words:
    return split(pa.array(texts, pa.string()), PLAIN_WORD, lower=True)


def _uses(made: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest of every word's place, the different words, and behind how many different words each stands."""
    word = made.digests()
    before = np.concatenate((np.zeros(1, np.uint64), word[:-1]))[: len(word)]
    before[made.first[:-1][made.counts > 0]] = 0
    pairs = np.unique(np.column_stack((word, before)), axis=0)
    return word, *np.unique(pairs[:, 0], return_counts=True)


def _samples(toxic: Words, ordinary: Words) -> tuple[list[bytes], list[bytes]]:
    """Training texts of the two dictionaries; words are compared by digest, so none becomes an object of its own."""
    word, found, many = _uses(toxic)
    usual_word, usual_found, usual_many = _uses(ordinary)
    among = np.zeros(len(found))
    _, here, there = np.intersect1d(found, usual_found, assume_unique=True, return_indices=True)
    among[here] = usual_many[there]
    ratio = np.log((many + 0.5) / (many.sum() + 1)) - np.log((among + 0.5) / (usual_many.sum() + 1))
    clear = (ratio >= np.log(TIMES)) & (ratio >= ERRORS * np.sqrt(1 / (many + 0.5) + 1 / (among + 0.5)))
    least = max(SUPPORT, SUPPORT_SHARE * (len(toxic.first) - 1))
    chosen = found[clear & (many >= least)]
    marked = np.flatnonzero(np.isin(word, chosen))
    lines = defaultdict(list)
    for i, document in zip(marked.tolist(), toxic.owner()[marked].tolist(), strict=True):
        lines[document].append(toxic.word(i))
    rest = ~np.isin(usual_word, chosen)
    counts = np.bincount(ordinary.owner()[rest], minlength=len(ordinary.counts))
    rest = Words(ordinary.data, ordinary.begin[rest], ordinary.end[rest], np.concatenate(([0], np.cumsum(counts))))
    joined, begin, end, _ = windows(rest, 1 << 40)
    usual = [joined[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
    return [b" " + b" ".join(own) + b" " for own in lines.values()], usual


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return w


def sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The labelled texts that the fit may see: text, toxic, half."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.groupBy(F.col(id_column).alias("_id")).agg(F.max("toxic").alias("toxic"))
    some = [
        known.where(F.col("toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(limit)
        for label, limit in SAMPLE.items()
    ]
    chosen = some[0].union(some[1])
    texts = docs.select(F.col(id_column).alias("_doc"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= LONGEST)
    # At most sum(SAMPLE) rows of two numbers.
    joined = texts.join(F.broadcast(chosen), texts["_doc"] == chosen["_id"])
    return joined.select("text", "toxic", (F.xxhash64("_id", F.lit(1)) % 2 == 0).alias("half"))


def _model(toxic: list[str], ordinary: list[str]) -> Model:
    marked, usual = _samples(_split(toxic), _split(ordinary))
    made = (_dictionary(marked, TOXIC_BYTES), _dictionary(usual, ORDINARY_BYTES))
    return Model(*made, np.zeros(8), np.ones(8), np.zeros(9))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Dictionaries from the sample; the calibration sees each half with dictionaries from the other one."""
    rows = sorted(map(tuple, sample(docs, labels, id_column, text_column).collect()))
    texts = {(t, h): [r[0] for r in rows if r[1] == t and r[2] == h] for t in (0, 1) for h in (False, True)}
    if not all(texts.values()):
        share = float(np.mean([r[1] for r in rows])) if rows else 0.0
        return Model(b"", b"", np.zeros(8), np.ones(8), np.zeros(9), share)
    x, y = [], []
    for half in (False, True):
        model = _model(texts[1, half], texts[0, half])
        for label in (0, 1):
            x.append(model.features(_split(texts[label, not half]), model.compressors()))
            y.append(np.full(len(x[-1]), float(label)))
    x, y = np.concatenate(x), np.concatenate(y)
    model = _model(texts[1, False] + texts[1, True], texts[0, False] + texts[0, True])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.weights = _logistic((x - model.mean) / model.scale, y)
    return model


def _scorer(model: Model):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model.constant is None else None
        for batch in batches(rows):
            if compressors:
                features = model.features(split(batch.column("text"), PLAIN_WORD, lower=True), compressors)
            else:
                features = np.zeros((batch.num_rows, 8))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(model.score(features))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (0 or 1). Rows stay where they are read."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        held_out(id_column).alias("held_out"),
        F.col(text_column).alias("text"),
    )
    scored = rows.mapInArrow(_scorer(model), f"doc_id {kind_of(rows)}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
