"""Importance resampling towards a target corpus, on hashed n-grams.

Features are all runs of one to ``LENGTH`` words. The bytes of a text go through one 256-byte table that
lower-cases A-Z and blanks everything that is no word, ``bytes.split`` gives the words, and the CRC of a run is
continued from that of the run one word shorter, so no run is ever put together as a string. Counters add up
the buckets of the CRCs in every task; Spark sums one row per bucket and side.

A document's weight is the sum of the gains of its features' buckets: how much more frequent a bucket is in the
target than in the documents, smoothed by one per bucket, in thousandths of a natural logarithm rounded down.
A Gumbel number from the id's hash is added, so the highest scores are a sample without replacement in
proportion to the weights' exponentials; it is the same on every retry. Ranks come from one range-partitioned
sort of (id, numbers) rows, never from one task; texts do not move.

Defined results: null texts have no words, no features and weight 0; texts are taken in slices of SLICE bytes
that end between words, so memory beyond the text itself is bounded; only documents of ``least`` words and more
are drawn, floor(percent * number / 100) of them; ties go to the smaller id (nulls first), then to the smaller
hash of the text, and repeated rows share their score but no rank; a null id hashes like the empty text. Empty
tables give no rows, an empty target gives gains from the smoothing alone. Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabforge.llm.frames import text_hash
from tabforge.session import materialise

LENGTH = 3
BUCKETS = 10_000
SLICE = 1 << 20
#: Words of ASCII letters and digits and all bytes beyond ASCII; A-Z becomes a-z, everything else a blank.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about SLICE bytes."""
    low = 0
    while low < len(text):
        high = low + SLICE
        parts = [text[low:high].translate(TABLE)]
        while high < len(text) and parts[-1][-1] != 0x20:
            more = text[high : high + SLICE].translate(TABLE)
            parts.append(more[: more.find(b" ") + 1] or more)
            high += len(parts[-1])
        yield b"".join(parts).split()
        low = high


def runs_of(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, list[list[int]]]]:
    """Per slice: its number of words, and the CRCs of the runs of 1, 2, ... words that end in it."""
    carried: list[int] = []  # CRCs of the runs that end at the last word of the slice before, shortest first
    for words in words_of(text):
        if not words:
            continue
        follow = [b" " + w for w in words]
        found = [list(map(crc32, words))]
        for size in range(1, length):
            # A run of size + 1 words goes on from the run of size words that ends one word earlier.
            before = found[-1][:-1]
            if len(carried) >= size:
                found.append(list(map(crc32, follow, [carried[size - 1], *before])))
            else:
                skip = len(words) - len(before)
                found.append(list(map(crc32, follow[skip:], before)))
        yield len(words), found
        carried = [c[-1] for c in found if c]


def _slots(found: list[list[int]], buckets: int) -> np.ndarray:
    return np.concatenate([np.array(c, np.int64) for c in found]) % buckets


def _texts(batch: pa.RecordBatch) -> Iterable[bytes]:
    return (t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist())


def _count(buckets: int, length: int):
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in given:
            for text in _texts(batch):
                for _, found in runs_of(text, length):
                    total.update(_slots(found, buckets).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"]
        )

    return run


def bucket_counts(
    docs: DataFrame, text_column: str = "text", buckets: int = BUCKETS, length: int = LENGTH
) -> np.ndarray:
    """Features of the whole table per bucket; the driver gets one row per bucket."""
    texts = docs.select(F.col(text_column).alias("text"))
    rows = texts.mapInArrow(_count(buckets, length), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in rows.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the source."""
    buckets = len(source)
    t_all, s_all = float(target.sum()) + buckets, float(source.sum()) + buckets
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
            for t, s in zip(target.tolist(), source.tolist(), strict=True)
        ],
        np.int64,
    )


def _weigh(gain: np.ndarray, length: int, schema: pa.Schema):
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            rows = []
            for text in _texts(batch):
                n_words = features = weight = 0
                for count, found in runs_of(text, length):
                    slots = _slots(found, len(gain))
                    n_words, features, weight = n_words + count, features + len(slots), weight + int(gain[slots].sum())
                rows.append((n_words, features, weight))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), *columns], schema=schema
            )

    return run


def gumbel(id_column: Column, seed: int) -> Column:
    """Gumbel number of an id in thousandths, rounded down, from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((bits + 0.5) / 4294967296)))


def _number(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the partition's number and the row's place in it."""
    place = 0
    for batch in given:
        places = pa.array(np.arange(place, place + batch.num_rows))
        place += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, places], [*batch.schema.names, "place"])


def ranked(rows: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rows with their place, from 1, in the order of the whole table.

    Ranges of the order go to tasks and are sorted there; the rows before a range are counted over one row per
    range. Both the rows and the sorted ranges are written once, so that every pass sees the same ranges.
    """
    dealt = materialise(rows, "to-rank").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("worker", F.spark_partition_id())
    placed = materialise(dealt.mapInArrow(_number, T.StructType([*dealt.schema, T.StructField("place", T.LongType())])), "ranked")
    sizes = placed.groupBy("worker").agg(F.max("place").alias("last"))
    before = F.sum(F.col("last") + 1).over(Window.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("worker", F.coalesce(before, F.lit(0)).alias("before"))
    found = placed.join(F.broadcast(sizes), "worker").withColumn(rank, F.col("before") + F.col("place") + 1)
    return found.drop("worker", "place", "before")


def draw(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least: int = 20,
    seed: int = 42,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    length: int = LENGTH,
) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank (null if not drawn).

    ``percent`` of the documents with ``least`` words and more are drawn, those with the highest scores. Texts
    are read twice, for the counts and for the weights.
    """
    gain = gains(
        bucket_counts(target, target_text, buckets, length), bucket_counts(docs, text_column, buckets, length)
    )
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.select("doc_id", text_hash().alias("hash"), "text")
    made = T.StructType([rows.schema["doc_id"], T.StructField("hash", T.LongType())])
    for name in ("n_words", "n_features", "weight"):
        made = made.add(name, "long")
    weighed = rows.mapInArrow(_weigh(gain, length, to_arrow_schema(made)), made)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    eligible = F.col("n_words") >= least
    scored = scored.withColumn("eligible", eligible)
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("hash").asc()]
    found = ranked(scored, order)
    wanted = found.where("eligible").count() * percent // 100
    drawn = F.col("eligible") & (F.col("rank") <= wanted)
    return found.withColumn("rank", F.when(drawn, F.col("rank"))).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
