"""Near copies: consistent weighted samples of TF-IDF shingles, banded, and verified by weighted Jaccard.

A document is the bag of its shingles (five words; a shorter text with words is one shingle). A shingle weighs
its count times log2(1 + N / df), df being the number of the N documents that hold it. Frequencies are those of all
documents, counted by the shingle's hash in 2 ** 22 buckets (the hashing trick of HashingTF and IDF), so the table that tasks need
has one size whatever the corpus; shingles that share a bucket add up, so a weight can be too small, never too large.

Improved consistent weighted sampling draws ``bands`` * ``rows`` samples; documents that agree on all samples
of a band become candidates. A candidate pair is a link if the sums of the smaller and the larger weights of all shingles
have a ratio of at least ``threshold``, or the sums of their plain counts have. The weighted ratio falls with the size of
a group of near copies, whose shared shingles become common; the plain one does not, so links do not depend on how large
the group is. So every document is sampled by its weights and by its counts, with the same draws. Texts that are equal word for word collapse
before anything is compared.

In a band bucket, all members are first compared with one of them (a star), links are joined to components, and
then every member outside the bucket's largest component is compared with the members of other components, in
bounded blocks. So no candidate pair between components is left out, and most of a large group of near copies costs
one comparison a member. Lengths prune pairs that cannot reach the threshold.

Defined results: ids keep their type; texts without words are copies of each other only. Null ids come after all others; rows that repeat an id
and text share a class. An empty table gives an empty result. No other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.frames import kind_of, restrict, row_key, text_hash
from tabforge.llm.words import PLAIN_WORD, SLICE_BYTES, batches, mix, roll, split
from tabforge.session import materialise

SHINGLE = 5
#: Share of the documents below which shingles count as equally rare: none, each has its own frequency.
COMMON = 0.0
BANDS, ROWS, THRESHOLD = 12, 3, 0.8
#: Buckets of document frequencies as a power of two, buckets of a segment, and shingles counted together in a task, about.
_BITS, SEGMENT, CHUNK = 22, 1 << 16, 4_000_000
#: Members of a bucket that meet in a task: those outside the largest component, and all. Rows of a task, about.
STRANGERS, OTHERS, UNIT = 256, 1024, 1000
_TABLE = 1 << 16


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text, their counts, and where each text's begin."""
    made = split(texts, PLAIN_WORD, lower=True)
    digests, counts = made.digests(), made.counts
    whole = roll(digests, SHINGLE)
    many = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    total = int(many.sum())
    at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(made.first[:-1], many)
    short = np.repeat(counts < SHINGLE, many)
    shingles = np.zeros(total, np.uint64)
    shingles[~short] = whole[at[~short]]
    for n in range(1, SHINGLE):
        texts_of_n = np.flatnonzero(counts == n)
        if len(texts_of_n):
            places = (np.cumsum(many) - many)[texts_of_n]
            shingles[places] = roll(digests, n)[made.first[texts_of_n]]
    owner = np.repeat(np.arange(len(counts)), many)
    order = np.argsort(shingles)
    small = np.uint16 if len(counts) < 1 << 16 else np.int64
    order = order[np.argsort(owner[order].astype(small), kind="stable")]
    shingles = shingles[order]
    new = np.ones(total, bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    first = np.searchsorted(owner[begin], np.arange(len(counts) + 1))
    return shingles[begin], np.diff(np.append(begin, total)), first


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - _BITS)).astype(np.int64)


def _frequencies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per bucket of a part of the documents, packed, a row per segment of buckets."""
    import zstandard

    total, parts, size = None, [], 0
    for batch in batches(rows):
        shingles, _, _ = bags(batch.column("text"))
        parts.append(_bucket(shingles))
        size += len(shingles)
        if size >= CHUNK:
            own = np.bincount(np.concatenate(parts), minlength=1 << _BITS)
            total, parts, size = own if total is None else total + own, [], 0
    if size:
        own = np.bincount(np.concatenate(parts), minlength=1 << _BITS)
        total = own if total is None else total + own
    if total is not None:
        pack = zstandard.ZstdCompressor(level=1)
        small = total.astype(np.uint16) if total.max() < 1 << 16 else total
        blobs = [pack.compress(part.tobytes()) for part in small.reshape(-1, SEGMENT)]
        values = [pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(values, ["segment", "n"])


def _weighed(documents: int, common: float):
    """mapInArrow function: packed counts -> the weights of the segments of a partition, one blob at a time."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, total = zstandard.ZstdDecompressor(), {}
        for batch in rows:
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = pack.decompress(blob.as_py())
                own = np.frombuffer(raw, np.uint16 if len(raw) == 2 * SEGMENT else np.int64)
                total[segment] = total.get(segment, 0) + own.astype(np.int64)
        values = [relative_idf(t, documents, common).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(values, pa.binary())], ["segment", "n"])

    return run


def relative_idf(frequency: np.ndarray, documents: int, common: float) -> np.ndarray:
    """Inverse document frequency, relative to that of a shingle in one document."""
    least = max(1.0, common * documents)
    idf = np.log2(1 + documents / np.maximum(frequency, least)) / np.log2(1 + documents / least)
    return idf.astype(np.float32)


class Weights:
    """Weight of every shingle by the relative idf of its bucket."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def of(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.values[_bucket(shingles)].astype(np.float64)


def weights(docs: DataFrame, text_column: str = "text", common: float = COMMON) -> Weights:
    """Document frequencies of all shingles over all documents, in one scan.

    Tasks count into ``2 ** _BITS`` buckets of the shingles' hash and send packed segments, which are added up and
    weighed on the executors; a 32-bit number per bucket reaches the driver, whatever the size of the corpus.
    """
    texts = docs.select(F.col(text_column).alias("text"))
    documents = max(texts.count(), 1)
    parts = texts.mapInArrow(_frequencies, "segment int, n binary").repartition((1 << _BITS) // SEGMENT, "segment")
    found = parts.mapInArrow(_weighed(documents, common), "segment int, n binary").collect()
    # A segment without shingles weighs as one document would.
    values = np.ones(((1 << _BITS) // SEGMENT, SEGMENT), np.float32)
    for r in found:
        values[r["segment"]] = np.frombuffer(r["n"], np.float32)
    return Weights(values.reshape(-1))


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1), log of Gamma(2, 1) and uniform values that 16 bits of a hash choose from."""
    random = np.random.Generator(np.random.PCG64(11))
    gamma = random.gamma(2.0, 1.0, _TABLE).astype(np.float32)
    log_gamma = np.log(random.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
    return gamma, log_gamma, random.random(_TABLE).astype(np.float32)


_R, _LOG_C, _BETA = _draws()


def samples(shingles: np.ndarray, weight: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """Improved consistent weighted samples: a digest per text (with shingles) and draw."""
    return _drawn(shingles, [weight], first, count)[0]


def _drawn(shingles: np.ndarray, sides: list[np.ndarray], first: np.ndarray, count: int) -> list[np.ndarray]:
    """The samples by several weights, with the same draws."""
    full = np.flatnonzero(np.diff(first) > 0)
    begin, sizes = first[:-1][full], np.diff(first)[full]
    logs = [np.log(weight).astype(np.float32) for weight in sides]
    out = [np.zeros((len(full), count), np.uint64) for _ in sides]
    for k in range(count if len(full) else 0):
        h = mix(shingles + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        r = _R[(h & np.uint64(0xFFFF)).astype(np.int32)]
        beta = _BETA[(h >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int32)]
        log_c = _LOG_C[(h >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int32)]
        for log_weight, own in zip(logs, out, strict=True):
            t = np.floor(log_weight / r + beta)
            rank = log_c - r * (t - beta) - r
            least = np.repeat(np.minimum.reduceat(rank, begin), sizes)
            at = np.flatnonzero(rank == least)
            at = at[np.searchsorted(at, begin)]
            own[:, k] = mix(h[at] ^ mix(t[at].astype(np.int64).view(np.uint64)))
    return out


def _keys(drawn: np.ndarray, bands: int, rows_per_band: int) -> np.ndarray:
    """A key per text and band; keys of different bands differ."""
    keys = np.zeros((len(drawn), bands), np.uint64)
    for b in range(bands):
        part = drawn[:, b * rows_per_band : (b + 1) * rows_per_band]
        keys[:, b] = roll(part.reshape(-1), rows_per_band, b)[::rows_per_band] if len(part) else 0
    return keys


def _sketch(shared: Broadcast, bands: int, rows_per_band: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, limit=SLICE_BYTES):
            shingles, counts, first = bags(batch.column("text"))
            weight = shared.value.of(shingles, counts)
            many = np.diff(first)
            total, size = _sums(weight, first), _sums(counts, first)
            keys = np.zeros((len(many), 2 * bands), np.uint64)
            drawn = _drawn(shingles, [weight, counts.astype(np.float64)], first, bands * rows_per_band)
            for side, own in enumerate(drawn):
                keys[many > 0, side * bands : (side + 1) * bands] = _keys(own, bands, rows_per_band)
            use = np.repeat((many > 0)[:, None], 2 * bands, axis=1)
            use[:, bands:] &= keys[:, bands:] != keys[:, :bands]
            ends = np.concatenate(([0], np.cumsum(use.sum(axis=1)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[use].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), _same_words(batch), pa.array(total), pa.array(size), lists],
                ["doc_id", "text_hash", "content", "total", "size", "keys"],
            )

    return run


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of every text."""
    out, full = np.zeros(len(first) - 1), np.diff(first) > 0
    if full.any():
        out[full] = np.add.reduceat(values.astype(np.float64), first[:-1][full])
    return out


def _same_words(batch: pa.RecordBatch) -> pa.Array:
    """128-bit digest of the words of every text."""
    import hashlib

    made = split(batch.column("text"), PLAIN_WORD, lower=True)
    digests = made.digests()
    out = []
    for low, high in zip(made.first[:-1], made.first[1:], strict=True):
        out.append(hashlib.blake2b(digests[low:high].tobytes(), digest_size=16).digest())
    return pa.array(out, pa.binary())


def _similar(shared: Broadcast, threshold: float):
    """Keeps the pairs of texts whose weighted or plain Jaccard similarity reaches the threshold."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text_a"):
            sides = []
            for name in ("text_a", "text_b"):
                shingles, counts, first = bags(batch.column(name))
                pair = np.repeat(np.arange(batch.num_rows), np.diff(first))
                sides.append((pair, shingles, shared.value.of(shingles, counts), counts))
            pair, shingles, weight, counts = (np.concatenate(c) for c in zip(*sides, strict=True))
            order = np.lexsort((shingles, pair))
            pair, shingles, weight, counts = pair[order], shingles[order], weight[order], counts[order]
            both = np.flatnonzero((pair[1:] == pair[:-1]) & (shingles[1:] == shingles[:-1]))
            near = np.zeros(batch.num_rows, bool)
            for value in (weight, counts):
                less = np.bincount(pair[both], np.minimum(value[both], value[both + 1]), batch.num_rows)
                more = np.bincount(pair, value, batch.num_rows) - less
                near |= (less >= threshold * more * (1 - 1e-9)) & (more > 0)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def components(links: DataFrame) -> DataFrame:
    """Per vertex of the links (a, b): its class, the smallest vertex it is connected with.

    Large and small stars in turn: every vertex hands its neighbours to its smallest one, until count and
    checksum of the edges stay. Each step is written to the shared folder; a vertex with very many neighbours has
    its smallest found by aggregation and its neighbours joined, never gathered.
    """
    check = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")))
    edges = materialise(links.where("a != b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    before = edges.agg(*check).first()
    while True:
        both = edges.union(edges.selectExpr("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = edges.selectExpr("b as a", "a as v").join(least, "a").selectExpr("v as a", "m as b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").selectExpr("b as a", "m as b")
        edges = materialise(small.union(low.selectExpr("a", "m as b")).distinct(), "edges")
        now = edges.agg(*check).first()
        if now == before:
            break
        before = now
    members = edges.selectExpr("a as vertex", "b as class")
    return members.union(edges.selectExpr("b as vertex", "b as class").distinct())


def _verified(pairs: DataFrame, texts: DataFrame, shared: Broadcast, threshold: float) -> DataFrame:
    """The links among pairs (a, b) of representatives."""
    joined = pairs.join(texts.selectExpr("vertex as a", "text as text_a"), "a")
    joined = joined.join(texts.selectExpr("vertex as b", "text as text_b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_similar(shared, threshold), "a long, b long")


def classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows_per_band: int = ROWS,
    common: float = COMMON,
) -> DataFrame:
    """Per row: doc_id, text_hash, class_id (smallest id of its class), class_size, kept."""
    session = docs.sparkSession
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(text_column).alias("text"),
        text_hash(text_column).alias("text_hash"),
    )
    shared = session.sparkContext.broadcast(weights(rows, common=common))
    kinds = f"doc_id {kind_of(rows)}, text_hash long, content binary, total double, size double, keys array<long>"
    sketched = materialise(rows.mapInArrow(_sketch(shared, bands, rows_per_band), kinds), "sketches")
    heads = _heads(sketched)
    keyed = heads.select("vertex", "total", "size", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("vertex", "total", "size")).alias("star")
    )
    buckets = buckets.where("n > 1").select("key", "star")
    members = materialise(keyed.join(buckets, "key"), "buckets")
    texts = materialise(_texts(rows, heads.join(members.select("vertex").distinct(), "vertex")), "candidates")
    likely = _can_reach("total", "star.total", threshold) | _can_reach("size", "star.size", threshold)
    pairs = members.where("vertex != star.vertex").where(likely)
    pairs = pairs.selectExpr("vertex as a", "star.vertex as b").distinct()
    links = materialise(_verified(pairs, texts, shared, threshold), "links")
    label = components(links)
    more = materialise(_across(members, label, texts, shared, threshold), "links")
    if not more.isEmpty():
        label = components(label.selectExpr("vertex as a", "class as b").union(more))
    named = heads.select("content", "first", "copies", "vertex").join(label, "vertex", "left")
    named = named.withColumn("class", F.coalesce("class", "vertex"))
    whole = named.groupBy("class").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    named = named.join(whole, "class").select("content", "head", "class_size")
    return sketched.join(named, "content").select(
        "doc_id",
        "text_hash",
        F.col("head.doc_id").alias("class_id"),
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("kept"),
    )


def _heads(sketched: DataFrame) -> DataFrame:
    """One row per word sequence: its first row, number of rows, sketch, and a 64-bit vertex for the joins."""
    null_last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    heads = sketched.groupBy("content").agg(
        F.min(null_last).alias("first"),
        F.count(F.lit(1)).alias("copies"),
        F.min("total").alias("total"),
        F.min("size").alias("size"),
        F.min("keys").alias("keys"),
    )
    return materialise(heads.withColumn("vertex", F.xxhash64("content")), "heads")


def _can_reach(one: str, other: str, threshold: float):
    """Length bound: either similarity is at most the ratio of its totals."""
    return F.least(one, other) >= F.lit(threshold * (1 - 1e-9)) * F.greatest(one, other)


def _across(members: DataFrame, label: DataFrame, texts: DataFrame, shared: Broadcast, threshold: float) -> DataFrame:
    """Links (a, b) between the components that the stars left in a bucket.

    Members outside a bucket's largest component meet all its members, blocks of one with blocks of the other. A
    meeting is a group of its own, so a task holds the texts of one block of either at a time; buckets with few copies share
    groups of about ``UNIT`` rows, counted from the copies. Copies of texts grow with the square of a bucket of strangers.
    """
    labelled = members.drop("star").join(label, "vertex", "left").withColumn("class", F.coalesce("class", "vertex"))
    sizes = labelled.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(
        F.max_by("class", F.struct("n", "class")).alias("main"),
        F.max("n").alias("most"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("classes"),
    )
    main = main.where("classes > 1").select(
        "key",
        "main",
        F.ceil((F.col("n") - F.col("most")) / STRANGERS).alias("as"),
        F.ceil(F.col("n") / OTHERS).alias("bs"),
        (F.col("n") - F.col("most")).alias("askers"),
        F.col("n"),
    )
    main = main.withColumn("copies", F.expr("askers * bs + n * `as`")).drop("askers", "n")
    split_up = materialise(labelled.join(main, "key"), "split-buckets")
    place = F.xxhash64("vertex")
    both = F.array(
        F.struct(F.lit(0).alias("side"), F.pmod(place, "as").alias("block"), F.col("bs").alias("times")),
        F.struct(F.lit(1).alias("side"), F.pmod(place, "bs").alias("block"), F.col("as").alias("times")),
    )
    roles = split_up.select("*", F.inline(F.when(F.col("class") != F.col("main"), both).otherwise(F.slice(both, 2, 1))))
    times = F.sequence(F.lit(0).cast("long"), F.col("times") - 1)
    roles = roles.select("key", "copies", "vertex", "class", "side", "block", F.explode(times).alias("other"))
    first, second = F.when(F.col("side") == 0, F.col("block")), F.when(F.col("side") == 1, F.col("block"))
    meeting = F.xxhash64("key", F.coalesce(first, "other"), F.coalesce(second, "other"))
    shared_copies = split_up.where(F.col("copies") < UNIT).groupBy("key").agg(F.first("copies").alias("n")).agg(F.sum("n"))
    units = max(1, (shared_copies.first()[0] or 0) // UNIT)
    # Shared units are small numbers, so a meeting's hash hardly ever equals one; it would only share the group.
    unit = F.when(F.col("copies") < UNIT, F.pmod(F.xxhash64("key"), F.lit(units))).otherwise(F.col("meeting"))
    roles = roles.select("vertex", "class", "side", meeting.alias("meeting"), "key", "copies")
    roles = roles.withColumn("unit", unit).drop("key", "copies").join(texts, "vertex")
    return roles.groupBy("unit").applyInArrow(_meet(shared, threshold), "a long, b long").distinct()


def _meet(shared: Broadcast, threshold: float):
    """Links between the two sides of every meeting in a unit, one for each component that a member touches."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        shingles, counts, first = bags(table.column("text"))
        weight = shared.value.of(shingles, counts)
        values = [(value, _sums(value, first)) for value in (weight, counts)]
        size = values[1][1]
        vertex, label, side, meeting = (np.asarray(table.column(n)) for n in ("vertex", "class", "side", "meeting"))
        order = np.lexsort((side, meeting))
        edges = np.flatnonzero(np.concatenate(([True], np.diff(meeting[order]) != 0, [True])))
        links = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            rows = order[low:high]
            askers, others = rows[side[rows] == 0], rows[side[rows] == 1]
            if not len(askers) or not len(others):
                continue
            owner = np.repeat(np.arange(len(others)), first[others + 1] - first[others])
            place = np.concatenate([np.arange(first[o], first[o + 1]) for o in others])
            sort = np.argsort(shingles[place], kind="stable")
            place, owner = place[sort], owner[sort]
            posted = shingles[place]
            for i in askers:
                own = slice(first[i], first[i + 1])
                begin = np.searchsorted(posted, shingles[own], "left")
                many = np.searchsorted(posted, shingles[own], "right") - begin
                pick = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
                near = np.zeros(len(others), bool)
                for value, total in values:
                    least = np.minimum(np.repeat(value[own], many), value[place[pick]])
                    less = np.bincount(owner[pick], least, len(others))
                    near |= less >= threshold * (1 - 1e-9) * (total[i] + total[others] - less)
                near = others[near & (label[others] != label[i]) & (size[others] > 0)]
                _, one = np.unique(label[near], return_index=True)
                links += [(vertex[i], vertex[j]) for j in near[one]]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _texts(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """One text per candidate."""
    on = rows["doc_id"].eqNullSafe(needed["first.doc_id"]) & (rows["text_hash"] == needed["first.text_hash"])
    return rows.join(needed, on).groupBy("vertex").agg(F.min("text").alias("text"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the smallest id of every class, once."""
    marks = classes(docs, id_column, text_column, **options).where("kept")
    keys = marks.select(row_key("doc_id", F.col("text_hash")).alias("key"))
    return restrict(docs, row_key(id_column, text_hash(text_column)), keys, "left_semi", once=True)
