"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Ids are replaced by their rank in the whole corpus, most frequent first. A rank takes one to four data bytes;
two bits of a control byte say how many, so four ranks share one control byte. Control and data bytes lie
apart, and numpy decodes them with a table from control byte to lengths.

A set of files is a folder with ``blocks`` (Parquet: documents in ascending id order, several to a row, with
the control and data bytes of their ids) and ``ranks`` (Parquet: rank -> id). Spark's writer commits them, so a
lost executor leaves no half file.

Defined results: ids are whole numbers of 64 bits, or text that spells one (other ids end the job, by Spark's cast); a null or empty text is the end id alone; null ids come first; rows that repeat an id lie in
the order of their ids' bytes. Empty tables give empty files. No other column is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.tokens import TOGETHER, encoder, with_end
from tabforge.llm.words import batches
from tabforge.session import materialise, scratch_path

#: Ids in a block at least, unless the partition ends.
BLOCK = 1 << 16
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
IDS = "doc_id long, n_tokens long, ids binary"
BLOCKS = "worker long, first long, doc_ids array<long>, counts array<long>, control binary, data binary"
READ = "worker long, first long, doc_id long, n_tokens long, ids_crc32 long, ids binary"


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned integers below 2**32."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    codes[: len(ranks)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.cumsum(extra + np.int64(1))
    at = ends - extra - 1
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    data[at] = ranks & 0xFF
    for byte in range(1, 4):
        some = extra >= byte
        if some.any():
            data[at[some] + byte] = ranks[some] >> (8 * byte) & 0xFF
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The integers that ``encode`` was given."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    values = np.frombuffer(data, np.uint8)
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    out = values[at].astype(np.uint32)
    for byte in range(1, 4):
        some = sizes > byte
        if some.any():
            out[some] |= values[at[some] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def _tokenise(path: str, end: int):
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True)
        for batch in batches(given, limit=TOGETHER):
            ids, ends = with_end(*encoder(path).encode(batch.column("text")), end)
            flat = ids.astype("<u4" if ids.dtype == np.uint32 else "<u2")
            blobs = [pack.compress(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(blobs, pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    return run


def _unpacked(batch: pa.RecordBatch, dtype: str) -> list[np.ndarray]:
    import zstandard

    pack = zstandard.ZstdDecompressor()
    return [np.frombuffer(pack.decompress(b), dtype) for b in batch.column("ids").to_pylist()]


def _counts(vocabulary: int, dtype: str):
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in given:
            if batch.num_rows:
                total += np.bincount(np.concatenate(_unpacked(batch, dtype)), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return run


def _blocks(rank_of: np.ndarray, dtype: str):
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, worker, docs, ids, size = 0, None, [], [], 0

        def block():
            control, data = encode(rank_of[np.concatenate(ids)])
            values = [[worker], [first], [docs], [[len(i) for i in ids]], [control], [data]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["worker", "first", "doc_ids", "counts", "control", "data"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in given:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), _unpacked(batch, dtype), strict=True):
                worker = batch.column("worker")[0].as_py() if worker is None else worker
                docs.append(doc_id)
                ids.append(own)
                size += len(own)
                if size >= BLOCK:
                    yield block()
                    first, docs, ids, size = first + size, [], [], 0
        if docs:
            yield block()

    return run


def write(
    docs: DataFrame, folder: str, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Writes the ids of all documents to ``folder``, which must be reachable by all executors.

    Texts are encoded once; the ids are kept in the shared folder, counted, dealt out by ranges of
    document ids, and coded. Counts are one row per id of the vocabulary.
    """
    made = encoder(path)
    vocabulary = max(made.tokenizer.get_vocab_size(), end_id + 1)
    dtype = "<u2" if made.dtype == np.uint16 and end_id < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    tokens = materialise(rows.mapInArrow(_tokenise(path, end_id), IDS), "token-ids")
    counts = tokens.select("ids").mapInArrow(_counts(vocabulary, dtype), "id long, n long")
    counted = counts.groupBy("id").agg(F.sum("n").alias("n")).collect()
    counted.sort(key=lambda r: (-r["n"], r["id"]))
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[[r["id"] for r in counted]] = np.arange(len(counted))
    session = docs.sparkSession
    ranks = session.createDataFrame([(n, r["id"]) for n, r in enumerate(counted)], "rank long, id long")
    ranks.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered = ordered.select("doc_id", "ids", F.spark_partition_id().cast("long").alias("worker"))
    ordered.mapInArrow(_blocks(rank_of, dtype), BLOCKS).write.mode("overwrite").parquet(f"{folder}/blocks")


def _decoded(id_of: np.ndarray):
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = id_of[decode(row["control"], row["data"], int(counts.sum()))].astype("<u4")
                ends = np.cumsum(counts)
                parts = [ids[e - c : e].tobytes() for c, e in zip(counts, ends, strict=True)]
                size = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["worker"]] * size, pa.int64()),
                        pa.array(row["first"] + ends - counts),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(counts),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                        pa.array(parts, pa.binary()),
                    ],
                    ["worker", "first", "doc_id", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, ids (little-endian 32-bit integers).

    ``start`` counts the ids of all documents before it: those of earlier files, which are summed over one
    row per file, and those before it in its own file, which the blocks store.
    """
    ranks = spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in ranks], np.uint32)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    files = blocks.groupBy("worker").agg(F.max(F.col("first") + size).alias("size"))
    before = F.sum("size").over(Window.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("worker", F.coalesce(before, F.lit(0)).alias("before"))
    rows = blocks.mapInArrow(_decoded(id_of), READ).join(F.broadcast(files), "worker")
    return rows.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id") -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write(docs, folder, path, end_id, id_column)
    return read(docs.sparkSession, folder)
