"""Exact copies: rows grouped by a 128-bit content hash, with the bytes compared inside groups.

Defined results: a null text counts as empty, so all null and empty texts are copies of each other. A null
id is a valid id and loses against every other id. Rows that repeat an id and its text count as rows of the
group and are all marked kept; ``deduplicate`` leaves one of them. An empty table gives an empty result.
Other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.frames import restrict, row_key
from tabforge.session import materialise


def content_hash(text: Column) -> Column:
    """128-bit hash of the bytes."""
    return F.unhex(F.md5(text))


def _classes(rows: DataFrame) -> DataFrame:
    """One row per (hash, bytes): the grouping compares the texts themselves.

    Copies collapse before the shuffle, so a group of a third of all rows is one row per task.
    """
    classes = rows.groupBy("_hash", "_text").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("_id").alias("keep_id")
    )
    return classes.withColumn("text_sha256", F.sha2("_text", 256))


def mark_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    hashing: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Per row: id, keep_id (largest id of its copies), group_size, kept, text_sha256.

    Text crosses the network once, for the byte comparison; the way back to the rows joins on the hash
    alone. Should one hash stand for different texts, its rows are joined on the texts instead.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("_id"), text.alias("_text"))
    rows = rows.withColumn("_hash", hashing(F.col("_text")))
    classes = materialise(_classes(rows).drop("_text"), "exact-classes")
    clashes = classes.groupBy("_hash").count().where("count > 1").select("_hash")
    marked = rows.drop("_text").join(classes, "_hash")
    if not clashes.isEmpty():
        clashes = materialise(clashes, "exact-clashes")
        clashing = rows.join(clashes, "_hash", "left_semi")
        compared = clashing.join(_classes(clashing), ["_hash", "_text"]).drop("_text")
        marked = marked.join(clashes, "_hash", "left_anti").unionByName(compared)
    return marked.select(
        F.col("_id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest id, once."""
    marks = mark_copies(docs, id_column, text_column).where("kept")
    keys = marks.select(row_key(id_column, F.col("text_sha256")).alias("key"))
    own = row_key(id_column, F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256))
    return restrict(docs, own, keys, "left_semi", once=True)
