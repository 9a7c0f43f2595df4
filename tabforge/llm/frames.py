"""Small helpers for frames of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer name where the frame has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def kind_of(df: DataFrame, column: str = "doc_id") -> str:
    """Type of an id column, as it is written in a schema."""
    return df.schema[column].dataType.simpleString()


def text_hash(column: str = "text") -> Column:
    """64-bit hash that tells apart rows which share an id."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def row_key(id_column: str, hashed: Column) -> Column:
    """Id and text hash of a row as one string that is never null."""
    return F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("")), hashed.cast("string"))


def restrict(docs: DataFrame, key: Column, keys: DataFrame, how: str, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose key is (left_semi) or is not (left_anti) in the column ``key`` of ``keys``.

    ``once`` leaves one row of those that share a key, without another shuffle of the texts.
    """
    own = unused(docs, "key")
    rows = docs.withColumn(own, key).join(keys.select(F.col("key").alias(own)).distinct(), own, how)
    rows = rows.dropDuplicates([own]) if once else rows
    return rows.select(*docs.columns)
