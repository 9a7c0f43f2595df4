"""Scoring requests as JSON text: batch files, streams, single records and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_records(df: DataFrame, payload: str, fields: Sequence[str]) -> DataFrame:
    """Fields of a JSON record as text, NULL where absent; ``_corrupt_record`` keeps what is no JSON.

    Text is kept as text so that validation can name a wrong value instead of losing it.
    """
    schema = ", ".join(f"`{f}` string" for f in fields) + ", _corrupt_record string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = df.withColumn("__p", F.from_json(payload, schema, options))
    return parsed.select("*", *[F.col(f"__p.{f}").alias(f) for f in fields], "__p._corrupt_record").drop("__p")


def parse_batches(df: DataFrame, payload: str, fields: Sequence[str]) -> DataFrame:
    """Items of ``{"items": [...]}``, one row each with its place in the batch, from 0."""
    record = ", ".join(f"`{f}`: string" for f in fields)
    items: Column = F.from_json(payload, f"items array<struct<{record}>>")["items"]
    exploded = df.select(*df.columns, F.posexplode_outer(items).alias("item_index", "__i"))
    return exploded.select(
        *df.columns, "item_index", *[F.col(f"__i.{f}").alias(f) for f in fields]
    )
