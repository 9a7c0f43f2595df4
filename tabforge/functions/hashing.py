"""Portable hashes: the same number for the same key on every engine, layout and retry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK_BITS = 60


def _leading_hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def uniform(key: Column, tag: str = "") -> Column:
    """A number in [0, 1) from the first 32 bits of md5(key + tag)."""
    return _leading_hex(F.concat(key.cast("string"), F.lit(tag)), 8) / F.lit(4294967296.0)


def hash_below(key: Column, tag: str, share: float) -> Column:
    """``uniform(key, tag) < share``, decided on the hexadecimal digits themselves."""
    limit = math.ceil(share * 2**32)
    if limit >= 2**32:
        return F.lit(True)
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(tag))), 1, 8)
    return digits < F.lit(f"{limit:08x}")


def rank_hash(key: Column, tag: str = "") -> Column:
    """A 60-bit integer from md5(key + tag); ordering by it is a seeded shuffle."""
    return _leading_hex(F.concat(key.cast("string"), F.lit(tag)), 15)


def row_text(df: DataFrame) -> Column:
    """All columns of a row as one string: each value behind its length, NULL and NaN as a mark without one.

    No text can look like the border between two values, so different rows have different strings.
    """
    parts = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("float", "double"):
            column = F.when(~F.isnan(column), column)
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.concat(*parts)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row with 12 hex characters that change with any value, row count, column order or type.

    Row hashes are added up, so row order and partitioning do not matter and the
    only thing shuffled is one partial sum per task.
    """
    hashed = df.select(F.md5(row_text(df)).alias("h")).select(
        F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)").alias("left"),
        F.conv(F.substring("h", 16, 15), 16, 10).cast("decimal(38,0)").alias("right"),
    )
    sums = hashed.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("left"), F.lit(0).cast("decimal(38,0)")).alias("left"),
        F.coalesce(F.sum("right"), F.lit(0).cast("decimal(38,0)")).alias("right"),
    )
    whole = F.concat_ws(
        "|", F.lit(",".join(f"{name} {kind}" for name, kind in df.dtypes)), *[F.col(c).cast("string") for c in ("n", "left", "right")]
    )
    return sums.select(F.substring(F.md5(whole), 1, 12).alias("fingerprint"), "n")
