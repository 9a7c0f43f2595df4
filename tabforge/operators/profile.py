"""Profiles of a table: counts, nulls, descriptive statistics, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalars import number
from tabforge.operators.order_stats import quantiles


def check_columns(columns: Sequence[str], expected: Sequence[str]) -> None:
    """Raises when columns are missing or, after that, when there are unexpected ones."""
    missing, extra = set(expected) - set(columns), set(columns) - set(expected)
    if missing:
        raise ValueError(f"Missing columns: {sorted(missing)}")
    if extra:
        raise ValueError(f"Unexpected columns: {sorted(extra)}")


def long_form(row: DataFrame, columns: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """Turns one row of ``<field>__<i>`` aggregates into one row per column."""
    structs = [
        F.struct(F.lit(c).alias(name), *[F.col(f"{f}__{i}").alias(f) for f in fields])
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*structs)))


def summary(df: DataFrame) -> DataFrame:
    """Rows, columns, gaps (NULL or NaN) of each column and gaps in all, one row per column, from one pass."""
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(df.columns):
        aggregates.append(F.count_if(_known(df, c).isNull()).alias(f"n_missing__{i}"))
    row = df.agg(*aggregates)
    total = sum((F.col(f"n_missing__{i}") for i in range(len(df.columns))), F.lit(0).cast("bigint"))
    structs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("n_rows"),
            F.lit(len(df.columns)).alias("n_columns"),
            F.col(f"n_missing__{i}").alias("n_missing"),
            total.alias("total_missing"),
        )
        for i, c in enumerate(df.columns)
    ]
    return row.select(F.inline(F.array(*structs)))


def _known(df: DataFrame, column: str) -> Column:
    """The column with NaN as NULL."""
    kind = dict(df.dtypes)[column]
    return number(F.col(f"`{column}`")) if kind in ("float", "double") else F.col(f"`{column}`")


def info(df: DataFrame) -> DataFrame:
    """Type and number of values of each column that are neither NULL nor NaN."""
    row = df.agg(*[F.count(_known(df, c)).alias(f"non_null__{i}") for i, c in enumerate(df.columns)])
    structs = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.lit(kind).alias("dtype"),
            F.col(f"non_null__{i}").alias("non_null"),
        )
        for i, (c, kind) in enumerate(df.dtypes)
    ]
    return row.select(F.inline(F.array(*structs)))


def head(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max of each column."""
    quartiles = quantiles(df, columns, (0.25, 0.5, 0.75))
    aggregates = []
    for i, c in enumerate(columns):
        col = number(c)
        aggregates += [
            F.count(col).alias(f"count__{i}"),
            F.avg(col).alias(f"mean__{i}"),
            F.stddev_samp(col).alias(f"std__{i}"),
            F.min(col).alias(f"min__{i}"),
            F.max(col).alias(f"max__{i}"),
        ]
    row = df.agg(*aggregates).withColumns(
        {
            f"{field}__{i}": F.lit(quartiles[c][q]).cast("double")
            for i, c in enumerate(columns)
            for q, field in enumerate(("p25", "p50", "p75"))
        }
    )
    fields = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
    return long_form(row, columns, fields, "column_name")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the range of ``column``; the last bin includes its upper edge."""
    col = number(column)
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None:
        raise ValueError(f"{column} holds no values")
    if float("inf") in (abs(low), abs(high)):
        raise ValueError(f"{column} holds infinite values")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    index = F.least(F.floor((col - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(col.isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(columns) if columns else None)


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Min, max, mean and sample std of each feature, one row per feature."""
    aggregates = []
    for i, c in enumerate(features):
        col = number(c)
        aggregates += [
            F.min(col).alias(f"min__{i}"),
            F.max(col).alias(f"max__{i}"),
            F.avg(col).alias(f"mean__{i}"),
            F.stddev_samp(col).alias(f"std__{i}"),
        ]
    return long_form(df.agg(*aggregates), features, ("min", "max", "mean", "std"), "feature")


def feature_ranges(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Min and max of each feature, one row per feature."""
    aggregates = []
    for i, c in enumerate(features):
        col = number(c)
        aggregates += [F.min(col).alias(f"min__{i}"), F.max(col).alias(f"max__{i}")]
    return long_form(df.agg(*aggregates), features, ("min", "max"), "feature")
