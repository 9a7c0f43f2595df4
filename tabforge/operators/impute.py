"""Simple imputation and scaling: fitted numbers that become column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalars import number
from tabforge.operators.order_stats import OrderStatistics, interpolation_ranks, order_statistics

_ZERO = 10 * 2.220446049250313e-16


def safe_scale(value: float) -> float:
    """A spread of zero would divide by zero; such a column is only shifted."""
    return 1.0 if value is None or abs(value) < _ZERO else value


def _imputed_rank(rank: int, count: int, nulls: int) -> int | None:
    """Where rank ``rank`` of a median-filled column sits among its observed values.

    The filled-in medians stand in the middle, so no second pass over the filled
    column is needed. ``None`` means the median itself.
    """
    if rank < count // 2:
        return rank
    if rank >= count - count // 2 + nulls:
        return rank - nulls
    return None


class MedianFit:
    """Medians of columns, and moments and quantiles of the columns once filled with them."""

    def __init__(self, df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = ()):
        self.columns = list(columns)

        def wanted(_, summary):
            low, high, _w = interpolation_ranks(summary.count, 0.5)
            yield from (low, high)
            for p in probabilities:
                for rank in interpolation_ranks(summary.count + summary.nulls, p)[:2]:
                    observed = _imputed_rank(rank, summary.count, summary.nulls)
                    if observed is not None:
                        yield observed

        self.stats: OrderStatistics = order_statistics(df, wanted, self.columns)
        empty = [c for c in self.columns if not self.stats.summaries[c].count]
        if empty:
            raise ValueError(f"no values in {empty}")
        self.medians = {c: self._observed_median(c) for c in self.columns}

    def _observed_median(self, c: str) -> float:
        low, high, weight = interpolation_ranks(self.stats.summaries[c].count, 0.5)
        a, b = float(self.stats.values[c, low]), float(self.stats.values[c, high])
        return a + (b - a) * weight

    def quantile(self, c: str, probability: float) -> float:
        """Interpolated quantile of the filled column."""
        s = self.stats.summaries[c]
        low, high, weight = interpolation_ranks(s.count + s.nulls, probability)
        ends = []
        for rank in (low, high):
            observed = _imputed_rank(rank, s.count, s.nulls)
            ends.append(self.medians[c] if observed is None else float(self.stats.values[c, observed]))
        return ends[0] + (ends[1] - ends[0]) * weight

    def mean_std(self, c: str) -> tuple[float, float]:
        """Mean and population std of the filled column."""
        s, fill = self.stats.summaries[c], self.medians[c]
        total = s.count + s.nulls
        mean = (s.count * s.mean + s.nulls * fill) / total
        spread = s.count * (s.variance + (s.mean - mean) ** 2) + s.nulls * (fill - mean) ** 2
        return mean, (spread / total) ** 0.5


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Most frequent value of each column, the smallest on a tie.

    Values are counted by a shuffle; no task holds all values of a column.
    """
    pairs = [F.struct(F.lit(c).alias("c"), number(c).alias("v")) for c in columns]
    counts = (
        df.select(F.inline(F.array(*pairs))).where("v is not null").groupBy("c", "v").agg(F.count("v").alias("n"))
    )
    best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    found = {r["c"]: r["v"] for r in best.collect()}
    if missing := [c for c in columns if c not in found]:
        raise ValueError(f"no values in {missing}")
    return found


def filled(column: str, value: float) -> Column:
    return F.coalesce(number(column), F.lit(float(value)))


def standard_scale(df: DataFrame, columns: Sequence[str]) -> tuple[dict, dict]:
    """Mean and population std of each column."""
    row = df.agg(
        *[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(number(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return (
        {c: row[f"m{i}"] for i, c in enumerate(columns)},
        {c: safe_scale(row[f"s{i}"]) for i, c in enumerate(columns)},
    )
