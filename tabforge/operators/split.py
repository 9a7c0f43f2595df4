"""Seeded splits, folds, prefixes, traffic routing and jitter.

Splits have exact sizes. They come out as predicates on a hash of the row key, so
assigning a row needs no shuffle and gives the same answer on any layout or retry.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.hashing import RANK_BITS, hash_below, rank_hash, uniform
from tabforge.functions.scalars import half_away
from tabforge.operators.order_stats import rank_bands, rank_cuts
from tabforge.session import materialise
from tabforge.spec import CHAMPION_WEIGHT, CV_SPLITS, SEED, TEST_SIZE

_RANK = "__rank"
_RANK_BOUNDS = {_RANK: (0, 2**RANK_BITS - 1)}


def _ordered(df: DataFrame, key: str, tag: str, order: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """The order columns and the key's hash, written once, since cutting takes several passes."""
    ranked = materialise(df.select(*order, rank_hash(F.col(key), tag).alias(_RANK)), "ranks")
    return ranked, ranked.count()


def train_test_split(
    df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SEED
) -> DataFrame:
    """Adds ``split``: the ceil(n * test_size) rows of lowest seeded hash are 'test'."""
    tag = f":split:{seed}"
    ranked, total = _ordered(df, key, tag)
    (is_test,) = rank_cuts(ranked, [_RANK], [math.ceil(total * test_size)], total, _RANK_BOUNDS)
    return (
        df.withColumn(_RANK, rank_hash(F.col(key), tag))
        .withColumn("split", F.when(is_test, "test").otherwise("train"))
        .drop(_RANK)
    )


def written_split(
    df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SEED, name: str = "parted"
) -> DataFrame:
    """``train_test_split``, written once: the rows are computed and hashed in one pass, and the cut is found in the
    written ranks."""
    written = materialise(df.withColumn(_RANK, rank_hash(F.col(key), f":split:{seed}")), name)
    total = written.count()
    (is_test,) = rank_cuts(written.select(_RANK), [_RANK], [math.ceil(total * test_size)], total, _RANK_BOUNDS)
    return written.withColumn("split", F.when(is_test, "test").otherwise("train")).drop(_RANK)


def fold_sizes(total: int, k: int) -> list[int]:
    """Rows per fold; the first ``total mod k`` folds hold one more."""
    if not 2 <= k <= total:
        raise ValueError(f"cannot cut {total} rows into {k} folds")
    return [total // k + (1 if i < total % k else 0) for i in range(k)]


def kfold(
    df: DataFrame,
    key: str,
    k: int = CV_SPLITS,
    shuffle: bool = True,
    seed: int = SEED,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``fold`` 0..k-1: seeded when ``shuffle``, else contiguous runs by ``order``.

    ``order`` are numeric columns; the key's hash settles rows they do not tell apart.
    """
    tag = f":fold:{seed}" if shuffle else ":order"
    columns = [] if shuffle else list(order or ())
    ranked, total = _ordered(df, key, tag, columns)
    ends = np.cumsum(fold_sizes(total, k))[:-1].tolist()
    band = rank_bands(ranked, [*columns, _RANK], ends, total, _RANK_BOUNDS)
    labelled = df.withColumn(_RANK, rank_hash(F.col(key), tag))
    return labelled.withColumn("fold", band).drop(_RANK)


def written_folds(df: DataFrame, key: str, k: int = CV_SPLITS, seed: int = SEED, name: str = "folds") -> DataFrame:
    """Seeded ``kfold`` of rows written once with their ranks, in which the cuts are found."""
    written = materialise(df.withColumn(_RANK, rank_hash(F.col(key), f":fold:{seed}")), name)
    total = written.count()
    ends = np.cumsum(fold_sizes(total, k))[:-1].tolist()
    return written.withColumn("fold", rank_bands(written.select(_RANK), [_RANK], ends, total, _RANK_BOUNDS)).drop(_RANK)


def prefix_sizes(total: int, k: int, fractions: Sequence[float]) -> list[int]:
    """Training sizes of a learning curve: the given shares of the first fold's training rows."""
    largest = total - fold_sizes(total, k)[0]
    return sorted({int(f * largest) for f in fractions})


def prefix_segments(
    df: DataFrame, key: str, k: int, fractions: Sequence[float], order: Sequence[str]
) -> tuple[DataFrame, list[dict]]:
    """Cuts the ordered rows so that every fold and every training prefix is a run of segments.

    Returns the rows with ``segment`` and a plan ``{fold, size, train, test}`` listing
    segment numbers. All folds and sizes are then served by one pass over the data.
    """
    ranked, total = _ordered(df, key, ":order", order)
    sizes = prefix_sizes(total, k, fractions)
    stops = [0, *np.cumsum(fold_sizes(total, k)).tolist()]
    train_ends = {}
    for fold in range(k):
        start, stop = stops[fold], stops[fold + 1]
        for size in sizes:
            train_ends[fold, size] = size if size <= start else size + stop - start
    ends = sorted({*stops[1:-1], *train_ends.values()} - {0, total})
    band = rank_bands(ranked, [*order, _RANK], ends, total, _RANK_BOUNDS)
    bounds = [0, *ends, total]
    plan = []
    for (fold, size), end in train_ends.items():
        start, stop = stops[fold], stops[fold + 1]
        runs = list(enumerate(zip(bounds[:-1], bounds[1:], strict=True)))
        plan.append(
            {
                "fold": fold,
                "size": size,
                "train": [i for i, (a, b) in runs if b <= end and (b <= start or a >= stop)],
                "test": [i for i, (a, b) in runs if a >= start and b <= stop],
            }
        )
    labelled = df.withColumn(_RANK, rank_hash(F.col(key), ":order"))
    return labelled.withColumn("segment", band).drop(_RANK), plan


def route(
    key: Column,
    champion: bool = True,
    challenger: bool = True,
    weight: float = CHAMPION_WEIGHT,
    tag: str = ":route",
) -> Column:
    """Which model serves a request. A hash decides, so a retried task cannot change its mind."""
    check_weight(weight)
    if not champion and not challenger:
        raise RuntimeError("No model available for predictions")
    if not challenger:
        return F.lit("champion")
    if not champion:
        return F.lit("challenger")
    return F.when(hash_below(key, tag, weight), "champion").otherwise("challenger")


def check_weight(weight: float) -> float:
    if not 0.0 <= weight <= 1.0:
        raise ValueError(f"champion weight {weight} is outside 0..1")
    return weight


def effective_split(champion: bool, challenger: bool, weight: float = CHAMPION_WEIGHT) -> dict[str, float]:
    """Share of traffic each side gets, given which models are loaded."""
    if champion and challenger:
        return {"champion": weight, "challenger": round(1.0 - weight, 4)}
    return {"champion": float(champion), "challenger": float(challenger)}


def jitter(
    df: DataFrame,
    key: str,
    ranges: Mapping[str, tuple[float | None, float | None]],
    integers: Sequence[str] = (),
    amount: float = 0.2,
    tag: str = ":jitter:",
) -> DataFrame:
    """Varies each ranged column by up to ``amount`` of its size and clamps it to its range."""
    changed = {}
    for name, (low, high) in ranges.items():
        value = F.col(name).cast("double")
        swing = (uniform(F.col(key), tag + name) * 2 - 1) * F.lit(amount)
        if name in integers:
            moved = clamp(value + swing * value, low, high)
            changed[name] = F.bround(moved, 0).cast("bigint")
        else:
            size = F.when(value == 0, F.lit(1.0)).otherwise(F.abs(value))
            changed[name] = half_away(clamp(value + swing * size, low, high), 4)
    return df.withColumns(changed)


def clamp(value: Column, low: float | None, high: float | None) -> Column:
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return value if low is None else F.greatest(value, F.lit(float(low)))
