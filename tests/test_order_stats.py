"""Quantiles, cuts, splits and folds against numpy, on any layout."""

import math
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabforge.operators import impute, order_stats, split
from tabforge.operators.order_stats import order_statistics, quantiles, rank_bands, rank_cuts

PROBABILITIES = (0.0, 0.25, 0.5, 0.9, 1.0)


def frame_of(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, x double")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e300, 1e300, allow_nan=False), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    got = quantiles(frame_of(spark, values), ["x"], PROBABILITIES)["x"]
    assert np.allclose(got, np.quantile(values, PROBABILITIES), rtol=1e-9, atol=1e-300)


def test_quantiles_with_a_value_holding_a_third_of_the_rows(spark):
    random = np.random.RandomState(0)
    values = np.concatenate([np.full(5000, 7.0), np.exp(random.normal(0, 8, 10000))])
    got = quantiles(frame_of(spark, values.tolist()).repartition(13), ["x"], PROBABILITIES)["x"]
    assert np.allclose(got, np.quantile(values, PROBABILITIES), rtol=1e-12)


def test_quantiles_skip_null_and_nan(spark):
    got = quantiles(frame_of(spark, [1.0, None, 3.0, float("nan"), 2.0]), ["x"], (0.5,))["x"]
    assert got == [2.0]


def test_empty_column_has_no_quantiles(spark):
    assert quantiles(frame_of(spark, [None, None]), ["x"], (0.5,))["x"] == [None]


def test_cuts_through_ties_have_exact_sizes(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 10).alias("a"), F.xxhash64("id").alias("b")
    )
    sizes = [0, 1, 17, 333, 500, 999, 1000]
    for size, predicate in zip(sizes, rank_cuts(rows, ["a", "b"], sizes, 1000), strict=True):
        assert rows.where(predicate).count() == size


def test_bands_are_runs_of_exact_sizes(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 10).alias("a"), F.xxhash64("id").alias("k")
    )
    sizes = [1, 2, 2, 700, 1500, 2999]
    band = rank_bands(rows, ["a", "k"], sizes, 3000)
    got = rows.withColumn("band", band).groupBy("band").agg(
        F.count("*"), F.min(F.struct("a", "k")).alias("lo"), F.max(F.struct("a", "k")).alias("hi")
    ).orderBy("band").collect()
    assert [(r[0], r[1]) for r in got] == [(0, 1), (1, 1), (3, 698), (4, 800), (5, 1499), (6, 1)]
    assert all(a["hi"] < b["lo"] for a, b in zip(got[:-1], got[1:], strict=True))
    with pytest.raises(ValueError, match="rise"):
        rank_bands(rows, ["k"], [2, 1], 3000)


def test_five_hundred_cuts(spark):
    x = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**9)) / 7
    rows = spark.range(20_040).select(F.xxhash64("id").alias("k"), x.alias("x"))
    sizes = list(range(40, 20_001, 40))
    for order in (["k"], ["x", "k"]):
        labelled = rows.withColumn("band", rank_bands(rows, order, sizes, 20_040))
        began = time.monotonic()
        labelled._jdf.queryExecution().executedPlan()
        assert time.monotonic() - began < 1
        counts = [r["count"] for r in labelled.groupBy("band").count().orderBy("band").collect()]
        assert len(sizes) == 500 and counts == [40] * 501


def test_rounds_over_600_decades(spark, monkeypatch):
    random = np.random.RandomState(5)
    values = random.choice([-1.0, 1.0], 20_000) * 10 ** random.uniform(-300, 300, 20_000) * random.uniform(1, 10, 20_000)
    rounds, counted = [], order_stats._count_slices
    monkeypatch.setattr(order_stats, "_count_slices", lambda *a: rounds.append(1) or counted(*a))
    got = quantiles(frame_of(spark, values.tolist()), ["x"], (0.25, 0.5, 0.75))["x"]
    assert np.allclose(got, np.quantile(values, (0.25, 0.5, 0.75)), rtol=1e-9) and len(rounds) <= 6


def test_full_range_of_whole_numbers(spark):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**63 - 2, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in ends], "x bigint")
    got = order_statistics(rows, lambda *_: range(7), ["x"]).values
    assert [got["x", r] for r in range(7)] == ends
    for size, predicate in enumerate(rank_cuts(rows, ["x"], list(range(8)), 7)):
        assert rows.where(predicate).count() == size


def test_cut_through_identical_rows_is_refused(spark):
    rows = spark.range(10).select(F.lit(1).cast("bigint").alias("a"))
    with pytest.raises(ValueError, match="unique key"):
        rank_cuts(rows, ["a"], [5], 10)


@pytest.mark.parametrize("n,share", [(10, 0.2), (11, 0.2), (7, 0.33), (100, 0.5)])
def test_split_size_and_layout_independence(spark, n, share):
    sides = []
    for parts in (1, 4, 13):
        rows = spark.range(n).repartition(parts)
        parted = split.train_test_split(rows, "id", share, 7)
        sides.append(sorted(r["id"] for r in parted.where("split = 'test'").collect()))
    assert sides[0] == sides[1] == sides[2]
    assert len(sides[0]) == math.ceil(n * share)


def test_seed_changes_the_split(spark):
    picked = [
        sorted(r["id"] for r in split.train_test_split(spark.range(100), "id", 0.2, s).where("split='test'").collect())
        for s in (1, 2)
    ]
    assert picked[0] != picked[1]


def test_fold_sizes(spark):
    counts = split.kfold(spark.range(11), "id", 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in counts] == [4, 4, 3]
    with pytest.raises(ValueError):
        split.fold_sizes(2, 3)


def test_contiguous_folds_follow_the_order(spark):
    rows = split.kfold(spark.range(10).withColumn("o", F.col("id")), "id", 3, shuffle=False, order=["o"])
    assert [r["fold"] for r in rows.orderBy("id").collect()] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_prefix_segments_cover_what_the_plan_says(spark):
    rows = spark.range(23).withColumn("o", F.col("id"))
    labelled, plan = split.prefix_segments(rows, "id", 4, (0.3, 1.0), ["o"])
    where = {r["id"]: r["segment"] for r in labelled.collect()}
    sizes = split.fold_sizes(23, 4)
    for step in plan:
        start = sum(sizes[: step["fold"]])
        test = list(range(start, start + sizes[step["fold"]]))
        train = [i for i in range(23) if i not in test][: step["size"]]
        assert sorted(i for i, s in where.items() if s in step["train"]) == train
        assert sorted(i for i, s in where.items() if s in step["test"]) == test


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=40))
def test_median_filled_statistics(spark, values):
    known = [v for v in values if v is not None]
    if not known:
        return
    fit = impute.MedianFit(frame_of(spark, values), ["x"], (0.25, 0.5, 0.75))
    full = [np.median(known) if v is None else v for v in values]
    assert fit.medians["x"] == np.median(known)
    assert np.allclose([fit.quantile("x", p) for p in (0.25, 0.5, 0.75)], np.quantile(full, (0.25, 0.5, 0.75)))
    assert np.allclose(fit.mean_std("x"), (np.mean(full), np.std(full)))


def test_mode_takes_the_smallest_on_a_tie(spark):
    assert impute.modes(frame_of(spark, [3.0, 1.0, 1.0, 3.0, 2.0, None]), ["x"]) == {"x": 1.0}


def test_routing_edges(spark):
    rows = spark.range(1000)

    def served(**options):
        picked = rows.select(split.route(F.col("id"), **options).alias("a")).groupBy("a").count().collect()
        return {r["a"]: r["count"] for r in picked}

    assert served(weight=1.0) == {"champion": 1000}
    assert served(weight=0.0) == {"challenger": 1000}
    assert served(challenger=False, weight=0.1) == {"champion": 1000}
    assert served(champion=False, weight=0.9) == {"challenger": 1000}
    both = served(weight=0.5)
    assert 400 < both["champion"] < 600
    with pytest.raises(RuntimeError):
        served(champion=False, challenger=False)
    with pytest.raises(ValueError):
        served(weight=1.5)
    assert split.effective_split(True, True, 0.7) == {"champion": 0.7, "challenger": 0.3}
    assert split.effective_split(False, True) == {"champion": 0.0, "challenger": 1.0}
    assert split.effective_split(False, False) == {"champion": 0.0, "challenger": 0.0}


def test_written_split_computes_rows_once(spark):
    """The same split as that of the predicate, from rows that are computed a single time."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(500).withColumn("v", F.col("id") * 2).mapInArrow(counted, "id long, v long")
    parted = split.written_split(rows, "id", 0.3, 7)
    found = {tuple(r) for r in parted.select("id", "v", "split").collect()}
    assert parted.columns == ["id", "v", "split"] and seen.value == 500
    assert found == {tuple(r) for r in split.train_test_split(rows, "id", 0.3, 7).collect()}


def test_quantiles_of_written_columns(spark):
    """Columns read one by one give what one scan gives: ties, gaps, an empty column and huge ranges included."""
    rows = [(float(i % 7), None if i % 3 else i * 1e12, None, -(2.0**i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    assert quantiles(df, df.columns, shares, written=True) == quantiles(df, df.columns, shares)


def test_written_folds_compute_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(503).mapInArrow(counted, "id long")
    found = {tuple(r) for r in split.written_folds(rows, "id", 5, 7).collect()}
    assert seen.value == 503 and found == {tuple(r) for r in split.kfold(rows, "id", 5, seed=7).collect()}
