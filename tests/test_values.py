"""Unusual values: NaN, signed zero, infinity, wide ranges, separators, deep trees, late gaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.functions.hashing import fingerprint
from tabforge.functions.scalars import half_away
from tabforge.operators import impute, iterative, knn, order_stats, profile, registry
from tabforge.operators.models import create_model
from tabforge.operators.order_stats import quantiles
from tabforge.operators.strategies import create_strategy
from tabforge.spec import FeatureSpec


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def test_infinity_is_refused(spark):
    df = frame(spark, [(1.0,), (2.0,), (math.inf,)], ["a"])
    with pytest.raises(ValueError, match="infinite"):
        quantiles(df, ["a"], (0.5,))
    with pytest.raises(ValueError, match="infinite"):
        profile.histogram(df, "a")


def test_wide_ranges_take_few_rounds(spark, monkeypatch):
    values = [s * 10.0**e for e in range(-300, 300, 7) for s in (-1.0, 1.0)] + [0.0, -0.0, 5e-324, 1.7e308]
    rounds = []
    count = order_stats._count_slices
    monkeypatch.setattr(order_stats, "_count_slices", lambda *a: rounds.append(1) or count(*a))
    got = quantiles(frame(spark, [(v,) for v in values], ["a"]), ["a"], (0.1, 0.5, 0.77))["a"]
    assert got == pytest.approx(list(np.quantile(values, (0.1, 0.5, 0.77))), rel=1e-12, abs=1e-320)
    assert len(rounds) <= 6


def test_nan_is_a_gap_everywhere(spark):
    nan = math.nan
    rows = [(1.0, 5.0), (nan, 7.0), (None, nan), (3.0, None), (3.0, 9.0)]
    df = frame(spark, rows, ["a", "b"])
    assert {r["column_name"]: r["n_missing"] for r in profile.summary(df).collect()} == {"a": 2, "b": 2}
    described = {r["column_name"]: r for r in profile.describe(df, ["a", "b"]).collect()}
    assert described["a"]["count"] == 3 and described["b"]["mean"] == 7.0
    assert impute.modes(frame(spark, [(nan,), (nan,), (2.0,)], ["a"]), ["a"]) == {"a": 2.0}
    spec = FeatureSpec("k", ("a", "b"), target="y")
    keyed = df.withColumns({"k": F.monotonically_increasing_id(), "y": F.lit(1.0)})
    for name in ("v1_median", "v2_knn", "v3_iterative", "v4_robust_col"):
        filled = create_strategy(name, spec).fit(keyed).transform(keyed)
        assert all(math.isfinite(r["a"]) and math.isfinite(r["b"]) for r in filled.collect()), name


def test_negative_zero_finds_its_neighbours(spark):
    rows = [(0.0, 2.0), (-0.0, 2.0), (50.0, 57.0), (-0.0, None), (0.0, None)]
    df = frame(spark, rows, ["a", "b"])
    filled = knn.impute(df, knn.fit(df, ["a", "b"], 2))
    assert sorted(r["b"] for r in filled.where("a = 0").collect()) == [2.0] * 4


def test_nan_metric_is_never_best(spark):
    runs = spark.createDataFrame(
        [("a", {"r2": math.nan, "rmse": math.nan}), ("b", {"r2": 0.5, "rmse": 3.0})],
        "run_id string, test_metrics map<string,double>",
    )
    assert registry.best_run(runs, "test_r2").first()["run_id"] == "b"
    assert registry.best_run(runs, "test_rmse").first()["run_id"] == "b"
    flat = spark.createDataFrame([("a", math.nan), ("b", 0.5)], "run_id string, r2 double")
    assert {r["run_id"] for r in registry.mark_best(flat, "r2").where("is_best").collect()} == {"b"}


@pytest.mark.parametrize(
    "one, other",
    [((("a|b", "c"),), (("a", "b|c"),)), (((None, "c"),), (("~", "c"),)), ((("1:a", "b"),), (("1", ":ab"),))],
)
def test_fingerprints_tell_rows_apart(spark, one, other):
    marks = [fingerprint(spark.createDataFrame(list(r), "x string, y string")).first()[0] for r in (one, other)]
    assert marks[0] != marks[1]


def test_fingerprint_sees_types(spark):
    numbers = spark.createDataFrame([(1,)], "x long")
    assert fingerprint(numbers).first()[0] != fingerprint(numbers.selectExpr("cast(x as string) x")).first()[0]


@pytest.mark.parametrize("name", ["random_forest", "gradient_boost"])
def test_trees_of_the_greatest_allowed_depth(spark, name):
    spec = FeatureSpec("k", ("a",), target="y")
    df = spark.createDataFrame([(i, float(i), 2.0**i) for i in range(60)], "k long, a double, y double")
    model = create_model(name, spec, max_depth=50, n_estimators=1, min_samples_split=2, min_samples_leaf=1).fit(df)
    # A target that doubles from row to row is split off from the top, one row a level; each tree sees some of the rows.
    levels = sum(1 for f in model.inner.trees[0][0] if f >= 0)
    assert levels > 15


def test_gaps_that_appear_only_when_scoring(spark):
    """y = 2x without gaps in training: the missing x of y = 4 is 2, worked out by hand."""
    train = frame(spark, [(float(i), 2.0 * i) for i in range(-10, 11)], ["x", "y"])
    state = iterative.fit(train, ["x", "y"])
    asked = frame(spark, [(None, 4.0), (3.0, None)], ["x", "y"])
    got = {(round(r["x"], 1), round(r["y"], 1)) for r in iterative.impute(asked, state).collect()}
    assert got == {(2.0, 4.0), (3.0, 6.0)}


def test_more_features_than_bits(spark):
    names = [f"f{i}" for i in range(66)]
    rng = np.random.default_rng(3)
    rows = [[None if rng.random() < 0.02 else float(v) for v in rng.normal(size=66)] for _ in range(60)]
    df = frame(spark, rows, names)
    state = iterative.fit(df, names, max_iter=1)
    assert iterative.impute(df, state).dropna().count() == 60


def test_csv_texts_that_are_no_numbers_are_named(spark, tmp_path):
    from tabforge.sources import files

    (tmp_path / "a.csv").write_text("a,b\n1,2\nNA, x1 \n3,4e0\n,-\n")
    path = str(tmp_path / "a.csv")
    with pytest.raises(Exception, match="b holds no number: x1"):
        files.read_csv(spark, path, ["a", "b"]).collect()
    assert {(r["column"], r["text"]) for r in files.csv_rejects(spark, path, ["a", "b"]).collect()} == {("b", "x1"), ("b", "-")}


def test_cache_entries_differ_by_roles_and_options(spark, tmp_path):
    from tabforge.sources.cache import PreparedCache

    rows = [(f"k{i}", float(i % 3), float(i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double")
    cache = PreparedCache(spark, str(tmp_path / "cache"))
    plain, marked = FeatureSpec("k", ("a", "b"), target="y"), FeatureSpec("k", ("a", "b"), ("a",), "y")
    scaled = cache.get_or_create(df, plain, "v4_robust_col").rows.select("a").distinct().count()
    kept = {r["a"] for r in cache.get_or_create(df, marked, "v4_robust_col").rows.collect()}
    assert kept == {0.0, 1.0, 2.0} and scaled == 3
    cache.get_or_create(df, plain, "v2_knn", n_neighbors=1)
    cache.get_or_create(df, plain, "v2_knn", n_neighbors=3)
    assert cache.status().count() == 4


def test_accepted_and_refused_requests_are_all_requests(spark):
    from tabforge.operators import validate
    from tabforge.spec import Constraint
    from tabforge.streaming import jobs

    rules = (Constraint("n", ge=1, integer=True),)
    rows = spark.createDataFrame([("5.0",), ("1e1",), ("2.5",), ("x",), (None,), ("0",), ("NaN",)], "n string")
    fine = validate.accepted(validate.with_errors(rows, rules), rules)
    assert {r["n"] for r in fine.collect()} == {5, 10}
    assert fine.count() + jobs.rejected(rows, rules).count() == rows.count()


def test_rounding_agrees_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    values = [s * n / 1000 for n in range(5, 2000, 5) for s in (1, -1)] + [1 - n / 200 for n in range(300)] + [0.0, 4e15]
    got = frame(spark, [(v,) for v in values], ["a"]).select(
        "a", half_away("a", 2).alias("r"), F.format_string("%.4f", half_away("a", 2)).alias("t")
    )
    want = duckdb.sql(f"SELECT a, round(a, 2), printf('%.4f', round(a, 2)) FROM (SELECT unnest({values}::double[]) AS a)")
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_version_tags_on_decimal_halves(spark, tmp_path):
    import oracle
    from tabforge.plans import run_queries

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    priced = orders.withColumn("o_totalprice", (F.col("o_orderkey") % 900).cast("double") * 500)
    priced.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    sql = run_queries.catalogue.oracles["version_tags"]
    assert oracle.compare(spark, con, run_queries.version_tags, sql, str(tmp_path)) is None
