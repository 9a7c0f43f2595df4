"""Operators against closed forms and known answers on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions import hashing, scalars
from tabforge.operators import experiments, iterative, knn, metrics, monitor, profile, registry, resample, scoring
from tabforge.operators import validate
from tabforge.operators.models import create_model, importance_table, list_models
from tabforge.operators.strategies import PreprocessorModel, create_strategy, list_strategies
from tabforge.spec import HOUSING, HOUSING_CONSTRAINTS, Constraint, FeatureSpec

SPEC = FeatureSpec("id", ("a", "b", "c"), categorical=("c",), target="y")


def numbers(spark, n=300, seed=0, gaps=0.0):
    random = np.random.RandomState(seed)
    a, b, c = random.normal(0, 3, n), random.uniform(0, 10, n), (random.uniform(size=n) < 0.3).astype(float)
    y = 20 + 4 * a - 0.5 * b + 3 * c + random.normal(0, 0.5, n)
    x = np.column_stack([a, b, c])
    x[random.uniform(size=x.shape) < gaps] = np.nan
    rows = [
        (i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(n)
    ]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, y double"), x, y


def scores(spark, actual, predicted):
    rows = spark.createDataFrame(list(zip(map(float, actual), map(float, predicted), strict=True)), "y double, p double")
    return metrics.regression_metrics(rows, "y", "p").first().asDict()


@pytest.mark.parametrize(
    "actual,predicted,expected",
    [
        ((100, 200, 300), (110, 220, 330), {"mape": 10.0, "accuracy_within_10pct": 100.0}),
        ((100, 100, 100), (90, 100, 110), {"mape": 6.6667}),
        ((0, 0, 0), (10, 20, 30), {"mape": 0.0}),
        ((0, 100, 200), (10, 110, 220), {"mape": 10.0}),
        ((100, 100, 100), (95, 105, 150), {"accuracy_within_10pct": 66.6667}),
        ((100,), (110,), {"accuracy_within_10pct": 100.0, "r2": 0.0}),
        ((5, 5), (5, 5), {"r2": 1.0, "rmse": 0.0}),
        ((100, 200, 300), (100, 200, 300), {"rmse": 0.0, "mae": 0.0, "r2": 1.0, "mape": 0.0, "accuracy_within_10pct": 100.0}),
    ],
)
def test_metrics(spark, actual, predicted, expected):
    got = scores(spark, actual, predicted)
    assert {k: got[k] for k in expected} == expected


def test_profile(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (3.0, 6.0)], "a double, b double")
    got = {r["column_name"]: r for r in profile.summary(rows).collect()}
    assert (got["a"]["n_missing"], got["b"]["n_missing"], got["a"]["total_missing"]) == (1, 2, 3)
    assert profile.summary(rows.limit(0)).first()["n_rows"] == 0
    with pytest.raises(ValueError, match="Missing"):
        profile.check_columns(["a"], ["a", "b"])
    with pytest.raises(ValueError, match="Unexpected"):
        profile.check_columns(["a", "z"], ["a"])
    flat = profile.histogram(spark.createDataFrame([(2.0,)] * 4, "a double"), "a", 4)
    assert sum(r["n"] for r in flat.collect()) == 4


def test_fingerprint(spark):
    base = spark.createDataFrame([(1, 1.5, "x", True), (2, None, "y", False)], "i int, d double, s string, b boolean")
    mark = lambda df: hashing.fingerprint(df).first()["fingerprint"]
    assert len(mark(base)) == 12 and int(mark(base), 16) >= 0
    assert mark(base) == mark(base.orderBy(F.desc("i")).repartition(3))
    assert mark(base) != mark(base.select("d", "i", "s", "b"))
    assert mark(base) != mark(base.withColumn("i", F.col("i") + 1))
    assert mark(base) != mark(base.unionAll(base))
    assert len(mark(base.limit(0))) == 12


def good_record():
    # One valid housing record.
    return dict(
        CRIM="0.00632", ZN="18", INDUS="2.31", CHAS="0", NOX="0.538", RM="6.575", AGE="65.2",
        DIS="4.09", RAD="1", TAX="296", PTRATIO="15.3", B="396.9", LSTAT="4.98",
    )


def check(spark, rows):
    schema = ", ".join(f"{f} string" for f in rows[0])
    return validate.with_errors(spark.createDataFrame([tuple(r.values()) for r in rows], schema), HOUSING_CONSTRAINTS)


def test_every_broken_field_is_found(spark):
    rows = [good_record()]
    for field in HOUSING.features:
        for bad in ("not_a_number", None, "-999", "NaN"):
            rows.append({**good_record(), field: bad})
    checked = check(spark, rows)
    counts = [r["n"] for r in checked.select(F.size("errors").alias("n")).collect()]
    assert counts == [0] + [1] * (len(rows) - 1)
    assert validate.quarantined(checked).count() == len(rows) - 1
    assert validate.accepted(checked, HOUSING_CONSTRAINTS).first()["RM"] == 6.575


def test_boundaries_are_accepted(spark):
    low = {c.field: str(c.ge if c.ge is not None else 0.0001) for c in HOUSING_CONSTRAINTS}
    high = {c.field: str(c.le if c.le is not None else 1e9) for c in HOUSING_CONSTRAINTS}
    assert check(spark, [low, high]).where(F.size("errors") > 0).count() == 0


def test_absent_field(spark):
    record = good_record()
    del record["RM"]
    errors = check(spark, [record]).first()["errors"]
    assert [(e["field"], e["message"]) for e in errors] == [("body.RM", "Field required")]


def test_batches(spark):
    rows = spark.createDataFrame(
        [("big", i, "1") for i in range(101)] + [("full", i, "1") for i in range(100)]
        + [("bad", 0, "1"), ("bad", 1, "x")],
        "batch string, i int, v string",
    )
    checked = validate.with_errors(rows, [Constraint("v", ge=0)])
    served = {r["batch"] for r in validate.serve_batches(checked, "batch").collect()}
    assert served == {"full"}


def test_warnings(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (1.0, 2.0), (float("nan"), 1e7 + 1), (3.0, None)], "dis double, crim double")
    ranges = {"dis": (1.0, 3.0), "crim": (0.00632, 88.9762)}
    texts = rows.select(scoring.warning_texts(scoring.range_warnings(["dis", "crim"], ranges)).alias("w")).collect()
    assert texts[0]["w"] == ["dis (0.5) is below training min (1.00)"]
    assert texts[1]["w"] == []
    assert texts[2]["w"] == ["crim (10000001.0) is above training max (88.98)"]
    assert texts[3]["w"] == []
    assert rows.select(scoring.range_warnings(["dis"], {}).alias("w")).first()["w"] == []


def test_money_and_names(spark):
    rows = spark.createDataFrame([(24.5,), (24.5005,), (0.0,)], "v double")
    assert [r[0] for r in rows.select(scalars.money(F.col("v"))).collect()] == ["$24,500", "$24,500", "$0"]
    name = spark.range(1).select(
        scalars.display_name(F.lit("m"), F.lit("p"), F.create_map(F.lit("max_depth"), F.lit("3"))).alias("a"),
        scalars.display_name(F.lit("m"), F.lit("p"), F.create_map(F.lit("z"), F.lit("3"))).alias("b"),
        scalars.minute_text(F.lit(0).cast("bigint")).alias("c"),
        scalars.strip_prefix(F.lit("test_rmse"), ["test", "train"]).alias("d"),
        scalars.with_default(F.create_map(F.lit("k"), F.lit(1.0)), "q", 7.0).alias("e"),
        scalars.iso_text(F.lit("2024-01-02 03:04:05.5").cast("timestamp")).alias("f"),
    ).first()
    assert tuple(name) == ("m_p (d=3)", "m_p", "1970-01-01 00:00", "rmse", 7.0, "2024-01-02T03:04:05.500000Z")


def brute_knn(train, rows, k):
    out = rows.copy()
    for r, f in zip(*np.nonzero(np.isnan(rows)), strict=True):
        found = []
        for d in train:
            both = ~np.isnan(rows[r]) & ~np.isnan(d)
            if not np.isnan(d[f]) and both.any():
                gap = rows[r][both] - d[both]
                found.append(((gap @ gap) * rows.shape[1] / both.sum(), d[f]))
        found.sort()
        out[r, f] = np.mean([v for _, v in found[:k]]) if found else np.nanmean(train[:, f])
    return out


@pytest.mark.parametrize("n,gaps,copies", [(40, 0.3, 0), (400, 0.1, 0), (900, 0.15, 300)])
def test_knn_matches_brute_force(spark, n, gaps, copies):
    """Whole numbers give many ties; copies put a third of the rows into one vector."""
    random = np.random.RandomState(n)
    x = np.floor(random.normal(0, [30, 8, 3, 1], (n, 4)))
    x[random.uniform(size=x.shape) < gaps] = np.nan
    if copies:
        x[:copies] = x[copies]
    x[-1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double")
    state = knn.fit(df, ["a", "b", "c", "d"], 5)
    got = np.array([[r[c] for c in "abcd"] for r in knn.impute(df, state).orderBy("id").collect()])
    assert np.allclose(got, brute_knn(x, x, 5))


def test_knn_with_small_chunks(spark, monkeypatch):
    """Crowded cells split into many units must not change the answer."""
    monkeypatch.setattr(knn, "UNIT_ROWS", 7)
    test_knn_matches_brute_force(spark, 400, 0.1, 0)


def test_knn_with_deep_trees(spark, monkeypatch):
    """Two children a node and leaves of 6 donors: several levels, nodes that cannot be cut, the same answers."""
    monkeypatch.setattr(knn, "UNIT_ROWS", 25)
    monkeypatch.setattr(knn, "_DEPTH", 1)
    fit = knn.fit
    states = []

    def deep(df, features, k):
        states.append(fit(df, features, k, cell_limit=4, leaf_rows=6))
        return states[-1]

    monkeypatch.setattr(knn, "fit", deep)
    test_knn_matches_brute_force(spark, 900, 0.15, 300)
    state = states[0]
    assert state.levels == knn._LEVELS
    assert state.placed.count() == sum(c["rows"] for c in state.cells if c["inner"])


def test_knn_tree_is_saved(spark, monkeypatch, tmp_path):
    """A loaded strategy walks the same tree."""
    monkeypatch.setattr(knn.fit, "__defaults__", (5, 4, 20))
    df, _, _ = numbers(spark, 300, 3, gaps=0.1)
    model = create_strategy("v2_knn", SPEC).fit(df)
    assert model.knn_state.levels
    model.save(str(tmp_path / "s"))
    loaded = PreprocessorModel.load(str(tmp_path / "s"))
    new = df.withColumn("a", F.when(F.col("b").isNull(), F.col("a")))
    assert sorted(map(str, loaded.transform(new).collect())) == sorted(map(str, model.transform(new).collect()))


def test_knn_work_follows_the_donors(spark):
    """Four times the donors in the same space: the pairs per receiver must not grow by as much."""
    pairs = []
    for n in (4_000, 16_000):
        random = np.random.RandomState(3)
        x = pd.DataFrame(random.uniform(size=(n, 3)), columns=["a", "b", "c"])
        df = spark.createDataFrame(x)
        state = knn.fit(df, ["a", "b", "c"], 5, cell_limit=8, leaf_rows=100)
        asking = df.limit(200).withColumn("c", F.lit(None).cast("double"))
        knn.imputed_cells(asking, state).count()
        pairs.append(state.compared)
    assert pairs[1] < 2 * pairs[0]


def slow_iterative(x, max_iter=10, tol=1e-3):
    """Round-robin imputation row by row on whole arrays."""
    missing = np.isnan(x)
    means = np.nanmean(x, axis=0)
    filled = np.where(missing, means, x)
    order = sorted((j for j in range(x.shape[1]) if missing[:, j].any()), key=lambda j: (missing[:, j].sum(), j))
    for _ in range(max_iter):
        before = filled.copy()
        for j in order:
            others = [i for i in range(x.shape[1]) if i != j]
            train = filled[~missing[:, j]]
            a, y = train[:, others], train[:, j]
            am, ym = a.mean(0), y.mean()
            w, _b = iterative.bayesian_ridge(len(y), am, ym, (a - am).T @ (a - am), (a - am).T @ (y - ym), ((y - ym) ** 2).sum())
            filled[missing[:, j], j] = filled[missing[:, j]][:, others] @ w + ym - am @ w
        if np.abs(filled - before).max() < tol * np.abs(x[~missing]).max():
            break
    return filled


def test_iterative_matches_whole_array_version(spark):
    df, x, _ = numbers(spark, 400, 3, gaps=0.15)
    x[:, 2] = np.where(np.isnan(x[:, 2]), np.nan, x[:, 2])
    state = iterative.fit(df, ["a", "b", "c"])
    got = np.array([[r[c] for c in "abc"] for r in iterative.impute(df, state).orderBy("id").collect()])
    assert np.allclose(got, slow_iterative(x), atol=1e-6)


def test_iterative_does_not_depend_on_condensing(spark):
    df, x, _ = numbers(spark, 200, 4, gaps=0.2)
    names = ["a", "b", "c"]
    moments = {}
    patterns = len(np.unique(np.isnan(x), axis=0))
    for held in (1, 7, 65_536):
        table = iterative.factors(df.select(*names).repartition(5), names, held).toPandas()
        for pattern, rows in table.groupby("pattern")["row"]:
            z = np.array(rows.tolist())
            moments.setdefault(bytes(pattern), []).append(z.T @ z)
    assert len(moments) == patterns and all(len(m) == 3 for m in moments.values())
    assert all(np.allclose(m[0], other) for m in moments.values() for other in m[1:])
    assert len(table) < 60


def test_iterative_in_lots_of_rounds(spark, monkeypatch):
    df, _, _ = numbers(spark, 300, 6, gaps=0.3)
    names = ["a", "b", "c"]
    whole = iterative.fit(df, names, max_iter=5, tol=0.0)
    monkeypatch.setattr(iterative, "FIRST_LOT", 5)
    at_once = iterative.fit(df, names, max_iter=5, tol=0.0)
    assert whole.rounds == at_once.rounds == 5 and len(whole.steps) == len(at_once.steps) == 15
    for a, b in zip(whole.steps, at_once.steps, strict=True):
        assert np.allclose(a["weights"], b["weights"]) and np.isclose(a["offset"], b["offset"])
    assert iterative.fit(df, names, max_iter=0).steps == []


def test_iterative_with_20_000_patterns_of_70_features(spark):
    random = np.random.RandomState(8)
    x = random.normal(size=(20_000, 4)) @ random.normal(size=(4, 70)) + random.normal(size=(20_000, 70))
    x[random.uniform(size=x.shape) < 0.2] = np.nan
    assert len(np.unique(np.packbits(np.isnan(x), axis=1), axis=0)) == 20_000
    names = [f"f{i}" for i in range(70)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(20_000)))
    state = iterative.fit(df, names, max_iter=1)
    got = iterative.impute(df, state).orderBy("id").select(*names).toPandas().to_numpy()
    assert np.allclose(got, slow_iterative(x, max_iter=1), atol=1e-6)


def test_bayesian_ridge_recovers_a_line():
    random = np.random.RandomState(1)
    x = random.normal(size=(500, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + random.normal(0, 0.01, 500)
    xm, ym = x.mean(0), y.mean()
    w, b = iterative.bayesian_ridge(500, xm, ym, (x - xm).T @ (x - xm), (x - xm).T @ (y - ym), ((y - ym) ** 2).sum())
    assert np.allclose(w, [1.0, -2.0, 0.5], atol=0.01) and abs(b - 3) < 0.01


@pytest.mark.parametrize("name", ["v1_median", "v2_knn", "v3_iterative", "v4_robust_col"])
def test_strategies(spark, name, tmp_path):
    df, x, _ = numbers(spark, 200, 5, gaps=0.1)
    estimator = create_strategy(name, SPEC)
    with pytest.raises(RuntimeError):
        estimator.transform(df)
    model = estimator.fit(df)
    got = model.transform(df).orderBy("id").collect()
    values = np.array([[r[f] for f in SPEC.features] for r in got], dtype=float)
    assert not np.isnan(values).any() and len(got) == 200
    if name in ("v1_median", "v2_knn"):
        assert np.allclose(values.mean(0), 0, atol=1e-9) and np.allclose(values.std(0), 1)
    elif name == "v4_robust_col":
        assert np.allclose(np.median(values[:, :2], axis=0), 0, atol=1e-9) and set(values[:, 2]) <= {0.0, 1.0}
    model.save(str(tmp_path / "p"))
    again = PreprocessorModel.load(str(tmp_path / "p")).transform(df).orderBy("id").collect()
    assert np.allclose(values, np.array([[r[f] for f in SPEC.features] for r in again], dtype=float))


def test_registries():
    assert list_strategies() == ["v1_median", "v2_knn", "v3_iterative", "v4_robust_col"]
    assert list_models() == ["gradient_boost", "linear", "random_forest", "xgboost"]
    with pytest.raises(ValueError, match="Available: v1_median"):
        create_strategy("v9", SPEC)
    with pytest.raises(ValueError, match="Available: gradient_boost"):
        create_model("svm", SPEC)


@pytest.mark.parametrize(
    "name,params",
    [
        ("linear", {}),
        ("random_forest", {"n_estimators": 10, "max_depth": 6}),
        ("gradient_boost", {"n_estimators": 10, "learning_rate": 0.3}),
        ("xgboost", {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.4}),
    ],
)
def test_models(spark, name, params, tmp_path):
    from tabforge.operators.models import RegressorModel

    df, _, _ = numbers(spark)
    estimator = create_model(name, SPEC, **params)
    with pytest.raises(RuntimeError):
        estimator.transform(df)
    model = estimator.fit(df)
    scored = model.transform(df)
    assert metrics.regression_metrics(scored, "y", "prediction").first()["r2"] > 0.8
    shares = model.importance()
    assert shares[0][0] == "a" and abs(sum(v for _, v in shares) - 1) < 1e-6 and min(v for _, v in shares) >= 0
    assert importance_table(spark, model, 2).count() == 2
    model.save(str(tmp_path / "m"))
    again = RegressorModel.load(str(tmp_path / "m")).transform(df)
    first = [r["prediction"] for r in scored.orderBy("id").collect()]
    assert np.allclose(first, [r["prediction"] for r in again.orderBy("id").collect()])


@pytest.mark.parametrize("name", ["random_forest", "xgboost"])
def test_trees_do_not_depend_on_layout(spark, name):
    df, _, _ = numbers(spark)
    results = []
    for parts in (1, 5):
        model = create_model(name, SPEC, n_estimators=4, max_depth=4).fit(df.repartition(parts))
        results.append([r["prediction"] for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(results[0], results[1])


def test_ridge_matches_closed_form(spark):
    df, x, y = numbers(spark)
    model = create_model("linear", SPEC, alpha=2.5).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    expected = np.linalg.solve(xc.T @ xc + 2.5 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.inner.stages[-1].coefficients.toArray(), expected)
    parts = resample.moments_by(df.withColumn("g", F.col("id") % 4), "g", SPEC.columns)
    slopes, intercept = resample.ridge(resample.add_moments(list(parts.values())), 2.5)
    assert np.allclose(slopes, expected) and np.isclose(intercept, y.mean() - x.mean(0) @ expected)


def test_cross_validation_agrees_with_fitting_each_fold(spark):
    df, _, _ = numbers(spark)
    fast = resample.cross_validate_ridge(df, SPEC, k=3).orderBy("fold").collect()
    slow = resample.cross_validate(df, SPEC, "linear", k=3).orderBy("fold").collect()
    for a, b in zip(fast, slow, strict=True):
        assert (a["n_train"], a["n_test"]) == (b["n_train"], b["n_test"])
        assert np.isclose(a["rmse"], b["rmse"]) and np.isclose(a["r2"], b["r2"])


def test_learning_curve_agrees_with_fitting_each_step(spark):
    df, _, _ = numbers(spark, 60)
    key = ["train_size", "fold"]
    fast = resample.learning_curve_ridge(df, SPEC, ["id"], (0.5, 1.0), k=3)
    slow = resample.learning_curve(df, SPEC, "linear", ["id"], (0.5, 1.0), k=3)
    for a, b in zip(fast.orderBy(*key).collect(), slow.orderBy(*key).collect(), strict=True):
        assert np.allclose(list(a), list(b))
    summary = resample.curve_summary(fast).orderBy("train_size").collect()
    assert [r["train_size"] for r in summary] == [20, 40] and summary[0]["is_overfitting"] in (True, False)


def test_grid(spark):
    # A grid of two models, two strategies and two settings each.
    config = {
        "grid": {
            "models": ["random_forest", "gradient_boost", "linear"],
            "preprocessors": ["v1_median", "v2_knn"],
            "hyperparameters": {
                "random_forest": {"n_estimators": [100, 200], "max_depth": [10]},
                "gradient_boost": {"n_estimators": [100, 150], "max_depth": 3},
            },
        }
    }
    rows = experiments.expand_grid(experiments.grid_frame(spark, config)).collect()
    assert len(rows) == 10
    assert {tuple(sorted(r["hyperparameters"].items())) for r in rows if r["model_type"] == "linear"} == {()}


def test_run_grid_and_ranking(spark):
    df, _, _ = numbers(spark, 120, gaps=0.05)
    configs = spark.createDataFrame(
        [("linear", "v1_median", {"alpha": "1.0"}), ("random_forest", "v4_robust_col", {"n_estimators": "3", "max_depth": "2"})],
        experiments.CONFIGS,
    )
    results = experiments.run_grid(df, SPEC, configs, cv_splits=3)
    assert registry.best_run(results).first()["model_type"] == "linear"
    assert registry.best_run(results, "test_r2").first()["model_type"] == "linear"
    assert results.where("cv_metrics['cv_rmse_mean'] > 0").count() == 2
    board = registry.leaderboard(results, F.col("test_metrics")["rmse"]).collect()
    assert [r["is_best"] for r in board] == [True, False]


def test_run_lookup(spark):
    runs = spark.createDataFrame([("abc1",), ("abd2",), ("xyz3",)], "run_id string")
    assert registry.lookup_outcome(registry.find_run(runs, "ab")) == "ambiguous"
    assert registry.lookup_outcome(registry.find_run(runs, "x")) == "found"
    assert registry.lookup_outcome(registry.find_run(runs, "q")) == "missing"
    with pytest.raises(ValueError):
        registry.check_alias("production")


def test_backfill_twice_changes_nothing(spark):
    schema = "model string, alias string, version string, ts bigint"
    owned = spark.createDataFrame([("m1", "champion", "3", 0)], schema)
    seeds = spark.createDataFrame([("m1", "9", 1), ("m2", "1", 1)], "model string, version string, ts bigint")
    once = registry.backfill(owned, seeds)
    twice = registry.backfill(once, seeds)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == 3


def test_histogram_quantile_edges(spark):
    rows = spark.createDataFrame([(0.0,), (4.0,), (60.0,), (70.0,)], "v double")
    wide = rows.groupBy().agg(*monitor.bucket_aggregates(F.col("v"), (5.0, 10.0)))
    got = monitor.with_quantiles(wide, (5.0, 10.0), {"p50": 0.5, "p99": 0.99}).first()
    assert (got["p50"], got["p99"]) == (5.0, 10.0)
    none = rows.limit(0).groupBy().agg(*monitor.bucket_aggregates(F.col("v"), (5.0, 10.0)))
    assert monitor.with_quantiles(none, (5.0, 10.0), {"p": 0.5}).first()["p"] is None


def test_hash_below_is_uniform_below(spark):
    rows = spark.range(3000)
    for share in (0.0, 0.05, 0.5, 1.0):
        wrong = rows.where(hashing.hash_below(F.col("id"), ":t", share) != (hashing.uniform(F.col("id"), ":t") < share))
        assert wrong.count() == 0


def test_schema_of_responses(spark):
    rows = spark.createDataFrame([(1, 1, 2.0)], "b bigint, i bigint, prediction double").withColumn(
        "warnings", F.array().cast(scoring.WARNING_TYPE)
    )
    whole = scoring.envelope(scoring.respond(rows, "0123456789", "linear"), "b", "i", ["model_version", "model_type"])
    row = whole.first()
    assert row["model_version"] == "01234567" and row["predictions"][0]["index"] == 0
    assert isinstance(whole.schema["predictions"].dataType, T.ArrayType)


def test_knn_places_and_rough_distances(spark):
    """A value finds its cell by halving, so the plan is shallow; pairs picked by rough distances are the closest ones."""
    cuts = [float(i) for i in range(200)]
    place = knn._place(F.col("x"), cuts, 1)
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 77.0, 77.5, 199.0, 500.0)], "x double")
    assert [r[0] for r in rows.select(place).collect()] == [1 + sum(v > c for c in cuts) for (v,) in rows.collect()]
    random = np.random.default_rng(5)
    donors = random.integers(0, 9, (700, 4)) * np.array([1.0, 1e-3, 1e6, 1.0])
    donors[random.random(donors.shape) < 0.2] = np.nan
    donors[:, 0] = np.arange(700.0)
    x = donors[::20].copy()
    x[:, 0] = np.nan
    limit = np.where(np.arange(len(x)) % 2, np.inf, 4.0)
    found = [list(zip(*(c.tolist() for c in part))) for part in knn.nearest(x, limit, 0, donors, np.ones(700, int), 3)]
    for i, row in enumerate(x):
        both = ~np.isnan(donors[:, 1:] - row[1:])
        with np.errstate(invalid="ignore"):
            far = np.nansum((donors[:, 1:] - row[1:]) ** 2, axis=1) * 4 / both.sum(axis=1)
        best = [j for j in np.lexsort((donors[:, 0], far)) if both[j].any() and far[j] <= limit[i]][:3]
        assert [(w, v) for w, _, v, _ in sum(found, []) if w == i] == [(i, donors[j, 0]) for j in best]
