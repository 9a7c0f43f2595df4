"""The tree engine next to plain recursive versions, and the same trees by every way through it."""

import numpy as np
import pytest

from tabforge.operators import trees
from tabforge.operators.models import RegressorModel, create_model
from tabforge.spec import FeatureSpec

SPEC = FeatureSpec("id", ("a", "b", "c"), target="y")
SCHEMA = "id long, a double, b double, c double, y double"


def table(n=600, seed=3, kinds=(40, 7, 1000)):
    random = np.random.RandomState(seed)
    x = np.stack([random.randint(0, k, n) / 4.0 for k in kinds], axis=1)
    y = np.round(x[:, 0] * 2 - 3 * (x[:, 1] > 0.75) + 0.01 * x[:, 2] + random.normal(0, 0.5, n), 3)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], SCHEMA)


def plain_tree(x, r, depth, split_rows, leaf_rows, l1=0.0, l2=0.0, least=0.0):
    """Prediction of every row by a tree grown with all midpoints, best gain first feature first."""
    def soft(g):
        return np.sign(g) * max(abs(g) - l1, 0.0)

    def score(v):
        return soft(v.sum()) ** 2 / (len(v) + l2)

    out = np.zeros(len(r))

    def grow(rows, level):
        out[rows] = soft(r[rows].sum()) / (len(rows) + l2)
        if level == depth or len(rows) < split_rows:
            return
        best = (max(least, 1e-9), None)
        for f in range(x.shape[1]):
            v = np.unique(x[rows, f])
            for cut in (v[1:] + v[:-1]) / 2:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if min(len(left), len(right)) >= leaf_rows:
                    gain = score(r[left]) + score(r[right]) - score(r[rows])
                    if gain > best[0] + 1e-9:
                        best = (gain, left, right)
        if best[1] is not None:
            grow(best[1], level + 1)
            grow(best[2], level + 1)

    grow(np.arange(len(r)), 0)
    return out


def predictions(model, df):
    return np.array([r["prediction"] for r in model.transform(df).orderBy("id").collect()])


def test_one_tree_is_the_plain_tree(spark):
    x, y = table(kinds=(40, 7, 100))
    df = frame(spark, x, y)
    model = create_model("random_forest", SPEC, n_estimators=1, max_depth=4, bootstrap=False).fit(df)
    assert np.allclose(predictions(model, df), y.mean() + plain_tree(x, y - y.mean(), 4, 6, 3), atol=1e-6)


def test_boosting_starts_from_the_mean_and_shrinks_every_tree(spark):
    x, y = table(200, kinds=(20, 5, 30))
    df = frame(spark, x, y)
    want = np.full(len(y), y.mean())
    for _ in range(3):
        want += 0.3 * plain_tree(x, y - want, 3, 6, 3)
    model = create_model("gradient_boost", SPEC, n_estimators=3, max_depth=3, learning_rate=0.3, subsample=1.0).fit(df)
    assert np.allclose(predictions(model, df), want, atol=1e-6)
    want = np.full(len(y), y.mean())
    for _ in range(3):
        want += 0.1 * plain_tree(x, y - want, 3, 2, 1, 0.1, 1.0, 1e-6)
    model = create_model("xgboost", SPEC, n_estimators=3, max_depth=3, subsample=1.0, colsample_bytree=1.0).fit(df)
    assert np.allclose(predictions(model, df), want, atol=1e-6)


@pytest.mark.parametrize("name", ["random_forest", "gradient_boost", "xgboost"])
def test_every_way_gives_the_same_trees(spark, monkeypatch, name):
    x, y = table()
    df = frame(spark, x, y)

    def fit(parts):
        return predictions(create_model(name, SPEC, n_estimators=3, max_depth=6).fit(df.repartition(parts)), df)

    local = fit(1)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 60)  # the upper levels by passes over the blocks
    monkeypatch.setattr(trees, "PART_ROWS", 100)
    assert (fit(4) == local).all()
    monkeypatch.setattr(trees, "DRIVER_BYTES", 0)  # sums reduced on the executors
    monkeypatch.setattr(trees, "SUM_BYTES", 100_000)  # several passes a level
    assert (fit(3) == local).all()
    monkeypatch.setattr(trees, "LOCAL_ROWS", 0)  # passes only
    monkeypatch.setattr(trees, "REWRITE_EVERY", 2)
    assert (fit(5) == local).all()


def test_cuts_from_rows_are_those_from_sums():
    random = np.random.RandomState(1)
    offsets, rules = np.array([0, 5, 9, 30]), trees.Rules(3, split_rows=4, leaf_rows=2)
    for trial in range(50):
        n, k = random.randint(10, 300), random.randint(1, 12)
        bins = np.stack([random.randint(0, w, n) for w in (5, 4, 21)]).astype(np.uint8)
        node = np.append(np.arange(k), random.randint(0, k, n - k)).astype(np.uint16) if n > k else np.zeros(n, np.uint16)
        k = int(node.max()) + 1
        weight = random.randint(1, 4, n)
        values = np.stack([random.randint(-50, 50, n) * weight, weight, np.ones(n, int)])
        allowed = np.array([trial % 3 != 0, True, trial % 2 == 0])
        sums = trees._sums(bins, np.arange(n), node, values, k, offsets)
        a = trees.cuts_from_sums(sums, offsets, rules, np.full(k, 0.25), np.broadcast_to(allowed, (k, 3)))
        b = trees.cuts_from_rows(bins, node, values, k, rules, 0.25, allowed)
        for part in ("feature", "gain", "total", "left"):
            assert (getattr(a, part) == getattr(b, part)).all()
        assert (a.cut == b.cut)[a.feature >= 0].all()


def test_bags_count_rows_as_often_as_chance_says():
    hashes = np.random.RandomState(0).randint(-(2**62), 2**62, 200_000)
    rows, times = trees._sample(hashes, 3, trees.Rules(1, sampling="bag", seed=42))
    assert abs(times.sum() / 200_000 - 1) < 0.02 and abs(len(rows) / 200_000 - 0.632) < 0.01
    rows, times = trees._sample(hashes, 3, trees.Rules(1, sampling="share", share=0.8, seed=42))
    assert abs(len(rows) / 200_000 - 0.8) < 0.01 and (times == 1).all()


def test_cut_points():
    assert trees.cut_points(np.array([3.0, 1.0, 1.0, 2.0]), 256).tolist() == [1.5, 2.5]
    many = trees.cut_points(np.arange(10_000) // 2.0, 256)
    assert len(many) == 255 and np.allclose(np.diff(many), 5000 / 256, atol=1.01)
    assert trees.cut_points(np.array([1.0] * 99_000 + list(range(2, 1002))), 10).tolist() == [1.5]
    assert trees.cut_points(np.array([]), 5).tolist() == []


def test_deep_trees_missing_values_and_odd_tables(spark):
    x, y = table(400)
    deep = create_model("random_forest", SPEC, n_estimators=2, max_depth=50, min_samples_split=2, min_samples_leaf=1)
    df = frame(spark, x, y)
    assert np.abs(predictions(deep.fit(df), df) - y).mean() < 0.6
    rows = [(1, None, 1.0, float("nan"), 5.0), (2, 1.0, 1.0, 2.0, 1.0), (3, None, 1.0, 2.0, 5.0), (4, 1.0, 1.0, 3.0, None)]
    odd = spark.createDataFrame(rows, SCHEMA)
    one = create_model("random_forest", SPEC, n_estimators=1, bootstrap=False, min_samples_split=2, min_samples_leaf=1).fit(odd)
    # A missing value lies in the largest bin: with one known value it cannot be told apart from it.
    assert np.allclose(predictions(one, odd), 11 / 3)
    same = create_model("xgboost", SPEC, n_estimators=2).fit(df.selectExpr("id", "a", "b", "c", "7.0 AS y"))
    assert np.allclose(predictions(same, df), 7.0) and sum(v for _, v in same.importance()) == 0
    none = create_model("gradient_boost", SPEC, n_estimators=2).fit(df.limit(0))
    assert (predictions(none, df) == 0).all()
    with pytest.raises(ValueError, match="infinite"):
        create_model("gradient_boost", SPEC).fit(df.selectExpr("id", "a", "b", "c", "double('inf') AS y"))


def test_model_comes_back(spark, tmp_path):
    x, y = table(300)
    df = frame(spark, x, y)
    model = create_model("xgboost", SPEC, n_estimators=4).fit(df)
    model.save(str(tmp_path / "m"))
    again = RegressorModel.load(str(tmp_path / "m"))
    assert (predictions(again, df) == predictions(model, df)).all()
    assert again.importance() == model.importance() and again.hyperparameters == model.hyperparameters


def test_sums_on_the_driver_stay_small(spark, monkeypatch):
    """Depth 20 with 13 features: nodes in flight are bounded by the rows, not by 2^20."""
    names = tuple(f"x{i}" for i in range(13))
    df = spark.range(3000).selectExpr("id", *[f"hash(id, {i}) % 997 / 10D AS {n}" for i, n in enumerate(names)])
    df = df.selectExpr("*", "x0 * x1 + x2 AS y")
    monkeypatch.setattr(trees, "LOCAL_ROWS", 500)
    kept, most = trees._pass, []

    def watched(table, rdd, jobs, arrays, wanted, rules, allowed):
        most.append(24 * sum(map(len, wanted)) * int(table.offsets[-1]))
        return kept(table, rdd, jobs, arrays, wanted, rules, allowed)

    monkeypatch.setattr(trees, "_pass", watched)
    spec = FeatureSpec("id", names, target="y")
    create_model("xgboost", spec, n_estimators=1, max_depth=20).fit(df)
    assert most and max(most) < 100 << 20


def test_fits_in_the_same_passes_are_those_of_each_alone(spark, monkeypatch):
    from tabforge.operators.models import fit_all

    monkeypatch.setattr(trees, "LOCAL_ROWS", 150)
    tables = [frame(spark, *table(300, seed, kinds)) for seed, kinds in ((1, (20, 7, 9)), (2, (50, 3, 400)))]
    tables.append(tables[0].selectExpr("id", "a", "b", "c", "1000 * y AS y"))
    wanted = [
        ("random_forest", {"n_estimators": 3, "max_depth": 5}),
        ("gradient_boost", {"n_estimators": 4, "max_depth": 3}),
        ("random_forest", {"n_estimators": 2, "max_depth": 5}),
        ("linear", {"alpha": 1.0}),
    ]
    laid, kept = [], trees.binned

    def counted(*args):
        laid.append(args)
        return kept(*args)

    monkeypatch.setattr(trees, "binned", counted)
    found = fit_all(SPEC, wanted, tables)
    assert len(laid) == len(tables)  # one layout a table, whatever the number of learners
    for (name, params), models in zip(wanted, found, strict=True):
        for model, df in zip(models, tables, strict=True):
            alone = create_model(name, SPEC, **params).fit(df)
            assert model.hyperparameters == alone.hyperparameters
            assert (predictions(model, df) == predictions(alone, df)).all()


def test_training_job_leaves_a_bundle_that_predicts(spark, tmp_path):
    from tabforge.operators import experiments
    from tabforge.sources.bundle import Bundle

    df = frame(spark, *table(200))
    log = experiments.train_job(df, SPEC, "gradient_boost", "v1_median", {"n_estimators": 3}, str(tmp_path / "b"), cv_splits=2)
    found = {r["key"]: r["value"] for r in log.where("kind = 'metric'").collect()}
    bundle = Bundle.load(str(tmp_path / "b"))
    scored = bundle.predict(df)
    error = np.array([r["prediction"] - r["y"] for r in scored.collect()])
    low, high = sorted(float(found[f"{side}_rmse"]) for side in ("train", "test"))
    assert low - 1e-3 <= np.sqrt((error**2).mean()) <= high + 1e-3
    assert bundle.metadata["training_samples"] == 160 and bundle.metadata["test_samples"] == 40
    assert bundle.metadata["cv_metrics"]["cv_rmse_mean"] == float(found["cv_rmse_mean"])
    assert set(bundle.metadata["feature_stats"]) == set(SPEC.features)


def test_histograms_hold_no_empty_columns():
    """The arrays that a pass fills per feature have the width of that feature's bins, not that of all features."""
    rng = np.random.default_rng(3)
    offsets, n, k = np.array([0, 200, 400, 656, 660]), 500, 64
    bins = np.stack([rng.integers(0, w, n) for w in np.diff(offsets)]).astype(np.uint8)
    node, values = rng.integers(0, k, n), np.stack([rng.integers(-9, 9, n), rng.integers(1, 4, n), np.ones(n, np.int64)])
    asked, count = [], np.bincount

    def counted(slot, *rest, minlength=0):
        asked.append(max(minlength, *[r for r in rest if isinstance(r, int)], 0))
        return count(slot, *rest[:1], minlength=max([minlength, *rest[1:]]))

    old, np.bincount = np.bincount, counted
    try:
        sums = trees._sums(bins, np.arange(n), node, values, k, offsets)
    finally:
        np.bincount = old
    assert max(asked) <= k * 256
    for f, (low, high) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for b in range(high - low):
            for c in range(3):
                assert sums[c, :, low + b].sum() == values[c][bins[f] == b].sum()


def test_slots_and_sorted_slots_give_the_same_cuts(monkeypatch):
    rng = np.random.default_rng(4)
    n, k = 3000, 700
    bins = rng.integers(0, 256, (3, n)).astype(np.uint8)
    node = rng.integers(0, k, n).astype(np.uint16)
    values = np.stack([rng.integers(-(2**40), 2**40, n), rng.integers(1, 4, n), np.ones(n, np.int64)])
    rules, made = trees.Rules(depth=3, leaf_rows=2), []
    for slots in (0, 10**9):
        monkeypatch.setattr(trees, "SLOTS_A_ROW", slots)
        made.append(trees.cuts_from_rows(bins, node, values, k, rules, 0.5, np.ones(3, bool)))
    for name in ("feature", "cut", "gain", "total", "left"):
        assert np.array_equal(getattr(made[0], name), getattr(made[1], name))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_rows_dealt_to_subtrees_give_their_disk_back(spark, monkeypatch):
    x, y = table()
    df = frame(spark, x, y)

    def fit():
        return predictions(create_model("random_forest", SPEC, n_estimators=5, max_depth=6).fit(df), df)

    whole, kept, seen = fit(), trees._finish, []

    def watched(table, rdd, jobs, arrays, wanted, *rest):
        before = shuffle_files(spark)
        made = kept(table, rdd, jobs, arrays, wanted, *rest)
        seen.append((sum(rows for nodes in wanted for _, _, rows in nodes), shuffle_files(spark) - before))
        return made

    monkeypatch.setattr(trees, "_finish", watched)
    monkeypatch.setattr(trees, "LOT_ROWS", 0, raising=False)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 150)
    assert (fit() == whole).all()
    assert len(seen) > 1 and all(rows <= 2 * len(y) and not left for rows, left in seen)


def test_subtrees_by_parts_and_joint_counts_are_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    n, offsets = 4000, np.array([0, 50, 61, 63, 319])
    bins = np.stack([rng.integers(0, w, n) for w in np.diff(offsets)]).astype(np.uint8)
    residual, weight = rng.integers(-(2**33), 2**33, n), rng.integers(1, 4, n)
    rules, made = trees.Rules(depth=11, split_rows=4, leaf_rows=2), []
    ways = ((1 << 16, 4, 1, 3), (50, 4, 1, 2), (300, 10**9, 0, 1), (1 << 16, 0.1, 50, 30))
    for near, joint, full, order in ways:
        for name, value in (("NEAR_ROWS", near), ("ROWS_A_SLOT", joint), ("FULL_A_ROW", full), ("ORDER_EVERY", order)):
            monkeypatch.setattr(trees, name, value)
        tree = trees.subtree(bins, residual, weight, 0, rules, 0.5, offsets, np.ones(4, bool))
        made.append((tree.values(bins, np.arange(n)), np.sort(tree.gain)))
    for values, gains in made[1:]:
        assert (values == made[0][0]).all() and (gains == made[0][1]).all()


def test_sums_beyond_the_exact_range_of_doubles():
    values = np.array([[2**52 + 1, 2**52 + 1, -(2**52), 3], [1, 2, 3, 4], [1, 1, 1, 1]])
    add = trees._Adder(values)
    assert add.residuals(np.array([0, 0, 1, 0]), 2).tolist() == [2**53 + 5, -(2**52)]
    assert [x.tolist() for x in add.weights(np.array([0, 0, 1, 0]), 2)] == [[7, 3], [3, 1]]


def test_samples_follow_from_the_hash_as_a_fraction():
    hashes = np.random.RandomState(1).randint(-(2**63), 2**63 - 1, 100_000)
    share = (trees._mixed(hashes, 7, 42) >> np.uint64(11)) / float(2**53)
    want = np.searchsorted(trees._POISSON, share, side="right")
    rows, times = trees._sample(hashes, 7, trees.Rules(1, sampling="bag", seed=42))
    assert (np.flatnonzero(want) == rows).all() and (want[rows] == times).all()
    rows, _ = trees._sample(hashes, 7, trees.Rules(1, sampling="share", share=0.8, seed=42))
    assert (np.flatnonzero(share < 0.8) == rows).all()
