"""Catalogue: metrics, models, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import experiments, metrics, resample
from tabforge.operators.models import create_model, importance_table
from tabforge.operators.split import train_test_split
from tabforge.operators.strategies import create_strategy
from tabforge.plans.data_queries import FRACTIONS, PREFIX_CTE
from tabforge.plans.frames import (
    FRAME,
    FRAME_CTE,
    NULLS_CTE,
    SCORED_CTE,
    frame,
    frame_nulls,
    rank_sql,
    scored,
    split_sql,
    table,
)
from tabforge.plans.prep_queries import parted
from tabforge.plans.registry import Catalogue, rounded
from tabforge.session import materialise
from tabforge.spec import FeatureSpec

catalogue = Catalogue()
query = catalogue.query

METRICS_SQL = """round(sqrt(avg((y - prediction) ** 2)), 4) AS rmse,
  round(avg(abs(y - prediction)), 4) AS mae,
  round(1 - sum((y - prediction) ** 2) / (count(*) * var_pop(y)), 4) AS r2,
  round(coalesce(avg(abs((y - prediction) / y)) FILTER (y <> 0), 0) * 100, 4) AS mape,
  round(avg((abs(y - prediction) / greatest(abs(y), 1e-8) <= 0.1)::int) * 100, 4) AS accuracy_within_10pct"""


@query("regression_metrics", f"WITH {SCORED_CTE} SELECT {METRICS_SQL} FROM scored")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.regression_metrics(scored(spark, sf), "y", "prediction")


@query(
    "metrics_by_group",
    f"WITH {SCORED_CTE} SELECT is_open, p_size, count(*) AS n, {METRICS_SQL} FROM scored GROUP BY is_open, p_size",
)
def metrics_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.regression_metrics(scored(spark, sf), "y", "prediction", ["is_open", "p_size"], count="n")


_SPLIT_SCORED = f"{SCORED_CTE}, {split_sql('scored')}"
_BOTH = f"per AS (SELECT split, {METRICS_SQL} FROM parted GROUP BY split)"


@query(
    "overfit_report",
    f"WITH {_SPLIT_SCORED}, {_BOTH} SELECT "
    + ", ".join(
        f"max({m}) FILTER (split = '{s}') AS {s}_{m}" for s in ("train", "test") for m in metrics.METRICS
    )
    + ", max(r2) FILTER (split = 'train') - max(r2) FILTER (split = 'test') > 0.1 AS overfitting_warning FROM per",
)
def overfit_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.overfit_report(train_test_split(scored(spark, sf), "row_key"), "y", "prediction")


@query(
    "metrics_comparison",
    f"WITH {_SPLIT_SCORED}, {_BOTH} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, max({m}) FILTER (split = 'train') AS train,"
        f" max({m}) FILTER (split = 'test') AS test FROM per"
        for m in metrics.METRICS
    ),
)
def metrics_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.comparison(train_test_split(scored(spark, sf), "row_key"), "y", "prediction")


ONE = FeatureSpec("row_key", ("l_quantity",), target="y")
_SLOPE = "covar_pop(y, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1.0)"


@query(
    "ridge_one_feature",
    f"""WITH {FRAME_CTE}, fit AS (SELECT {_SLOPE} AS b, avg(y) AS my, avg(l_quantity) AS mx FROM frame)
    SELECT row_key, round(my + b * (l_quantity - mx), 4) AS prediction FROM frame, fit""",
)
def ridge_one_feature(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialise(frame(spark, sf).select("row_key", "l_quantity", "y"), "ridge")
    fitted = create_model("linear", ONE, alpha=1.0).fit(rows)
    return rounded(fitted.transform(rows).select("row_key", "prediction"), "prediction", digits=4)


_CV_CTE = f"""folds AS (SELECT *, ntile(5) OVER (ORDER BY {rank_sql('row_key', ':fold:42')}) - 1 AS fold FROM frame),
fits AS (SELECT k, {_SLOPE} AS b, avg(y) AS my, avg(l_quantity) AS mx, count(*) AS n_train
         FROM (SELECT unnest(range(5)) AS k) JOIN folds ON fold <> k GROUP BY k),
cv AS (SELECT fold::int AS fold, any_value(n_train) AS n_train, count(*) AS n_test,
         sqrt(avg((y - my - b * (l_quantity - mx)) ** 2)) AS rmse,
         1 - sum((y - my - b * (l_quantity - mx)) ** 2) / (count(*) * var_pop(y)) AS r2
       FROM folds JOIN fits ON fold = k GROUP BY fold)"""


@query(
    "cv_ridge",
    f"""WITH {FRAME_CTE}, {_CV_CTE} SELECT fold, n_train, n_test, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM cv""",
)
def cv_ridge(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.cross_validate_ridge(frame(spark, sf), ONE), "rmse", "r2")


@query(
    "cv_summary",
    f"""WITH {FRAME_CTE}, {_CV_CTE} SELECT round(avg(rmse), 4) AS cv_rmse_mean, round(stddev_pop(rmse), 4) AS cv_rmse_std,
      round(avg(r2), 4) AS cv_r2_mean, round(stddev_pop(r2), 4) AS cv_r2_std, count(*) AS n_splits FROM cv""",
)
def cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fold_summary(resample.cross_validate_ridge(frame(spark, sf), ONE))


@query(
    "cv_table",
    f"""WITH {FRAME_CTE}, {_CV_CTE}
    SELECT 'RMSE' AS metric, printf('%.4f', round(avg(rmse), 4)) AS mean,
           printf('± %.4f', round(stddev_pop(rmse), 4)) AS std FROM cv
    UNION ALL SELECT 'R²', printf('%.4f', round(avg(r2), 4)), printf('± %.4f', round(stddev_pop(r2), 4)) FROM cv""",
)
def cv_table(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fold_table(metrics.fold_summary(resample.cross_validate_ridge(frame(spark, sf), ONE)))


_ALL_SPEC = FeatureSpec("row_key", FRAME.features, target="y")


@query(
    "learning_curve_ridge",
    f"""WITH {FRAME_CTE}, {PREFIX_CTE},
    fits AS (SELECT fold, size, {_SLOPE} AS b, avg(y) AS my, avg(l_quantity) AS mx
             FROM train_pos JOIN sizes ON train_rank <= size GROUP BY fold, size),
    train_scores AS (SELECT t.fold, s.size, sqrt(avg((y - my - b * (l_quantity - mx)) ** 2)) AS train_rmse
      FROM train_pos t JOIN sizes s ON train_rank <= s.size JOIN fits f ON f.fold = t.fold AND f.size = s.size
      GROUP BY t.fold, s.size),
    val_scores AS (SELECT f.fold, f.size, sqrt(avg((y - my - b * (l_quantity - mx)) ** 2)) AS val_rmse
      FROM ordered o JOIN fits f ON f.fold = o.own GROUP BY f.fold, f.size),
    curve AS (SELECT size AS train_size, avg(train_rmse) AS tm, stddev_pop(train_rmse) AS ts,
                     avg(val_rmse) AS vm, stddev_pop(val_rmse) AS vs
              FROM train_scores JOIN val_scores USING (fold, size) GROUP BY size),
    gap AS (SELECT max_by(vm - tm, train_size) AS g FROM curve)
    SELECT train_size, round(tm, 4) AS train_mean, round(ts, 4) AS train_std, round(vm, 4) AS val_mean,
      round(vs, 4) AS val_std, round(g, 4) AS gap_at_full_data, g > 0.15 AS is_overfitting FROM curve, gap""",
)
def learning_curve_ridge(spark: SparkSession, sf: str) -> DataFrame:
    curve = resample.learning_curve_ridge(frame(spark, sf), ONE, ["l_orderkey"], FRACTIONS)
    return resample.curve_summary(curve)


@query("cv_ridge_all_features")
def cv_ridge_all_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.cross_validate_ridge(frame(spark, sf), _ALL_SPEC), "rmse", "r2")


@query("cv_forest")
def cv_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Strategy and forest fitted anew in every fold."""
    scores = resample.cross_validate(frame_nulls(spark, sf), FRAME, "random_forest", strategy="v1_median")
    return rounded(scores, "rmse", "r2", digits=4)


def fit_and_score(spark: SparkSession, sf: str, strategy: str, model: str, **params) -> DataFrame:
    """Train and test metrics of a model fitted on the training side of the split."""
    rows = parted(spark, sf)
    prepared = create_strategy(strategy, FRAME).fit(rows.where("split = 'train'")).transform(rows)
    fitted = create_model(model, FRAME, **params).fit(prepared.where("split = 'train'"))
    return metrics.regression_metrics(fitted.transform(prepared), "y", "prediction", ["split"])


@query("train_linear")
def train_linear(spark: SparkSession, sf: str) -> DataFrame:
    return fit_and_score(spark, sf, "v1_median", "linear")


@query("train_forest")
def train_forest(spark: SparkSession, sf: str) -> DataFrame:
    return fit_and_score(spark, sf, "v4_robust_col", "random_forest")


@query("train_gbt")
def train_gbt(spark: SparkSession, sf: str) -> DataFrame:
    return fit_and_score(spark, sf, "v1_median", "gradient_boost")


@query("train_regularised_gbt")
def train_regularised_gbt(spark: SparkSession, sf: str) -> DataFrame:
    return fit_and_score(spark, sf, "v4_robust_col", "xgboost")


@query("importance_topn")
def importance_topn(spark: SparkSession, sf: str) -> DataFrame:
    rows = frame(spark, sf)
    fitted = create_model("random_forest", FRAME).fit(rows)
    return rounded(importance_table(spark, fitted, 5), "importance", digits=4)


TWO = FeatureSpec("row_key", ("l_quantity", "l_discount"), target="y")
# Ridge on two features in closed form: Cramer's rule on the centred cross products.
_TWO_CTE = f"""{FRAME_CTE}, sums AS (
  SELECT var_pop(l_quantity) * count(*) + 1.0 AS aa, var_pop(l_discount) * count(*) + 1.0 AS bb,
    covar_pop(l_quantity, l_discount) * count(*) AS ab, covar_pop(y, l_quantity) * count(*) AS ay,
    covar_pop(y, l_discount) * count(*) AS by_, avg(y) AS my, avg(l_quantity) AS ma, avg(l_discount) AS mb FROM frame),
fit AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM sums)"""


def _ridge_two(spark: SparkSession, sf: str):
    rows = materialise(frame(spark, sf).select("row_key", *TWO.features, "y"), "ridge")
    return rows, create_model("linear", TWO, alpha=1.0).fit(rows)


@query(
    "ridge_two_features",
    f"""WITH {_TWO_CTE} SELECT row_key,
      round(my + wa * (l_quantity - ma) + wb * (l_discount - mb), 4) AS prediction FROM frame, fit""",
)
def ridge_two_features(spark: SparkSession, sf: str) -> DataFrame:
    rows, fitted = _ridge_two(spark, sf)
    return rounded(fitted.transform(rows).select("row_key", "prediction"), "prediction", digits=4)


@query(
    "linear_importance",
    f"""WITH {_TWO_CTE}, w AS (
      SELECT 'l_quantity' AS feature, abs(wa) AS w FROM fit UNION ALL SELECT 'l_discount', abs(wb) FROM fit)
    SELECT feature, round(w / (SELECT sum(w) FROM w), 6) AS importance,
      rank() OVER (ORDER BY w DESC)::int AS rank FROM w""",
)
def linear_importance(spark: SparkSession, sf: str) -> DataFrame:
    _, fitted = _ridge_two(spark, sf)
    return rounded(importance_table(spark, fitted), "importance")


_JOB_SIDES = " UNION ALL ".join(
    f"SELECT '{side}_{m}' AS key, {m} AS value FROM per WHERE split = '{side}'"
    for side in ("train", "test")
    for m in metrics.METRICS
)

# Median, scaler and regression of every fold from the rows of the other four.
_JOB_FOLDS = f"""dealt AS (SELECT *, ntile(5) OVER (ORDER BY {rank_sql('row_key', ':fold:42')}) - 1 AS fold FROM train),
    fold_med AS (SELECT k, quantile_cont(l_quantity, 0.5) AS m FROM dealt, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY k),
    fold_filled AS (SELECT k, fold, y, coalesce(l_quantity, m) AS x FROM dealt, fold_med),
    fold_s AS (SELECT k, avg(x) AS mx, stddev_pop(x) AS sx FROM fold_filled WHERE fold <> k GROUP BY k),
    fold_z AS (SELECT k, fold, y, (x - mx) / sx AS z FROM fold_filled JOIN fold_s USING (k)),
    fold_fit AS (SELECT k, covar_pop(y, z) * count(*) / (var_pop(z) * count(*) + 1.0) AS b, avg(y) AS my, avg(z) AS mz
      FROM fold_z WHERE fold <> k GROUP BY k),
    fold_scores AS (SELECT k, sqrt(avg((y - my - b * (z - mz)) ** 2)) AS rmse,
      1 - sum((y - my - b * (z - mz)) ** 2) / (count(*) * var_pop(y)) AS r2
      FROM fold_z JOIN fold_fit USING (k) WHERE fold = k GROUP BY k)"""


@query(
    "train_job",
    f"""WITH {NULLS_CTE}, {split_sql('frame_nulls')}, train AS (SELECT * FROM parted WHERE split = 'train'),
    med AS (SELECT quantile_cont(l_quantity, 0.5) AS m FROM train),
    filled AS (SELECT row_key, split, y, coalesce(l_quantity, m) AS x FROM parted, med),
    s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx FROM filled WHERE split = 'train'),
    scaled AS (SELECT split, y, (x - mx) / sx AS z FROM filled, s),
    fit AS (SELECT covar_pop(y, z) * count(*) / (var_pop(z) * count(*) + 1.0) AS b, avg(y) AS my, avg(z) AS mz
            FROM scaled WHERE split = 'train'),
    scored AS (SELECT split, y, my + b * (z - mz) AS prediction FROM scaled, fit),
    per AS (SELECT split, {METRICS_SQL} FROM scored GROUP BY split), {_JOB_FOLDS}
    {_JOB_SIDES} UNION ALL SELECT unnest(['cv_rmse_mean', 'cv_rmse_std', 'cv_r2_mean', 'cv_r2_std']),
      unnest([round(avg(rmse), 4), round(stddev_pop(rmse), 4), round(avg(r2), 4), round(stddev_pop(r2), 4)]) FROM fold_scores""",
)
def train_job(spark: SparkSession, sf: str) -> DataFrame:
    """The metric rows that a whole training run, with its five folds, writes to its log."""
    rows = frame_nulls(spark, sf).select("row_key", "l_quantity", "y")
    log = experiments.train_job(rows, ONE, "linear", "v1_median", {"alpha": 1.0})
    sides = [f"{side}_{m}" for side in ("train", "test") for m in metrics.METRICS]
    sides += [f"cv_{m}_{how}" for m in ("rmse", "r2") for how in ("mean", "std")]
    return log.where(F.col("key").isin(sides)).select("key", F.col("value").cast("double").alias("value"))


# --- trees of depth 1, whose whole training SQL can follow ------------------------------------

_SIDES = " UNION ALL ".join(
    f"SELECT '{f}' AS f, {f} AS v, sum(r) AS g, count(*) AS n FROM {{before}} GROUP BY {f}" for f in TWO.features
)
_LEFT = "(CASE WHEN f = 'l_quantity' THEN l_quantity ELSE l_discount END) <= v"


def _stump_sql(stage: int, leaf: str, score: str, shrink: float, leaf_rows: int) -> str:
    """CTEs of one more tree: ``leaf`` and ``score`` are formulas of {g} and {n}, the sums of a side."""
    before, left, right = f"s{stage - 1}", {"g": "gl", "n": "nl"}, {"g": "(gt - gl)", "n": "(nt - nl)"}
    gain = f"{score.format(**left)} + {score.format(**right)}"
    step = f"{shrink} * CASE WHEN {_LEFT} THEN {leaf.format(**left)} ELSE {leaf.format(**right)} END"
    return f"""c{stage} AS (SELECT f, v, sum(g) OVER w AS gl, sum(n) OVER w AS nl, gt, nt FROM ({_SIDES.format(before=before)}),
      (SELECT sum(r) AS gt, count(*) AS nt FROM {before}) WINDOW w AS (PARTITION BY f ORDER BY v)),
    b{stage} AS (SELECT * FROM c{stage} WHERE nl >= {leaf_rows} AND nt - nl >= {leaf_rows} ORDER BY {gain} DESC LIMIT 1),
    s{stage} AS (SELECT row_key, l_quantity, l_discount, r - {step} AS r, p + {step} AS p FROM {before}, b{stage})"""


_START = f"""{FRAME_CTE}, s0 AS (SELECT row_key, l_quantity, l_discount, y - m AS r, m AS p
  FROM frame, (SELECT avg(y) AS m FROM frame))"""
_MEAN, _SQUARE = "({g} / {n})", "({g} * {g} / {n})"
_SOFT = "(sign({g}) * greatest(abs({g}) - 0.1, 0))"
_PREDICTED = "SELECT row_key, round(p, 4) AS prediction FROM s{}"


def _stumps(spark: SparkSession, sf: str, model: str, **params) -> DataFrame:
    rows = materialise(frame(spark, sf).select("row_key", *TWO.features, "y"), "stump")
    fitted = create_model(model, TWO, max_depth=1, **params).fit(rows)
    return rounded(fitted.transform(rows).select("row_key", "prediction"), "prediction", digits=4)


@query("forest_stump", f"WITH {_START}, {_stump_sql(1, _MEAN, _SQUARE, 1, 3)} {_PREDICTED.format(1)}")
def forest_stump(spark: SparkSession, sf: str) -> DataFrame:
    return _stumps(spark, sf, "random_forest", n_estimators=1, bootstrap=False)


@query(
    "gbt_stump",
    f"WITH {_START}, {_stump_sql(1, _MEAN, _SQUARE, 0.1, 3)}, {_stump_sql(2, _MEAN, _SQUARE, 0.1, 3)} {_PREDICTED.format(2)}",
)
def gbt_stump(spark: SparkSession, sf: str) -> DataFrame:
    """The mean and two shrunk trees."""
    return _stumps(spark, sf, "gradient_boost", n_estimators=2, subsample=1.0)


_PENALISED = (f"({_SOFT} / ({{n}} + 1.0))", f"({_SOFT} * {_SOFT} / ({{n}} + 1.0))", 0.1, 1)


@query(
    "regularised_gbt_stump",
    f"WITH {_START}, {_stump_sql(1, *_PENALISED)}, {_stump_sql(2, *_PENALISED)} {_PREDICTED.format(2)}",
)
def regularised_gbt_stump(spark: SparkSession, sf: str) -> DataFrame:
    return _stumps(spark, sf, "xgboost", n_estimators=2, subsample=1.0, colsample_bytree=1.0)
