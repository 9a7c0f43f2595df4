"""Catalogue: imputation, scaling and the preprocessing strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.scalars import half_away
from tabforge.operators import impute, iterative, knn
from tabforge.operators.order_stats import quantiles
from tabforge.operators.split import written_split
from tabforge.operators.strategies import create_strategy
from tabforge.plans.frames import (
    FRAME,
    FRAME_CTE,
    NULLS_CTE,
    PARTS,
    PARTS_CTE,
    frame,
    frame_nulls,
    part_nulls,
    rank_sql,
    split_sql,
    with_nan,
)
from tabforge.plans.registry import Catalogue, rounded
from tabforge.session import materialise

catalogue = Catalogue()
query = catalogue.query

FEATURES, NUMERIC = FRAME.features, FRAME.numeric
_NULLS_SPLIT = f"{NULLS_CTE}, {split_sql('frame_nulls')}, train AS (SELECT * FROM parted WHERE split = 'train')"


def _each(template: str, columns=FEATURES) -> str:
    return ", ".join(template.format(c=c) for c in columns)


def parted(spark: SparkSession, sf: str) -> DataFrame:
    """The split rows, written once: fitting reads them several times."""
    rows = frame_nulls(spark, sf).select("row_key", *FRAME.columns)
    return written_split(rows, "row_key")


@query(
    "impute_median",
    f"""WITH {_NULLS_SPLIT}, med AS (SELECT {_each('quantile_cont({c}, 0.5) AS med_{c}')} FROM train)
    SELECT row_key, {_each('round(coalesce({c}, med_{c}), 6) AS {c}')} FROM parted, med""",
)
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    rows = parted(spark, sf)
    medians = impute.MedianFit(rows.where("split = 'train'"), FEATURES).medians
    return rows.select("row_key", *[half_away(impute.filled(f, m), 6).alias(f) for f, m in medians.items()])


@query(
    "impute_mode",
    f"WITH {_NULLS_SPLIT}, "
    + ", ".join(
        f"m_{c} AS (SELECT {c} AS mode_{c} FROM train WHERE {c} IS NOT NULL GROUP BY {c}"
        f" ORDER BY count(*) DESC, {c} LIMIT 1)"
        for c in ("is_open", "l_quantity", "p_size")
    )
    + """ SELECT row_key, coalesce(is_open, mode_is_open) AS is_open,
      coalesce(l_quantity, mode_l_quantity) AS l_quantity, coalesce(p_size, mode_p_size) AS p_size
    FROM parted, m_is_open, m_l_quantity, m_p_size""",
)
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    rows = parted(spark, sf)
    found = impute.modes(rows.where("split = 'train'"), ["is_open", "l_quantity", "p_size"])
    return rows.select("row_key", *[impute.filled(f, m).alias(f) for f, m in found.items()])


@query(
    "scale_standard",
    f"""WITH {FRAME_CTE}, s AS (SELECT {_each('avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}')} FROM frame)
    SELECT row_key, {_each('round(({c} - m_{c}) / s_{c}, 6) AS {c}')} FROM frame, s""",
)
def scale_standard(spark: SparkSession, sf: str) -> DataFrame:
    rows = frame(spark, sf)
    center, scale = impute.standard_scale(rows, FEATURES)
    return rows.select(
        "row_key", *[half_away((F.col(f) - center[f]) / scale[f], 6).alias(f) for f in FEATURES]
    )


@query(
    "scale_robust",
    f"""WITH {FRAME_CTE}, s AS (SELECT {_each(
        'quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}',
        NUMERIC)} FROM frame)
    SELECT row_key, {_each(
        'round(({c} - m_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE b_{c} - a_{c} END, 6) AS {c}', NUMERIC)}
    FROM frame, s""",
)
def scale_robust(spark: SparkSession, sf: str) -> DataFrame:
    rows = frame(spark, sf)
    cuts = quantiles(rows, NUMERIC, (0.25, 0.5, 0.75))
    return rows.select(
        "row_key",
        *[
            half_away((F.col(f) - cuts[f][1]) / impute.safe_scale(cuts[f][2] - cuts[f][0]), 6).alias(f)
            for f in NUMERIC
        ],
    )


def _run_strategy(name: str, spark: SparkSession, sf: str, nan: bool = False) -> DataFrame:
    """Fits on the training rows only, then transforms both sides of the split."""
    rows = parted(spark, sf)
    if nan:
        rows = with_nan(rows, "row_key", FEATURES)
    model = create_strategy(name, FRAME).fit(rows.where("split = 'train'"))
    return rounded(model.transform(rows).select("row_key", "split", *FEATURES), *FEATURES)


_V1_SQL = (
    f"""WITH {_NULLS_SPLIT}, med AS (SELECT {_each('quantile_cont({c}, 0.5) AS med_{c}')} FROM train),
    filled AS (SELECT row_key, split, {_each('coalesce({c}, med_{c}) AS {c}')} FROM parted, med),
    s AS (SELECT {_each('avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}')} FROM filled WHERE split = 'train')
    SELECT row_key, split, {_each('round(({c} - m_{c}) / s_{c}, 6) AS {c}')} FROM filled, s"""
)


@query("strategy_v1_nan", _V1_SQL)
def strategy_v1_nan(spark: SparkSession, sf: str) -> DataFrame:
    return _run_strategy("v1_median", spark, sf, nan=True)


@query("strategy_v1", _V1_SQL)
def strategy_v1(spark: SparkSession, sf: str) -> DataFrame:
    return _run_strategy("v1_median", spark, sf)


_V4_SQL = (
    f"""WITH {_NULLS_SPLIT}, med AS (SELECT {_each('quantile_cont({c}, 0.5) AS med_{c}', NUMERIC)} FROM train),
    top AS (SELECT is_open AS mode_is_open FROM train WHERE is_open IS NOT NULL GROUP BY is_open
            ORDER BY count(*) DESC, is_open LIMIT 1),
    filled AS (SELECT row_key, split, {_each('coalesce({c}, med_{c}) AS {c}', NUMERIC)},
               coalesce(is_open, mode_is_open) AS is_open FROM parted, med, top),
    s AS (SELECT {_each(
        'quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}',
        NUMERIC)} FROM filled WHERE split = 'train')
    SELECT row_key, split, is_open, {_each('round(({c} - m_{c}) / (b_{c} - a_{c}), 6) AS {c}', NUMERIC)}
    FROM filled, s"""
)


@query("strategy_v4_nan", _V4_SQL)
def strategy_v4_nan(spark: SparkSession, sf: str) -> DataFrame:
    return _run_strategy("v4_robust_col", spark, sf, nan=True)


@query("strategy_v4", _V4_SQL)
def strategy_v4(spark: SparkSession, sf: str) -> DataFrame:
    return _run_strategy("v4_robust_col", spark, sf)


def _nearest_sql(source: str, train: str) -> str:
    """CTEs that impute ``source`` from the rows of ``train`` by comparing all of them."""
    feats = PARTS.features
    common = " + ".join(f"(r.{f} IS NOT NULL AND d.{f} IS NOT NULL)::int" for f in feats)
    total = " + ".join(f"coalesce((r.{f} - d.{f}) * (r.{f} - d.{f}), 0)" for f in feats)
    ctes, picks = [], []
    for f in feats:
        ctes.append(f"""d_{f} AS (
          SELECT r.p_partkey, d.{f} AS v, ({total}) * 3 / nullif({common}, 0) AS dist
          FROM {source} r, {train} d WHERE r.{f} IS NULL AND d.{f} IS NOT NULL AND ({common}) > 0),
        k_{f} AS (SELECT p_partkey, avg(v) AS v FROM (
            SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY dist, v) AS n FROM d_{f})
          WHERE n <= 5 GROUP BY p_partkey),
        a_{f} AS (SELECT avg({f}) AS v FROM {train})""")
        picks.append(
            f"coalesce({f}, (SELECT v FROM k_{f} WHERE k_{f}.p_partkey = s.p_partkey), (SELECT v FROM a_{f})) AS {f}"
        )
    return ", ".join(ctes) + f", full_rows AS (SELECT s.* EXCLUDE ({', '.join(feats)}), {', '.join(picks)} FROM {source} s)"


_KNN_SQL = f"""WITH {PARTS_CTE}, {_nearest_sql('part_nulls', 'part_nulls')}
    SELECT p_partkey, {_each('round({c}, 6) AS {c}', PARTS.features)} FROM full_rows"""


@query("impute_knn_nan", _KNN_SQL)
def impute_knn_nan(spark: SparkSession, sf: str) -> DataFrame:
    parts = with_nan(part_nulls(spark, sf), "p_partkey", PARTS.features)
    return rounded(knn.impute(parts, knn.fit(parts, PARTS.features, 5)), *PARTS.features)


@query("impute_knn", _KNN_SQL)
def impute_knn(spark: SparkSession, sf: str) -> DataFrame:
    parts = part_nulls(spark, sf)
    state = knn.fit(parts, PARTS.features, 5)
    return rounded(knn.impute(parts, state), *PARTS.features)


_PARTS_SPLIT = f"""{PARTS_CTE}, parted AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {rank_sql('p_partkey', ':split:42')})
                      <= ceil(count(*) OVER () * 0.2::double) THEN 'test' ELSE 'train' END AS split
  FROM part_nulls), train AS (SELECT * FROM parted WHERE split = 'train')"""


@query(
    "strategy_v2",
    f"""WITH {_PARTS_SPLIT}, {_nearest_sql('parted', 'train')},
    s AS (SELECT {_each('avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}', PARTS.features)}
          FROM full_rows WHERE split = 'train')
    SELECT p_partkey, split, {_each('round(({c} - m_{c}) / s_{c}, 6) AS {c}', PARTS.features)} FROM full_rows, s""",
)
def strategy_v2(spark: SparkSession, sf: str) -> DataFrame:
    rows = written_split(part_nulls(spark, sf), "p_partkey")
    model = create_strategy("v2_knn", PARTS).fit(rows.where("split = 'train'"))
    return rounded(model.transform(rows), *PARTS.features)


@query("strategy_v2_frame")
def strategy_v2_frame(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the frame; too many pairs for SQL, so the operator is tested on a small table."""
    return _run_strategy("v2_knn", spark, sf)


@query("strategy_v3")
def strategy_v3(spark: SparkSession, sf: str) -> DataFrame:
    return _run_strategy("v3_iterative", spark, sf)


def _evidence_sql(source: str, x: str, y: str) -> str:
    """CTEs up to ``line (slope, mx, my)``: ridge with one feature whose penalty follows from the evidence."""
    return f"""known AS (SELECT {x}::double AS x, {y}::double AS y FROM {source} WHERE {y} IS NOT NULL),
    mid AS (SELECT count(*)::double AS n, avg(x) AS mx, avg(y) AS my FROM known),
    sums AS (SELECT n, mx, my, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy,
                    sum((y - my) * (y - my)) AS yy FROM known, mid GROUP BY n, mx, my),
    ev(i, noise, prior, w, last) AS (
      SELECT 0, 1 / (yy / n + 2.220446049250313e-16), 1::double, NULL::double, false FROM sums
      UNION ALL
      SELECT i + 1, (n - used + 2e-6) / (err + 2e-6), (used + 2e-6) / (slope * slope + 2e-6), slope,
             i > 0 AND abs(w - slope) < 1e-3
      FROM (SELECT *, greatest(yy - 2 * slope * xy + slope * slope * xx, 0) AS err,
                   noise * xx / (prior + noise * xx) AS used
            FROM (SELECT *, xy / (xx + prior / noise) AS slope FROM ev, sums WHERE NOT last AND i < 300))),
    line AS (SELECT xy / (xx + prior / noise) AS slope, mx, my FROM ev, sums ORDER BY i DESC LIMIT 1)"""


@query(
    "iterative_two_features",
    f"""WITH RECURSIVE {PARTS_CTE}, sized AS (SELECT p_partkey, p_size, p_price FROM part_nulls WHERE p_size IS NOT NULL),
    {_evidence_sql('sized', 'p_size', 'p_price')}
    SELECT p_partkey, round(p_size::double, 6) AS p_size,
           round(coalesce(p_price, my + slope * (p_size - mx)), 6) AS p_price FROM sized, line""",
)
def iterative_two_features(spark: SparkSession, sf: str) -> DataFrame:
    """One feature has gaps and the other has none, so that one regression decides."""
    sized = part_nulls(spark, sf).where("p_size IS NOT NULL").select("p_partkey", "p_size", "p_price")
    state = iterative.fit(sized, ["p_size", "p_price"])
    return rounded(iterative.impute(sized, state), "p_size", "p_price")
