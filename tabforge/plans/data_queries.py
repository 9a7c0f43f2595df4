"""Catalogue: profiles, validation, splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.hashing import fingerprint, hash_below
from tabforge.functions.scalars import half_away
from tabforge.operators import profile, split, validate
from tabforge.plans.frames import (
    FRAME,
    FRAME_CTE,
    NULLS_CTE,
    frame,
    frame_nulls,
    rank_sql,
    split_sql,
    table,
    u_sql,
    with_nan,
)
from tabforge.plans.registry import Catalogue, rounded, union_sql
from tabforge.session import materialise
from tabforge.spec import Constraint

catalogue = Catalogue()
query = catalogue.query


# --- profiles -------------------------------------------------------------------------------

_NULLS_TOTAL = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in FRAME.columns)


_SUMMARY_SQL = f"WITH {NULLS_CTE} " + union_sql(
    FRAME.columns,
    "SELECT '{c}' AS column_name, count(*) AS n_rows, 7 AS n_columns,"
    f" count(*) FILTER ({{c}} IS NULL) AS n_missing, {_NULLS_TOTAL} AS total_missing FROM frame_nulls",
)


@query("profile_nan", _SUMMARY_SQL)
def profile_nan(spark: SparkSession, sf: str) -> DataFrame:
    """NaN counts as a gap like NULL."""
    return profile.summary(with_nan(frame_nulls(spark, sf), "row_key", FRAME.features).select(*FRAME.columns))


@query("profile_summary", _SUMMARY_SQL)
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return profile.summary(frame_nulls(spark, sf).select(*FRAME.columns))


@query(
    "column_info",
    f"WITH {NULLS_CTE} "
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, 'double' AS dtype, count({c}) AS non_null FROM frame_nulls"
        for i, c in enumerate(FRAME.columns)
    ),
)
def column_info(spark: SparkSession, sf: str) -> DataFrame:
    return profile.info(frame_nulls(spark, sf).select(*FRAME.columns))


_DESCRIBED = ("l_quantity", "l_discount", "p_retailprice", "y")
_DESCRIBE_SQL = """SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM frame_nulls"""


@query("describe_numeric", f"WITH {NULLS_CTE} " + union_sql(_DESCRIBED, _DESCRIBE_SQL))
def describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialise(frame_nulls(spark, sf).select(*_DESCRIBED), "described")
    described = profile.describe(rows, _DESCRIBED)
    return rounded(described, "mean", "std", "min", "p25", "p50", "p75", "max")


@query(
    "histogram30",
    """WITH edges AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    counts AS (SELECT least(floor((value - lo) / ((hi - lo) / 30)), 29)::int AS bin, count(*) AS n
               FROM events, edges GROUP BY 1)
    SELECT b::int AS bin, round(lo + b * ((hi - lo) / 30), 6) AS left_edge, coalesce(n, 0) AS n
    FROM range(30) r(b) CROSS JOIN edges LEFT JOIN counts ON counts.bin = r.b""",
)
def histogram30(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.histogram(table(spark, sf, "events"), "value", 30), "left_edge")


@query(
    "complete_cases",
    f"WITH {NULLS_CTE} SELECT row_key, "
    + ", ".join(FRAME.features)
    + " FROM frame_nulls WHERE "
    + " AND ".join(f"{f} IS NOT NULL" for f in FRAME.features),
)
def complete_cases(spark: SparkSession, sf: str) -> DataFrame:
    return profile.complete_cases(frame_nulls(spark, sf).select("row_key", *FRAME.features))


@query(
    "head_rows",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
)
def head_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return profile.head(orders, [F.desc("o_totalprice"), "o_orderkey"], 5)


@query(
    "feature_target_projection",
    f"WITH {FRAME_CTE} SELECT row_key, {', '.join(FRAME.features)}, round(y, 6) AS y FROM frame",
)
def feature_target_projection(spark: SparkSession, sf: str) -> DataFrame:
    projected = frame(spark, sf).select("row_key", *FRAME.features, FRAME.target)
    return rounded(projected, "y")


@query(
    "drop_column",
    "SELECT event_id, ts, user_id, event_type, value FROM events",
)
def drop_column(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").drop("props")


_FINGERPRINT_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "cents", "o_orderpriority")


@query(
    "fingerprint",
    """WITH texts AS (SELECT md5(concat(length(a), ':', a, length(b), ':', b, length(c), ':', c, length(d), ':', d,
                       length(e), ':', e)) AS h
      FROM (SELECT o_orderkey::varchar AS a, o_custkey::varchar AS b, o_orderstatus AS c,
                   (round(o_totalprice * 100)::bigint)::varchar AS d, o_orderpriority AS e FROM orders)),
    sums AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::bigint::hugeint) AS l,
                    sum(('0x' || substr(h, 16, 15))::bigint::hugeint) AS r FROM texts)
    SELECT substr(md5(concat_ws('|',
             'o_orderkey bigint,o_custkey bigint,o_orderstatus string,cents bigint,o_orderpriority string', n, l, r)), 1, 12)
           AS fingerprint, n FROM sums""",
)
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return fingerprint(orders.select(*_FINGERPRINT_COLUMNS))


_STATS_SQL = """SELECT '{c}' AS feature, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM parted WHERE split = 'train'"""


@query(
    "feature_stats",
    f"WITH {NULLS_CTE}, {split_sql('frame_nulls')} " + union_sql(FRAME.features, _STATS_SQL),
)
def feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    train = split.train_test_split(frame_nulls(spark, sf), "row_key").where("split = 'train'")
    return rounded(profile.feature_stats(train, FRAME.features), "min", "max", "mean", "std")


_RANGES_SQL = "SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max FROM parted WHERE split = 'train'"


@query(
    "feature_ranges",
    f"WITH {NULLS_CTE}, {split_sql('frame_nulls')} " + union_sql(FRAME.features, _RANGES_SQL),
)
def feature_ranges(spark: SparkSession, sf: str) -> DataFrame:
    train = split.train_test_split(frame_nulls(spark, sf), "row_key").where("split = 'train'")
    return profile.feature_ranges(train, FRAME.features)


# --- validation -----------------------------------------------------------------------------

RULES = (
    Constraint("amount", ge=0, le=300),
    Constraint("k", ge=1, le=90, integer=True),
    Constraint("user", gt=10),
)


def raw_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as text, a few of them broken: not a number, absent, or a fraction."""
    events = table(spark, sf, "events")
    key = F.col("event_id")
    k = F.regexp_extract("props", r"(\d+)", 1)
    return events.select(
        "event_id",
        F.floor(key / 7).alias("batch_id"),
        F.when(hash_below(key, ":text", 0.01), F.lit("not_a_number"))
        .when(hash_below(key, ":null", 0.01), F.lit(None))
        .otherwise(F.format_string("%.2f", "value"))
        .alias("amount"),
        F.when(hash_below(key, ":half", 0.01), F.concat(k, F.lit(".5"))).otherwise(k).alias("k"),
        F.col("user_id").cast("string").alias("user"),
    )


RAW_CTE = f"""raw AS (
  SELECT event_id, event_id // 7 AS batch_id,
    CASE WHEN {u_sql('event_id', ':text')} < 0.01 THEN 'not_a_number'
         WHEN {u_sql('event_id', ':null')} < 0.01 THEN NULL
         ELSE printf('%.2f', value) END AS amount,
    CASE WHEN {u_sql('event_id', ':half')} < 0.01 THEN regexp_extract(props, '(\\d+)', 1) || '.5'
         ELSE regexp_extract(props, '(\\d+)', 1) END AS k,
    user_id::varchar AS "user"
  FROM events),
messages AS (
  SELECT *,
    CASE WHEN amount IS NULL THEN 'Input should be a valid number'
         WHEN try_cast(amount AS double) IS NULL
           THEN 'Input should be a valid number, unable to parse string as a number'
         WHEN amount::double < 0 THEN 'Input should be greater than or equal to 0'
         WHEN amount::double > 300 THEN 'Input should be less than or equal to 300' END AS m1,
    CASE WHEN k::double <> floor(k::double)
           THEN 'Input should be a valid integer, got a number with a fractional part'
         WHEN k::double < 1 THEN 'Input should be greater than or equal to 1'
         WHEN k::double > 90 THEN 'Input should be less than or equal to 90' END AS m2,
    CASE WHEN "user"::double <= 10 THEN 'Input should be greater than 10' END AS m3
  FROM raw)"""


@query(
    "validate_rows",
    f"""WITH {RAW_CTE} SELECT event_id,
      (m1 IS NOT NULL)::int + (m2 IS NOT NULL)::int + (m3 IS NOT NULL)::int AS n_errors,
      concat_ws(';', 'body.amount:' || m1, 'body.k:' || m2, 'body.user:' || m3) AS errors_text
    FROM messages""",
)
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    checked = validate.with_errors(raw_requests(spark, sf), RULES)
    texts = F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["message"]))
    return checked.select(
        "event_id", F.size("errors").alias("n_errors"), F.concat_ws(";", texts).alias("errors_text")
    )


@query(
    "quarantine_rows",
    f"""WITH {RAW_CTE}, listed AS (
      SELECT event_id, 'body.amount' AS field, m1 AS message, amount AS value FROM messages
      UNION ALL SELECT event_id, 'body.k', m2, k FROM messages
      UNION ALL SELECT event_id, 'body.user', m3, "user" FROM messages)
    SELECT event_id, field, message, value FROM listed WHERE message IS NOT NULL""",
)
def quarantine_rows(spark: SparkSession, sf: str) -> DataFrame:
    checked = validate.with_errors(raw_requests(spark, sf), RULES)
    return validate.quarantined(checked).select("event_id", F.inline("errors"))


@query(
    "accepted_rows",
    f"""WITH {RAW_CTE} SELECT event_id, batch_id, amount::double AS amount, k::bigint AS k,
    "user"::double AS "user" FROM messages WHERE m1 IS NULL AND m2 IS NULL AND m3 IS NULL""",
)
def accepted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return validate.accepted(validate.with_errors(raw_requests(spark, sf), RULES), RULES)


INTEGER_RULES = (Constraint("user", ge=1, integer=True),)


@query(
    "accepted_integers",
    """SELECT event_id, user_id::bigint AS "user" FROM events WHERE user_id >= 1 AND event_id % 4 <> 3""",
)
def accepted_integers(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers in several spellings; those with a fraction are refused, not cut."""
    number = F.col("user_id").cast("string")
    spelled = F.when(F.col("event_id") % 4 == 1, F.concat(number, F.lit(".0")))
    spelled = spelled.when(F.col("event_id") % 4 == 2, F.concat(number, F.lit("e0")))
    spelled = spelled.when(F.col("event_id") % 4 == 3, F.concat(number, F.lit(".5"))).otherwise(number)
    rows = table(spark, sf, "events").select("event_id", spelled.alias("user"))
    return validate.accepted(validate.with_errors(rows, INTEGER_RULES), INTEGER_RULES)


@query(
    "batch_all_or_nothing",
    f"""WITH {RAW_CTE}, judged AS (
      SELECT *, bool_and(m1 IS NULL AND m2 IS NULL AND m3 IS NULL) OVER (PARTITION BY batch_id) AS fine
      FROM messages)
    SELECT event_id, batch_id FROM judged WHERE fine""",
)
def batch_all_or_nothing(spark: SparkSession, sf: str) -> DataFrame:
    checked = validate.with_errors(raw_requests(spark, sf), RULES)
    return validate.serve_batches(checked, "batch_id").select("event_id", "batch_id")


@query(
    "batch_size_bound",
    """SELECT user_id AS batch_id, count(*) AS total_items, count(*) BETWEEN 1 AND 100 AS size_ok,
      CASE WHEN count(*) > 100
           THEN 'Value error, Batch size ' || count(*) || ' exceeds maximum allowed (100)' END AS message
    FROM events GROUP BY user_id""",
)
def batch_size_bound(spark: SparkSession, sf: str) -> DataFrame:
    batches = table(spark, sf, "events").select("event_id", F.col("user_id").alias("batch_id"))
    verdicts = validate.batch_verdicts(batches, "batch_id")
    return verdicts.select(
        "batch_id", "total_items", "size_ok", validate.batch_message(F.col("total_items")).alias("message")
    )


# --- splits ---------------------------------------------------------------------------------


@query(
    "split_exact",
    f"WITH {FRAME_CTE}, {split_sql('frame')} SELECT row_key, split FROM parted",
)
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return split.train_test_split(frame(spark, sf).select("row_key"), "row_key")


@query(
    "sample_counts",
    f"WITH {FRAME_CTE}, {split_sql('frame')} SELECT split, count(*) AS n FROM parted GROUP BY split",
)
def sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    parted = split.train_test_split(frame(spark, sf).select("row_key"), "row_key")
    return parted.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_FOLDS = f"""folds AS (SELECT row_key, ntile(5) OVER (ORDER BY {rank_sql('row_key', ':fold:42')}) - 1 AS fold
  FROM frame)"""


@query(
    "fold_assignment",
    f"WITH {FRAME_CTE}, {_FOLDS} SELECT row_key, fold::int AS fold FROM folds",
)
def fold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return split.kfold(frame(spark, sf).select("row_key"), "row_key")


@query(
    "kfold_sizes",
    f"WITH {FRAME_CTE}, {_FOLDS} SELECT fold::int AS fold, count(*) AS n FROM folds GROUP BY fold",
)
def kfold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    folds = split.kfold(frame(spark, sf).select("row_key"), "row_key")
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "contiguous_folds",
    f"""WITH {FRAME_CTE} SELECT row_key,
      (ntile(7) OVER (ORDER BY l_orderkey, {rank_sql('row_key', ':order')}) - 1)::int AS fold FROM frame""",
)
def contiguous_folds(spark: SparkSession, sf: str) -> DataFrame:
    rows = frame(spark, sf).select("row_key", "l_orderkey")
    return split.kfold(rows, "row_key", 7, shuffle=False, order=["l_orderkey"]).select("row_key", "fold")


FRACTIONS = tuple(np.linspace(0.1, 1.0, 10).tolist())
PREFIX_CTE = f"""ordered AS (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, {rank_sql('row_key', ':order')}) - 1 AS pos,
         count(*) OVER () AS total,
         ntile(5) OVER (ORDER BY l_orderkey, {rank_sql('row_key', ':order')}) - 1 AS own
  FROM frame),
sizes AS (SELECT DISTINCT floor(f * largest)::bigint AS size
  FROM (SELECT count(*) FILTER (own <> 0) AS largest FROM ordered),
       (SELECT unnest([{', '.join(repr(f) + '::double' for f in FRACTIONS)}]) AS f)),
train_pos AS (
  SELECT o.*, k.fold, row_number() OVER (PARTITION BY k.fold ORDER BY pos) AS train_rank
  FROM ordered o JOIN (SELECT unnest(range(5)) AS fold) k ON o.own <> k.fold)"""


@query(
    "train_prefixes",
    f"""WITH {FRAME_CTE}, {PREFIX_CTE}
    SELECT fold::int AS fold, size, 'train' AS part, count(*) AS n, sum(l_quantity)::bigint AS quantity
    FROM train_pos JOIN sizes ON train_rank <= size GROUP BY fold, size
    UNION ALL
    SELECT own::int, size, 'test', count(*), sum(l_quantity)::bigint FROM ordered CROSS JOIN sizes GROUP BY own, size""",
)
def train_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and summed quantity of every training prefix and validation fold."""
    rows = frame(spark, sf).select("row_key", "l_orderkey", "l_quantity")
    segments, plan = split.prefix_segments(rows, "row_key", 5, FRACTIONS, ["l_orderkey"])
    per_segment = segments.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )
    members = [
        (step["fold"], step["size"], part, segment)
        for step in plan
        for part in ("train", "test")
        for segment in step[part]
    ]
    wanted = spark.createDataFrame(members, "fold int, size bigint, part string, segment int")
    return (
        wanted.join(per_segment, "segment")
        .groupBy("fold", "size", "part")
        .agg(F.sum("n").alias("n"), F.sum("quantity").cast("bigint").alias("quantity"))
    )


# --- routing and jitter ---------------------------------------------------------------------


@query(
    "route_rows",
    f"""SELECT event_id, CASE WHEN {u_sql('event_id', ':route')} < 0.7 THEN 'champion' ELSE 'challenger' END
      AS served_by FROM events""",
)
def route_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select("event_id", split.route(F.col("event_id"), weight=0.7).alias("served_by"))


@query(
    "route_share",
    f"""WITH routed AS (SELECT event_type, {u_sql('event_id', ':route')} < 0.7 AS c FROM events)
    SELECT event_type, count(*) AS n, round(count(*) FILTER (c) / count(*), 6) AS champion,
      round(count(*) FILTER (NOT c) / count(*), 6) AS challenger, 0.7::double AS configured_champion,
      0.3::double AS configured_challenger FROM routed GROUP BY event_type""",
)
def route_share(spark: SparkSession, sf: str) -> DataFrame:
    configured = split.effective_split(True, True, 0.7)
    served = split.route(F.col("event_id"), weight=0.7).alias("served_by")
    routed = table(spark, sf, "events").select("event_type", served)
    n = F.count(F.lit(1))
    return routed.groupBy("event_type").agg(
        n.alias("n"),
        *[half_away(F.count_if(F.col("served_by") == a) / n, 6).alias(a) for a in configured],
        *[F.lit(w).alias(f"configured_{a}") for a, w in configured.items()],
    )


@query(
    "route_batches",
    f"""SELECT event_id, event_id // 7 AS batch_id,
      CASE WHEN {u_sql('event_id // 7', ':route')} < 0.5 THEN 'champion' ELSE 'challenger' END AS served_by
    FROM events""",
)
def route_batches(spark: SparkSession, sf: str) -> DataFrame:
    batches = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 7).alias("batch_id"))
    return batches.withColumn("served_by", split.route(F.col("batch_id")))


@query(
    "jitter_rows",
    f"""WITH swung AS (SELECT event_id, value, user_id,
      ({u_sql('event_id', ':jitter:value')} * 2 - 1) * 0.2::double AS a,
      ({u_sql('event_id', ':jitter:user_id')} * 2 - 1) * 0.2::double AS b FROM events)
    SELECT event_id,
      round(greatest(least(value + a * CASE WHEN value = 0 THEN 1 ELSE abs(value) END, 400), 0), 4) AS value,
      round_even(greatest(user_id + b * user_id, 0), 0)::bigint AS user_id FROM swung""",
)
def jitter_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "value", "user_id")
    return split.jitter(events, "event_id", {"value": (0, 400), "user_id": (0, None)}, ["user_id"])
