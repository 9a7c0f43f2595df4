"""Catalogue: scoring, monitoring and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions import scalars
from tabforge.functions.hashing import uniform
from tabforge.operators import monitor, scoring
from tabforge.operators.models import create_model
from tabforge.operators.profile import feature_ranges
from tabforge.operators.split import route
from tabforge.operators.strategies import create_strategy
from tabforge.plans.frames import table, u_sql
from tabforge.plans.registry import Catalogue, rounded
from tabforge.session import materialise, scratch_path
from tabforge.sources.bundle import Bundle
from tabforge.sources.requests import parse_batches, parse_records
from tabforge.spec import PREDICTION_SECONDS_BUCKETS, PREDICTION_VALUE_BUCKETS, Constraint, FeatureSpec
from tabforge.streaming import jobs, serve
from tabforge.streaming.reload import ModelSlots

catalogue = Catalogue()
query = catalogue.query

TRAIN_END = "2024-01-08"
RULES = (Constraint("k", ge=0, le=95, integer=True), Constraint("value", ge=0), Constraint("user_id", ge=0))
FEATURES = ("k", "value", "user_id")


def requests_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.floor(F.col("event_id") / 7).alias("batch_id"),
        "ts",
        F.regexp_extract("props", r"(\d+)", 1).alias("k"),
        "value",
        F.col("user_id").cast("double").alias("user_id"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return requests_of(table(spark, sf, "events"))


def training(spark: SparkSession, sf: str) -> DataFrame:
    """The first week, with text turned into numbers."""
    week = requests(spark, sf).where(F.col("ts") < F.lit(TRAIN_END).cast("timestamp_ntz"))
    return week.withColumn("k", F.col("k").cast("double"))


REQUESTS_CTE = f"""requests AS (SELECT event_id, event_id // 7 AS batch_id, ts,
    regexp_extract(props, '(\\d+)', 1)::double AS k, value, user_id::double AS user_id FROM events),
training AS (SELECT * FROM requests WHERE ts < TIMESTAMP '{TRAIN_END}'),
ranges AS (SELECT {', '.join(f'min({f}) AS lo_{f}, max({f}) AS hi_{f}' for f in FEATURES)} FROM training)"""


def _warn_sql(f: str) -> str:
    return f"""CASE WHEN {f} < lo_{f} THEN '{f} (' || {f} || ') is below training min (' || printf('%.2f', lo_{f}) || ')'
      WHEN {f} > hi_{f} THEN '{f} (' || {f} || ') is above training max (' || printf('%.2f', hi_{f}) || ')' END"""


def warned(spark: SparkSession, sf: str) -> DataFrame:
    ranges = scoring.ranges_dict(feature_ranges(training(spark, sf), FEATURES))
    typed = requests(spark, sf).withColumn("k", F.col("k").cast("double"))
    return typed.withColumn("warnings", scoring.range_warnings(FEATURES, ranges))


@query(
    "range_warnings",
    f"""WITH {REQUESTS_CTE} SELECT event_id, concat_ws('; ', {', '.join(_warn_sql(f) for f in FEATURES)}) AS warnings
    FROM requests, ranges""",
)
def range_warnings(spark: SparkSession, sf: str) -> DataFrame:
    texts = scoring.warning_texts(F.col("warnings"))
    return warned(spark, sf).select("event_id", F.concat_ws("; ", texts).alias("warnings"))


@query(
    "out_of_range_counters",
    f"""WITH {REQUESTS_CTE}, hits AS ("""
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CASE WHEN {f} < lo_{f} THEN 'below' ELSE 'above' END AS kind"
        f" FROM requests, ranges WHERE {f} < lo_{f} OR {f} > hi_{f}"
        for f in FEATURES
    )
    + ") SELECT feature, kind, count(*) AS total FROM hits GROUP BY feature, kind",
)
def out_of_range_counters(spark: SparkSession, sf: str) -> DataFrame:
    hits = warned(spark, sf).select(F.inline("warnings"))
    return monitor.counters(hits, ["feature", "kind"])


@query(
    "format_prices",
    """SELECT event_id, round_even(value, 2) AS prediction,
      '$' || format('{:,}', round_even(value * 1000, 0)::bigint) AS prediction_formatted FROM events""",
)
def format_prices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.bround("value", 2).alias("prediction"),
        scalars.money(F.col("value")).alias("prediction_formatted"),
    )


CHAMPION = FeatureSpec("event_id", ("k",), target="value")
CHALLENGER = FeatureSpec("event_id", ("user_id",), target="value")


def models(spark: SparkSession, sf: str):
    """Champion and challenger, trained on the first week."""
    rows = training(spark, sf).select("event_id", "k", "user_id", "value")
    fitted = {
        alias: create_model("linear", spec).fit(rows)
        for alias, spec in (("champion", CHAMPION), ("challenger", CHALLENGER))
    }
    return {alias: (lambda df, m=m: m.transform(df)) for alias, m in fitted.items()}


def _fit_sql(name: str, x: str) -> str:
    return f"""{name} AS (SELECT covar_pop(value, {x}) * count(*) / (var_pop({x}) * count(*) + 1.0) AS b,
      avg(value) AS my, avg({x}) AS mx FROM training)"""


SCORE_CTE = f"""{REQUESTS_CTE}, {_fit_sql('champ', 'k')}, {_fit_sql('chall', 'user_id')},
routed AS (SELECT *, CASE WHEN {u_sql('event_id', ':route')} < 0.7 THEN 'champion' ELSE 'challenger' END AS served_by
  FROM requests WHERE k BETWEEN 0 AND 95 AND value >= 0 AND user_id >= 0),
scored AS (SELECT routed.*, CASE WHEN served_by = 'champion' THEN champ.my + champ.b * (k - champ.mx)
                                 ELSE chall.my + chall.b * (user_id - chall.mx) END AS prediction
  FROM routed, champ, chall)"""

SCORE_SQL = f"""WITH {SCORE_CTE} SELECT event_id, served_by, round(prediction, 2) AS prediction,
  '$' || format('{{:,}}', round_even(round(prediction, 2) * 1000, 0)::bigint) AS prediction_formatted,
  concat_ws('; ', {', '.join(_warn_sql(f) for f in FEATURES)}) AS warnings FROM scored, ranges"""


def _score(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    ranges = scoring.ranges_dict(feature_ranges(training(spark, sf), FEATURES))
    both = models(spark, sf)
    scored = jobs.score(rows, "event_id", RULES, ranges, both["champion"], both["challenger"], 0.7)
    answered = scoring.respond(scored, "0123456789abcdef", "linear")
    return answered.select(
        "event_id",
        "served_by",
        "prediction",
        "prediction_formatted",
        F.concat_ws("; ", "warnings").alias("warnings"),
    )


@query("score_batch", SCORE_SQL)
def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _score(spark, sf, requests(spark, sf))


@query("stream_score", SCORE_SQL)
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """The same scoring on a stream of the events, appended to a prediction log."""
    stream = requests_of(jobs.read_table(spark, sf, "events"))
    return jobs.score_to_table(spark, _score(spark, sf, stream))


@query(
    "stream_quarantine",
    f"""WITH {REQUESTS_CTE} SELECT event_id, value, user_id, k FROM requests
    WHERE NOT coalesce(k BETWEEN 0 AND 95 AND value >= 0 AND user_id >= 0, false)""",
)
def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """What the scoring stream refuses ends in a table of its own; together they hold all requests."""
    stream = requests_of(jobs.read_table(spark, sf, "events"))
    refused = jobs.quarantine_to_table(spark, stream, RULES)
    return refused.select("event_id", "value", "user_id", F.expr("try_cast(k AS double)").alias("k"))


def _bundle_sql(name: str, x: str) -> str:
    """Ridge on the filled and scaled feature, written for the raw one."""
    return f"""{name} AS (SELECT covar_pop(value, {x}) / var_pop({x}) * count(*) / (count(*) + 1.0) AS b,
      avg(value) AS my, avg({x}) AS mx FROM filled)"""


@query(
    "stream_bundle",
    f"""WITH {REQUESTS_CTE}, filled AS (SELECT value, coalesce(k, (SELECT quantile_cont(k, 0.5) FROM training)) AS k,
      coalesce(user_id, (SELECT quantile_cont(user_id, 0.5) FROM training)) AS user_id FROM training),
    {_bundle_sql('champ', 'k')}, {_bundle_sql('chall', 'user_id')},
    routed AS (SELECT *, coalesce(k BETWEEN 0 AND 95 AND value >= 0 AND user_id >= 0, false) AS fine,
      {u_sql('event_id', ':route')} < 0.7 AS first FROM requests)
    SELECT event_id, fine AS scored,
      CASE WHEN fine THEN CASE WHEN first THEN 'champion' ELSE 'challenger' END END AS served_by,
      CASE WHEN fine THEN round(CASE WHEN first THEN champ.my + champ.b * (k - champ.mx)
                                     ELSE chall.my + chall.b * (user_id - chall.mx) END, 4) END AS prediction,
      CASE WHEN fine THEN concat_ws('; ', CASE WHEN first THEN {_warn_sql('k')} ELSE {_warn_sql('user_id')} END) END AS warnings
    FROM routed, champ, chall, ranges""",
)
def stream_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Two saved bundles serve a stream: strategy and model of each, a prediction log and a quarantine."""
    rows = materialise(training(spark, sf).select("event_id", "k", "user_id", "value"), "week")
    folder = scratch_path(spark, "service")
    paths = []
    for alias, spec in (("champion", CHAMPION), ("challenger", CHALLENGER)):
        prepared = create_strategy("v1_median", spec).fit(rows)
        model = create_model("linear", spec).fit(prepared.transform(rows))
        ranges = scoring.ranges_dict(feature_ranges(rows, spec.features))
        made = Bundle.create(model, prepared, rows.count(), ranges=ranges)
        paths.append((alias, made.save(f"{folder}/bundles/{alias}")))
    slots = ModelSlots(lambda: spark.createDataFrame(paths, "alias string, path string"), Bundle.load)
    stream = requests_of(jobs.read_table(spark, sf, "events"))
    serve.run_service(stream, slots, "event_id", RULES, folder, 0.7)
    scores = serve.read_log(spark, folder, "scores").select(
        "event_id",
        F.lit(True).alias("scored"),
        "served_by",
        scalars.half_away("prediction", 4).alias("prediction"),
        F.concat_ws("; ", scoring.warning_texts(F.col("warnings"))).alias("warnings"),
    )
    refused = serve.read_log(spark, folder, "refused").select("event_id", F.lit(False).alias("scored"))
    return scores.unionByName(refused, allowMissingColumns=True)


_JSON_FIELDS = ("event_id", *FEATURES)
_JSON_SQL = f"""WITH {REQUESTS_CTE}, sent AS (SELECT *, event_id % 50 = 7 AS broken FROM requests)
SELECT CASE WHEN NOT broken THEN event_id::double END AS event_id, {', '.join(f'CASE WHEN NOT broken THEN {f} END AS {f}' for f in FEATURES)},
  CASE WHEN broken THEN 'no json' WHEN coalesce(k BETWEEN 0 AND 95 AND value >= 0 AND user_id >= 0, false) THEN 'accepted'
       ELSE 'refused' END AS verdict FROM sent"""


def _inbox(spark: SparkSession, sf: str) -> str:
    """The events as lines of JSON, those with ``event_id % 50 = 7`` cut short."""
    text = F.to_json(F.struct(*_JSON_FIELDS))
    line = F.when(F.col("event_id") % 50 == 7, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    folder = scratch_path(spark, "inbox")
    requests(spark, sf).select(line.alias("value")).write.text(folder)
    return folder


def _judged(lines: DataFrame) -> DataFrame:
    parsed = parse_records(lines.withColumnRenamed("value", "payload"), "payload", _JSON_FIELDS)
    broken = F.col(serve.CORRUPT).isNotNull()
    verdict = F.when(broken, "no json").when(F.size("errors") > 0, "refused").otherwise("accepted")
    fields = [F.when(~broken, F.col(f).try_cast("double")).alias(f) for f in _JSON_FIELDS]
    return serve.checked(parsed, RULES).select(*fields, verdict.alias("verdict"))


@query("requests_json", _JSON_SQL)
def requests_json(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as lines of JSON: parsed, checked, and told apart from text that is no JSON."""
    return _judged(spark.read.text(_inbox(spark, sf)))


@query("stream_requests_json", _JSON_SQL)
def stream_requests_json(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines read as a stream."""
    return jobs.score_to_table(spark, _judged(spark.readStream.text(_inbox(spark, sf))), "judged")


@query(
    "request_lists",
    """SELECT event_id // 7 AS batch_id, row_number() OVER (PARTITION BY event_id // 7 ORDER BY event_id) - 1 AS item_index,
      event_id::double AS event_id, value FROM events""",
)
def request_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Batches sent as one JSON list each, seven items at most, taken apart again."""
    items = F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("items")
    sent = requests(spark, sf).groupBy("batch_id").agg(items)
    payloads = sent.select("batch_id", F.to_json(F.struct("items")).alias("payload"))
    rows = parse_batches(payloads, "payload", ("event_id", "value"))
    numbers = [F.col(f).try_cast("double").alias(f) for f in ("event_id", "value")]
    return rows.select("batch_id", F.col("item_index").cast("bigint").alias("item_index"), *numbers)


@query(
    "refused_batches",
    """SELECT user_id AS batch_id, count(*) AS total_items,
      'Value error, Batch size ' || count(*) || ' exceeds maximum allowed (20)' AS message
    FROM events GROUP BY user_id HAVING count(*) > 20""",
)
def refused_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("batch_id"))
    return scoring.refusals(rows, "batch_id", 20)


@query(
    "batch_envelope",
    f"""WITH numbered AS (SELECT event_id // 7 AS batch_id, value, event_id,
      row_number() OVER (PARTITION BY event_id // 7 ORDER BY event_id) - 1 AS i FROM events)
    SELECT batch_id, CASE WHEN {u_sql('batch_id', ':route')} < 0.5 THEN 'champion' ELSE 'challenger' END AS served_by,
      'linear' AS model_type, count(*)::int AS total_items,
      string_agg(i || ':' || '$' || format('{{:,}}', round_even(value * 1000, 0)::bigint), ' ' ORDER BY i) AS predictions
    FROM numbered GROUP BY batch_id""",
)
def batch_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded values as predictions; a batch is served by one model."""
    scored = requests(spark, sf).select(
        "batch_id",
        "event_id",
        F.col("value").alias("prediction"),
        F.array().cast(scoring.WARNING_TYPE).alias("warnings"),
        route(F.col("batch_id")).alias("served_by"),
    )
    answered = scoring.respond(scored, "0123456789abcdef", "linear")
    whole = scoring.envelope(answered, "batch_id", "event_id", ["served_by", "model_type"])
    items = F.transform("predictions", lambda p: F.concat(p["index"], F.lit(":"), p["prediction_formatted"]))
    return whole.withColumn("predictions", F.concat_ws(" ", items))


# --- monitoring -----------------------------------------------------------------------------


def traffic(spark: SparkSession, sf: str) -> DataFrame:
    """Events as served requests: endpoint, status, serving model, seconds and predicted value."""
    key = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", "503").otherwise("200").alias("status_code"),
        route(key, weight=0.7).alias("model_alias"),
        (uniform(key, ":seconds") * 0.6).alias("seconds"),
        F.col("value").alias("prediction"),
    )


TRAFFIC_CTE = f"""traffic AS (SELECT event_id, ts, event_type AS endpoint,
    CASE WHEN event_type = 'error' THEN '503' ELSE '200' END AS status_code,
    CASE WHEN {u_sql('event_id', ':route')} < 0.7 THEN 'champion' ELSE 'challenger' END AS model_alias,
    {u_sql('event_id', ':seconds')} * 0.6::double AS seconds, value AS prediction FROM events)"""


def _text(df: DataFrame) -> DataFrame:
    """Window starts as text, so that no client shifts them to its own time zone."""
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def _windows_sql(source: str, width: str, slide: str, back: str) -> str:
    pane = f"time_bucket(INTERVAL '{slide}', ts)"
    return f"""(SELECT *, unnest(generate_series({pane} - INTERVAL '{back}', {pane}, INTERVAL '{slide}')) AS w
      FROM {source})"""


_START = "strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start"
_RATE = "count(*) AS n, round(count(*) / 300, 6) AS per_second, round(count(*) / 300 * 60, 6) AS per_minute"


@query(
    "traffic_rate_5m",
    f"""WITH {TRAFFIC_CTE} SELECT {_START}, {_RATE}
    FROM {_windows_sql('traffic', '5 minutes', '1 minute', '4 minutes')} GROUP BY w""",
)
def traffic_rate_5m(spark: SparkSession, sf: str) -> DataFrame:
    rates = monitor.sliding_rates(traffic(spark, sf), "ts", "5 minutes", "1 minute", 300)
    return _text(rounded(rates, "per_second", "per_minute"))


@query(
    "rate_by_label",
    f"""WITH {TRAFFIC_CTE} SELECT {_START}, endpoint, model_alias, {_RATE}
    FROM {_windows_sql('traffic', '5 minutes', '1 minute', '4 minutes')} GROUP BY w, endpoint, model_alias""",
)
def rate_by_label(spark: SparkSession, sf: str) -> DataFrame:
    labels = ["endpoint", "model_alias"]
    rates = monitor.sliding_rates(traffic(spark, sf), "ts", "5 minutes", "1 minute", 300, labels)
    return _text(rounded(rates, "per_second", "per_minute"))


@query(
    "error_rate",
    f"""WITH {TRAFFIC_CTE} SELECT {_START}, {_RATE} FROM {_windows_sql(
        "(SELECT * FROM traffic WHERE regexp_full_match(status_code, '5..'))", '5 minutes', '1 minute', '4 minutes')}
    GROUP BY w""",
)
def error_rate(spark: SparkSession, sf: str) -> DataFrame:
    errors = traffic(spark, sf).where(scalars.is_server_error(F.col("status_code")))
    return _text(rounded(monitor.sliding_rates(errors, "ts", "5 minutes", "1 minute", 300), "per_second", "per_minute"))


_HITS_CTE = REQUESTS_CTE + ", hits AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, ts FROM requests, ranges WHERE {f} < lo_{f} OR {f} > hi_{f}" for f in FEATURES
) + ")"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return warned(spark, sf).select("ts", F.explode("warnings.feature").alias("feature"))


@query(
    "drift_features_1h",
    f"""WITH {_HITS_CTE}, drift AS (SELECT w, count(DISTINCT feature) AS n
      FROM {_windows_sql('hits', '1 hour', '15 minutes', '45 minutes')} GROUP BY w),
    spine AS (SELECT unnest(generate_series(min(time_bucket(INTERVAL '15 minutes', ts)) - INTERVAL '45 minutes',
                max(time_bucket(INTERVAL '15 minutes', ts)), INTERVAL '15 minutes')) AS w FROM events)
    SELECT {_START}, coalesce(n, 0) AS features_in_drift FROM spine LEFT JOIN drift USING (w)""",
)
def drift_features_1h(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("ts")
    return _text(monitor.drifting_features(events, _hits(spark, sf), "ts", "1 hour", "15 minutes"))


@query(
    "increase_by_feature_1h",
    f"""WITH {_HITS_CTE} SELECT {_START}, feature, count(*) AS n
    FROM {_windows_sql('hits', '1 hour', '15 minutes', '45 minutes')} GROUP BY w, feature""",
)
def increase_by_feature_1h(spark: SparkSession, sf: str) -> DataFrame:
    return _text(monitor.sliding_counts(_hits(spark, sf), "ts", "1 hour", "15 minutes", ["feature"]))


@query(
    "champion_share",
    f"""WITH {TRAFFIC_CTE}, shares AS (SELECT w, count(*) AS n, count(*) FILTER (model_alias = 'champion') AS c
      FROM {_windows_sql('traffic', '5 minutes', '1 minute', '4 minutes')} GROUP BY w),
    spine AS (SELECT unnest(generate_series(min(time_bucket(INTERVAL '1 minute', ts)) - INTERVAL '4 minutes',
                max(time_bucket(INTERVAL '1 minute', ts)), INTERVAL '1 minute')) AS w FROM events)
    SELECT {_START}, coalesce(n, 0) AS n, round(coalesce(c / n * 100, 50), 6) AS champion_pct
    FROM spine LEFT JOIN shares USING (w)""",
)
def champion_share(spark: SparkSession, sf: str) -> DataFrame:
    shares = monitor.champion_share(traffic(spark, sf), "ts", "model_alias", "5 minutes", "1 minute")
    return _text(rounded(shares, "champion_pct"))


def _buckets_sql(value: str, buckets) -> str:
    return ", ".join(f"count(*) FILTER ({value} <= {le}) AS le_{i}" for i, le in enumerate(buckets))


_LE_ROWS = " UNION ALL ".join(
    f"SELECT model_alias, count, sum, '{le:g}' AS le, le_{i} AS bucket_count FROM wide"
    for i, le in enumerate(PREDICTION_VALUE_BUCKETS)
) + " UNION ALL SELECT model_alias, count, sum, '+Inf', count FROM wide"


@query(
    "histogram_buckets",
    f"""WITH {TRAFFIC_CTE}, wide AS (SELECT model_alias, {_buckets_sql('prediction', PREDICTION_VALUE_BUCKETS)},
      count(*) AS count, round(sum(prediction), 4) AS sum FROM traffic GROUP BY model_alias) {_LE_ROWS}""",
)
def histogram_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = monitor.histogram(
        traffic(spark, sf), F.col("prediction"), PREDICTION_VALUE_BUCKETS, ["model_alias"]
    )
    return rounded(rows, "sum", digits=4)


def _quantile_sql(q: float, buckets) -> str:
    cases = []
    for i, le in enumerate(buckets):
        start, before = (0, "0") if i == 0 else (buckets[i - 1], f"le_{i - 1}")
        cases.append(f"WHEN le_{i} >= count * {q}::double THEN {start} + {le - start}::double * ((count * {q}::double - {before}) / (le_{i} - {before}))")
    return f"CASE {' '.join(cases)} ELSE {buckets[-1]} END"


@query(
    "histogram_quantiles",
    f"""WITH {TRAFFIC_CTE}, wide AS (SELECT w, {_buckets_sql('prediction', PREDICTION_VALUE_BUCKETS)}, count(*) AS count
      FROM {_windows_sql('traffic', '5 minutes', '1 minute', '4 minutes')} GROUP BY w)
    SELECT {_START}, round({_quantile_sql(0.5, PREDICTION_VALUE_BUCKETS)}, 9) AS p50,
           round({_quantile_sql(0.9, PREDICTION_VALUE_BUCKETS)}, 9) AS p90 FROM wide""",
)
def histogram_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = monitor.sliding_histogram(
        traffic(spark, sf), "ts", F.col("prediction"), PREDICTION_VALUE_BUCKETS, "5 minutes", "1 minute"
    )
    with_q = monitor.with_quantiles(rows, PREDICTION_VALUE_BUCKETS, {"p50": 0.5, "p90": 0.9})
    return _text(rounded(with_q, "p50", "p90", digits=9).select("window_start", "p50", "p90"))


@query(
    "latency_p95_by_model",
    f"""WITH {TRAFFIC_CTE}, wide AS (SELECT w, model_alias, {_buckets_sql('seconds', PREDICTION_SECONDS_BUCKETS)},
      count(*) AS count FROM {_windows_sql('traffic', '1 hour', '15 minutes', '45 minutes')} GROUP BY w, model_alias)
    SELECT {_START}, model_alias, round({_quantile_sql(0.95, PREDICTION_SECONDS_BUCKETS)}, 9) AS p95 FROM wide""",
)
def latency_p95_by_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = monitor.sliding_histogram(
        traffic(spark, sf), "ts", F.col("seconds"), PREDICTION_SECONDS_BUCKETS, "1 hour", "15 minutes", ["model_alias"]
    )
    with_q = monitor.with_quantiles(rows, PREDICTION_SECONDS_BUCKETS, {"p95": 0.95})
    return _text(rounded(with_q, "p95", digits=9).select("window_start", "model_alias", "p95"))


@query(
    "bucket_distribution",
    f"""WITH {TRAFFIC_CTE} SELECT {_START}, {_buckets_sql('prediction', PREDICTION_VALUE_BUCKETS)}, count(*) AS count,
      round(sum(prediction), 4) AS sum
    FROM {_windows_sql('traffic', '1 hour', '15 minutes', '45 minutes')} GROUP BY w""",
)
def bucket_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = monitor.sliding_histogram(
        traffic(spark, sf), "ts", F.col("prediction"), PREDICTION_VALUE_BUCKETS, "1 hour", "15 minutes"
    )
    return _text(rounded(rows, "sum", digits=4))


@query(
    "request_counters",
    f"WITH {TRAFFIC_CTE} SELECT endpoint, status_code, model_alias, count(*) AS total FROM traffic GROUP BY ALL",
)
def request_counters(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.counters(traffic(spark, sf), ["endpoint", "status_code", "model_alias"])


# --- streaming ------------------------------------------------------------------------------


@query(
    "stream_counts",
    "SELECT event_type, count(*) AS total FROM events GROUP BY event_type",
)
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = jobs.running_counters(jobs.read_table(spark, sf, "events"), ["event_type"])
    return jobs.latest_snapshot(spark, jobs.run_snapshots(counted, scratch_path(spark, "counters"))).select(
        "event_type", "total"
    )


@query(
    "stream_windows",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n
    FROM (SELECT *, time_bucket(INTERVAL '1 day', ts) AS w, max(ts) OVER () AS newest FROM events)
    WHERE w + INTERVAL '1 day' <= newest - INTERVAL '10 minutes' GROUP BY w, event_type""",
)
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts whose window the watermark has passed; the open last day is held back."""
    counted = jobs.windowed_counts(
        jobs.read_table(spark, sf, "events"), "ts", "1 day", "1 day", ["event_type"]
    )
    return _text(jobs.score_to_table(spark, counted, "windows"))


@query(
    "stream_quantiles",
    f"""WITH {TRAFFIC_CTE}, wide AS (SELECT w, {_buckets_sql('prediction', PREDICTION_VALUE_BUCKETS)}, count(*) AS count
      FROM {_windows_sql('traffic', '5 minutes', '1 minute', '4 minutes')}
      WHERE w + INTERVAL '5 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY w)
    SELECT {_START}, count AS n, round({_quantile_sql(0.5, PREDICTION_VALUE_BUCKETS)}, 9) AS p50,
           round({_quantile_sql(0.9, PREDICTION_VALUE_BUCKETS)}, 9) AS p90 FROM wide""",
)
def stream_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """The quantiles of ``histogram_quantiles`` for every window that the watermark has closed."""
    stream = jobs.read_table(spark, sf, "events").select("ts", F.col("value").alias("prediction"))
    found = jobs.windowed_quantiles(
        stream, "ts", F.col("prediction"), PREDICTION_VALUE_BUCKETS, {"p50": 0.5, "p90": 0.9}, "5 minutes", "1 minute"
    )
    return _text(
        rounded(jobs.score_to_table(spark, found, "quantiles"), "p50", "p90", digits=9).withColumnRenamed("count", "n")
    )


@query(
    "stream_drift",
    f"""WITH {_HITS_CTE} SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
      count(DISTINCT feature) AS features_in_drift FROM hits
    WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM requests) - INTERVAL '10 minutes'
    GROUP BY 1""",
)
def stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    ranges = scoring.ranges_dict(feature_ranges(training(spark, sf), FEATURES))
    stream = requests_of(jobs.read_table(spark, sf, "events")).withColumn("k", F.col("k").cast("double"))
    marked = stream.withColumn("warnings", scoring.range_warnings(FEATURES, ranges))
    return _text(jobs.score_to_table(spark, jobs.windowed_drift(marked, "ts", "1 hour"), "drift"))
