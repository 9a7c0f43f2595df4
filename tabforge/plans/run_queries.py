"""Catalogue: grids, runs, leaderboards, versions and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions import scalars
from tabforge.functions.hashing import uniform
from tabforge.operators import experiments, registry, validate
from tabforge.plans.frames import FRAME, frame_nulls, table, u_sql
from tabforge.plans.registry import Catalogue
from tabforge.session import scratch_path
from tabforge.sources import runlog
from tabforge.sources.store import Change, Snapshot, TableStore

catalogue = Catalogue()
query = catalogue.query


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a training run; one in fifty has no metrics, one in five no cross-validation."""
    key = F.col("o_orderkey")
    rmse, r2 = F.col("o_totalprice") / 100000, 1 - F.col("o_totalprice") / 1000000
    none = F.lit(None).cast("map<string,double>")
    tested = F.create_map(F.lit("rmse"), rmse, F.lit("r2"), r2)
    cv = F.create_map(F.lit("cv_rmse_mean"), rmse * 2, F.lit("cv_r2_mean"), r2 / 2)
    n = F.when(uniform(key, ":n") < 0.8, F.lit("n_estimators"))
    keys = F.array_compact(F.array(n, F.lit("max_depth")))
    values = F.when(n.isNotNull(), F.array((key % 600).cast("string"), (key % 25).cast("string"))).otherwise(
        F.array((key % 25).cast("string"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.md5(key.cast("string")).alias("run_id"),
        F.concat(F.lit("model-"), F.col("o_custkey") % 1000).alias("model"),
        F.col("o_orderdate").alias("start"),
        F.col("o_orderpriority").alias("model_type"),
        F.col("o_orderstatus").alias("preprocessing"),
        F.map_from_arrays(keys, values).alias("hyperparameters"),
        F.when(uniform(key, ":tested") >= 0.02, tested).otherwise(none).alias("test_metrics"),
        F.when(uniform(key, ":cv") >= 0.2, cv).otherwise(none).alias("cv_metrics"),
    )


RUNS_CTE = f"""runs AS (SELECT o_orderkey, md5(o_orderkey::varchar) AS run_id, 'model-' || (o_custkey % 1000) AS model,
    o_orderdate AS start, o_orderpriority AS model_type, o_orderstatus AS preprocessing,
    CASE WHEN {u_sql('o_orderkey', ':n')} < 0.8 THEN (o_orderkey % 600)::varchar END AS hp_n,
    (o_orderkey % 25)::varchar AS hp_d,
    CASE WHEN {u_sql('o_orderkey', ':tested')} >= 0.02 THEN o_totalprice / 100000 END AS rmse,
    CASE WHEN {u_sql('o_orderkey', ':tested')} >= 0.02 THEN 1 - o_totalprice / 1000000 END AS r2,
    CASE WHEN {u_sql('o_orderkey', ':cv')} >= 0.2 THEN o_totalprice / 100000 * 2 END AS cv_rmse,
    CASE WHEN {u_sql('o_orderkey', ':cv')} >= 0.2 THEN (1 - o_totalprice / 1000000) / 2 END AS cv_r2
  FROM orders)"""


@query(
    "grid_configs",
    """WITH m AS (SELECT DISTINCT o_orderpriority AS model_type FROM orders),
    p AS (SELECT DISTINCT o_orderstatus AS preprocessing FROM orders),
    n AS (SELECT DISTINCT month(o_orderdate)::varchar AS n FROM orders),
    d AS (SELECT DISTINCT year(o_orderdate)::varchar AS d FROM orders)
    SELECT model_type, preprocessing, n AS n_estimators, d AS max_depth,
           model_type || '_' || preprocessing || ' (n=' || n || ', d=' || d || ')' AS display_name
    FROM m, p, n, d WHERE model_type <> '5-LOW'
    UNION ALL SELECT model_type, preprocessing, NULL, NULL, model_type || '_' || preprocessing
    FROM m, p WHERE model_type = '5-LOW'""",
)
def grid_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Models, strategies and options are the distinct labels, months and years of the orders."""
    orders = table(spark, sf, "orders")
    grid = orders.agg(
        F.collect_set("o_orderpriority").alias("models"),
        F.collect_set("o_orderstatus").alias("preprocessors"),
        F.collect_set(F.month("o_orderdate").cast("string")).alias("n"),
        F.collect_set(F.year("o_orderdate").cast("string")).alias("d"),
    )
    options = F.create_map(F.lit("n_estimators"), F.col("n"), F.lit("max_depth"), F.col("d"))
    tuned = F.filter("models", lambda m: m != "5-LOW")
    grid = grid.select(
        "models",
        "preprocessors",
        F.map_from_arrays(tuned, F.transform(tuned, lambda _: options)).alias("hyperparameters"),
    )
    hyper = F.col("hyperparameters")
    return experiments.expand_grid(grid).select(
        "model_type",
        "preprocessing",
        hyper["n_estimators"].alias("n_estimators"),
        hyper["max_depth"].alias("max_depth"),
        scalars.display_name(F.col("model_type"), F.col("preprocessing"), hyper).alias("display_name"),
    )


@query(
    "hyperparameter_bounds",
    f"""WITH {RUNS_CTE}, long AS (
      SELECT run_id, CASE WHEN model_type < '3' THEN 'random_forest' ELSE 'gradient_boost' END AS model_type,
             'n_estimators' AS parameter, hp_n AS value FROM runs WHERE hp_n IS NOT NULL
      UNION ALL
      SELECT run_id, CASE WHEN model_type < '3' THEN 'random_forest' ELSE 'gradient_boost' END, 'max_depth', hp_d FROM runs)
    SELECT *, CASE WHEN parameter = 'n_estimators' AND value::int < 10 THEN 'Value must be >= 10'
                   WHEN parameter = 'n_estimators' AND value::int > 500 THEN 'Value must be <= 500'
                   WHEN parameter = 'max_depth' AND value::int < 1 THEN 'Value must be >= 1'
                   WHEN parameter = 'max_depth' AND model_type = 'random_forest' AND value::int > 50 THEN 'Value must be <= 50'
                   WHEN parameter = 'max_depth' AND model_type = 'gradient_boost' AND value::int > 20
                     THEN 'Value must be <= 20' END AS error FROM long""",
)
def hyperparameter_bounds(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("model_type") < "3", "random_forest").otherwise("gradient_boost")
    long = runs(spark, sf).select(
        "run_id", kind.alias("model_type"), F.explode("hyperparameters").alias("parameter", "value")
    )
    return validate.hyperparameter_errors(long)


@query(
    "run_log_long",
    f"""WITH {RUNS_CTE}
    SELECT run_id, 'param' AS kind, 'hp_n_estimators' AS key, hp_n AS value FROM runs WHERE hp_n IS NOT NULL
    UNION ALL SELECT run_id, 'param', 'hp_max_depth', hp_d FROM runs
    UNION ALL SELECT run_id, 'tag', 'model_type', model_type FROM runs
    UNION ALL SELECT run_id, 'tag', 'preprocessing', preprocessing FROM runs
    UNION ALL SELECT run_id, 'metric', 'test_cents', round(rmse * 10000000)::bigint::varchar FROM runs WHERE rmse IS NOT NULL""",
)
def run_log_long(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("test_metrics")["rmse"] * 10000000).cast("bigint").cast("string")
    wide = runs(spark, sf).select(
        "run_id",
        F.create_map(
            F.lit("model_type"), "model_type", F.lit("preprocessing"), "preprocessing"
        ).alias("tags"),
        "hyperparameters",
        F.create_map(F.lit("cents"), cents).alias("test_metrics"),
    )
    return runlog.long_form(wide)


@query(
    "leaderboard",
    f"""WITH {RUNS_CTE} SELECT run_id, model_type, preprocessing, round(coalesce(rmse, 999), 9) AS sort_rmse,
      row_number() OVER (ORDER BY coalesce(rmse, 999), run_id) = 1 AS is_best FROM runs""",
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    ranked = registry.leaderboard(runs(spark, sf), F.col("test_metrics")["rmse"])
    return ranked.select(
        "run_id", "model_type", "preprocessing", scalars.half_away("sort_rmse", 9).alias("sort_rmse"), "is_best"
    )


@query(
    "best_run",
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH {RUNS_CTE} SELECT '{m}' AS by_metric, run_id, round({c}, 9) AS metric FROM runs
            ORDER BY {c} {d} NULLS LAST, run_id LIMIT 1)"""
        for m, c, d in (
            ("test_rmse", "rmse", "ASC"),
            ("test_r2", "r2", "DESC"),
            ("cv_rmse_mean", "cv_rmse", "ASC"),
            ("cv_r2_mean", "cv_r2", "DESC"),
        )
    ),
)
def best_run(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf)
    found = [
        registry.best_run(rows, m).select(
            F.lit(m).alias("by_metric"), "run_id", scalars.half_away("metric", 9).alias("metric")
        )
        for m in ("test_rmse", "test_r2", "cv_rmse_mean", "cv_r2_mean")
    ]
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


@query(
    "recent_runs",
    f"WITH {RUNS_CTE} SELECT run_id, model_type, strftime(start, '%Y-%m-%d %H:%M') AS started FROM runs"
    " ORDER BY start DESC, run_id LIMIT 10",
)
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    recent = registry.recent_runs(runs(spark, sf), "start")
    return recent.select("run_id", "model_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("started"))


@query(
    "best_ties",
    "SELECT p_partkey, p_size, p_size = (SELECT max(p_size) FROM part) AS is_best FROM part",
)
def best_ties(spark: SparkSession, sf: str) -> DataFrame:
    return registry.mark_best(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size")


@query(
    "run_prefix_lookup",
    f"""WITH {RUNS_CTE}, found AS (SELECT run_id FROM runs WHERE starts_with(run_id, 'ab') ORDER BY run_id LIMIT 10)
    SELECT run_id, substr(run_id, 1, 8) AS short_id, count(*) OVER () AS matches,
           CASE WHEN count(*) OVER () = 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM found""",
)
def run_prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = registry.find_run(runs(spark, sf).select("run_id"), "ab")
    return found.withColumn("short_id", scalars.short_id(F.col("run_id")))


# --- versions and aliases -------------------------------------------------------------------


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every run is a version of its model, numbered by order."""
    return runs(spark, sf).select(
        "model",
        (F.col("o_orderkey") + 1).cast("string").alias("version"),
        "run_id",
        (F.unix_timestamp(F.col("start").cast("timestamp")) * 1000).alias("created_ms"),
    )


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Newest version as champion, oldest as challenger."""
    number = F.col("version").cast("bigint")
    ends = versions(spark, sf).groupBy("model").agg(
        F.max(number).cast("string").alias("hi"), F.min(number).cast("string").alias("lo")
    )
    pairs = F.array(
        F.struct(F.lit("champion").alias("alias"), F.col("hi").alias("version")),
        F.struct(F.lit("challenger").alias("alias"), F.col("lo").alias("version")),
    )
    return ends.select("model", F.inline(pairs)).withColumn("ts", F.lit(0).cast("bigint"))


VERSIONS_CTE = RUNS_CTE + """,
versions AS (SELECT model, (o_orderkey + 1)::varchar AS version, run_id, epoch_ms(start) AS created_ms FROM runs),
aliases AS (
  SELECT model, 'champion' AS alias, max(version::bigint)::varchar AS version, 0 AS ts FROM versions GROUP BY model
  UNION ALL SELECT model, 'challenger', min(version::bigint)::varchar, 0 FROM versions GROUP BY model)"""


@query(
    "alias_resolution",
    f"""WITH {VERSIONS_CTE} SELECT a.model, a.version, r.run_id, r.model_type, r.preprocessing
    FROM aliases a JOIN versions v ON a.model = v.model AND a.version = v.version JOIN runs r ON r.run_id = v.run_id
    WHERE alias = 'champion'""",
)
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf).select("run_id", "model_type", "preprocessing")
    resolved = registry.resolve_alias(aliases(spark, sf), versions(spark, sf), rows, "champion")
    return resolved.select("model", "version", "run_id", "model_type", "preprocessing")


@query(
    "versions_with_aliases",
    f"""WITH {VERSIONS_CTE}, lists AS (SELECT model, version, string_agg(alias, ',' ORDER BY alias) AS names
      FROM aliases GROUP BY model, version)
    SELECT v.model, v.version, v.run_id, coalesce(names, '') AS aliases,
           strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d %H:%M') AS created
    FROM versions v LEFT JOIN lists l ON v.model = l.model AND v.version = l.version""",
)
def versions_with_aliases(spark: SparkSession, sf: str) -> DataFrame:
    listed = registry.versions_with_aliases(versions(spark, sf), aliases(spark, sf))
    return listed.select(
        "model",
        "version",
        "run_id",
        F.concat_ws(",", "aliases").alias("aliases"),
        scalars.minute_text(F.col("created_ms")).alias("created"),
    )


@query(
    "latest_versions",
    f"""WITH {VERSIONS_CTE} SELECT model, max_by(version, version::bigint) AS version,
      max_by(run_id, version::bigint) AS run_id FROM versions GROUP BY model""",
)
def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    return registry.latest_versions(versions(spark, sf))


def promotions(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to move an alias, some with a wrong alias or an unknown version."""
    rows = runs(spark, sf).where("preprocessing = 'P'")
    return rows.select(
        "model",
        F.when(F.col("model_type") == "2-HIGH", "challenger")
        .when(F.col("model_type") == "3-MEDIUM", "production")
        .otherwise("champion")
        .alias("alias"),
        (F.col("o_orderkey") + F.when(F.col("model_type") == "4-NOT SPECIFIED", 10**9).otherwise(1))
        .cast("string")
        .alias("version"),
        F.unix_timestamp(F.col("start").cast("timestamp")).alias("ts"),
    )


_CHANGES = VERSIONS_CTE + """,
changes AS (SELECT model, CASE model_type WHEN '2-HIGH' THEN 'challenger' WHEN '3-MEDIUM' THEN 'production'
                          ELSE 'champion' END AS alias,
    (o_orderkey + CASE WHEN model_type = '4-NOT SPECIFIED' THEN 1000000000 ELSE 1 END)::varchar AS version,
    epoch(start)::bigint AS ts FROM runs WHERE preprocessing = 'P'),
good AS (SELECT c.* FROM changes c WHERE alias IN ('champion', 'challenger')
           AND EXISTS (SELECT 1 FROM versions v WHERE v.model = c.model AND v.version = c.version))"""


@query(
    "alias_promote",
    f"""WITH {_CHANGES}, every AS (SELECT * FROM aliases UNION ALL SELECT * FROM good)
    SELECT model, alias, version, ts FROM (SELECT *, row_number() OVER (
      PARTITION BY model, alias ORDER BY ts DESC, version::bigint DESC) AS n FROM every) WHERE n = 1""",
)
def alias_promote(spark: SparkSession, sf: str) -> DataFrame:
    return registry.promote(aliases(spark, sf), versions(spark, sf), promotions(spark, sf))[0]


@query(
    "refused_promotions",
    f"""WITH {_CHANGES} SELECT model, alias, version, ts,
      CASE WHEN alias NOT IN ('champion', 'challenger') THEN 'invalid alias' ELSE 'unknown version' END AS reason
    FROM changes c WHERE alias NOT IN ('champion', 'challenger')
       OR NOT EXISTS (SELECT 1 FROM versions v WHERE v.model = c.model AND v.version = c.version)""",
)
def refused_promotions(spark: SparkSession, sf: str) -> DataFrame:
    return registry.promote(aliases(spark, sf), versions(spark, sf), promotions(spark, sf))[1]


@query(
    "registrable_runs",
    f"""WITH {RUNS_CTE} SELECT run_id, model_type FROM runs WHERE EXISTS (
      SELECT 1 FROM lineitem WHERE l_orderkey = runs.o_orderkey AND l_returnflag = 'R')""",
)
def registrable_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items are the artifacts of a run; the flagged ones are bundles."""
    artifacts = table(spark, sf, "lineitem").select(
        F.md5(F.col("l_orderkey").cast("string")).alias("run_id"),
        F.when(F.col("l_returnflag") == "R", "artifact_bundle").otherwise("metrics.json").alias("path"),
    )
    return registry.registrable(runs(spark, sf), artifacts).select("run_id", "model_type")


@query(
    "version_tags",
    f"""WITH {VERSIONS_CTE} SELECT v.model, v.version,
      model_type || ' with ' || preprocessing || ' preprocessing. Test R²: ' || printf('%.4f', round(r2, 2))
        || ', RMSE: ' || printf('%.4f', round(rmse, 2)) AS description,
      model_type, preprocessing, printf('%.4f', round(r2, 2)) AS test_r2, 'cli' AS source
    FROM versions v JOIN runs r ON v.run_id = r.run_id WHERE rmse IS NOT NULL""",
)
def version_tags(spark: SparkSession, sf: str) -> DataFrame:
    tested = runs(spark, sf).where("test_metrics is not null")
    scores = tested.select(
        "run_id",
        "model_type",
        "preprocessing",
        scalars.half_away(F.col("test_metrics")["r2"], 2).alias("test_r2"),
        scalars.half_away(F.col("test_metrics")["rmse"], 2).alias("test_rmse"),
    )
    tagged = registry.version_tags(versions(spark, sf), scores, "cli")
    tags = [F.col("tags")[t].alias(t) for t in ("model_type", "preprocessing", "test_r2", "source")]
    return tagged.select("model", "version", "description", *tags)


@query(
    "backfill_aliases",
    f"""WITH {VERSIONS_CTE}, owned AS (SELECT * FROM aliases WHERE version::bigint % 2 = 0),
    seeds AS (SELECT model, max(version::bigint)::varchar AS version FROM versions GROUP BY model),
    fresh AS (SELECT * FROM seeds WHERE model NOT IN (SELECT model FROM owned WHERE alias = 'champion'))
    SELECT model, alias, version, ts FROM owned o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.model = o.model)
    UNION ALL SELECT model, 'champion', version, 1 FROM fresh
    UNION ALL SELECT model, 'challenger', version, 1 FROM fresh""",
)
def backfill_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Only aliases on even versions exist; models left without a champion are seeded."""
    owned = aliases(spark, sf).where(F.col("version").cast("bigint") % 2 == 0)
    seeds = registry.latest_versions(versions(spark, sf), ["version"]).withColumn("ts", F.lit(1).cast("bigint"))
    return registry.backfill(owned, seeds)


@query(
    "backfill_registry",
    f"""WITH {VERSIONS_CTE}, owned AS (SELECT * FROM aliases WHERE version::bigint % 2 = 0),
    picked AS (SELECT model, max(run_id) AS base FROM runs WHERE rmse IS NOT NULL GROUP BY model),
    fresh AS (SELECT p.model, md5('seed:' || p.model || ':bundle-' || base) AS run_id, r.model_type, r.preprocessing,
                     r.o_orderkey * 8 AS samples, round(r.rmse, 2) AS rmse, round(r.r2, 2) AS r2,
                     (SELECT max(version::bigint) + 1 FROM versions v WHERE v.model = p.model)::varchar AS version
              FROM picked p JOIN runs r ON r.run_id = p.base
              WHERE p.model NOT IN (SELECT model FROM owned WHERE alias = 'champion'))
    SELECT 'alias' AS part, model AS id, alias AS name, version AS value, NULL::double AS number
    FROM owned o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.model = o.model)
    UNION ALL SELECT 'alias', model, a, version, NULL FROM fresh, (VALUES ('champion'), ('challenger')) t(a)
    UNION ALL SELECT 'version', model, version, run_id, NULL FROM versions
    UNION ALL SELECT 'version', model, version, run_id, NULL FROM fresh
    UNION ALL SELECT 'description', model, version, model_type || ' with ' || preprocessing
      || ' preprocessing. Test R²: ' || printf('%.4f', r2) || ', RMSE: ' || printf('%.4f', rmse), NULL FROM fresh
    UNION ALL SELECT 'tag', run_id, k, v, NULL FROM fresh,
      LATERAL (VALUES ('model_type', model_type), ('preprocessing', preprocessing), ('source', 'seed'), ('environment', 'demo')) t(k, v)
    UNION ALL SELECT 'param', run_id, k, v, NULL FROM fresh,
      LATERAL (VALUES ('model_type', model_type), ('preprocessing_strategy', preprocessing), ('source', 'seed'),
                      ('training_samples', samples::varchar), ('test_samples', '0')) t(k, v)
    UNION ALL SELECT 'metric', run_id, k, NULL, v FROM fresh,
      LATERAL (VALUES ('train_rmse', 0), ('train_mae', 0), ('train_r2', 0),
                      ('test_rmse', rmse), ('test_mae', 0), ('test_r2', r2)) t(k, v)""",
)
def backfill_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Models without a champion get a run, a version and both aliases in one commit; a second time adds nothing."""
    tested = F.transform_values("test_metrics", lambda _, v: scalars.half_away(v, 2))
    seeds = (
        runs(spark, sf).where("test_metrics is not null").groupBy("model")
        .agg(F.max_by(F.struct("run_id", "model_type", "preprocessing", "o_orderkey", tested.alias("test_metrics")), "run_id").alias("r"))
        .select(
            "model",
            F.concat(F.lit("bundle-"), "r.run_id").alias("bundle"),
            "r.model_type",
            "r.preprocessing",
            (F.col("r.o_orderkey") * 8).alias("training_samples"),
            F.lit(None).cast("bigint").alias("test_samples"),
            F.lit(None).cast("map<string,double>").alias("train_metrics"),
            "r.test_metrics",
            F.lit(1).cast("bigint").alias("ts"),
        )
    )
    known = versions(spark, sf).select(
        "model", "version", "run_id", F.col("created_ms").cast("bigint").alias("ts"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("map<string,string>").alias("tags"),
    )
    store = TableStore(spark, scratch_path(spark, "registry"))
    store.commit(
        Snapshot(),
        Change(
            replace={
                "log": spark.createDataFrame([], runlog.LOG),
                "versions": known,
                "aliases": aliases(spark, sf).where(F.col("version").cast("bigint") % 2 == 0),
            }
        ),
    )
    for _ in range(2):
        store.update(registry.seed_registry(seeds))
    log, every, owned = (store.read(t) for t in ("log", "versions", "aliases"))
    none = F.lit(None).cast("double").alias("number")
    metric = F.col("kind") == "metric"
    return (
        owned.select(F.lit("alias").alias("part"), F.col("model").alias("id"), F.col("alias").alias("name"), F.col("version").alias("value"), none)
        .unionAll(every.select(F.lit("version"), "model", "version", "run_id", none))
        .unionAll(every.where("description is not null").select(F.lit("description"), "model", "version", "description", none))
        .unionAll(
            log.select(
                "kind", "run_id", "key", F.when(~metric, F.col("value")), F.when(metric, F.col("value").cast("double"))
            )
        )
    )


@query(
    "run_names",
    f"""WITH {RUNS_CTE} SELECT run_id,
      model_type || '_' || preprocessing || '_' || strftime(start, '%Y%m%d_%H%M%S') AS run_name,
      model_type || '_' || preprocessing || ' (' || concat_ws(', ', 'n=' || hp_n, 'd=' || hp_d) || ')' AS display_name
    FROM runs""",
)
def run_names(spark: SparkSession, sf: str) -> DataFrame:
    model, prep = F.col("model_type"), F.col("preprocessing")
    return runs(spark, sf).select(
        "run_id",
        scalars.run_name(model, prep, F.col("start")).alias("run_name"),
        scalars.display_name(model, prep, F.col("hyperparameters")).alias("display_name"),
    )


@query("grid_run")
def grid_run(spark: SparkSession, sf: str) -> DataFrame:
    """Eight runs, trained and cross-validated end to end on the whole frame."""
    config = {
        "grid": {
            "models": ["random_forest", "gradient_boost"],
            "preprocessors": ["v1_median", "v2_knn"],
            "hyperparameters": {
                "random_forest": {"n_estimators": [100, 200], "max_depth": [10]},
                "gradient_boost": {"n_estimators": [100, 150], "max_depth": [3]},
            },
        }
    }
    configs = experiments.expand_grid(experiments.grid_frame(spark, config))
    results = experiments.run_grid(frame_nulls(spark, sf), FRAME, configs)
    return results.select(
        "model_type",
        "preprocessing",
        F.col("test_metrics")["rmse"].alias("test_rmse"),
        F.col("test_metrics")["r2"].alias("test_r2"),
    )
