"""Runs, versions and aliases as tables: lookup, registration, promotion, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalars import number, version_description
from tabforge.sources import runlog
from tabforge.spec import ALIASES

# Metrics where more is better.
HIGHER_IS_BETTER = ("r2", "accuracy_within_10pct", "r2_mean")


def metric_value(metric: str) -> Column:
    """The metric of a run; the prefix names the map it is kept in."""
    for prefix in ("test", "train"):
        if metric.startswith(f"{prefix}_"):
            return F.col(f"{prefix}_metrics")[metric.removeprefix(f"{prefix}_")]
    if metric.startswith("cv_"):
        return F.col("cv_metrics")[metric]
    return F.col("test_metrics")[metric]


def best_run(runs: DataFrame, metric: str = "test_rmse", higher_is_better: bool | None = None) -> DataFrame:
    """The best run by a metric; runs without it come last, ties go to the smaller id."""
    if higher_is_better is None:
        name = metric
        for prefix in ("cv_", "test_", "train_"):
            name = name.removeprefix(prefix)
        higher_is_better = name in HIGHER_IS_BETTER
    value = number(metric_value(metric))
    order = value.desc_nulls_last() if higher_is_better else value.asc_nulls_last()
    return runs.withColumn("metric", value).orderBy(order, "run_id").limit(1)


def leaderboard(runs: DataFrame, rmse: Column, missing: float = 999.0) -> DataFrame:
    """Runs by test RMSE with the best one marked; a run without RMSE sorts as ``missing``."""
    ranked = runs.withColumn("sort_rmse", F.coalesce(number(rmse), F.lit(missing)))
    top = ranked.agg(F.min(F.struct("sort_rmse", "run_id")).alias("top")).select("top.run_id").scalar()
    return ranked.withColumn("is_best", F.col("run_id") == top).orderBy("sort_rmse", "run_id")


def mark_best(runs: DataFrame, r2: str) -> DataFrame:
    """Marks every run that reaches the highest R2. The maximum is one number, not a window."""
    return runs.withColumn("is_best", number(r2) == runs.agg(F.max(number(r2))).scalar())


def recent_runs(runs: DataFrame, start: str, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc(start), "run_id").limit(n)


def find_run(runs: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    """Runs whose id starts with ``prefix``, at most ``n``, and what that means for a lookup."""
    found = runs.where(F.col("run_id").startswith(prefix)).orderBy("run_id").limit(n)
    matches = found.agg(F.count(F.lit(1))).scalar()
    outcome = F.when(matches == 1, "found").otherwise("ambiguous")
    return found.withColumns({"matches": matches, "outcome": outcome})


def lookup_outcome(found: DataFrame) -> str:
    """'missing', 'found' or 'ambiguous' for the rows ``find_run`` returned."""
    rows = found.select("outcome").limit(1).collect()
    return rows[0]["outcome"] if rows else "missing"


def registrable(runs: DataFrame, artifacts: DataFrame, needed: str = "artifact_bundle") -> DataFrame:
    """Runs that hold the artifact a version needs."""
    holders = artifacts.where(F.col("path") == needed).select("run_id")
    return runs.join(holders, "run_id", "left_semi")


def check_alias(alias: str) -> str:
    if alias not in ALIASES:
        raise ValueError(f"Invalid alias '{alias}'. Must be one of: {', '.join(ALIASES)}")
    return alias


def promote(aliases: DataFrame, versions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies ``changes`` (model, alias, version, ts); returns the new aliases and the refused rows.

    The latest change of an alias wins; ``max_by`` settles it with a partial result
    per task instead of sorting all changes of an alias in one place.
    """
    known = versions.select("model", "version")
    valid = F.col("alias").isin(*ALIASES)
    accepted = changes.where(valid).join(known, ["model", "version"], "left_semi")
    refused = changes.join(known, ["model", "version"], "left_anti").withColumn(
        "reason", F.when(valid, "unknown version").otherwise("invalid alias")
    ).unionByName(
        changes.where(~valid).join(known, ["model", "version"], "left_semi").withColumn(
            "reason", F.lit("invalid alias")
        )
    )
    every = aliases.select("model", "alias", "version", "ts").unionByName(
        accepted.select("model", "alias", "version", "ts")
    )
    newest = every.groupBy("model", "alias").agg(
        F.max(F.struct("ts", F.col("version").cast("bigint").alias("number"))).alias("top")
    )
    return (
        newest.select("model", "alias", F.col("top.number").cast("string").alias("version"), F.col("top.ts").alias("ts")),
        refused,
    )


def resolve_alias(aliases: DataFrame, versions: DataFrame, runs: DataFrame, alias: str) -> DataFrame:
    """The run behind an alias of each model: alias -> version -> run."""
    chosen = aliases.where(F.col("alias") == check_alias(alias)).select("model", "version")
    return chosen.join(versions, ["model", "version"]).join(runs, "run_id")


def versions_with_aliases(versions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Versions, newest first, each with the sorted list of its aliases."""
    lists = aliases.groupBy("model", "version").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    joined = versions.join(lists, ["model", "version"], "left")
    return joined.withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>"))
    ).orderBy("model", F.col("version").cast("bigint").desc())


def latest_versions(versions: DataFrame, columns: Sequence[str] = ("version", "run_id")) -> DataFrame:
    """Highest version number of each model; versions are text and compared as numbers."""
    number = F.col("version").cast("bigint")
    return versions.groupBy("model").agg(*[F.max_by(c, number).alias(c) for c in columns])


def version_tags(versions: DataFrame, runs: DataFrame, source: str) -> DataFrame:
    """Description and tags of each version, from the run it was made by."""
    joined = versions.join(runs, "run_id")
    return joined.select(
        "model",
        "version",
        version_description(
            F.col("model_type"), F.col("preprocessing"), F.col("test_r2"), F.col("test_rmse")
        ).alias("description"),
        F.create_map(
            F.lit("model_type"), F.col("model_type"),
            F.lit("preprocessing"), F.col("preprocessing"),
            F.lit("test_r2"), F.format_string("%.4f", "test_r2"),
            F.lit("source"), F.lit(source),
        ).alias("tags"),
    )


def backfill(aliases: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds champion and challenger for models that have no champion yet; running it twice changes nothing."""
    owned = aliases.where("alias = 'champion'").select("model")
    fresh = seeds.join(owned, "model", "left_anti")
    added = fresh.select("model", F.explode(F.array(*[F.lit(a) for a in ALIASES])).alias("alias"), "version", "ts")
    kept = aliases.select("model", "alias", "version", "ts").join(
        added.select("model", "alias"), ["model", "alias"], "left_anti"
    )
    return kept.unionByName(added)


def seeded(
    versions: DataFrame, aliases: DataFrame, seeds: DataFrame, source: str = "seed", environment: str = "demo"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run rows and versions to add and the new aliases, for models of ``seeds`` that have no champion.

    ``seeds`` holds model, bundle, model_type, preprocessing, training_samples, test_samples, train_metrics, test_metrics
    and ts; of several seeds of a model the one with the greatest bundle name counts. A seed becomes a run, whose id
    follows from model and bundle, the next version of its model, and that version's champion and challenger. Applied
    again, nothing is added, since the models have a champion then. Metrics and sizes that are not known are 0.
    """
    owned = aliases.where(F.col("alias") == "champion").select("model")
    fields = [c for c in seeds.columns if c != "model"]
    fresh = (
        seeds.groupBy("model")
        .agg(F.max_by(F.struct(*fields), "bundle").alias("seed"))
        .select("model", "seed.*")
        .join(owned, "model", "left_anti")
    )
    # Names of tags, parameters and metrics.
    known = {
        side: F.create_map(
            *[x for m in ("rmse", "mae", "r2") for x in (F.lit(m), F.coalesce(F.col(side)[m], F.lit(0.0)))]
        )
        for side in ("train_metrics", "test_metrics")
    }
    model_type, preprocessing = F.col("model_type"), F.col("preprocessing")
    sizes = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).cast("string") for c in ("training_samples", "test_samples")]
    fresh = fresh.withColumns(known).withColumns(
        {
            "run_id": F.md5(F.concat_ws(":", F.lit(source), "model", "bundle")),
            "tags": F.create_map(
                F.lit("model_type"), model_type,
                F.lit("preprocessing"), preprocessing,
                F.lit("source"), F.lit(source),
                F.lit("environment"), F.lit(environment),
            ),
            "params": F.create_map(
                F.lit("model_type"), model_type,
                F.lit("preprocessing_strategy"), preprocessing,
                F.lit("source"), F.lit(source),
                F.lit("training_samples"), sizes[0],
                F.lit("test_samples"), sizes[1],
            ),
        }
    )
    at = fresh.select("run_id", F.timestamp_millis("ts").alias("ts"))
    log = runlog.long_form(fresh.select("run_id", "tags", "params", "train_metrics", "test_metrics")).join(at, "run_id")
    last = versions.groupBy("model").agg(F.max(F.col("version").cast("bigint")).alias("last"))
    numbered = fresh.join(last, "model", "left").withColumn(
        "version", (F.coalesce("last", F.lit(0)) + 1).cast("string")
    )
    results = numbered.select(
        "run_id", "model_type", "preprocessing",
        F.col("test_metrics")["r2"].alias("test_r2"),
        F.col("test_metrics")["rmse"].alias("test_rmse"),
    )
    notes = version_tags(numbered.select("model", "version", "run_id"), results, source)
    added = numbered.select("model", "version", "run_id", "ts").join(notes, ["model", "version"])
    return log, added, backfill(aliases, numbered.select("model", "version", "ts"))


def seed_registry(seeds: DataFrame, source: str = "seed"):
    """Function for ``TableStore.update``: runs, versions and aliases of new models in one commit.

    The store's tables are ``log``, ``versions`` (model, version, run_id, ts, description, tags) and ``aliases``.
    """
    from tabforge.sources.store import Change

    def run(store, base) -> Change:
        log, added, aliases = seeded(store.read("versions", base), store.read("aliases", base), seeds, source)
        columns = store.read("versions", base).columns
        return Change({"log": log, "versions": added.select(*columns)}, {"aliases": aliases})

    return run
