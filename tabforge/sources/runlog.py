"""Append-only log of runs in long form: one row per tag, parameter and metric."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.scalars import prefixed

LOG = "run_id string, kind string, key string, value string, ts timestamp"


def long_form(runs: DataFrame) -> DataFrame:
    """Runs with map columns -> (run_id, kind, key, value).

    Hyperparameters get ``hp_``; train and test metrics get the name of their side.
    Maps that a run does not have are passed over.
    """
    kinds = {
        "tags": ("tag", ""),
        "hyperparameters": ("param", "hp_"),
        "params": ("param", ""),
        "model_params": ("param", "model_"),
        "train_metrics": ("metric", "train_"),
        "test_metrics": ("metric", "test_"),
        "cv_metrics": ("metric", ""),
    }
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entries = []
    for column, (kind, prefix) in kinds.items():
        if column not in runs.columns:
            continue
        named = prefixed(F.coalesce(F.col(column).cast("map<string,string>"), empty), prefix)
        entries.append(F.transform(F.map_entries(named), _entry(kind)))
    return runs.select("run_id", F.inline(F.concat(*entries))).where("value is not null")


def _entry(kind: str):
    return lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), e["value"].alias("value"))


def append(log_path: str, entries: DataFrame) -> None:
    """Adds rows (run_id, kind, key, value) with the current time."""
    now = F.lit(datetime.now(timezone.utc))
    entries.withColumn("ts", now.cast("timestamp")).write.mode("append").parquet(log_path)


def read(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log_path)


def latest_metrics(log: DataFrame, names: list[str]) -> DataFrame:
    """One row per run with the last value of each named metric."""
    return log.where("kind = 'metric'").groupBy("run_id").agg(
        *[
            F.max_by(F.when(F.col("key") == n, F.col("value").cast("double")), F.when(F.col("key") == n, F.col("ts"))).alias(n)
            for n in names
        ]
    )
