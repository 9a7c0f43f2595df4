"""A scoring service on a stream: bundles by alias, a prediction log, a quarantine and a batch log.

Every micro-batch is read once and ends in three folders of its own, ``scores/epoch=N``, ``refused/epoch=N`` and
``batches/epoch=N`` (rows read, accepted and refused, seconds). Which bundles an epoch uses is written down before
it is scored, so an epoch that runs again after a failure replaces its folders with the same answers, even when
an alias has moved in between.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import validate
from tabforge.operators.scoring import route_and_score
from tabforge.sources import files
from tabforge.spec import CHAMPION_WEIGHT, Constraint
from tabforge.streaming.reload import ModelSlots

CORRUPT = "_corrupt_record"
_BATCHES = "read bigint, accepted bigint, refused bigint, seconds double"


def checked(requests: DataFrame, rules: Sequence[Constraint]) -> DataFrame:
    """Adds ``errors``; a record that is no JSON has one error instead of one per absent field."""
    rows = validate.with_errors(requests, rules)
    if CORRUPT not in rows.columns:
        return rows
    broken = F.struct(
        F.lit("body").alias("field"), F.lit("Input should be valid JSON").alias("message"), F.col(CORRUPT).alias("value")
    )
    errors = F.when(F.col(CORRUPT).isNotNull(), F.array(broken).cast(validate.ERROR_TYPE)).otherwise(F.col("errors"))
    return rows.withColumn("errors", errors)


def _folder(path: str, part: str, epoch: int) -> str:
    return f"{path}/{part}/epoch={epoch:012d}"


def _bundles(spark: SparkSession, slots: ModelSlots, path: str, epoch: int) -> dict:
    """The bundles of an epoch: those written down for it, else those the aliases name now."""
    noted = _folder(path, "versions", epoch)
    if files.is_complete(spark, noted):
        return slots.at(files.read_document(spark, noted))
    slots.refresh()
    if not slots.models:
        raise RuntimeError("no bundle could be loaded")
    files.write_document(spark, slots.paths, noted)
    return dict(slots.models)


def scorer(
    slots: ModelSlots, key: str, rules: Sequence[Constraint], path: str, weight: float = CHAMPION_WEIGHT
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``."""

    def run(batch: DataFrame, epoch: int) -> None:
        started, spark = time.monotonic(), batch.sparkSession
        bundles = _bundles(spark, slots, path, epoch)
        sides = [bundles[a].predict if a in bundles else None for a in ("champion", "challenger")]
        rows = checked(batch, rules).persist()
        try:
            scores = route_and_score(validate.accepted(rows, rules).drop(CORRUPT), key, *sides, weight)
            scores.write.mode("overwrite").parquet(_folder(path, "scores", epoch))
            validate.quarantined(rows).write.mode("overwrite").parquet(_folder(path, "refused", epoch))
            read, refused = rows.agg(F.count(F.lit(1)), F.count_if(F.size("errors") > 0)).first()
            line = [(read, read - refused, refused, time.monotonic() - started)]
            log = spark.createDataFrame(line, _BATCHES).coalesce(1)
            log.write.mode("overwrite").parquet(_folder(path, "batches", epoch))
        finally:
            rows.unpersist()

    return run


def run_service(
    stream: DataFrame,
    slots: ModelSlots,
    key: str,
    rules: Sequence[Constraint],
    path: str,
    weight: float = CHAMPION_WEIGHT,
) -> str:
    """Scores what is there; a restart continues after the last finished epoch."""
    query = (
        stream.writeStream.foreachBatch(scorer(slots, key, rules, path, weight))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def read_log(spark: SparkSession, path: str, part: str) -> DataFrame:
    """``scores``, ``refused`` or ``batches`` of all epochs; ``epoch`` says which one a row comes from."""
    return spark.read.parquet(f"{path}/{part}")
