"""Streaming jobs. They apply the batch operators to a stream and write to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import monitor, validate
from tabforge.operators.scoring import range_warnings, route_and_score
from tabforge.session import scratch_path
from tabforge.sources.files import children
from tabforge.spec import CHAMPION_WEIGHT, Constraint


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of ``folder`` as a stream, its times made fit for watermarks."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    times = [f.name for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return stream.withColumns({t: F.col(t).cast("timestamp") for t in times}) if times else stream


def run_append(stream: DataFrame, path: str) -> str:
    """Processes what is there, appending finished rows; restarts continue where they stopped."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def run_snapshots(stream: DataFrame, path: str) -> str:
    """Processes what is there; each micro-batch replaces its own snapshot of the full result."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}-checkpoint")
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(children(spark, path)[-1])


def running_counters(stream: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Counters since the start of the stream; state is one number per label set."""
    return stream.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def windowed_counts(
    stream: DataFrame, ts: str, width: str, slide: str, labels: Sequence[str], delay: str = "10 minutes"
) -> DataFrame:
    """Counts per window; a window is final once the watermark has passed its end."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide).alias("w"), *labels)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *labels, "n")


def windowed_quantiles(
    stream: DataFrame,
    ts: str,
    value: Column,
    buckets: Sequence[float],
    quantiles: dict[str, float],
    width: str,
    slide: str,
    labels: Sequence[str] = (),
    delay: str = "10 minutes",
) -> DataFrame:
    """Quantiles per window from its buckets; state is one count per bucket, window and label set, never a value."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide).alias("w"), *labels)
    counted = grouped.agg(*monitor.bucket_aggregates(value, buckets))
    return monitor.with_quantiles(counted, buckets, quantiles).select(
        F.col("w.start").alias("window_start"), *labels, "count", *quantiles
    )


def windowed_drift(warned: DataFrame, ts: str, width: str, delay: str = "10 minutes") -> DataFrame:
    """Distinct drifting features per window, without a distinct aggregate, which streams refuse.

    The watermark follows all rows, not only those with a warning, so a quiet hour
    does not hold back the windows before it. That is why rows without warnings are
    dropped after the explode: Spark would move a plain explode's filter ahead of
    the watermark.
    """
    hits = (
        warned.withWatermark(ts, delay)
        .select(ts, F.explode_outer("warnings.feature").alias("feature"))
        .where("feature is not null")
    )
    per_feature = hits.groupBy(F.window(ts, width).alias("w"), "feature").agg(F.count(F.lit(1)).alias("n"))
    return per_feature.groupBy("w").agg(F.count(F.lit(1)).alias("features_in_drift")).select(
        F.col("w.start").alias("window_start"), "features_in_drift"
    )


def score(
    requests: DataFrame,
    key: str,
    rules: Sequence[Constraint],
    ranges: dict,
    champion: Callable[[DataFrame], DataFrame] | None,
    challenger: Callable[[DataFrame], DataFrame] | None,
    weight: float = CHAMPION_WEIGHT,
) -> DataFrame:
    """Validation, warnings, routing and prediction; the same columns for batch and stream.

    ``rejected`` gives the rows that are missing here.
    """
    accepted = validate.accepted(validate.with_errors(requests, rules), rules)
    warned = accepted.withColumn("warnings", range_warnings([r.field for r in rules], ranges))
    return route_and_score(warned, key, champion, challenger, weight)


def rejected(requests: DataFrame, rules: Sequence[Constraint]) -> DataFrame:
    """The requests that ``score`` refuses, with what is wrong; the same columns for batch and stream."""
    return validate.quarantined(validate.with_errors(requests, rules))


def quarantine_to_table(spark: SparkSession, stream: DataFrame, rules: Sequence[Constraint]) -> DataFrame:
    """Second sink of a scoring stream: refused requests go to a table of their own."""
    refused = rejected(stream, rules)
    return spark.read.schema(refused.schema).parquet(run_append(refused, scratch_path(spark, "refused")))


def score_to_table(spark: SparkSession, stream: DataFrame, name: str = "scores") -> DataFrame:
    """Runs a scoring stream into a fresh prediction log and reads it back."""
    return spark.read.schema(stream.schema).parquet(run_append(stream, scratch_path(spark, name)))
