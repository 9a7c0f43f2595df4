"""Traffic monitoring: counters, histograms, sliding rates, shares and quantiles.

Sliding windows are built in two steps. Events are first counted per pane (one
slide long) and label, which shrinks them to one row per pane; only panes are then
copied into the windows that cover them. Raw events are never multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(events: DataFrame, labels: Sequence[str], name: str = "total") -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias(name))


def bucket_names(buckets: Sequence[float]) -> list[str]:
    return [f"le_{i}" for i in range(len(buckets))]


def bucket_aggregates(value: Column, buckets: Sequence[float]) -> list[Column]:
    """Cumulative counts per upper bound, and the count and sum of all values."""
    counts = [
        F.count_if(value <= F.lit(float(le))).alias(name)
        for le, name in zip(buckets, bucket_names(buckets), strict=True)
    ]
    return [*counts, F.count(value).alias("count"), F.sum(value).alias("sum")]


def histogram(events: DataFrame, value: Column, buckets: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """One row per label set and bucket: ``le``, cumulative count, and the totals."""
    wide = events.groupBy(*labels).agg(*bucket_aggregates(value, buckets))
    entries = [
        F.struct(F.lit(f"{le:g}").alias("le"), F.col(name).alias("bucket_count"))
        for le, name in zip(buckets, bucket_names(buckets), strict=True)
    ]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return wide.select(*labels, "count", "sum", F.inline(F.array(*entries)))


def bucket_quantile(counts: Sequence[Column], total: Column, buckets: Sequence[float], q: float) -> Column:
    """Quantile of a cumulative histogram, linear inside a bucket.

    Above the last finite bound the answer is that bound; the first bucket starts
    at 0 unless its bound is not positive.
    """
    rank = total * F.lit(q)
    result = F.when(total == 0, F.lit(None).cast("double"))
    for i, (count, le) in enumerate(zip(counts, buckets, strict=True)):
        if i == 0:
            start, before = (0.0, F.lit(0)) if le > 0 else (float(le), F.lit(0))
        else:
            start, before = float(buckets[i - 1]), counts[i - 1]
        inside = F.lit(start) + F.lit(float(le) - start) * F.try_divide(rank - before, count - before)
        result = result.when(count >= rank, F.coalesce(inside, F.lit(float(le))))
    return result.otherwise(F.lit(float(buckets[-1])))


def panes(events: DataFrame, ts: str, slide: str, labels: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates per pane of length ``slide`` and label set."""
    return (
        events.groupBy(F.window(ts, slide).alias("w"), *labels)
        .agg(*aggregates)
        .withColumn("pane", F.col("w.start"))
        .drop("w")
    )


def slide_panes(
    paned: DataFrame, width: str, slide: str, labels: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Adds panes up into windows of ``width`` that start every ``slide``."""
    first = F.col("pane") - F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {slide}")
    starts = F.sequence(first, F.col("pane"), F.expr(f"INTERVAL {slide}"))
    return (
        paned.withColumn("window_start", F.explode(starts))
        .groupBy("window_start", *labels)
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def sliding_counts(
    events: DataFrame, ts: str, width: str, slide: str, labels: Sequence[str] = (), name: str = "n"
) -> DataFrame:
    """Events per sliding window and label set."""
    counted = panes(events, ts, slide, labels, [F.count(F.lit(1)).alias(name)])
    return slide_panes(counted, width, slide, labels, [name])


def sliding_rates(
    events: DataFrame, ts: str, width: str, slide: str, seconds: int, labels: Sequence[str] = ()
) -> DataFrame:
    """Events per second and per minute over each window."""
    counted = sliding_counts(events, ts, width, slide, labels)
    return counted.withColumns(
        {"per_second": F.col("n") / seconds, "per_minute": F.col("n") / seconds * 60}
    )


def window_spine(paned: DataFrame, width: str, slide: str) -> DataFrame:
    """Every window start between the first and the last event, whether or not anything happened."""
    first = F.min("pane") - F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {slide}")
    kind = dict(paned.dtypes)["pane"]
    micros = [F.unix_micros(c.cast("timestamp")) for c in (first, F.max("pane"))]
    step = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {slide}"))
    low, high, step = paned.agg(*micros, F.max(step)).first()
    if low is None:
        return paned.select(F.col("pane").alias("window_start")).limit(0)
    starts = paned.sparkSession.range(low, high + 1, step)
    return starts.select(F.timestamp_micros("id").cast(kind).alias("window_start"))


def drifting_features(events: DataFrame, warnings: DataFrame, ts: str, width: str, slide: str) -> DataFrame:
    """Features with at least one out-of-range value per window, 0 where there is none.

    ``warnings`` has one row per (time, feature); ``events`` gives the time span.
    """
    hits = slide_panes(
        panes(warnings, ts, slide, ["feature"], [F.count(F.lit(1)).alias("n")]), width, slide, ["feature"], ["n"]
    )
    per_window = hits.groupBy("window_start").agg(F.count(F.lit(1)).alias("features"))
    spine = window_spine(panes(events, ts, slide, [], [F.count(F.lit(1)).alias("n")]), width, slide)
    return spine.join(per_window, "window_start", "left").select(
        "window_start", F.coalesce("features", F.lit(0)).alias("features_in_drift")
    )


def champion_share(events: DataFrame, ts: str, alias: str, width: str, slide: str, default: float = 50.0) -> DataFrame:
    """Percent of traffic the champion served per window, ``default`` where there was none."""
    aggregates = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(alias) == "champion").alias("champion")]
    paned = panes(events, ts, slide, [], aggregates)
    counted = slide_panes(paned, width, slide, [], ["n", "champion"])
    return window_spine(paned, width, slide).join(counted, "window_start", "left").select(
        "window_start",
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        F.coalesce(F.col("champion") / F.col("n") * 100, F.lit(default)).alias("champion_pct"),
    )


def sliding_histogram(
    events: DataFrame, ts: str, value: Column, buckets: Sequence[float], width: str, slide: str, labels=()
) -> DataFrame:
    """Cumulative bucket counts per window and label set, one column per bucket."""
    paned = panes(events, ts, slide, labels, bucket_aggregates(value, buckets))
    return slide_panes(paned, width, slide, labels, [*bucket_names(buckets), "count", "sum"])


def with_quantiles(histogram_rows: DataFrame, buckets: Sequence[float], quantiles: dict[str, float]) -> DataFrame:
    counts = [F.col(name) for name in bucket_names(buckets)]
    return histogram_rows.withColumns(
        {name: bucket_quantile(counts, F.col("count"), buckets, q) for name, q in quantiles.items()}
    )
