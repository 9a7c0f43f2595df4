"""Batch scoring: range warnings, price text, champion/challenger and the batch envelope."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalars import money, number_text, short_id
from tabforge.operators.split import route
from tabforge.operators.validate import batch_message, batch_verdicts, serve_batches
from tabforge.spec import BATCH_MAX_ITEMS, CHAMPION_WEIGHT

WARNING_TYPE = "array<struct<feature:string,value:double,bound:double,kind:string>>"


def ranges_dict(ranges: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """Rows (feature, min, max) as a dict; one row per feature, so always small."""
    return {r["feature"]: (r["min"], r["max"]) for r in ranges.collect()}


def range_warnings(features: Sequence[str], ranges: Mapping[str, tuple]) -> Column:
    """Array of features outside their training range; a value on the bound is inside."""
    entries = []
    for name in features:
        if name not in ranges:
            continue
        low, high = ranges[name]
        value = F.col(name).cast("double")
        known = ~F.isnan(value)

        def entry(bound, kind, name=name, value=value):
            return F.struct(
                F.lit(name).alias("feature"),
                value.alias("value"),
                F.lit(float(bound)).alias("bound"),
                F.lit(kind).alias("kind"),
            )

        column = None
        if low is not None:
            column = F.when(known & (value < low), entry(low, "below"))
        if high is not None:
            condition, struct = known & (value > high), entry(high, "above")
            column = F.when(condition, struct) if column is None else column.when(condition, struct)
        if column is not None:
            entries.append(column)
    if not entries:
        return F.array().cast(WARNING_TYPE)
    return F.array_compact(F.array(*entries)).cast(WARNING_TYPE)


def warning_texts(warnings: Column) -> Column:
    """``RM (2.5) is below training min (3.56)`` for each warning."""

    def text(w):
        side = F.when(w["kind"] == "below", "min").otherwise("max")
        return F.format_string(
            "%s (%s) is %s training %s (%.2f)", w["feature"], number_text(w["value"]), w["kind"], side, w["bound"]
        )

    return F.transform(warnings, text)


def respond(scored: DataFrame, model_version: Column | str, model_type: Column | str) -> DataFrame:
    """Adds the response fields next to ``prediction`` and ``warnings``."""
    as_column = lambda c: F.lit(c) if isinstance(c, str) else c
    return scored.withColumns(
        {
            "prediction": F.bround("prediction", 2),
            "prediction_formatted": money(F.bround("prediction", 2)),
            "model_version": short_id(as_column(model_version)),
            "model_type": as_column(model_type),
            "warnings": warning_texts(F.col("warnings")),
        }
    )


def route_and_score(
    requests: DataFrame,
    key: str,
    champion: Callable[[DataFrame], DataFrame] | None,
    challenger: Callable[[DataFrame], DataFrame] | None,
    weight: float = CHAMPION_WEIGHT,
) -> DataFrame:
    """Sends each request to one model. Both models are column functions over their own rows."""
    routed = requests.withColumn(
        "served_by", route(F.col(key), champion is not None, challenger is not None, weight)
    )
    sides = {"champion": champion, "challenger": challenger}
    loaded = [(alias, model) for alias, model in sides.items() if model is not None]
    if len(loaded) == 1:
        return loaded[0][1](routed)
    first, second = (model(routed.where(F.col("served_by") == alias)) for alias, model in loaded)
    return first.unionByName(second)


def envelope(
    scored: DataFrame, batch: str, item_order: str, labels: Sequence[str], max_items: int = BATCH_MAX_ITEMS
) -> DataFrame:
    """One row per batch with its items in order, numbered from 0.

    Batches above the size bound are turned away before items are gathered, which
    is what keeps a gathered list at ``max_items`` entries; ``refusals`` answers them.
    """
    item = F.struct(item_order, "prediction", "prediction_formatted", "warnings")
    grouped = (
        serve_batches(scored, batch, max_items)
        .groupBy(batch, *labels)
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    numbered = F.transform(
        "items",
        lambda x, i: F.struct(
            i.alias("index"),
            x["prediction"].alias("prediction"),
            x["prediction_formatted"].alias("prediction_formatted"),
            x["warnings"].alias("warnings"),
        ),
    )
    return grouped.select(
        batch, *labels, F.size("items").alias("total_items"), numbered.alias("predictions")
    )


def refusals(rows: DataFrame, batch: str, max_items: int = BATCH_MAX_ITEMS) -> DataFrame:
    """One row per batch that ``envelope`` turns away for its size: number of items and what to tell the sender."""
    verdicts = batch_verdicts(rows, batch, max_items).where("not size_ok")
    return verdicts.select(batch, "total_items", batch_message(F.col("total_items"), max_items).alias("message"))
