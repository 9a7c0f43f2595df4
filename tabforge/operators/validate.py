"""Row and batch validation of raw request tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.spec import BATCH_MAX_ITEMS, HYPERPARAMETER_BOUNDS, Constraint

ERROR_TYPE = "array<struct<field:string,message:string,value:string>>"


def _number(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else str(value)


def field_error(df: DataFrame, rule: Constraint) -> Column:
    """The message for one field, NULL when its value is fine."""
    kind, article = ("integer", "an") if rule.integer else ("number", "a")
    if rule.field not in df.columns:
        return F.lit("Field required")
    raw = F.col(rule.field)
    value = raw.try_cast("double")
    message = F.when(raw.isNull(), f"Input should be a valid {kind}").when(
        value.isNull(),
        f"Input should be a valid {kind}, unable to parse string as {article} {kind}",
    )
    if rule.integer:
        message = message.when(
            F.isnan(value) | (F.abs(value) == float("inf")), "Input should be a finite number"
        ).when(
            value != F.floor(value), "Input should be a valid integer, got a number with a fractional part"
        )
    # NaN sorts above every number, but it satisfies no bound.
    nan = F.isnan(value)
    if rule.ge is not None:
        message = message.when(
            nan | (value < rule.ge), f"Input should be greater than or equal to {_number(rule.ge)}"
        )
    if rule.gt is not None:
        message = message.when(
            nan | (value <= rule.gt), f"Input should be greater than {_number(rule.gt)}"
        )
    if rule.le is not None:
        message = message.when(
            nan | (value > rule.le), f"Input should be less than or equal to {_number(rule.le)}"
        )
    return message


def with_errors(df: DataFrame, rules: Sequence[Constraint], path: Column | str = "body") -> DataFrame:
    """Adds ``errors``: field path, message and offending value of every broken rule."""
    prefix = F.lit(path) if isinstance(path, str) else path
    entries = []
    for rule in rules:
        raw = F.col(rule.field).cast("string") if rule.field in df.columns else F.lit(None).cast("string")
        message = field_error(df, rule)
        entries.append(
            F.when(
                message.isNotNull(),
                F.struct(
                    F.concat_ws(".", prefix, F.lit(rule.field)).alias("field"),
                    message.alias("message"),
                    raw.alias("value"),
                ),
            )
        )
    return df.withColumn("errors", F.array_compact(F.array(*entries)).cast(ERROR_TYPE))


def accepted(checked: DataFrame, rules: Sequence[Constraint]) -> DataFrame:
    """Rows without errors, their fields cast to numbers; "5.0" and "1e1" are fine as integers."""
    casts = {}
    for rule in rules:
        value = F.col(rule.field).try_cast("double")
        casts[rule.field] = value.try_cast("bigint") if rule.integer else value
    return checked.where(F.size("errors") == 0).withColumns(casts).drop("errors")


def quarantined(checked: DataFrame) -> DataFrame:
    """Rows with errors, next to the reasons."""
    return checked.where(F.size("errors") > 0)


def batch_verdicts(checked: DataFrame, batch: str, max_items: int = BATCH_MAX_ITEMS) -> DataFrame:
    """One row per batch: its size, how many items are broken and whether it may be served.

    Built by aggregation, not by a window over the batch: partial counts are made
    before the shuffle, so a batch holding a third of all rows costs one counter.
    """
    bad = F.size("errors") > 0 if "errors" in checked.columns else F.lit(False)
    counted = checked.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(bad).alias("bad_items")
    )
    return counted.withColumn("size_ok", F.col("total_items").between(1, max_items)).withColumn(
        "accepted", F.col("size_ok") & (F.col("bad_items") == 0)
    )


def serve_batches(checked: DataFrame, batch: str, max_items: int = BATCH_MAX_ITEMS) -> DataFrame:
    """Rows of the batches in which every item is fine and whose size is allowed.

    The other side of the join holds one row per batch, so adaptive execution can
    split a hot batch on the row side without repeating more than that one row.
    """
    good = batch_verdicts(checked, batch, max_items).where("accepted").select(batch)
    return checked.join(good, batch, "left_semi")


def batch_message(total: Column, max_items: int = BATCH_MAX_ITEMS) -> Column:
    """What to tell the sender of a batch of the wrong size."""
    return F.when(total < 1, "List should have at least 1 item after validation, not 0").when(
        total > max_items,
        F.format_string(f"Value error, Batch size %s exceeds maximum allowed ({max_items})", total),
    )


def hyperparameter_errors(configs: DataFrame) -> DataFrame:
    """Long configurations ``(model_type, parameter, value)`` with the bound each value breaks.

    The bounds are a fixed table of a dozen rows, so they become one CASE expression.
    """
    value = F.col("value").cast("string").try_cast("double")
    message = None
    for model, parameter, integer, low, high in HYPERPARAMETER_BOUNDS:
        here = (F.col("model_type") == model) & (F.col("parameter") == parameter)
        kind = "integer" if integer else "number"
        wrong = value.isNull() | F.isnan(value)
        if integer:
            wrong = wrong | (value != F.floor(value))
        checks = (
            (wrong, f"Please enter a valid {kind}"),
            (value < low, f"Value must be >= {_number(low)}"),
            (value > high, f"Value must be <= {_number(high)}"),
        )
        for condition, text in checks:
            message = (F if message is None else message).when(here & condition, text)
    return configs.withColumn("error", message)
