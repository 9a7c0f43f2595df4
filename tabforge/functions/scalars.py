"""Small column functions used by scoring and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabforge.spec import CURRENCY, PRICE_MULTIPLIER


def number(value: Column | str) -> Column:
    """A double with one mark for missing and one zero: NaN becomes NULL, -0.0 becomes 0.0."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(value), value + F.lit(0.0))


def half_away(value: Column | str, digits: int) -> Column:
    """A double rounded in doubles, halves away from zero, as SQL engines round: 0.285 is below its half, so it gives 0.28.

    Spark's own rounding works on the shortest decimal text and gives 0.29.
    """
    value = F.col(value) if isinstance(value, str) else value
    scale = F.lit(10.0**digits)
    # ``round`` goes through decimal text; ``rint`` only takes halves to the even neighbour.
    size = F.abs(value) * scale
    even = F.rint(size)
    return F.signum(value) * F.when(size - even == 0.5, even + 1).otherwise(even) / scale


def short_id(column: Column) -> Column:
    """First eight characters of an identifier."""
    return F.substring(column, 1, 8)


def money(value: Column, symbol: str = CURRENCY, multiplier: float = PRICE_MULTIPLIER) -> Column:
    """``$24,500`` from 24.5: scaled, no decimals, thousands separated, halves to even."""
    return F.concat(F.lit(symbol), F.format_number(value * F.lit(multiplier), 0))


def number_text(value: Column) -> Column:
    """A double the way it is usually written: shortest digits, plain between 1e-4 and 1e16."""
    value = value.cast("double")
    size = F.abs(value)
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    needs_plain = ((size >= 1e-4) & (size < 1e-3)) | ((size >= 1e7) & (size < 1e16))
    return F.when(needs_plain, plain).otherwise(value.cast("string"))


def run_name(model: Column, preprocessing: Column, at: Column) -> Column:
    return F.concat_ws("_", model, preprocessing, F.date_format(at, "yyyyMMdd_HHmmss"))


# Hyperparameters shown in a run's display name, and their short names.
_SHOWN = (("n_estimators", "n"), ("max_depth", "d"), ("learning_rate", "lr"))


def display_name(model: Column, preprocessing: Column, hyperparameters: Column) -> Column:
    """``model_prep (n=100, d=3)`` with the parameters that are set."""
    shown = F.concat_ws(
        ", ",
        *[
            F.when(hyperparameters[key].isNotNull(), F.concat(F.lit(f"{short}="), hyperparameters[key]))
            for key, short in _SHOWN
        ],
    )
    base = F.concat_ws("_", model, preprocessing)
    return F.when(shown == "", base).otherwise(F.concat(base, F.lit(" ("), shown, F.lit(")")))


def version_description(model: Column, preprocessing: Column, r2: Column, rmse: Column) -> Column:
    return F.format_string(
        "%s with %s preprocessing. Test R²: %.4f, RMSE: %.4f", model, preprocessing, r2, rmse
    )


def minute_text(epoch_ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` of a time in milliseconds since 1970."""
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd HH:mm")


def iso_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def is_server_error(status: Column) -> Column:
    return status.cast("string").rlike("^5..$")


def with_default(mapping: Column, key: str, default) -> Column:
    return F.coalesce(mapping[key], F.lit(default))


def strip_prefix(text: Column, prefixes: Sequence[str]) -> Column:
    return F.regexp_replace(text, f"^({'|'.join(prefixes)})_", "")


def prefixed(mapping: Column, prefix: str) -> Column:
    """The same map with every key put behind ``prefix``."""
    return F.transform_keys(mapping, lambda key, _: F.concat(F.lit(prefix), key))
