"""Collects catalogue queries next to their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType

from tabforge.functions.scalars import half_away


class Catalogue:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, name: str, oracle: str | None = None):
        """Decorator: adds the function under ``name``, with the SQL that gives the same rows."""

        def add(function):
            self.queries[name] = function
            if oracle:
                self.oracles[name] = oracle
            return function

        return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded as the SQL twins round; whole numbers stay."""
    doubles = [c for c in columns if isinstance(df.schema[c].dataType, DoubleType)]
    return df.withColumns({c: half_away(c, digits) for c in doubles}) if doubles else df


def union_sql(items, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in items)
