"""Exact order statistics and rank cuts by narrowing value ranges.

``percentile`` keeps every distinct value of a column in one task and a global
window sorts all rows into one. Both stop working long before 100 TB. Here each
round counts rows per slice of the ranges that still hold a wanted rank, keeps
the slice the rank falls into and goes on inside it until that slice holds one
value. A round is one aggregation whose result has a fixed maximum size, hot
values collapse into a counter, and the answer is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalars import number

MAX_SLICES = 65_536
MAX_RESULT_ROWS = 262_144


@dataclass
class _Search:
    """One wanted 0-based rank inside ``[low, high]``; ``below`` rows lie under ``low``."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    size: int
    exact_count: bool
    within: tuple[tuple[str, float], ...] = ()

    @property
    def done(self) -> bool:
        if self.low == self.high:
            return True
        last = self.below + self.size - 1
        return self.rank == last or (not self.exact_count and self.rank == self.below)

    @property
    def value(self):
        return self.low if self.rank == self.below and not self.exact_count else self.high


@dataclass(frozen=True)
class ColumnSummary:
    """Count, nulls, range and moments of a column, from the first pass."""

    count: int
    nulls: int
    low: float | None
    high: float | None
    mean: float | None
    variance: float | None


@dataclass
class OrderStatistics:
    summaries: dict[str, ColumnSummary]
    values: dict[tuple[str, int], float]


def summarise(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnSummary]:
    """One pass: count, nulls, min, max, mean and population variance of every column."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        col = F.col(c)
        aggregates += [
            F.count(col).alias(f"n{i}"),
            F.min(col).alias(f"lo{i}"),
            F.max(col).alias(f"hi{i}"),
            F.avg(col).alias(f"mean{i}"),
            F.var_pop(col).alias(f"var{i}"),
        ]
    row = df.agg(*aggregates).first()
    return {
        c: ColumnSummary(
            row[f"n{i}"], row["rows"] - row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"],
            row[f"mean{i}"], row[f"var{i}"],
        )
        for i, c in enumerate(columns)
    }


#: Values whose sizes differ by more are sliced by their logarithm first.
WIDE = 4096


def _wide(low: float, high: float) -> bool:
    return low < 0 < high or max(abs(low), abs(high)) > WIDE * min(abs(low), abs(high))


def _log_number(value: float) -> float:
    """Grows with the value, evenly over the powers of e; 746 lies above -ln of the least double."""
    return math.copysign(math.log(abs(value)) + 746, value) if value else 0.0


def _log_text(column: str) -> str:
    return f"CASE WHEN {column} = 0 THEN 0D ELSE signum({column}) * (ln(abs({column})) + 746D) END"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _literal(value) -> str:
    """SQL text of a number that reads back as the same number."""
    if isinstance(value, float):
        return f"double('{value!r}')"
    return f"{value}L" if isinstance(value, int) else f"{value}BD"


def _up_to(within: tuple, column: str, value) -> str:
    """SQL text for the rows up to ``value`` in lexicographic order."""
    predicate = f"{_name(column)} <= {_literal(value)}"
    for name, tied in reversed(within):
        predicate = f"({_name(name)} < {_literal(tied)} OR ({_name(name)} = {_literal(tied)} AND {predicate}))"
    return predicate


def _halving(conditions: Sequence[str], first: int = 0) -> str:
    """SQL text for the place of the first condition that holds, where each implies the next.

    A row compares itself with as many of them as the logarithm of their number, and the expression is as deep.
    """
    if not conditions:
        return str(first)
    mid = len(conditions) // 2
    return (
        f"CASE WHEN {conditions[mid]} THEN {_halving(conditions[:mid], first)} "
        f"ELSE {_halving(conditions[mid + 1 :], first + mid + 1)} END"
    )


def _pick(values: Iterable, place: str) -> str:
    """SQL text for the value at a place of a constant array."""
    return f"get(array({', '.join(_literal(v) for v in values)}), {place})"


def _slice_text(column: str, place: str, ranges: list[tuple], slices: int, integral: bool) -> str:
    """SQL text for the slice of a value inside the range at ``place``."""
    if integral:
        # Dividing before subtracting keeps full-range integers from overflowing.
        widths = [(int(high) - int(low)) // slices + 1 for low, high in ranges]
        # Truncated towards zero, as SQL divides.
        starts = [int(low) // w if low >= 0 else -(-int(low) // w) for (low, _), w in zip(ranges, widths, strict=True)]
        return f"{column} div {_pick(widths, place)} - {_pick(starts, place)}"
    # Halving first keeps the width finite for ranges up to the largest double.
    scales = [
        (True, _log_number(low), _log_number(high)) if _wide(low, high) else (False, low / 2, high / 2)
        for low, high in ranges
    ]
    texts = []
    for wide, value in ((False, f"{column} / 2"), (True, _log_text(column))):
        if any(s[0] == wide for s in scales):
            start = _pick((s[1] if s[0] == wide else 0.0 for s in scales), place)
            width = _pick((s[2] - s[1] if s[0] == wide else 1.0 for s in scales), place)
            share = f"floor(({value} - {start}) / {width} * {slices})"
            texts.append(f"greatest(0L, least({share}, {slices - 1}L))")
    if len(texts) == 1:
        return texts[0]
    return f"CASE WHEN {_pick((int(s[0]) for s in scales), place)} = 1L THEN {texts[1]} ELSE {texts[0]} END"


def _bracket(search: _Search) -> tuple:
    return (search.column, search.low, search.high, search.within)


def _count_slices(
    df: DataFrame, brackets: list[tuple], integral: bool, written: bool = False
) -> dict[int, list[tuple]]:
    """Rows, min and max per slice of every bracket, in one job.

    Brackets of one column never overlap, so a row enters at most one per column, found by halving. A ``written``
    table is scanned once for each column still searched, without the others; else all columns share one scan.
    """
    slices = max(64, min(MAX_SLICES if integral else 4096, MAX_RESULT_ROWS // len(brackets)))
    own: dict[str, list[tuple]] = {}
    for i, (name, low, high, within) in enumerate(brackets):
        own.setdefault(name, []).append((tuple(v for _, v in within), low, high, i, within))
    places, entries, parts = [], [], []
    for n, (name, found) in enumerate(own.items()):
        found.sort(key=lambda f: f[:2])
        column, place = _name(name), f"__place{n}"
        places.append(F.expr(_halving([_up_to(w, name, high) for _, _, high, _, w in found])).alias(place))
        inside = [f"{column} >= {_pick((f[1] for f in found), place)}", f"{column} <= {_pick((f[2] for f in found), place)}"]
        for k, (other, _) in enumerate(found[0][4]):
            inside.append(f"{_name(other)} = {_pick((f[0][k] for f in found), place)}")
        index = _slice_text(column, place, [f[1:3] for f in found], slices, integral)
        if written:
            inner = df.withColumn(place, places[-1]).where(" AND ".join(inside))
            bracket = F.expr(_pick((f[3] for f in found), place))
            parts.append(inner.select(bracket.alias("b"), F.expr(index).alias("s"), F.col(column).alias("v")))
        entries.append(
            f"CASE WHEN {' AND '.join(inside)} THEN "
            f"named_struct('b', {_pick((f[3] for f in found), place)}, 's', {index}, 'v', {column}) END"
        )
    if parts:
        inside_rows = reduce(DataFrame.unionByName, parts)
    else:
        flat = df.select("*", *places)
        if len(entries) == 1:
            flat = flat.select(F.expr(entries[0]).alias("e"))
        else:
            flat = flat.select(F.explode(F.array(*[F.expr(e) for e in entries])).alias("e"))
        inside_rows = flat.where("e is not null").select("e.*")
    rows = (
        inside_rows.groupBy("b", "s")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    result: dict[int, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (r["b"], r["s"])):
        result.setdefault(r["b"], []).append((r["n"], r["lo"], r["hi"]))
    return result


def _narrow(df: DataFrame, searches: list[_Search], integral: bool, written: bool = False) -> None:
    """Runs rounds until every search is done."""
    while open_searches := [s for s in searches if not s.done]:
        brackets = sorted({_bracket(s) for s in open_searches})
        counted = _count_slices(df, brackets, integral, written)
        where = {b: counted[i] for i, b in enumerate(brackets)}
        for s in open_searches:
            below, before = s.below, (s.low, s.high, s.size)
            for n, low, high in where[_bracket(s)]:
                if s.rank < below + n:
                    s.low, s.high, s.below, s.size = low, high, below, n
                    break
                below += n
            if not s.done and before == (s.low, s.high, s.size):
                raise ArithmeticError(f"no progress in {s.column} between {s.low} and {s.high}")


def _is_integral(df: DataFrame, columns: Sequence[str]) -> bool:
    kinds = dict(df.dtypes)
    return all(kinds[c] in ("bigint", "int", "smallint", "tinyint") for c in columns)


def order_statistics(
    df: DataFrame, ranks: Callable[[str, ColumnSummary], Iterable[int]], columns: Sequence[str], written: bool = False
) -> OrderStatistics:
    """Values at 0-based ranks of the non-null values of each column.

    ``ranks(column, summary)`` names the wanted ranks once the counts are known. ``written`` says that ``df`` is a
    table of files, whose columns are cheap to read one by one.
    """
    integral = _is_integral(df, columns)
    cast = "bigint" if integral else "double"
    base = df.select(*[(F.col(c).cast(cast) if integral else number(c)).alias(c) for c in columns])
    summaries = summarise(base, columns)
    if endless := [c for c, s in summaries.items() if s.count and math.inf in (abs(s.low), abs(s.high))]:
        raise ValueError(f"infinite values in {endless}")
    searches = [
        _Search(c, r, summaries[c].low, summaries[c].high, 0, summaries[c].count, False)
        for c in columns
        for r in sorted(set(ranks(c, summaries[c])))
        if 0 <= r < summaries[c].count
    ]
    _narrow(base, searches, integral, written and len(columns) > 1)
    return OrderStatistics(summaries, {(s.column, s.rank): s.value for s in searches})


def interpolation_ranks(count: int, probability: float) -> tuple[int, int, float]:
    """The two neighbouring ranks and the weight of the upper one (linear interpolation)."""
    position = (count - 1) * probability
    low = math.floor(position)
    return low, min(math.ceil(position), count - 1), position - low


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], written: bool = False
) -> dict[str, list]:
    """Exact, linearly interpolated quantiles of every column; ``None`` for an empty column."""

    def wanted(_, summary):
        for p in probabilities:
            low, high, _ = interpolation_ranks(summary.count, p)
            yield from (low, high)

    stats = order_statistics(df, wanted, columns, written)
    result = {}
    for c in columns:
        n = stats.summaries[c].count
        result[c] = []
        for p in probabilities:
            if n == 0:
                result[c].append(None)
                continue
            low, high, weight = interpolation_ranks(n, p)
            a, b = float(stats.values[c, low]), float(stats.values[c, high])
            result[c].append(a + (b - a) * weight)
    return result


def _cut_texts(
    df: DataFrame, order: Sequence[str], sizes: Sequence[int], total: int, bounds: dict[str, tuple[int, int]] | None
) -> list[str]:
    limits = dict(bounds or {})
    if unknown := [c for c in order if c not in limits]:
        limits.update({c: (s.low, s.high) for c, s in summarise(df, unknown).items()})
    predicates = {m: "true" if m > 0 else "false" for m in sizes if m <= 0 or m >= total}
    # Size of a cut -> rows wanted among those equal in ``within``, and how many there are.
    pending = {m: (m, total, ()) for m in sizes if m not in predicates}
    for column in order:
        searches = {
            m: _Search(column, wanted - 1, *limits[column], 0, available, True, within)
            for m, (wanted, available, within) in pending.items()
        }
        _narrow(df, list(searches.values()), _is_integral(df, [column]))
        for m, search in searches.items():
            wanted, _, within = pending.pop(m)
            if search.below + search.size == wanted:
                predicates[m] = _up_to(within, column, search.value)
            else:
                pending[m] = (wanted - search.below, search.size, (*within, (column, search.value)))
        if not pending:
            break
    for _, available, within in pending.values():
        raise ValueError(f"{available} rows share {dict(within)} at a cut; order by a unique key")
    return [predicates[m] for m in sizes]


def rank_cuts(
    df: DataFrame,
    order: Sequence[str],
    sizes: Sequence[int],
    total: int,
    bounds: dict[str, tuple[int, int]] | None = None,
) -> list[Column]:
    """One predicate per size ``m`` that holds for exactly the first ``m`` rows in ``order``.

    The order columns are numbers, and unique taken together. Where a cut falls
    among rows sharing the first column, those rows are cut by the next one; all
    cuts go through one column together. ``bounds`` are known limits of columns
    and save the pass that finds them.
    """
    return [F.expr(text) for text in _cut_texts(df, order, sizes, total, bounds)]


def rank_bands(
    df: DataFrame,
    order: Sequence[str],
    sizes: Sequence[int],
    total: int,
    bounds: dict[str, tuple[int, int]] | None = None,
) -> Column:
    """Number of the cuts at the rising ``sizes`` that a row lies behind: 0 for the first ``sizes[0]`` rows, and so on."""
    if list(sizes) != sorted(sizes):
        raise ValueError("sizes must rise")
    return F.expr(_halving(_cut_texts(df, order, sizes, total, bounds)))
