"""Round-robin imputation: each gap is regressed on the other features, round after round.

Run naively, every (round, feature) step is a pass over the data. But within one pattern of gaps an imputed value is a
linear function of the observed ones, so the regressions see the rows of a pattern through their cross products alone.
A pattern with more rows than observed columns is therefore replaced by the triangular factor of its rows: as many
rows as observed columns and the constant, with the same cross products, and imputed like any other row. Two scans
give means and factors. A step is one aggregate over the table of factors, whatever the number of patterns. Rounds
are fitted two, four, eight at a time; after each lot one scan of the incomplete rows measures how far the values moved
in every round, which tells where to stop.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalars import number as as_number
from tabforge.session import materialise

#: Rows a task holds before it replaces them by factors.
HELD_ROWS = 65_536
#: Rounds in the first lot; every further lot has twice as many.
FIRST_LOT = 2
FACTORS = "pattern binary, row array<double>"


@dataclass
class IterativeState:
    """Column means and the fitted steps ``{feature, others, weights, offset, round}``."""

    features: list[str]
    means: list[float]
    steps: list[dict] = field(default_factory=list)
    rounds: int = 0


def bayesian_ridge(n: float, mean_x, mean_y, xtx, xty, yty, max_iter: int = 300, tol: float = 1e-3):
    """Coefficients and intercept by evidence maximisation, from centred cross products."""
    tiny = 1e-6  # fixed value: shape and rate of both Gamma priors
    values, vectors = np.linalg.eigh(xtx)
    values = np.maximum(values, 0.0)
    projected = vectors.T @ xty
    noise = 1.0 / (yty / n + np.finfo(float).eps)
    prior = 1.0

    def solve(noise, prior):
        return vectors @ (projected / (values + prior / noise))

    previous = None
    for iteration in range(max_iter):
        weights = solve(noise, prior)
        error = max(float(yty - 2 * weights @ xty + weights @ xtx @ weights), 0.0)
        used = float(np.sum(noise * values / (prior + noise * values)))
        prior = (used + 2 * tiny) / (float(weights @ weights) + 2 * tiny)
        noise = (n - used + 2 * tiny) / (error + 2 * tiny)
        if iteration and np.sum(np.abs(previous - weights)) < tol:
            break
        previous = weights
    weights = solve(noise, prior)
    return weights, float(mean_y - mean_x @ weights)


def advance(rows: np.ndarray, missing: np.ndarray, steps: Sequence[dict]) -> np.ndarray:
    """Applies fitted steps in place to centred rows, whose last column is the constant."""
    for step in steps:
        gaps = np.flatnonzero(missing[:, step["feature"]])
        if len(gaps):
            linear = np.zeros(rows.shape[1])
            linear[step["others"]], linear[-1] = step["weights"], step["offset"]
            rows[gaps, step["feature"]] = rows[gaps] @ linear
    return rows


def _with_constant(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with 0 in their gaps and 1 in a further column, and where the gaps are."""
    missing = np.isnan(x)
    return np.column_stack([np.where(missing, 0.0, x), np.ones(len(x))]), missing


def _columns(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """The features as an array with NaN in the gaps."""
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])


def _patterns(missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of every row's pattern of gaps, and the rows of each pattern."""
    marks = np.packbits(missing, axis=1)
    if marks.shape[1] <= 8:
        # Up to 64 marks are one number, which sorts faster than a row of bytes.
        wide = np.zeros((len(marks), 8), np.uint8)
        wide[:, : marks.shape[1]] = marks
        _, pattern, counts = np.unique(wide.view(np.uint64)[:, 0], return_inverse=True, return_counts=True)
    else:
        _, pattern, counts = np.unique(marks, axis=0, return_inverse=True, return_counts=True)
    return pattern.reshape(-1), counts


def condense(rows: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The factor of every pattern with more rows than columns, and the other rows as they are."""
    width = rows.shape[1]
    pattern, counts = _patterns(missing)
    order, ends = np.argsort(pattern, kind="stable"), np.cumsum(counts)
    few = counts[pattern] <= width
    out, gaps = [rows[few]], [missing[few]]
    for n in np.flatnonzero(counts > width):
        own = order[ends[n] - counts[n] : ends[n]]
        seen = np.append(~missing[own[0]], True)
        factor = np.zeros((int(seen.sum()), width))
        factor[:, seen] = np.linalg.qr(rows[np.ix_(own, seen)], mode="r")
        out.append(factor)
        gaps.append(np.tile(missing[own[0]], (len(factor), 1)))
    return np.concatenate(out), np.concatenate(gaps)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).copy()
    marks = np.frombuffer(b"".join(batch.column("pattern").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return rows, np.unpackbits(marks, axis=1, count=rows.shape[1] - 1).astype(bool)


def _batch(rows: np.ndarray, missing: np.ndarray) -> pa.RecordBatch:
    marks = [m.tobytes() for m in np.packbits(missing, axis=1)]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), lists], ["pattern", "row"])


def _condensed(read, held: int):
    """Factors of a partition; what does not shrink goes on as it is, so memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(read(batch))
            size += batch.num_rows
            if size >= held:
                parts = [condense(*(np.concatenate(c) for c in zip(*parts, strict=True)))]
                size = len(parts[0][0])
                if size > held // 2:
                    yield _batch(*parts[0])
                    parts, size = [], 0
        if parts:
            yield _batch(*condense(*(np.concatenate(c) for c in zip(*parts, strict=True))))

    return run


def factors(centred: DataFrame, features: Sequence[str], held: int = HELD_ROWS) -> DataFrame:
    """Rows (pattern, row) with the cross products of all rows of each pattern, condensed before and after the shuffle."""

    def raw(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _with_constant(_columns(batch, features))

    first = centred.mapInArrow(_condensed(raw, held), FACTORS)
    return first.repartition("pattern").mapInArrow(_condensed(_read, held), FACTORS)


def _advanced(steps: Sequence[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, missing = _read(batch)
                yield _batch(advance(rows, missing, steps), missing)

    return run


def _total(table: DataFrame, p: int, steps: Sequence[dict], target: int | None) -> np.ndarray:
    """Cross products after ``steps`` over the rows that have ``target`` (all rows without one)."""
    above = np.triu_indices(p + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p + 1))
        for batch in batches:
            if batch.num_rows:
                rows, missing = _read(batch)
                if target is not None:
                    own = ~missing[:, target]
                    rows, missing = rows[own], missing[own]
                advance(rows, missing, steps)
                total += rows.T @ rows
        cells = total[above]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "v"])

    sums = table.mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    cells = np.zeros(len(above[0]))
    for row in sums.collect():
        cells[row["cell"]] = row["v"]
    total = np.zeros((p + 1, p + 1))
    total[above] = cells
    return total + np.triu(total, 1).T


def _fit_step(total: np.ndarray, feature: int, p: int, number: int) -> dict:
    others = [i for i in range(p) if i != feature]
    n = total[p, p]
    means = total[:p, p] / n
    centred = total[:p, :p] - n * np.outer(means, means)
    weights, offset = bayesian_ridge(
        n,
        means[others],
        means[feature],
        centred[np.ix_(others, others)],
        centred[others, feature],
        centred[feature, feature],
    )
    return {
        "feature": feature,
        "others": others,
        "weights": weights.tolist(),
        "offset": offset,
        "round": number,
    }


def _fit_round(table: DataFrame, order: Sequence[int], gaps: Sequence[int], done: list[dict], number: int) -> list[dict]:
    """The steps of a round. Features without gaps change no row, so they share one aggregate."""
    p, steps = len(gaps), []
    whole = [f for f in order if not gaps[f]]
    if whole:
        total = _total(table, p, done, None)
        steps += [_fit_step(total, f, p, number) for f in whole]
    for feature in order:
        if gaps[feature]:
            steps.append(_fit_step(_total(table, p, [*done, *steps], feature), feature, p, number))
    return steps


def _centred(df: DataFrame, features: Sequence[str], means: Sequence[float]) -> DataFrame:
    return df.select(
        *[(F.col(f).cast("double") - F.lit(m)).alias(f) for f, m in zip(features, means, strict=True)]
    )


def fit(train: DataFrame, features: Sequence[str], max_iter: int = 10, tol: float = 1e-3) -> IterativeState:
    """Fits the steps of every round up to convergence."""
    features, p = list(features), len(features)
    numeric = train.select(*[as_number(f).alias(f) for f in features])
    first = numeric.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f).alias(f"n{i}") for i, f in enumerate(features)],
        *[F.avg(f).alias(f"mean{i}") for i, f in enumerate(features)],
        *[F.max(F.abs(f)).alias(f"top{i}") for i, f in enumerate(features)],
    ).first()
    empty = [f for i, f in enumerate(features) if not first[f"n{i}"]]
    if empty:
        raise ValueError(f"no values in {empty}")
    state = IterativeState(features, [first[f"mean{i}"] for i in range(p)])
    gaps = [first["n"] - first[f"n{i}"] for i in range(p)]
    # Features complete in training get their regression too: they may have gaps later.
    order = sorted(range(p), key=lambda i: (gaps[i], i))
    if p < 2 or max_iter < 1:
        return state

    centred = _centred(numeric, features, state.means)
    table = materialise(factors(centred, features), "factors")
    limit = tol * max(first[f"top{i}"] for i in range(p))
    steps, lot = [], FIRST_LOT
    while True:
        fresh: list[dict] = []
        stop = min(max_iter, state.rounds + lot)
        for number in range(state.rounds, stop):
            fresh += _fit_round(table, order, gaps, fresh, number)
        steps += fresh
        moved = _movement(centred, features, steps, stop)
        settled = [r + 1 for r in range(state.rounds, stop) if moved[r] < limit]
        state.rounds = settled[0] if settled else stop
        if settled or stop == max_iter:
            break
        table, lot = materialise(table.mapInArrow(_advanced(fresh), FACTORS), "factors"), 2 * lot
    state.steps = [s for s in steps if s["round"] < state.rounds]
    return state


def _movement(centred: DataFrame, features: list[str], steps: list[dict], rounds: int) -> list[float]:
    """Largest sum of absolute changes in any row in each round, in one pass over the incomplete rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(rounds)
        for batch in batches:
            rows, missing = _with_constant(_columns(batch, features))
            for number in range(rounds):
                before = rows.copy()
                advance(rows, missing, [s for s in steps if s["round"] == number])
                if len(rows):
                    top[number] = max(top[number], np.abs(rows - before).sum(axis=1).max())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(top)], ["round", "moved"])

    gaps = " OR ".join(f"`{f}` IS NULL" for f in features)
    rows = (
        centred.where(gaps)
        .mapInArrow(partial, "round int, moved double")
        .groupBy("round")
        .agg(F.max("moved").alias("moved"))
        .collect()
    )
    result = [0.0] * rounds
    for row in rows:
        result[row["round"]] = row["moved"]
    return result


def impute(df: DataFrame, state: IterativeState) -> DataFrame:
    """Fills gaps by replaying the fitted steps; only incomplete rows go through Python."""
    features = state.features
    typed = df.withColumns({f: as_number(f) for f in features})
    means, steps = np.array(state.means), state.steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _columns(batch, features)
            rows, missing = _with_constant(raw - means)
            new = np.where(missing, advance(rows, missing, steps)[:, :-1] + means, raw)
            names = batch.schema.names
            # Other columns go back as they came.
            columns = [
                pa.array(new[:, features.index(name)]) if name in features else batch.column(i)
                for i, name in enumerate(names)
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    gaps = " OR ".join(f"`{f}` IS NULL" for f in features)
    filled = typed.where(gaps).mapInArrow(run, typed.schema)
    return typed.where(f"NOT ({gaps})").unionByName(filled)
