"""Whitening of embeddings by polarisation: covariances from variances of single dimensions and of pair sums.

Entries become whole numbers, x = floor(SCALE * c) + SHIFT, so every sum is exact and does not depend on the
layout. For a single dimension or the sum of two, the squares of n * value - sum are added up; half of
Q(i + j) - Q(i) - Q(j) is the cross-covariance of i and j, exactly, whatever the order of rows. Tasks square
x less the whole part of its mean, which is small, and the driver, which gets one number per dimension and pair,
restores the rest: n^2 * sum(d^2) - n * r^2 with r = sum(d). The matrix is put together in whole numbers, divided once,
and given to ``eigh``.

The fit list holds each distinct vector once: copies fold in the shuffle's partial aggregation, so a vector that
fills a third of the table is one row per task. The list is written once and read for the sums, the squares and the
check of the result; nothing grows with the rows on the driver.

Defined results: rows are dropped if the vector is null, holds a null or a value that is not finite or beyond 2^53 in
x, or has another length than most rows (ties: the shorter; empty vectors always). Repeated rows and ids stay, each
with its result; ids keep their type and may be null. A component along which the fit list does not vary has no
whitened value (null); without rows there are no components and no result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabforge.session import materialise

SCALE, SHIFT = 64, 1_000_000
#: Largest size of an entry that doubles hold exactly.
_LARGEST = 2**53
#: Rows that are squared together at most.
BLOCK = 8_192
_SUMS = "slot int, total decimal(38,0)"


@dataclass
class Whitening:
    """Exact sums of the fit list, its leading components (columns, falling variance) and the check of the result."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        """Share of each component in the whole variance."""
        return [float(e) / self.trace if self.trace else None for e in self.variances]

    def transform(self, df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
        """Rows (vec_id, deviation, whitened): sum over dimensions of (n * x - sum)^2, exact (null beyond 38 digits),
        and a value for each component."""
        rows = _vectors(df, vector_column, id_column).where(F.size("x") == len(self.sums))
        made = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType)])
        made = made.add("deviation", T.DecimalType(38, 0)).add("whitened", T.ArrayType(T.DoubleType()))
        return rows.mapInArrow(_whiten(self, to_arrow_schema(made)), made)


def _vectors(df: DataFrame, vector_column: str, id_column: str | None = None) -> DataFrame:
    """Ids and whole numbers ``x`` of the rows whose vector holds numbers only."""
    own = [F.col(id_column).alias("vec_id")] if id_column else []
    rows = df.select(*own, F.col(vector_column).cast("array<double>").alias("v"))
    # NaN is larger than every bound.
    proper = F.forall("v", lambda c: F.coalesce(F.abs(c * SCALE) <= _LARGEST - SHIFT, F.lit(False)))
    x = F.when(proper & (F.size("v") > 0), F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT))
    return rows.withColumn("x", x).where(F.col("x").isNotNull()).drop("v")


def _matrix(column: pa.Array) -> np.ndarray:
    """Whole numbers of a batch of vectors of one length, a row for each dimension."""
    flat = np.asarray(column.flatten(), np.int64)
    return np.ascontiguousarray(flat.reshape(len(column), -1).T)


def _summed(make, slots: int):
    """Adds up what ``make`` returns for each block of vectors; one exact row per slot and task."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, object)
        for batch in given:
            for low in range(0, batch.num_rows, BLOCK):
                total += make(_matrix(batch.column("x").slice(low, BLOCK))).astype(object)
        numbers = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots, dtype=np.int32)), numbers], ["slot", "total"])

    return run


def _collect(vectors: DataFrame, make, slots: int) -> list[int]:
    rows = vectors.mapInArrow(_summed(make, slots), _SUMS).groupBy("slot").agg(F.sum("total").alias("total"))
    found = {r["slot"]: int(r["total"]) for r in rows.collect()}
    return [found.get(i, 0) for i in range(slots)]


def _sizes(x: np.ndarray) -> np.ndarray:
    """Number of vectors, then the sum of each dimension."""
    return np.concatenate([np.array([x.shape[1]], object), x.sum(axis=1, dtype=object)])


def _squares(centre: np.ndarray):
    """Squares of every centred dimension, then of every centred sum of two (0 and 1, 0 and 2, ..., 1 and 2, ...)."""

    def make(x: np.ndarray) -> np.ndarray:
        d = x - centre[:, None]
        if d.size and (2 * int(np.abs(d).max())) ** 2 * d.shape[1] >= 2**63:
            d = d.astype(object)
        out = [(d * d).sum(axis=1)]
        for i in range(len(d) - 1):
            pair = d[i + 1 :] + d[i]
            out.append((pair * pair).sum(axis=1))
        return np.concatenate(out)

    return make


def covariance(n: int, sums: list[int], squares: list[int]) -> tuple[np.ndarray, float]:
    """Covariance matrix (divisor n) and its trace from the centred squares, in whole numbers up to one division."""
    p = len(sums)
    rest = [s - n * (s // n) for s in sums]
    single = [n * n * q - n * r * r for q, r in zip(squares[:p], rest, strict=True)]
    matrix, at = np.zeros((p, p)), p
    for i in range(p):
        matrix[i, i] = single[i] / n**3
        for j in range(i + 1, p):
            both = n * n * squares[at] - n * (rest[i] + rest[j]) ** 2
            matrix[i, j] = matrix[j, i] = (both - single[i] - single[j]) / (2 * n**3)
            at += 1
    return matrix, sum(single) / n**3


def _scaled(model: Whitening) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole and broken part of the means, and the components over the roots of their variances (0: no variance)."""
    n = max(model.n, 1)
    whole = np.array([s // n for s in model.sums], np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in model.sums])
    roots = np.sqrt(model.variances)
    return whole, rest, np.divide(model.components, roots, out=np.zeros_like(model.components), where=roots > 0)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if largest < 2**62 and n < 2**62:
        z = x * n - np.array(sums, np.int64)[:, None]
        if len(z) * int(np.abs(z).max(initial=0)) ** 2 < 2**62:
            return pa.array((z * z).sum(axis=0)).cast(pa.decimal128(38, 0))
    z = x.astype(object) * n - np.array(sums, object)[:, None]
    made = [int(t) for t in (z * z).sum(axis=0)]
    return pa.array([Decimal(t) if t < 10**38 else None for t in made], pa.decimal128(38, 0))


def _whiten(model: Whitening, schema: pa.Schema):
    whole, rest, weights = _scaled(model)
    flat = np.flatnonzero(model.variances <= 0)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                x = _matrix(part.column("x"))
                values = ((x - whole[:, None]) - rest[:, None]).T @ weights
                values[:, flat] = np.nan
                numbers = pa.array(values.ravel(), from_pandas=True)
                offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
                lists = pa.ListArray.from_arrays(offsets, numbers)
                columns = [part.column("vec_id"), _deviations(x, model.n, model.sums), lists.cast(schema.field(2).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _products(model: Whitening):
    """Sums of the whitened values and of their products, a row per slot and task."""
    whole, rest, weights = _scaled(model)
    k = weights.shape[1]

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in given:
            for low in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column("x").slice(low, BLOCK))
                values = ((x - whole[:, None]) - rest[:, None]).T @ weights
                total[:k] += values.sum(axis=0)
                total[k:] += (values.T @ values).ravel()
        slots = pa.array(np.arange(len(total), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([slots, pa.array(total)], ["slot", "total"])

    return run


def _identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest difference between the covariance of the whitened fit list and the identity."""
    used = np.flatnonzero(model.variances > 0)
    if not len(used):
        return None
    k = len(model.variances)
    rows = vectors.mapInArrow(_products(model), "slot int, total double").groupBy("slot").agg(F.sum("total").alias("t"))
    found = np.zeros(k + k * k)
    for row in rows.collect():
        found[row["slot"]] = row["t"] / model.n
    # The values are centred by the exact mean; what is left of theirs is rounding, taken off all the same.
    spread = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return float(np.abs(spread - np.eye(k))[np.ix_(used, used)].max())


def fit(df: DataFrame, vector_column: str = "embedding", components: int = 16) -> Whitening:
    """Learns the leading components from the distinct vectors of the whole table."""
    rows = _vectors(df, vector_column)
    lengths = rows.groupBy(F.size("x").alias("p")).count().orderBy(F.desc("count"), "p").limit(1).collect()
    if not lengths:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    p = lengths[0]["p"]
    vectors = materialise(rows.where(F.size("x") == p).distinct(), "vectors")
    n, *sums = _collect(vectors, _sizes, p + 1)
    centre = np.array([s // n for s in sums], np.int64)
    squares = _collect(vectors, _squares(centre), p + p * (p - 1) // 2)
    matrix, trace = covariance(n, sums, squares)
    values, directions = np.linalg.eigh(matrix)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    floor = max(float(values.max(initial=0)), 0.0) * p * np.finfo(float).eps
    values = np.where(values > floor, values, 0.0)
    model = Whitening(n, sums, values, np.ascontiguousarray(directions), trace)
    model.identity_error = _identity_error(vectors, model)
    return model
