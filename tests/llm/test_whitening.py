"""Whitening next to plain whole-number arithmetic and a second eigendecomposition."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from tabforge.llm import queries, whitening


def brute(vectors):
    """Kept rows' x, the fit list's size and sums, deviations and the covariance as fractions."""
    proper = [
        (i, [math.floor(64 * float(c)) + 1_000_000 for c in v])
        for i, v in vectors
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({tuple(x) for _, x in proper})
    n, p = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(p)]
    cov = [
        [Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3) for j in range(p)] for i in range(p)
    ]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in proper]
    return proper, n, sums, deviations, cov


def agree(rows, vectors, k=16):
    proper, n, sums, deviations, cov = brute(vectors)
    matrix = np.array(cov, float)
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    x = np.array([x for _, x in proper]) - np.array([float(Fraction(s, n)) for s in sums])
    want = x @ axes / np.sqrt(values)
    ids = [i for i, _ in proper]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * len(values)
    found = np.array([[got[i, c + 1]["whitened"] for c in range(len(values))] for i in ids])
    signs = np.sign((found * want).sum(axis=0))
    assert np.allclose(found, want * signs, atol=1e-6)
    assert [got[i, 1]["deviation"] for i in ids] == deviations
    assert {r["n"] for r in rows} == {n}
    shares = np.array([got[ids[0], c + 1]["explained"] for c in range(len(values))])
    assert np.allclose(shares, values / np.trace(matrix), rtol=1e-9)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_query_next_to_brute_force(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id", "slice(embedding, 1, 12) AS embedding")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    agree(queries.op13_whitened(spark, str(tmp_path)).collect(), vectors, 12)


def test_covariance_of_the_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    model = whitening.fit(table)
    x = np.unique([[math.floor(64 * c) + 1_000_000 for c in r["embedding"]] for r in table.collect()], axis=0)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert model.n == len(x) and model.sums == x.sum(axis=0).tolist()
    assert np.allclose(model.variances, values[:16], rtol=1e-9) and model.identity_error < 1e-9


NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def awkward():
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=3)], 1) for i in range(40)]
    rows += [(100 + i, rows[0][1], 1) for i in range(60)] + [(0, rows[0][1], 1), (None, rows[1][1], 2)]
    return rows + [(200, None, 1), (201, [], 1), (202, [1.0, None, 2.0], 1), (203, [1.0, NAN, 2.0], 1), (204, [1.0, INF, 0.0], 1)]


def test_awkward_vectors(spark):
    rows = awkward()
    table = spark.createDataFrame(rows + [(300, [1.0], 1), (301, [3e38, 0.0, 0.0], 1)], SCHEMA).selectExpr("*", "1 AS x", "2 AS n", "3 AS v")
    model = whitening.fit(table, components=2)
    found = model.transform(table).collect()
    proper, n, sums, deviations, _ = brute([r[:2] for r in rows])
    assert model.n == n == 40 and model.sums == sums
    assert sorted((r["vec_id"] or -1, int(r["deviation"])) for r in found) == sorted(
        ((i if i is not None else -1) or -1, d) for (i, _), d in zip(proper, deviations, strict=True)
    )
    assert all(len(r["whitened"]) == 2 for r in found)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**30 + 7 * i * i), -float(i) * 2**33, 0.25 * i]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(table, components=3)
    _, n, sums, deviations, cov = brute(rows)
    matrix, _ = whitening.covariance(n, sums, _squares_of(rows, sums, n))
    assert model.sums == sums and matrix.tolist() == [[float(c) for c in row] for row in cov]
    assert [int(r["deviation"]) for r in model.transform(table).orderBy("vec_id").collect()] == deviations


def _squares_of(rows, sums, n):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]).T
    return whitening._squares(np.array([s // n for s in sums], np.int64))(x).tolist()


def test_flat_and_missing_directions(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(4)]
    model = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=5)
    found = model.transform(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in found)
    one = spark.createDataFrame([("a", [1.0, 2.0])], "vec_id string, embedding array<double>")
    model = whitening.fit(one)
    assert model.identity_error is None and model.explained == [None, None]
    assert model.transform(one).collect() == [("a", 0, [None, None])]


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [NAN], 1)]])
def test_no_vectors(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op13_whitened(spark, str(tmp_path))
    assert found.collect() == [] and dict(found.dtypes)["whitened"] == "double"
