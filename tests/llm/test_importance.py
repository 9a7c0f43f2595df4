"""Importance resampling next to a plain version of the whole computation."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabforge.llm import importance, queries
from tests.llm.rows import SCHEMA, awkward, clashing, empty

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None) -> tuple[int, list[int]]:
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r) % 10_000 for r in runs]


def brute(docs, target):
    """doc_id -> rows of (n_features, weight, score, rank), as lists, since ids may repeat."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = s.total() + 10_000.0, t.total() + 10_000.0
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        n_words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([n_words >= 20, -score, doc_id is not None, doc_id or 0, len(found), weight, score])
    able = sorted((r for r in rows if r[0]), key=lambda r: r[1:4])
    ranks = {id(r): i + 1 for i, r in enumerate(able[: len(able) * 5 // 100])}
    return sorted(
        ((r[3] if r[2] else None, r[4], r[5], r[6], ranks.get(id(r))) for r in rows), key=str
    )


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", "é1", " ", "\n", "-", "x" * 9, "\x00", "世"]), max_size=60).map("".join), st.integers(1, 9))
def test_runs_do_not_depend_on_the_slices(text, size):
    kept, importance.SLICE = importance.SLICE, size
    try:
        n, found = 0, []
        for count, runs in importance.runs_of(text.encode()):
            n += count
            found += [c % 10_000 for r in runs for c in r]
    finally:
        importance.SLICE = kept
    want = features(text)
    assert (n, sorted(found)) == (want[0], sorted(want[1]))


def test_query_next_to_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12_importance(spark, sf).collect()), key=str)
    assert got == brute([tuple(r) for r in docs], target)
    assert sum(r[4] is not None for r in got) > 0


def test_query_next_to_sql(spark, sf):
    con = oracle.connect(sf)
    assert oracle.compare(spark, con, queries.op12_importance, queries.OP12_SQL, sf) is None


def test_awkward_documents(spark):
    docs = awkward(spark)
    target = spark.createDataFrame([("the river below",), (None,)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows *= 9  # so that some are drawn, with ties among copies
    many = docs
    for _ in range(8):
        many = many.union(docs)
    got = importance.draw(clashing(many), target).drop("n_words").collect()
    want = brute(rows, ["the river below", None])
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(r[4] is not None for r in want)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.draw(empty(spark), none).collect() == []
    one = spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA)
    assert importance.draw(one, none).first()["weight"] < 0


@pytest.mark.parametrize("kind", ["string", "double", "decimal(20,1)"])
def test_ids_keep_their_type(spark, kind):
    value = "'007'" if kind == "string" else f"cast(1.5 AS {kind})"
    docs = spark.sql(f"SELECT {value} AS doc_id, '{'w ' * 30}' AS text FROM range(40)")
    found = importance.draw(docs, docs)
    assert found.schema["doc_id"].dataType.simpleString() == kind
    assert sorted(r["rank"] for r in found.collect() if r["rank"]) == [1, 2]


def test_ranks_run_through_all_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "id % 3 AS score").repartition(5)
    found = importance.ranked(rows, [F.col("score").desc(), F.col("id").asc()]).collect()
    want = sorted(range(5000), key=lambda i: (-(i % 3), i))
    assert [r["id"] for r in sorted(found, key=lambda r: r["rank"])] == want
