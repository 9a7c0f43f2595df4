"""Ids of other types than long come back as they are, and rows whose ids read alike as numbers stay apart."""

import pytest

from tabforge.llm import decontaminate, exact, nearcopies, personal, quality, toxicity
from tests.llm.rows import PROSE

KINDS = {
    "string": ["007", "7", "a1", "08", "8", "b"],
    "double": [1.5, 1.25, 2.5, 3.75, 4.5, 5.5],
    "decimal(20,2)": ["1.50", "1.25", "2.50", "3.75", "4.50", "5.50"],
}


def texts():
    words = [" ".join(PROSE[i:] + PROSE[:i]) for i in range(4)]
    return [words[0], words[1], f"mail a{1}@b.org now", words[0] + " tail", words[3], "x"]


@pytest.fixture(params=sorted(KINDS))
def docs(request, spark):
    kind, made = request.param, list(zip(map(str, KINDS[request.param]), texts(), strict=True))
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], "i string, text string, lang string, source string, n_chars long")
    return rows.selectExpr(f"cast(i AS {kind}) AS doc_id", "text", "lang", "source", "n_chars")


def agree(docs, found):
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    ids = sorted(r["doc_id"] for r in docs.collect())
    assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == ids


def test_every_row_comes_back_with_its_id(spark, docs):
    agree(docs, personal.find(docs, personal.fit(docs)))
    agree(docs, quality.score(docs, quality.fit(docs)))
    benchmark = spark.createDataFrame([(1, texts()[1])], "item_id long, text string")
    found = decontaminate.find(docs, benchmark)
    agree(docs, found)
    assert found.where("size(spans) > 0").count() >= 1
    agree(docs, exact.mark_copies(docs))
    labels = docs.selectExpr("doc_id", "1 AS quality", "cast(length(text) % 2 AS int) AS toxic")
    agree(docs, toxicity.score(docs, toxicity.fit(docs, labels)))


def test_near_copies_lose_no_row(docs):
    found = nearcopies.classes(docs)
    agree(docs, found)
    assert found.schema["class_id"].dataType == docs.schema["doc_id"].dataType
    kept = nearcopies.deduplicate(docs)
    assert kept.schema == docs.schema
    assert kept.count() == found.select("class_id").distinct().count() == found.where("kept").count()


def test_padded_ids_of_different_texts_all_stay(spark):
    rows = [("007", "one two three four five six"), ("008", "a b c d e f g"), ("9", "q w e r t y u i")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(tuple(r) for r in nearcopies.deduplicate(docs).collect()) == sorted(rows)
