"""Awkward documents that every operator must take: nulls, empty, long, repeated, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the rain on the hill was cold and the river below it rose over the old stone bridge by noon today".split()


def awkward(spark):
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, "one", None, "a", 3),
        (4, " ".join(PROSE), "en", "a", 1),
        (5, " ".join(PROSE), "en", "a", 1),
        (5, " ".join(PROSE), "en", "a", 1),
        (6, " ".join(f"{w}{i}" for i in range(4000) for w in PROSE[:7]), "en", "b", 9),
        (None, "no id here but words enough to make up a text", "en", "b", 9),
        (8, "\u00e9t\u00e9 \u4e16\u754c \U0001f600 \x00 x\r\n\ty ", "fr", "b", 9),
        (9, "x" * 300_000, "en", "b", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "_hash _text _id sha256 worker ids start kept group score class_id h band n_words".split()
    return docs.select("*", *(F.lit(7).alias(n) for n in names))
