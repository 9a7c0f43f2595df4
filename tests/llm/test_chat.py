"""Chat formatting: spans of black-box templates, loss masks, templates that rewrite history."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabforge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["</s>", "<s>", "[INST]", " [/INST]", "[ROLE]", "<", "s>", "[", "INST]", "\\", "\n", " ", "ok", "", "é", "😀"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE] "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), min_size=1, max_size=5))
def test_turns_come_back(turns):
    text = chat.instruct(turns)
    assert list(chat.instruct_turns(text)) == turns
    for _, said in turns:
        assert chat.unescape(chat.escape(said)) == said
        assert not any(mark in chat.escape(said) for mark in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), min_size=1, max_size=9), st.integers(0, 2), st.integers(1, 3))
def test_spans_make_up_the_whole_text(turns, first, last):
    renderer, out = chat.Renderer(chat.instruct, first, last), ""
    for role, said in turns:
        span = renderer.add(role, said)
        assert not span.rewrites
        assert chat.unescape(span.added[slice(*span.text)]) == said
        out += span.added
    assert out == chat.instruct(turns)


def test_templates_that_rewrite_or_drop():
    def forgets(turns):  # answers before the last lose their text
        return "".join(f"<{r}>{t if i == len(turns) - 1 or r != 'assistant' else '..'}" for i, (r, t) in enumerate(turns))

    def shouts(turns):  # the text is written otherwise
        return "".join(f"<{r}>{t.strip().upper()}</>" for r, t in turns)

    def hides(turns):
        return "".join(f"<{r}>" + (t if r == "user" else "") for r, t in turns)

    turns = [("user", "a"), ("assistant", "bc"), ("user", " d ")]

    def spans(template):
        renderer = chat.Renderer(template)
        return [renderer.add(*turn) for turn in turns]

    assert [s.rewrites for s in spans(forgets)] == [False, False, True]
    assert [s.added[slice(*s.text)] for s in spans(shouts)] == ["A", "BC", "D"]
    assert [s.text is None for s in spans(hides)] == [False, True, False]


def brute(rows):
    """Digests per conversation from plain lists."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.instruct(turns)))
    return out


def awkward():
    return [
        (1, 0, "user", None),
        (1, 1, "assistant", ""),
        (2, 1, "assistant", "b"),
        (2, 0, "user", "a"),
        (2, 0, "user", "a"),
        (2, 0, "system", "a"),
        (2, None, None, "[INST]"),
        (None, 3, "assistant", "no id \U0001f600\x00\r\n"),
        (None, 4, "tool", "</s>"),
        (3, 0, "assistant", "x" * 3_000_000),
        (3, 1, "assistant", "y </s>" * 400_000),
        (3, 2, "user", "z"),
        *[(4, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(600)],
    ]


def test_awkward_conversations(spark):
    rows = awkward()
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    names = "part formatted spans start loss n_turns".split()
    table = table.select("*", *(F.lit(7).alias(n) for n in names))
    formatted = chat.format_turns(table)
    assert {tuple(r)[0]: tuple(r)[1:] for r in chat.read_back(formatted).collect()} == brute(rows)
    parts = formatted.where("conv_id = 3").orderBy("part").collect()
    assert [r["part"] for r in parts] == [0, 1, 2]
    whole = "".join(r["formatted"] for r in parts)
    assert whole == chat.instruct([("assistant", rows[9][3]), ("assistant", rows[10][3]), ("user", "z")])


def test_empty_table(spark):
    formatted = chat.format_turns(spark.createDataFrame([], SCHEMA))
    assert formatted.collect() == [] and chat.read_back(formatted).collect() == []


@pytest.mark.parametrize("kind", ["string", "double", "decimal(20,1)", "date"])
def test_ids_keep_their_type(spark, kind):
    value = "date'2020-01-01'" if kind == "date" else "'007'" if kind == "string" else f"cast(1.5 AS {kind})"
    made = f"SELECT {value} AS conv_id, 0 AS turn, 'user' AS role, 'a' AS text UNION ALL SELECT {value}, 1, 'assistant', 'b'"
    found = chat.read_back(chat.format_turns(spark.sql(made)))
    assert found.schema["conv_id"].dataType.simpleString() == kind
    assert found.select("n_turns", "loss_chars").collect() == [(2, 1)]
    assert found.select("conv_id").collect() == spark.sql(f"SELECT {value}").collect()


def test_rewriting_conversations_are_listed(spark):
    def forgetful(turns):
        last = len(turns) - 1
        return "".join(f"<{r}>{t if i == last or r != 'assistant' else ''}" for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c")]
    formatted = chat.format_turns(spark.createDataFrame(rows, SCHEMA), forgetful)
    assert [r["conv_id"] for r in chat.rewriting(formatted).collect()] == [2]
    last = formatted.where("conv_id = 2").first()["spans"][2]
    assert last["rewrites"] and not last["loss"] and last["text_start"] is None


def test_long_conversations_are_rendered_whole(spark):
    def drops(turns):  # from turn 700 on, an answer in the middle is gone
        return "".join(f"<{r}>{t if len(turns) <= 700 or i != 300 else ''}" for i, (r, t) in enumerate(turns))

    def counts(turns):  # a turn says how many of its role there are
        seen, out = {}, []
        for role, text in turns:
            seen[role] = seen.get(role, 0) + 1
            out.append(f"<{role} {seen[role]}>{text}")
        return "".join(out)

    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(900)]
    table = spark.createDataFrame(rows, SCHEMA)
    (row,) = chat.format_turns(table, drops).collect()
    assert [s["rewrites"] for s in row["spans"]] == [i == 700 for i in range(900)]
    (row,) = chat.format_turns(table, counts).collect()
    assert row["formatted"] == counts([r[2:] for r in rows])
    (row,) = chat.format_turns(table, counts, first=2, last=254).collect()
    assert row["formatted"] != counts([r[2:] for r in rows])
