"""Chat formatting by incremental rendering of a black-box template.

A template is any function from the turns so far, pairs of role and text, to the whole formatted text. Turns of
a conversation are added one by one: the text of the longer list must begin with that of the shorter one, and
what comes after is the new turn's span. A template that changes what it wrote before (drops old reasoning,
moves the system text to the last question) is caught at the turn where that happens. The same rendering with a
single unused character in place of the turn's text shows where the text lies inside its span, whatever the
template writes around it; that is the loss mask of the turns to learn.

Every rendering holds all turns up to the new one, so a template may depend on any of them and no change of an
earlier turn goes unseen. A black box has to be asked anew for each prefix, so the characters rendered grow with
the square of one conversation; its turns and two renderings are in memory at a time. A template that is known to look at no more
than some turns can be given bounds (``first`` and ``last``): then beyond first + last turns the span is the difference of two
renderings that leave out the same turns in the middle.

Rows of a conversation go to one task in order and are streamed through it: one shuffle.

Defined results: null texts and roles count as empty; turns come in the order of the turn column (nulls first),
then role, then text; repeated rows are turns of their own; null is a conversation id like any other and ids
keep their type; an empty table gives no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
#: Turns of a rendering: from the beginning of the conversation, and before the new turn; None is all of them.
FIRST, LAST = 0, None
#: Characters of texts whose escaped form a worker remembers, about; beyond it the memory starts anew.
REMEMBERED = 1 << 25
#: Characters of a row of formatted text at least, unless the conversation ends; longer ones take several rows.
PART = 1 << 20
LOSS_ROLES = ("assistant",)
_SPANS = (
    "array<struct<start: bigint, end: bigint, text_start: bigint, text_end: bigint, loss: boolean, rewrites: boolean>>"
)

# --- the template ----------------------------------------------------------------------------

#: Strings that mark turns. None holds white space; white space parts them from texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(
    r"(?:<s>)?(?:\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]"
    r"|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?) </s>| (?P<assistant>.*?) </s>)",
    re.DOTALL,
)

#: Escaped texts, which every longer prefix of a conversation asks for again, and their size.
_KNOWN: dict[str, str] = {}
_SIZE = [0]


def escape(text: str) -> str:
    """Text without control strings: backslashes are doubled, a control string gets one after its first character."""
    made = _KNOWN.get(text)
    if made is None:
        made = text.replace("\\", "\\\\")
        if "<" in made or "[" in made:
            made = _CONTROL.sub(lambda m: m[0] + "\\", made)
        if _SIZE[0] + len(text) + 100 > REMEMBERED:
            _KNOWN.clear()
            _SIZE[0] = 0
        _KNOWN[text] = made
        _SIZE[0] += len(text) + 100
    return made


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def instruct(turns: Sequence[Turn]) -> str:
    """Template with questions in [INST] marks and answers up to </s>; other roles are written out."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out += ["[INST] ", escape(text), " [/INST]"]
        elif role == "system":
            out += ["[SYS] ", escape(text), " [/SYS]"]
        elif role == "assistant":
            out += [" ", escape(text), " </s>"]
        else:
            out += ["[ROLE] ", escape(role), " [/ROLE] ", escape(text), " </s>"]
    return "".join(out)


def instruct_turns(text: str) -> Iterator[Turn]:
    """The turns that ``instruct`` was given, from its output or a run of whole spans of it."""
    at = 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        at = found.end()
        if found["role"] is not None:
            yield unescape(found["role"]), unescape(found["other"])
        else:
            yield next((role, unescape(found[role])) for role in ("user", "system", "assistant") if found[role] is not None)


# --- spans -----------------------------------------------------------------------------------


@dataclass
class Span:
    """What a turn added, and where its text lies in that; nothing for a turn that rewrites history."""

    added: str = ""
    text: tuple[int, int] | None = None
    rewrites: bool = False


def _unused(*texts: str) -> str:
    """A character of the private-use areas that stands in none of the texts."""
    private = map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE)))
    return next(c for c in private if not any(c in t for t in texts))


def _same(a, b) -> bool:
    """Equal ids as Spark groups them: NaN equals NaN."""
    return a == b or (a != a and b != b)


class Renderer:
    """Adds the turns of one conversation to a template and locates each of them."""

    def __init__(self, template: Template, first: int = FIRST, last: int | None = LAST):
        self.template, self.first = template, first
        self.head: list[Turn] = []
        self.tail: deque[Turn] = deque(maxlen=last)
        self.done: str | None = None

    def add(self, role: str, text: str) -> Span:
        before = [*self.head, *self.tail]
        done = self.done if self.done is not None else self.template(before) if before else ""
        whole = self.template([*before, (role, text)])
        full = len(self.tail) == self.tail.maxlen
        self.done = None if full else whole
        if len(self.head) < self.first:
            self.head.append((role, text))
        else:
            self.tail.append((role, text))
        if not whole.startswith(done):
            return Span(rewrites=True)
        probe = _unused(done, role)
        tried = self.template([*before, (role, probe)])
        place = None
        if tried.startswith(done) and tried.count(probe) == 1:
            begin = tried.index(probe)
            place = begin - len(done), len(whole) - (len(tried) - begin - 1) - len(done)
            place = place if place[0] <= place[1] else None
        return Span(whole[len(done) :], place)


def _run(template: Template, loss_roles: Sequence[str], first: int, last: int | None, part: int, schema: pa.Schema):
    def rows(conv, number, pieces, spans):
        values = [[conv], [number], ["".join(pieces)], [spans]]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema
        )

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, renderer, number, pieces, spans, size = None, None, 0, [], [], 0
        for batch in given:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for own, role, text in zip(*columns, strict=True):
                fresh = renderer is None or not _same(own, conv)
                if fresh or size >= part:
                    if renderer is not None:
                        yield rows(conv, number, pieces, spans)
                    number = 0 if fresh else number + 1
                    if fresh:
                        renderer = Renderer(template, first, last)
                    conv, pieces, spans, size = own, [], [], 0
                span = renderer.add(role, text)
                begin, end = (size + span.text[0], size + span.text[1]) if span.text else (None, None)
                spans.append(
                    {
                        "start": size,
                        "end": size + len(span.added),
                        "text_start": begin,
                        "text_end": end,
                        "loss": role in loss_roles and span.text is not None,
                        "rewrites": span.rewrites,
                    }
                )
                pieces.append(span.added)
                size += len(span.added)
        if renderer is not None:
            yield rows(conv, number, pieces, spans)

    return run


def format_turns(
    conversations: DataFrame,
    template: Template = instruct,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    loss_roles: Sequence[str] = LOSS_ROLES,
    first: int = FIRST,
    last: int | None = LAST,
    part: int = PART,
) -> DataFrame:
    """Rows (conv_id, part, formatted, spans) of every conversation; its parts lie together, in order.

    ``formatted`` of all parts, joined, is the template's output. ``spans`` holds a struct for each turn:
    characters ``start`` to ``end`` of the part that the turn added, ``text_start`` to ``text_end`` of its text as
    the template writes it (null if the template drops or repeats it), ``loss`` for the turns to learn, and
    ``rewrites`` if the template changed earlier turns here; such a turn adds nothing and is not learnt, and
    ``rewriting`` lists its conversation.
    """
    turns = conversations.select(
        F.col(conv_column).alias("conv_id"),
        F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType
    made = T.StructType().add("conv_id", kind).add("part", "integer").add("formatted", "string")
    made = made.add("spans", T.DataType.fromDDL(_SPANS))
    job = _run(template, tuple(loss_roles), first, last, part, to_arrow_schema(made))
    return ordered.select("conv_id", "role", "text").mapInArrow(job, made)


def rewriting(formatted: DataFrame) -> DataFrame:
    """Ids of the conversations in which the template rewrote history."""
    return formatted.where(F.exists("spans", lambda s: s["rewrites"])).select("conv_id").distinct()


# --- reading back ----------------------------------------------------------------------------


def _read(read: Callable[[str], Iterator[Turn]], plain: Callable[[str], str], schema: pa.Schema):
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            values = [[conv], [turns], [all_turns.hexdigest()], [learnt], [loss.hexdigest()], [size]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema
            )

        conv, all_turns = None, None
        for batch in given:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans")]
            for own, text, spans in zip(*columns, strict=True):
                if all_turns is None or not _same(own, conv):
                    if all_turns is not None:
                        yield done()
                    conv, turns, learnt, size = own, 0, 0, 0
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in read(text):
                    turns += 1
                    all_turns.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    if span["loss"]:
                        said = plain(text[span["text_start"] : span["text_end"]])
                        learnt += len(said)
                        loss.update(said.encode())
                size += len(text)
        if all_turns is not None:
            yield done()

    return run


def read_back(
    formatted: DataFrame,
    read: Callable[[str], Iterator[Turn]] = instruct_turns,
    plain: Callable[[str], str] = unescape,
) -> DataFrame:
    """Per conversation what its formatted text and loss mask hold: conv_id, n_turns, turns_sha256 (role, line
    feed, text, line feed of every turn), loss_chars, loss_sha256 (learnt texts, one after the other), formatted_chars.

    Turns are parsed from the formatted text alone, learnt texts are cut out by the mask. The rows of a
    conversation must lie together in order, as ``format_turns`` returns them.
    """
    kind = formatted.schema["conv_id"].dataType
    made = T.StructType().add("conv_id", kind).add("n_turns", "long").add("turns_sha256", "string")
    made = made.add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")
    return formatted.mapInArrow(_read(read, plain, to_arrow_schema(made)), made)
