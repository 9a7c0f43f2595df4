"""Personal data: exact patterns, and a skip-chain conditional random field that spreads their labels in a document.

The patterns find e-mail addresses, IP addresses, card and phone numbers; what they find stays. The field's tokens are these
spans and what resembles them: groups of digits, addresses written with "(at)", and words that are the name part of
an address. Neighbouring tokens share a potential (the chain), and so do tokens that repeat each other, however
distant: equal digits, equal last nine digits, or the same name (the skips). Loopy belief propagation then
labels each token of a document consistently; a token beside the base spans becomes one when its belief reaches
``CERTAIN``. A token that repeats a base span is linked to that span itself, and tokens that only repeat each other to one
variable that they share, so a label travels two links at most, however often a token occurs, and a token that occurs
very often needs no more links than it has occurrences. Messages pass until they stay.

The field's weights come from the patterns' own findings in a bounded sample: about ``SAMPLE`` different texts, those
with the smallest hashes among texts that have an "@" or a digit, without texts beyond ``LONGEST`` bytes.

Defined results: ids keep their type; null and empty texts have no spans. Null and repeated ids do not matter; rows are judged one by one
by their own text. An empty table gives an empty result. No other column is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.frames import kind_of
from tabforge.llm.words import batches

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 3000
LONGEST = 20_000
CERTAIN = 0.9
#: Messages have settled when none changes by more; rounds at most.
SETTLED, ROUNDS = 1e-4, 1000
#: Log potential of the label that a base span is held to.
HELD = 1e9
#: Pairs of repeats that agree and disagree, counted before any are seen.
PRIOR = (10.0, 1.0)

#: Fixed patterns; those for digits cannot begin within a run of digits, as the leftmost match begins the run.
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,3}[0-9]){5,}")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+[\x20]?(?:\(at\)|\[at\]|@)[\x20]?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_WORD = re.compile(r"[A-Za-z0-9._%+-]{5,}")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all pattern matches that hold, by kind and start, in code points."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _NAME:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((0, start, host.end()))
        last = host.end() if host else at + 1
        at = text.find("@", last)
    for match in _IP.finditer(text):
        parts = (p.lstrip("0") for p in match[0].split("."))
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((1, match.start(), match.end()))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = _NO_DIGIT.sub("", match[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, match.start(), match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", match[0])) <= 15:
                out.append((3, match.start(), match.end()))
    return out


@dataclass
class Graph:
    """Tokens of some documents: label of base spans (0: none), features, and edges of either sort.

    Skips link the first base span of a label with every token that repeats it; ``alone`` are the groups of tokens
    that share a key with each other, but with no base span.
    """

    document: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    shape: list[np.ndarray] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)
    alone: list[tuple[int, ...]] = field(default_factory=list)

    def add(self, document: int, text: str, base: list[tuple[int, int, int]]) -> None:
        found = [(s, e, k + 1) for k, s, e in base]
        names = {text[s:e].split("@")[0].lower() for k, s, e in base if k == 0}
        taken = sorted((s, e) for s, e, _ in found)
        found += [(s, e, 0) for s, e in _free(_candidates(text, names), taken)]
        found.sort()
        seen: dict[str, list[int]] = {}
        for n, (start, end, label) in enumerate(found):
            at = len(self.start)
            self.document.append(document)
            self.start.append(start)
            self.end.append(end)
            self.label.append(label)
            self.shape.append(_shape(text, start, end))
            if n:
                self.chain.append((at - 1, at))
            for key in _keys(text[start:end]):
                seen.setdefault(key, []).append(at)
        alone = set()
        for group in seen.values():
            heads: dict[int, int] = {}
            for at in group:
                if self.label[at]:
                    heads.setdefault(self.label[at], at)
            if heads:
                self.skip += [(head, at) for at in group for head in heads.values() if head != at]
            elif len(group) > 1:
                alone.add(tuple(group))
        self.alone += sorted(alone)


def _candidates(text: str, names: set[str]) -> Iterator[tuple[int, int]]:
    for match in _DIGITS.finditer(text):
        yield match.span()
    if "@" in text or "at" in text:
        for match in _AT.finditer(text) if "(at)" in text or "[at]" in text or "@" in text else ():
            yield match.span()
    if any(any(c in "0123456789._" for c in n) and len(n) >= 5 for n in names):
        for match in _WORD.finditer(text):
            word = match[0].rstrip(".")
            if word.lower() in names and any(c in "0123456789._" for c in word):
                yield match.start(), match.start() + len(word)


def _free(spans: Iterator[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans that overlap neither the sorted taken ones nor an earlier one."""
    at, last = 0, 0
    for start, end in sorted(spans):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= last and (at == len(taken) or taken[at][0] >= end):
            last = end
            yield start, end


def _keys(token: str) -> set[str]:
    digits = _NO_DIGIT.sub("", token)
    keys = {token.lower()}
    if "@" in token:
        keys.add(token.split("@")[0].lower())
    elif len(digits) >= 7:
        keys |= {digits, digits[-9:]}
    return keys


FEATURES = 18


def _shape(text: str, start: int, end: int) -> np.ndarray:
    token = text[start:end]
    digits = sum(c.isdigit() for c in token)
    dots = token.count(".")
    long_number = 16 <= digits <= 19 and not any(c.isalpha() for c in token)
    valid = long_number and _luhn(_NO_DIGIT.sub("", token))
    before = text[start - 1] if start else " "
    return np.array(
        [
            1,
            "@" in token,
            "(at)" in token or "[at]" in token,
            digits < 6,
            6 <= digits < 8,
            8 <= digits <= 11,
            12 <= digits <= 15,
            16 <= digits <= 19,
            digits > 19,
            dots == 3,
            dots > 3,
            "(" in token,
            "-" in token,
            " " in token,
            any(c.isalpha() for c in token),
            before.isspace(),
            valid,
            long_number and not valid,
        ],
        np.float64,
    )


@dataclass
class Field:
    """Log potentials: of a label given a token's shape, of neighbouring labels, of agreeing repeats."""

    shape: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, len(KINDS) + 1)))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS) + 1,) * 2))
    agree: float = 0.0

    def beliefs(self, graph: Graph) -> np.ndarray:
        """Marginals by loopy message passing; base spans are held to their label."""
        label = np.array(graph.label, np.int64)
        node = np.stack(graph.shape) @ self.shape
        # More than all messages of a document's repeats add up to.
        node[label > 0] = -HELD
        node[label > 0, label[label > 0]] = HELD
        # The variable that a group shares is a node behind the tokens.
        hub = [(len(label) + i, at) for i, group in enumerate(graph.alone) for at in group]
        node = np.concatenate([node, np.zeros((len(graph.alone), node.shape[1]))])
        chain, skip, hub = (np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip, hub))
        same = np.eye(len(KINDS) + 1)
        kinds = (self.chain, chain), (same * self.agree, skip), (same * _half(self.agree), hub)
        pair = np.concatenate([np.broadcast_to(p, (len(e), *same.shape)) for p, e in kinds])
        one, other = np.concatenate([chain, skip, hub]).T
        # Messages along every edge in both directions; edge i backwards is edge i + len(one).
        source, target = np.concatenate([one, other]), np.concatenate([other, one])
        weights = np.concatenate([pair, pair.transpose(0, 2, 1)])
        messages = np.zeros((len(source), same.shape[0]))
        back = np.concatenate([np.arange(len(one)) + len(one), np.arange(len(one))])
        total = node.copy()
        for _ in range(ROUNDS if len(source) else 0):
            given = total[source] - messages[back]
            new = _logsum(given[:, :, None] + weights)
            new -= new.max(axis=1, keepdims=True)
            settled = np.abs(new - messages).max() <= SETTLED
            messages = 0.5 * messages + 0.5 * new
            total = node.copy()
            np.add.at(total, target, messages)
            if settled:
                break
        total = total[: len(label)]
        total -= total.max(axis=1, keepdims=True)
        out = np.exp(total)
        return out / out.sum(axis=1, keepdims=True)


def _half(agree: float) -> float:
    """The potential that two links in a row need to tie their ends like one link of ``agree``."""
    others = len(KINDS)
    wanted = np.exp(agree) / (np.exp(agree) + others)
    # p * p + (1 - p) ** 2 / others = wanted
    p = (1 + np.sqrt(max(0.0, 1 - (1 + others) * (1 - others * wanted)))) / (1 + others)
    return float(np.log(p * others / (1 - p)))


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))


def learn(texts: list[str]) -> Field:
    """Potentials from what the patterns find: tokens that repeat a base span are hidden, others are none.

    Tokens that only repeat each other are none too, so that two doubtful ones do not make each other certain.
    """
    graph = Graph()
    for i, text in enumerate(texts):
        graph.add(i, text, base_spans(text))
    made = Field()
    if not graph.start:
        return made
    label = np.array(graph.label)
    shape = np.stack(graph.shape)
    hidden = np.zeros(len(label), bool)
    agree, apart = PRIOR
    for a, b in graph.skip:
        if (label[a] > 0) == (label[b] > 0):
            agree, apart = agree + (label[a] == label[b]), apart + (label[a] != label[b])
        else:
            hidden[[a, b]] = True
    agree += sum(len(group) - 1 for group in graph.alone)
    made.agree = float(np.clip(np.log(agree / apart), 0, 4))
    use = ~hidden | (label > 0)
    wanted = np.eye(len(KINDS) + 1)[label[use]]
    x, weights = shape[use], made.shape
    for _ in range(300):
        p = x @ weights
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= 2.0 * (x.T @ (p - wanted) / len(x) + 1e-3 * weights)
    counts = np.ones_like(made.chain)
    for a, b in graph.chain:
        counts[label[a], label[b]] += 1
    joint = counts / counts.sum()
    alone = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
    made.chain = np.clip(0.3 * np.log(joint / alone), -1, 1)
    return made


def fit(docs: DataFrame, text_column: str = "text") -> Field:
    """Learns the field from the sample: hashes below the share that about SAMPLE texts have, so the driver
    receives that many texts whatever the number of partitions."""
    texts = docs.select(F.col(text_column).alias("text")).where(F.octet_length(text_column) <= LONGEST)
    texts = texts.withColumn("h", F.xxhash64("text")).where(F.col("text").rlike("[0-9@]"))
    n = texts.count()
    if n > SAMPLE:
        texts = texts.where(F.col("h") < -(2**63) + int(2**64 * (SAMPLE / n)))
    # Copies count once, so no text can fill the sample.
    rows = texts.groupBy("h").agg(F.min("text").alias("text")).collect()
    return learn(sorted(r["text"] for r in sorted(rows, key=lambda r: r["h"])[:SAMPLE]))


SPAN = "array<struct<kind:string,start:long,end:long>>"


def _found(model: Field):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows_of(spans):
        return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(spans)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts = batch.column("text").to_pylist()
            base, graph = [base_spans(t) if t else [] for t in texts], Graph()
            for i, text in enumerate(texts):
                if text:
                    graph.add(i, text, base[i])
            spans = [list(b) for b in base]
            if graph.start:
                beliefs = model.beliefs(graph)
                best = beliefs.argmax(axis=1)
                new = np.flatnonzero((np.array(graph.label) == 0) & (best > 0) & (beliefs.max(axis=1) >= CERTAIN))
                for i in new.tolist():
                    spans[graph.document[i]].append((int(best[i]) - 1, graph.start[i], graph.end[i]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([rows_of(b) for b in base], kind),
                    pa.array([rows_of(s) for s in spans], kind),
                ],
                ["doc_id", "base", "spans"],
            )

    return run


def find(docs: DataFrame, model: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, base (spans of the patterns) and spans (those and the field's), by kind and start."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_found(model), f"doc_id {kind_of(rows)}, base {SPAN}, spans {SPAN}")


def written(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
