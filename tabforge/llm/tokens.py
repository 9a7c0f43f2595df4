"""Token ids of whole texts with a public tokenizer, in Arrow batches.

A byte-level BPE splits a text into words first and encodes each by itself, so equal pieces of text give equal
ids. Texts are cut where both supported tokenizers always start a new word, each different piece is encoded
once by the library, and the ids are put together by numpy. A tokenizer of another make gets whole texts.
A text that holds a special token literally, such as <|endoftext|>, gets that token's id, as from the library; no cut falls inside one.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabforge.llm.words import byte_class, raw

#: Pieces a worker remembers; beyond it the memory starts anew, which only costs time.
REMEMBERED = 1_500_000
#: Pieces of a line that the library encodes at once.
TO_A_LINE = 60
#: New pieces that go to the library in lines in one call.
IN_LINES = 20_000
#: New pieces that the library encodes in one call.
AT_ONCE = 5_000
#: Bytes of text that are encoded together.
TOGETHER = 16 << 20
#: Bytes whose cuts, and pieces whose ids, are found at once, so that temporary arrays do not follow the texts.
BLOCK, GATHERED = 1 << 20, 1 << 16
#: What a byte is, as bits: ASCII white space, visible ASCII, an ASCII letter, a mark, the first of two bytes of a character that
#: is no white space, that of one that is a letter, and the second byte of the signs among these letters.
_SPACE, _GRAPHIC, _LETTER, _MARK, _WIDE, _LATIN, _SIGN = (np.uint8(1 << bit) for bit in range(7))
_KINDS = (
    byte_class((0x09, 0x0D), (0x20, 0x20)) * _SPACE
    | byte_class((0x21, 0x7E)) * _GRAPHIC
    | byte_class((0x41, 0x5A), (0x61, 0x7A)) * _LETTER
    | byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x3B), (0x3F, 0x40), (0x5B, 0x60)) * _MARK
    | byte_class((0xC3, 0xDF)) * _WIDE
    | byte_class((0xC3, 0xC3), (0xC5, 0xC5)) * _LATIN
    | byte_class((0x97, 0x97), (0xB7, 0xB7)) * _SIGN
)
#: Words that no normaliser changes and that are one word to the pre-tokenizer with the pattern below.
_BARE = "^[a-zß-öø-ÿœ]+$"
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _splits_words(path: str) -> bool:
    """True for a pre-tokenizer with byte-level words, where a cut between words changes no id."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    steps = made.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    return (
        steps[-1].get("type") == "ByteLevel"
        and not steps[-1].get("add_prefix_space")
        and made["model"]["type"] == "BPE"
        and not made["model"].get("dropout")
        and all("L}" in str(s.get("pattern", "L}")) for s in steps)
    )


def _folds_words(path: str) -> bool:
    """True if white space before a word and the case of plain letters change no id: the normaliser lower-cases, and
    the pre-tokenizer keeps what its pattern finds, which is never white space."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    kinds = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = str(steps[0].get("pattern")) if steps else ""
    removed = bool(steps) and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    return kinds == ["NFC", "Replace", "Lowercase"] and removed and "[^\\\\s" in pattern


def _last_ids(path: str) -> np.ndarray | None:
    """Flags the ids that end a word, if the model marks them so and small Latin letters pass the other steps unchanged."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, steps = made["model"], (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
    known = len(steps) == 2 and steps[0].get("pattern") == {"Regex": _PATTERN} and steps[1].get("use_regex") is False
    if not (known and suffix and _folds_words(path)) or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        return None
    from tokenizers.pre_tokenizers import ByteLevel

    if not all(byte in vocab and byte + suffix in vocab for byte in ByteLevel.alphabet()):
        return None
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
    return last


def folded(words: pa.Array) -> pa.Array:
    """Words that give the same ids, in one spelling: no white space in front, plain ASCII in lower case.

    Letters beyond ASCII stay: a capital may compose with a following mark otherwise than its small letter. So
    does what holds "<", which could otherwise become a special token.
    """
    bare = pc.ascii_ltrim_whitespace(words)
    bare = pc.if_else(pc.string_is_ascii(bare), pc.ascii_lower(bare), bare)
    return pc.if_else(pc.match_substring(words, "<"), words, bare)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.splits = _splits_words(path)
        self.folds = self.splits and _folds_words(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        bar = self.tokenizer.encode(" | ", add_special_tokens=False).ids if self.folds else []
        self.bar = bar[0] if len(bar) == 1 else None
        self.last = _last_ids(path) if self.bar is not None else None
        if self.last is not None:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, self.dtype)
        self.first = np.zeros(1, np.int64)

    def _lines(self, tokenizer, pieces: pa.Array, between: str) -> Iterator[np.ndarray]:
        """Ids of pieces in lines, with ``between`` after each piece."""
        for low in range(0, len(pieces), IN_LINES):
            some = pieces.slice(low, IN_LINES).to_pylist()
            lines = [between.join([*some[i : i + TO_A_LINE], ""]) for i in range(0, len(some), TO_A_LINE)]
            made = [e.ids for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
            yield np.fromiter(chain.from_iterable(made), self.dtype)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Ids of new pieces. Where white space changes no id, pieces go to the library in lines, which saves a call's cost for
        each: words of small Latin letters to the model alone, whose ids show where a word ends; others with a bar between them,
        which is an id of its own and stands in none of them. Returns where each piece is kept."""
        ids, sizes = [self.ids], []
        way = np.full(len(pieces), 2, np.uint8)
        if self.bar is not None:
            way = np.asarray(pc.match_substring_regex(pieces, "[<|]")) + np.uint8(1)
        if self.last is not None:
            way[np.asarray(pc.match_substring_regex(pieces, _BARE))] = 0
        order = np.argsort(way, kind="stable")
        pieces, (bare, joined) = pieces.take(pa.array(order)), np.searchsorted(way[order], [1, 2])
        for flat in self._lines(self.bare, pieces.slice(0, bare), " ") if bare else ():
            sizes.append(np.diff(np.flatnonzero(self.last[flat]), prepend=-1))
            ids.append(flat)
        for flat in self._lines(self.tokenizer, pieces.slice(bare, joined - bare), " | "):
            bars = np.flatnonzero(flat == self.bar)
            sizes.append(np.diff(bars, prepend=-1) - 1)
            ids.append(np.delete(flat, bars))
        for low in range(joined, len(pieces), AT_ONCE):
            some = pieces.slice(low, AT_ONCE).to_pylist()
            made = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, made), np.int64))
            ids.append(np.fromiter(chain.from_iterable(made), self.dtype))
        self.ids = np.concatenate(ids)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) + len(self.known)
        self.known = pa.concat_arrays([self.known, pieces])
        return place

    def _cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin: before white space that follows a word, and before a mark that follows a letter. White space is
        known to follow a word if a visible ASCII or a two-byte character is before it; where the pre-tokenizer drops it, any."""
        at = np.zeros(len(data) + 1, bool)
        for low in range(0, len(data) - 1 if self.splits else 0, BLOCK):
            kinds = _KINDS[data[max(low - 1, 0) : low + 1 + BLOCK]]
            if not low:
                kinds = np.concatenate((np.zeros(1, np.uint8), kinds))
            lead, before, here = kinds[:-2], kinds[1:-1], kinds[2:]
            word = before & _SPACE == 0 if self.folds else (before & _GRAPHIC | lead & _WIDE) != 0
            letter = before & _LETTER | (lead & _LATIN) * (before & _SIGN == 0)
            at[low + 1 : low + 1 + len(here)] = (here & _SPACE != 0) & word | (here & _MARK != 0) & (letter != 0)
        at[ends] = True
        return np.flatnonzero(at)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of different words is kept, -1 for new ones. The known words are looked up among these, not the other way
        round, so that the table that Arrow builds has the size of the batch and not of the memory."""
        place = np.full(len(words), -1, np.int64)
        found = pc.index_in(self.known, words)
        kept = np.flatnonzero(np.asarray(found.is_valid()))
        place[np.asarray(found.drop_null())] = kept
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one offset more than texts)."""
        data, ends = raw(texts)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(ends), np.int64)
        cuts = self._cuts(data, ends)
        buffers = [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, buffers).dictionary_encode()
        words, spelt = pieces.dictionary, None
        if self.folds:
            folds = folded(words).dictionary_encode()
            words, spelt = folds.dictionary, np.asarray(folds.indices)
        use = self._places(words)
        if (use < 0).any():
            if len(self.known) + int((use < 0).sum()) > REMEMBERED:
                self._forget()
                use[:] = -1
            use[use < 0] = self._learn(words.filter(pa.array(use < 0)))
        use = use[spelt if spelt is not None else slice(None)]
        begin, size, spots = self.first[use], self.first[use + 1] - self.first[use], np.asarray(pieces.indices)
        stops = np.zeros(len(spots) + 1, np.int64)
        np.cumsum(size[spots], out=stops[1:])
        ids = np.empty(stops[-1], self.dtype)
        for low in range(0, len(spots), GATHERED):
            high = min(low + GATHERED, len(spots))
            some = spots[low:high]
            take = np.repeat(begin[some] - stops[low:high], size[some])
            take += np.arange(stops[low], stops[high])
            ids[stops[low] : stops[high]] = self.ids[take]
        return ids, stops[np.searchsorted(cuts, ends)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; the worker keeps it between tasks."""
    return Encoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the id ``end`` to every text."""
    if not len(offsets) - 1:
        return ids, offsets
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
