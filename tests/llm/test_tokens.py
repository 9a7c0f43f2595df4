"""Token files, packing and the word helpers against plain Python."""

import platform
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabforge.llm import packing, tokenfiles, tokens, words
from tabforge.llm.tokens import encoder

from . import rows

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def whole(path, text):
    return encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aZJ\u030c\u0130\u00e9 \t\n.,'<|>1\u0301\u00a0\u3000s\u03a3", max_size=25), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    for path in (BYTES, WORDS):
        ids, at = encoder(path).encode(pa.array(texts))
        assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == [whole(path, t) for t in texts]


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "a", "Z.", " ", "\n", "<|", "|>", "<", "endoftext", "\u00e9 b", "  ", "'s"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SPECIAL), max_size=9).map("".join), min_size=1, max_size=5))
def test_literal_special_tokens_give_the_ids_of_the_library(texts):
    from tokenizers import Tokenizer

    for path in (BYTES, WORDS):
        plain = Tokenizer.from_file(path)
        texts = [*texts, "a <|endoftext|> b", "a<|startoftext|>. b"]
        ids, at = encoder(path).encode(pa.array(texts))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_memory_that_overflows(monkeypatch):
    from tabforge.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    made = tokens.Encoder(BYTES)
    for text in ["a b c d", "c d e f g h", "a b", "c d e f g h i j k l m n"]:
        ids, _ = made.encode(pa.array([text]))
        assert list(ids) == whole(BYTES, text)


def test_temporary_arrays_stay_small():
    import tracemalloc

    made = tokens.Encoder(BYTES)
    texts = pa.array([" ".join(f"{i % 5000} w{i % 700}." for i in range(500_000))])
    made.encode(texts)
    tracemalloc.start()
    try:
        ids, _ = made.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    pieces = 1_500_000
    assert peak < 30 * pieces + ids.nbytes


def test_known_pieces_are_not_hashed_anew():
    made = tokens.Encoder(BYTES)
    made.known = pa.array([*(f"piece {i}" for i in range(500_000)), "a", " b"], pa.large_string())
    made.ids, made.first = np.arange(500_002).astype(made.dtype), np.arange(500_003)
    pool, before = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        ids, _ = made.encode(pa.array(["a b"]))
    finally:
        pa.set_memory_pool(before)
    assert list(ids) == list(made.ids[-2:])
    assert pool.max_memory() < 8_000_000


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="the C library cannot return memory")
def test_memory_of_a_batch_goes_back():
    def held():
        with open("/proc/self/smaps_rollup") as file:
            return sum(int(n) for n in re.findall(r"\nPss_Anon:\s+(\d+)", file.read())) / 1024

    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"])], ["text"])
    before, last = held(), None
    for _ in words.batches(iter([batch])):
        many = [np.ones(1000, np.uint8) for _ in range(100_000)]
        last = many[-1]  # keeps the heap from shrinking by itself
        del many
    assert last is not None and held() < before + 40


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_code_round_trip(values):
    control, data = tokenfiles.encode(np.array(values, np.uint32))
    assert list(tokenfiles.decode(control, data, len(values))) == values


def test_token_files_hold_every_document(spark):
    docs = rows.clashing(rows.awkward(spark)).repartition(3)
    got = tokenfiles.round_trip(docs, WORDS, 2).collect()
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    texts = {}
    for r in rows.awkward(spark).collect():
        texts.setdefault(r["doc_id"], []).append([*whole(WORDS, r["text"]), 2])
    at = 0
    for r in got:
        own = texts[r["doc_id"]].pop()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), crc(own))
        at += len(own)
    assert tokenfiles.round_trip(rows.empty(spark), WORDS, 2).count() == 0


@pytest.mark.parametrize("parts", [1, 70])
def test_packing_loses_no_id(spark, sf, parts):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*rows.SCHEMA.replace(",", "").split()[::2])
    docs = rows.clashing(docs.unionByName(rows.awkward(spark))).repartition(parts)
    pieces = packing.pack(docs, BYTES, 1, limit=256, open_windows=4, least_piece=8).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u2")
        assert len(ids) == p["length"] and crc(ids) == p["ids_crc32"]
        by_doc.setdefault(p["doc_id"], []).append((p["start"], list(ids), p["doc_tokens"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append([*whole(BYTES, r["text"]), 1])
    assert set(texts) == set(by_doc)
    for doc, wanted in texts.items():
        got = sorted(by_doc[doc])
        if len(wanted) == 1:
            assert [i for _, part, _ in got for i in part] == wanted[0]
            assert {n for _, _, n in got} == {len(wanted[0])}
        assert sum(len(p) for _, p, _ in got) == sum(map(len, wanted))
    used = padded = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
        used += at
        padded += 0 if at.bit_count() == 1 else 256 - at
    assert padded <= 0.05 * used
    assert packing.pack(rows.empty(spark), BYTES, 1).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1\u00e9 .\n\x00", max_size=30), min_size=1, max_size=6), st.booleans())
def test_words(texts, lower):
    pattern = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    made = words.split(pa.array(texts), words.PLAIN_WORD, lower)
    for i, text in enumerate(texts):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text
        assert [made.word(j).decode() for j in range(made.first[i], made.first[i + 1])] == re.findall(pattern, text)


def test_digests_follow_the_words():
    rng = random.Random(3)
    long = ["q" * 5000, "w" * 4097, "q" * 5000]
    text = [" ".join(rng.choice(["a", "bc", "bcd", "x" * 40, *long]) for _ in range(3000)) for _ in range(4)]
    made = words.split(pa.array(text), words.SPACED_WORD)
    digests, seen = made.digests(), {}
    for i, d in enumerate(digests):
        assert seen.setdefault(made.word(i), d) == d
    assert len(set(seen.values())) == len(seen)
    for size in (1, 2, 3, 5, 10, 20):
        rolled, runs = words.roll(digests, size), {}
        assert len(rolled) == len(digests) - size + 1
        for i in range(0, len(rolled), 7):
            key = tuple(digests[i : i + size])
            assert runs.setdefault(key, rolled[i]) == rolled[i]
        assert len(set(runs.values())) == len(runs)
        assert list(words.starts(made.first, size)) == [
            i for a, b in zip(made.first[:-1], made.first[1:], strict=True) for i in range(a, b - size + 1)
        ]


def test_lines_of_pieces_give_the_library_s_ids():
    """New pieces reach the library many to a line; ids are those of whole texts, bars and special tokens included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tabforge.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    words = ["a|b", "|", " || ", "x | y", "<|endoftext|>", "don't", "3.5%", "é", "́x", "ΑΣ", "Straße,", " ", " ", "\x00|", "‍"]
    texts = [f"{w} plain{i}, {v}{i % 7}" for i, w in enumerate(words) for v in words] + words + ["", " "]
    made = tokens.Encoder(path)
    lines, encode = [], made.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, some, **rest):
            lines.append(len(some))
            return encode(some, **rest)

    made.tokenizer = Counted()
    ids, ends = made.encode(pa.array(texts))
    plain = Tokenizer.from_file(path)
    for text, low, high in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[low:high].tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert sum(lines) < len(made.known) / 2


def test_words_that_end_beyond_ascii_are_pieces_of_their_own():
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in ("ti", "eau") for c in "éñü"]
    texts = [f"{v} {w}, {w}." for v in words for w in words]
    for path in (BYTES, WORDS):
        made = tokens.Encoder(path)
        ids, at = made.encode(pa.array(texts))
        assert len(made.known) <= 2 * len(words) + 2
        for text, low, high in list(zip(texts, at[:-1], at[1:], strict=True))[::37]:
            assert list(ids[low:high]) == whole(path, text)


def test_cuts_beyond_ascii_change_no_id():
    frames = ("a{} b", "A{}.b", "{}{}, x", "a{}\u0301. b", "{}", " {}\n\t{}", "{}'s", "×{}-", "1{} 2", "{}< |{}")
    letters = [chr(i) for i in range(0x80, 0x800)] + list("\u1680\u2003\u2028\u202f\u205f\u3000\u212a\u1e9e\ufeff\U0001f600")
    texts = [frame.format(c, c) for c in letters for frame in frames]
    for path in (BYTES, WORDS):
        want = [e.ids for e in encoder(path).tokenizer.encode_batch(texts, add_special_tokens=False)]
        ids, at = tokens.Encoder(path).encode(pa.array(texts))
        assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abZéÉßœŒŸ÷×İıŉſ\u0301\u0307\u0085\u00a0 \n.,'1|<", max_size=25), min_size=1, max_size=5))
def test_latin_texts_give_the_ids_of_whole_texts(texts):
    for path in (BYTES, WORDS):
        ids, at = tokens_once(path).encode(pa.array(texts))
        assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == [whole(path, t) for t in texts]


def tokens_once(path, made={}):
    if path not in made:
        made[path] = tokens.Encoder(path)
    made[path]._forget()
    return made[path]


def test_words_of_small_letters_go_to_the_model_alone():
    made = tokens.Encoder(WORDS)
    bare = ["".join(w) for w in zip("abcdefghij" * 20, "xyzéßœñüïa" * 20, map(chr, range(97, 97 + 20)), strict=False)]
    bare += [a + b * 40 for a in "qéz" for b in ("ab", "eau", "ÿ")]
    texts = [f"{w} {w.upper() if w.isascii() else w}, {w}s." for w in bare]
    seen, encode = [], made.tokenizer.encode_batch_fast

    class Seen:
        def encode_batch_fast(self, some, **rest):
            seen.extend(some)
            return encode(some, **rest)

    made.tokenizer = Seen()
    ids, at = made.encode(pa.array(texts))
    assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == [whole(WORDS, t) for t in texts]
    assert set("".join(seen)) <= set(" |,.")
