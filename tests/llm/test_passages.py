"""Decontamination, repeated passages and near copies against brute force on small awkward tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tabforge.llm import decontaminate, nearcopies, substrings

from . import rows

PLAIN = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def plain_words(text):
    return PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(spark, seed=5):
    """Awkward rows plus texts over a small vocabulary, copies, shared passages and edits."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["The", "été", "a.b"]
    passage = [rng.choice(vocabulary) + str(rng.randrange(90)) for _ in range(40)]
    data = [tuple(r) for r in rows.awkward(spark).collect()]
    for i in range(20, 60):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            low = rng.randrange(20)
            own[rng.randrange(len(own) + 1) : 0] = passage[low : low + rng.randrange(5, 40)]
        if i % 5 == 0:
            base = [f"u{i}x{j}" for j in range(120)]
            own = base
            for n in range(3):
                edited = list(base)
                for _ in range(n * 4):
                    edited[rng.randrange(120)] = "edit"
                data.append((1000 + 10 * i + n, " ".join(edited), "en", "c", 1))
        data.append((i, rng.choice([" ", "\n", ", "]).join(own), "en", "c", 1))
    return spark.createDataFrame(data, rows.SCHEMA).repartition(4), passage


def slow_hits(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, wanted in items:
        n = min(10, len(wanted))
        windows = {tuple(wanted[i : i + n]) for i in range(len(wanted) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found |= {item} - {None}
    return len(words), sorted(hit), sorted(found)


def test_decontamination(spark):
    docs, passage = corpus(spark)
    items = [(1, " ".join(passage)), (22, "w3 w4"), (3, "ONE"), (1, "short item of five words"), (5, None), (6, ""), (None, "w1 w2 w1")]
    items += [(7, " ".join(passage[5:20])), (7, " ".join(rows.PROSE))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as item")
    want = sorted(
        str((r["doc_id"], *slow_hits(r["text"], [(i and str(i), plain_words(t)) for i, t in items]))) for r in docs.collect()
    )
    for block in (200_000, 20):
        got = decontaminate.find(rows.clashing(docs), benchmark, block=block).collect()
        flat = [(r["doc_id"], r["n_words"], [i for s in r["spans"] for i in range(s["begin"], s["end"])], r["items"]) for r in got]
        assert sorted(map(str, flat)) == want
    clean = decontaminate.clean(rows.clashing(docs), benchmark)
    assert clean.count() == sum(", [], []" in w for w in want)
    assert decontaminate.find(rows.empty(spark), benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == docs.count()


def slow_repeats(data, size):
    seen, out = {}, []
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    words = [re.findall("[^\\x20\\x09-\\x0D]+", t or "") for _, t in order]
    for (doc, _), own in zip(order, words, strict=True):
        for i in range(len(own) - size + 1):
            seen.setdefault(tuple(own[i : i + size]), (doc, i))
    for (doc, _), own in zip(order, words, strict=True):
        gone = set()
        for i in range(len(own) - size + 1):
            if seen[tuple(own[i : i + size])] != (doc, i):
                gone.update(range(i, i + size))
        out.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(map(str, out))


def test_repeated_passages(spark, monkeypatch):
    docs, _ = corpus(spark)
    docs = docs.where("doc_id is null or doc_id not in (9)").union(
        spark.createDataFrame([(70, "a b " * 300, "", "", 0), (71, "x a b a b a b a b a b", "", "", 0)], rows.SCHEMA)
    )
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for size, chunk in ((20, 1_500_000), (6, 40)):
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        got = substrings.remove_repeats(rows.clashing(docs), size=size, group=50).drop("text_hash").collect()
        assert sorted(str(tuple(r)) for r in got) == slow_repeats(data, size)
    assert substrings.remove_repeats(rows.empty(spark)).count() == 0


def slow_classes(data, threshold, common):
    bags = []
    for _, text in data:
        own = plain_words(text)
        runs = [tuple(own[i : i + 5]) for i in range(len(own) - 4)] if len(own) >= 5 else [tuple(own)] * bool(own)
        bags.append({s: runs.count(s) for s in set(runs)} if len(runs) < 2000 else None)
    for i, (_, text) in enumerate(data):
        if bags[i] is None:
            own, bag = plain_words(text), {}
            for n in range(len(own) - 4):
                key = tuple(own[n : n + 5])
                bag[key] = bag.get(key, 0) + 1
            bags[i] = bag
    frequency = {}
    for bag in bags:
        for s in bag:
            frequency[s] = frequency.get(s, 0) + 1
    total = len(data)
    weight = {s: np.log2(1 + total / max(n, common * total)) for s, n in frequency.items()}
    group, links = list(range(total)), [set() for _ in data]
    contents = [tuple(plain_words(t)) for _, t in data]

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(total):
        for b in range(a):
            less = sum(min(n, bags[b].get(s, 0)) * weight[s] for s, n in bags[a].items())
            more = sum(n * weight[s] for s, n in bags[a].items()) + sum(n * weight[s] for s, n in bags[b].items()) - less
            same = contents[a] == contents[b]
            if same or (more and less >= threshold * more):
                group[root(a)] = root(b)
            if not same and more and less >= threshold * more:
                links[a].add(contents[b])
                links[b].add(contents[a])
    classes = {}
    for i in range(total):
        classes.setdefault(root(i), []).append(data[i][0])
    return sorted(
        str((data[i][0], min((x for x in classes[root(i)] if x is not None), default=None), len(classes[root(i)])))
        for i in range(total)
    )


def test_near_copies(spark):
    docs, _ = corpus(spark)
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for common in (0.01, 0.2):
        got = nearcopies.classes(rows.clashing(docs), bands=60, common=common).collect()
        assert sorted(str((r["doc_id"], r["class_id"], r["class_size"])) for r in got) == slow_classes(data, 0.8, common)
    # The registered bands find the same classes.
    got = nearcopies.classes(rows.clashing(docs)).collect()
    assert sorted(str((r["doc_id"], r["class_id"], r["class_size"])) for r in got) == slow_classes(data, 0.8, nearcopies.COMMON)
    stay = nearcopies.deduplicate(rows.clashing(docs), bands=60)
    assert stay.count() == len({r["class_id"] for r in nearcopies.classes(docs, bands=60).collect()})
    assert nearcopies.classes(rows.empty(spark)).count() == 0


def test_registered_bands_find_what_many_bands_find(spark):
    """Share of pairs (document, class) at 12 bands of 3 that 60 bands give too, on a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few, many = (
        {(r["doc_id"], r["class_id"]) for r in nearcopies.classes(docs, bands=bands).collect()}
        for bands in (nearcopies.BANDS, 60)
    )
    assert len(few & many) >= 0.999 * len(many)


def test_links_do_not_depend_on_the_size_of_the_group(spark):
    rng = random.Random(8)
    base = [f"u{i}" for i in range(120)]
    for group in (20, 100, 280):
        data = [(i, " ".join(f"x{i}y{j}" for j in range(120))) for i in range(group, 300)]
        for i in range(group):
            at = rng.randrange(120)
            data.append((i, " ".join([*base[:at], f"e{i}", *base[at + 1 :]])))
        got = nearcopies.classes(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
        assert {(r["class_id"], r["class_size"]) for r in got if r["doc_id"] < group} == {(0, group)}
        assert all(r["class_size"] == 1 for r in got if r["doc_id"] >= group)


def test_a_group_holds_one_meeting_of_strangers(spark, monkeypatch):
    def sizes(shared, threshold):
        def run(table):
            return pa.table({"a": table["meeting"][:1], "b": pa.array([table.num_rows], pa.int64())})

        return run

    monkeypatch.setattr(nearcopies, "_meet", sizes)
    for name, value in (("STRANGERS", 10), ("OTHERS", 40), ("UNIT", 50)):
        monkeypatch.setattr(nearcopies, name, value)
    star = "struct(vertex, 1d as total, 1d as size) as star"
    members = spark.range(1200).selectExpr("id as vertex", "if(id < 800, 1, id div 8) as key")
    members = members.selectExpr("vertex", "1d as total", "1d as size", "key", "1 as band", star)
    label = spark.createDataFrame([], "vertex long, class long")
    texts = members.selectExpr("vertex", "'a b c' as text")
    rows = [r["b"] for r in nearcopies._across(members, label, texts, None, 0.8).collect()]
    assert sum(rows) >= 800 * 20 + 800 * 80 and max(rows) <= 200


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(80)]
    pairs += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    links = spark.createDataFrame(pairs, "a long, b long")
    label = {r["vertex"]: r["class"] for r in nearcopies.components(links).collect()}
    group = {}
    for a, b in pairs * 70:
        low = min(group.get(a, a), group.get(b, b))
        group[a] = group[b] = low
    linked = {v for a, b in pairs if a != b for v in (a, b)}
    assert label == {v: group[v] for v in linked}


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(1)
    shingles = rng.integers(0, 2**63, 300).astype(np.uint64)
    one, other = rng.random(300) + 0.1, rng.random(300) + 0.1
    other[:100] = one[:100]
    first = np.array([0, 300, 600])
    drawn = nearcopies.samples(np.concatenate([shingles] * 2), np.concatenate([one, other]), first, 3000)
    share = (drawn[0] == drawn[1]).mean()
    assert abs(share - np.minimum(one, other).sum() / np.maximum(one, other).sum()) < 0.03


def test_bags():
    shingles, counts, first = nearcopies.bags(pa.array(["a b c d e a b c d e", "", "x", None, "A b, c D e"]))
    assert list(first) == [0, 5, 5, 6, 6, 7]
    assert sorted(counts[:5]) == [1, 1, 1, 1, 2]
    assert shingles[6] == shingles[:5][counts[:5] == 2][0]


def test_kept_texts_join_words(spark):
    docs = spark.createDataFrame([(1, " a\tb\n\nc "), (2, "   "), (3, "  d")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: "a b c", 2: "", 3: "  d"}
    assert hashlib.sha256(got[1].encode()).hexdigest()


def test_every_shingle_has_its_own_document_frequency(spark):
    texts = [(i, f"one two three four five q{i}a q{i}b") for i in range(64)]
    texts += [(100 + i, "six seven eight nine ten") for i in range(2)] + [(200, "alone we are here now")]
    docs = spark.createDataFrame(texts * 1, "doc_id long, text string").repartition(5)
    made = nearcopies.weights(docs)
    shingles, counts, first = nearcopies.bags(pa.array(["one two three four five", "six seven eight nine ten", "alone we are here now"]))
    got = made.of(shingles, counts)
    want = [np.log2(1 + 67 / n) / np.log2(1 + 67) for n in (64, 2, 1)]
    assert np.allclose(got, want, rtol=1e-6)
