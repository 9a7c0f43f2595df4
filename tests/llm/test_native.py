"""Exact copies and URL rules on awkward rows."""

import hashlib

from pyspark.sql import functions as F

from tabforge.llm import exact, urlfilter

from . import rows


def test_copies_of_awkward_rows(spark):
    docs = rows.clashing(rows.awkward(spark))
    got = exact.mark_copies(docs).collect()
    assert len(got) == docs.count()
    groups = {}
    for r in docs.collect():
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    want = sorted(
        (str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for i in ids
    )
    assert sorted((str(r[0]), str(r[1]), r[2], r[4]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    stay = exact.deduplicate(docs)
    assert stay.columns == docs.columns
    assert sorted(r["text"] or "" for r in stay.collect()) == sorted(groups)
    assert exact.mark_copies(rows.empty(spark)).count() == exact.deduplicate(rows.empty(spark)).count() == 0


def test_texts_that_share_a_hash_stay_apart(spark):
    docs = rows.awkward(spark)
    weak = exact.mark_copies(docs, hashing=lambda text: F.length(text) % 3).collect()
    assert sorted(map(str, weak)) == sorted(map(str, exact.mark_copies(docs).collect()))


RULES = [
    ("com", "/", "allow"),
    ("Example.com", "/en", "block"),
    ("example.com", "/en", "allow"),
    ("a.example.com", "", "allow"),
    (None, "/", "block"),
    ("net", "/x/y", "block"),
]


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fits = []
    for h, p, v in RULES:
        h = h and h.lower()
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, v))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/en?x", "http://xexample.com/english/",
        "https://b.a.Example.COM/en/1#t", "http://a.example.com", "ftp://n.net/x/yz", "http://net/x/", "http://net?/x/y",
        "http://com/", "://com/", "a://b://c.com/", "http://u@example.com:80/en", "http://" + "a." * 2000 + "com/" + "p" * 9000,
        "http://example.com./en", "http://\u0130.com/", "http://example.com/en?x", "http://example.com/\n/en",
    ]
    pages = spark.createDataFrame([(i // 2, u, 1, "h") for i, u in enumerate(urls)], "page_id long, url string, rule int, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urlfilter.judge(pages, rules, ["page_id"]).collect()
    want = [(i // 2, *slow(u)) for i, u in enumerate(urls)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    none = urlfilter.judge(pages, rules.limit(0), ["page_id"])
    assert none.where("verdict = 'allow' and rule is null").count() == len(urls)
    assert urlfilter.judge(pages.limit(0), rules, ["page_id"]).count() == 0
