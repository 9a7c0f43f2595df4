"""The numbered queries and their SQL: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import (
    chat,
    decontaminate,
    exact,
    importance,
    nearcopies,
    packing,
    personal,
    quality,
    substrings,
    tokenfiles,
    toxicity,
    urlfilter,
    whitening,
)
from tabforge.plans.registry import Catalogue

catalogue = Catalogue()
query = catalogue.query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that the contract gives.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
OP1_SQL = """
WITH rules(host, path, verdict) AS (VALUES {rules}),
parts AS (
    SELECT page_id, regexp_extract(CASE WHEN contains(url, '://')
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^?#]*', 0) AS rest
    FROM pages),
split AS (
    SELECT page_id, translate(CASE WHEN contains(rest, '/') THEN split_part(rest, '/', 1) ELSE rest END,
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
    FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parts)),
judged AS (SELECT page_id, host, path, (
        SELECT max({{'n': length(r.host) + length(r.path), 'h': length(r.host),
            'rule': r.host || r.path, 'verdict': r.verdict}}) FROM rules r
        WHERE (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)) AS fit
    FROM split s)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, 'allow') AS verdict FROM judged
""".format(rules=", ".join(str(r) for r in URL_RULES))


@query("op1_url_rules", OP1_SQL)
def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules, ["page_id"])


@query("op2_personal_data")
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal.find(docs, personal.fit(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        F.size(F.array_remove(F.transform(kinds, lambda k: k != F.lit(kind)), True)).cast("long").alias(f"n_{kind}")
        for kind in personal.KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(personal.written("base"), 256).alias("base_sha256"),
        personal.written("spans").alias("spans"),
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win
    FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i
          FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
          FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op3_decontaminate", OP3_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = decontaminate.hits("spans")
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
    sha256(coalesce(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(
        list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]), ' ') END, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


@query("op5_repeats", OP5_SQL)
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_near_copies")
def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.classes(table(spark, sf_dir, "documents")).drop("text_hash")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op7_exact_copies", OP7_SQL)
def op7_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), path, end_id=2).drop("ids")


@query("op10_packed")
def op10_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, end_id=1).drop("ids")


#: The conversation that the contract adds, whose texts are control strings.
ADDED_TEXT = "</s>[INST] ok [/INST]"
ADDED = ((-1, 0, "user", ADDED_TEXT), (-1, 1, "assistant", ADDED_TEXT))
_MARKS = " + ".join(
    f"(length(text) - length(replace(text, '{mark}', ''))) // {len(mark)}" for mark in chat.CONTROL
)
OP11_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES {", ".join(str(row) for row in ADDED)})),
sized AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + {_MARKS} AS n,
    length(role) + length(role) - length(replace(role, '\', '')) + {_MARKS.replace("text", "role")} AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(n + CASE role WHEN 'user' THEN {len("[INST]  [/INST]")} WHEN 'system' THEN {len("[SYS]  [/SYS]")}
        WHEN 'assistant' THEN {len("  </s>")} ELSE n_role + {len("[ROLE]  [/ROLE]  </s>")} END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op11_chat_turns", OP11_SQL)
def op11_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(given.unionByName(added)))


# CRCs in SQL: the table of 256 values, then the bytes of every distinct run after those of the run one word shorter.
OP12_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab),
texts AS (SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
split AS (SELECT side, doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
word AS (SELECT r, i, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM split)),
spelt AS (SELECT w, list_transform(range(1, 2 * octet_length(encode(w)), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT) AS bytes
    FROM (SELECT DISTINCT w1 AS w FROM word)),
one AS (SELECT w, bytes, list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295) AS c FROM spelt, steps),
two AS (SELECT w1, w2, list_reduce([32] || s.bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), f.c) AS c
    FROM (SELECT DISTINCT w1, w2 FROM word WHERE w2 IS NOT NULL) JOIN one f ON w1 = f.w JOIN spelt s ON w2 = s.w, steps),
three AS (SELECT w1, w2, w3, list_reduce([32] || s.bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), two.c) AS c
    FROM (SELECT DISTINCT w1, w2, w3 FROM word WHERE w3 IS NOT NULL) JOIN two USING (w1, w2) JOIN spelt s ON w3 = s.w, steps),
feature AS (SELECT r, xor(c, 4294967295) % 10000 AS b FROM word JOIN one ON w1 = w
    UNION ALL SELECT r, xor(c, 4294967295) % 10000 FROM word JOIN two USING (w1, w2)
    UNION ALL SELECT r, xor(c, 4294967295) % 10000 FROM word JOIN three USING (w1, w2, w3)),
bucket AS (SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM feature JOIN split USING (r) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS g
    FROM bucket),
summed AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS weight FROM feature JOIN gain USING (b) GROUP BY r),
scored AS (SELECT doc_id, len(ws) >= 20 AS able, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
        (('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM split LEFT JOIN summed USING (r) WHERE side = 's'),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= n * 5 // 100 THEN place END AS rank FROM placed
"""


@query("op12_importance", OP12_SQL)
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_whitened")
def op13_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    shares = F.array(*[F.lit(e).cast("double") for e in model.explained]).cast("array<double>")
    each = model.transform(rows).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
