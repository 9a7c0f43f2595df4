"""URL rules: host suffixes and path prefixes of every URL meet the rules in a hash-prefix join.

A rule is a host, a path and a verdict. It fits the host and its subdomains if the path starts with the
rule's; the longest rule text wins, then the longer host, then "block". URLs that no rule fits get the
default verdict.

Defined results: a null URL or one without "://" has an empty host and path and gets the default verdict.
Repeated rows stay repeated. Rules with a null host, path or verdict never fit; rules repeated with either
verdict count as "block". Empty tables of URLs or rules are fine. Other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that the join compares; the whole digest is confirmed after it.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without a "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^?#]*)", 1)
    slash = F.locate("/", rest)
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - F.lit(1))).otherwise(rest)
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise("")
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Columns host, path, verdict -> short, digest, rank, rule, verdict; one row per host and path."""
    rules = rules.select("host", "path", "verdict").dropna()
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    rules = rules.groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return rules.select(
        F.substring(digest, 1, SHORT).alias("short"),
        digest.alias("digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("fit"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_size"),
    )


def judge(
    pages: DataFrame, rules: DataFrame, keys: list[str], url_column: str = "url", default: str = "allow"
) -> DataFrame:
    """Per row of ``pages``: keys, host, path, rule, verdict.

    Only suffixes with as many labels, and path prefixes as long, as some rule has are expanded, so long hosts and
    paths cost no more than short ones. Rows are grouped once, by keys and URL; the rules are joined without a
    shuffle as long as Spark's size estimate allows a broadcast, and by sort-merge with skew splitting beyond that.
    """
    prepared = prepare_rules(rules)
    shapes = prepared.agg(
        F.array_sort(F.collect_set("labels")).alias("labels"),
        F.array_sort(F.collect_set("path_size")).alias("path_sizes"),
    ).first()
    names = [f"_key{i}" for i in range(len(keys))]
    rows = pages.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(url_column).alias("_url"))
    rows = rows.groupBy(*names, "_url").agg(F.count(F.lit(1)).alias("_rows"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumns({"host": host, "path": path})

    def longs(values):
        return F.array(*(F.lit(int(v)) for v in values)) if values else F.expr("array_repeat(0, 0)")

    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(longs(shapes["labels"]), lambda n: n <= F.size(parts)),
        lambda n: F.concat_ws(".", F.slice(parts, F.size(parts) - n + F.lit(1), n)),
    )
    prefixes = F.transform(
        F.filter(longs(shapes["path_sizes"]), lambda n: n <= F.length("path")),
        lambda n: F.substr("path", F.lit(1), n),
    )
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    expanded = rows.withColumn("_digest", F.explode_outer(expressions))
    expanded = expanded.withColumn("short", F.substring("_digest", 1, SHORT))
    found = expanded.join(prepared.select("short", "digest", "fit"), "short", "left")
    fit = F.when(F.col("_digest") == F.col("digest"), F.col("fit"))
    best = found.groupBy(*names, "_url", "_rows", "host", "path").agg(F.max(fit).alias("fit"))
    result = best.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return result.select(
        *(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.lit(default)).alias("verdict"),
    )
