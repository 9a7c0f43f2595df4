"""Runs catalogue queries next to their SQL twins and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return f"bool {value}"
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    if isinstance(value, str):
        return f"'{value}'"
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, function, sql, sf_dir):
    df = function(spark, sf_dir)
    got = normalise(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = normalise([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w]
    return f"{len(bad)} rows differ, e.g. {bad[:2]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tabforge.session import build_session

    sf = sys.argv[1]
    names = sys.argv[2:]
    session = build_session(
        "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    for name, function in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(session, con, function, oracles[name], sf)
                label = "ok" if problem is None else "DIFF " + problem
            else:
                label = f"rows {function(session, sf).count()}"
        except Exception as error:  # noqa: BLE001
            label = "FAIL " + str(error)[:1500]
        print(f"{name:28s} {time.time() - start:6.1f}s {label}", flush=True)
