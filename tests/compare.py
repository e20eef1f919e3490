"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0.0:
        return 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, name, query, sql, sf_dir) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    t0 = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    note = f"{len(got)} rows, spark {took:.1f}s, sql {time.time() - t0:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} <> {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        kinds_a = [type(v).__name__ for v in a[0]] if a else []
        kinds_b = [type(v).__name__ for v in b[0]] if b else []
        return kinds_a == kinds_b, note + ("" if kinds_a == kinds_b else f" TYPES {kinds_a} <> {kinds_b}")
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"{note}; {len(a)} vs {len(b)} rows; columns {sorted(cols)}; first differences {diff}"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import os

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF", "0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [q for q in queries if not sys.argv[1:] or any(a in q for a in sys.argv[1:])]
    bad = []
    for name in chosen:
        try:
            ok, note = check(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print("ok " if ok else "BAD", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(len(chosen), "checked;", len(bad), "bad:", bad)
