"""Side-by-side check of registered queries: Spark result against the SQL cross-check."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value) if value != value.to_integral_value() else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}")
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value).hex()
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def kind(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "num"
    return type(value).__name__


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(norm(r[i]) for i in order) for r in data]
    kinds = [None] * len(order)
    for r in data:
        for at, i in enumerate(order):
            kinds[at] = kinds[at] or kind(r[i])
        if all(kinds):
            break
    return [names[i] for i in order], kinds, sorted(shaped, key=repr)


def compare(spark, con, name, build, sql, folder):
    """None when equal, else a description of the first difference."""
    df = build(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[2] else "no rows"
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[2]) != len(want[2]):
        return f"{len(got[2])} rows != {len(want[2])}\n  spark {got[2][:3]}\n  sql   {want[2][:3]}"
    for a, b in zip(got[2], want[2]):
        if a != b:
            return f"values {got[0]}\n  spark {a}\n  sql   {b}"
    if got[1] != want[1]:
        return f"kinds {got[1]} != {want[1]}"
    return None


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from passband.session import local_session

    folder = argv[0]
    spark = local_session(8)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = argv[1:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), folder)
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        tag = "ok  " if problem is None else "FAIL"
        print(f"{tag} {name} {time.time() - start:.2f}s {'' if name in oracles else '(rows only)'}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
