"""Run named queries against their SQL counterparts in DuckDB, strictly.

``python -m tests.compare [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    """Comparable text that keeps kinds apart: 1, 1.0, a date and a timestamp differ."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return f"bool:{value}"
    if isinstance(value, int):
        return f"int:{value}"
    if isinstance(value, decimal.Decimal):
        return f"dec:{value}"
    if isinstance(value, float):
        return f"float:{value + 0.0:.12g}"
    if isinstance(value, dt.datetime):
        return f"ts:{value.isoformat()}"
    if isinstance(value, dt.date):
        return f"date:{value.isoformat()}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_norm, value)) + "]"
    return f"{type(value).__name__}:{value}"


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a short description of the first difference."""
    left = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    right = normal_rows([c[0] for c in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} vs {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"spark {a} vs sql {b}"
    return None


def main(argv):
    from tarmac.catalogue.all import QUERIES
    from tarmac.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session("compare", f"local[{os.cpu_count()}]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        query = QUERIES[name]
        start = time.time()
        try:
            df = query.build(spark, sf_dir)
            if query.sql is None:
                n = df.count()
                print(f"rows {name:28s} {n} rows {time.time() - start:.2f}s", flush=True)
                continue
            problem = compare(df, con, query.sql)
            n = df.count() if problem is None else -1
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {n} rows {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
