"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python -m checks.compare [scale folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "is_finite"):
        value = float(value)
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return int(value)
    return value


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(normal(row[i]) for i in order) for row in data]
    return sorted(rows, key=lambda r: tuple(map(repr, r))), [names[i] for i in order]


def check(spark, con, sf_dir, name, fn, sql):
    """None when equal, else the first difference in words."""
    df = fn(spark, sf_dir)
    got, got_names = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want, want_names = rows_of(names, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; e.g. {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        pairs = [(n, g, w) for n, g, w in zip(got_names, *bad[0]) if g != w]
        return f"{len(bad)} of {len(got)} rows differ, first: {pairs}"
    return None


def main(argv):
    from checks.registry import QUERIES, SQL
    from checks.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            problem = check(spark, con, sf_dir, name, QUERIES[name], SQL.get(name))
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        state = "ok" if problem is None else f"FAIL {problem}"
        print(f"{name:28s} {time.time() - start:6.1f}s {'' if name in SQL else '(rows) '}{state}",
              flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
