"""Run registered queries next to their SQL twins in DuckDB and compare values.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql):
    """Empty string if equal, else a description of the first difference."""
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        diff = sorted(set(got) ^ set(want), key=repr)[:4]
        return f"rows {len(got)} != {len(want)}: {diff}", len(got)
    for a, b in zip(got, want):
        if a != b:
            return f"spark {a} != sql {b} ({got_cols})", len(got)
    return "", len(got)


def main():
    from fieldtrace.session import local_session
    import __spark_entry__ as entry
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        folder = args[i + 1]
        del args[i:i + 2]
    spark = local_session(8)
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = duck(folder)
    bad = 0
    for name in args or sorted(queries):
        t = time.time()
        try:
            if name in oracles:
                message, n = compare(queries[name](spark, folder), con, oracles[name])
                state = "ok" if not message else "DIFF"
            else:
                n, message, state = len(queries[name](spark, folder).collect()), "", "rows"
        except Exception as error:  # report and go on with the next query
            n, message, state = -1, f"{type(error).__name__}: {str(error)[:400]}", "FAIL"
        bad += state in ("DIFF", "FAIL") or n == 0
        print(f"{state:5} {name:32} rows={n:<7} {time.time() - t:6.2f}s {message}", flush=True)
    print("problems:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
