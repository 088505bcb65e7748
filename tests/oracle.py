"""Compare registered queries with DuckDB. Also a command: python tests/oracle.py SF_DIR [names...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str, datetime.datetime)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return float(value)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(plain(r[i]) for i in order) for r in rows]
    key = lambda r: tuple(("", f"{v:.6e}") if isinstance(v, float) else (str(type(v).__name__ == "NoneType"), str(v)) for v in r)
    return [columns[i] for i in order], sorted(rows, key=key)


def close(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark_rows, spark_columns, duck_rows, duck_columns) -> str | None:
    """None if equal, else what differs."""
    sc, sr = normal(spark_rows, spark_columns)
    dc, dr = normal(duck_rows, duck_columns)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"{len(sr)} rows != {len(dr)}"
    exact = True
    for a, b in zip(sr, dr):
        if a != b:
            exact = False
            if not all(close(x, y) for x, y in zip(a, b)):
                bad = [(c, x, y) for c, x, y in zip(sc, a, b) if not close(x, y)]
                return f"row {a[:4]}: {bad[:3]}"
    return None if exact else "close"


def run(spark, con, name, queries, oracles, sf_dir):
    started = time.time()
    df = queries[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - started
    if name not in oracles:
        return took, len(rows), "rows-only"
    started = time.time()
    cursor = con.execute(oracles[name])
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    return took, len(rows), compare(rows, df.columns, expected, columns) or "equal"


if __name__ == "__main__":
    from querysentry.session import local_session
    from querysentry.workload import ORACLES, QUERIES

    sf = sys.argv[1]
    spark = local_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in sys.argv[2:] or list(QUERIES):
        try:
            took, rows, verdict = run(spark, con, name, QUERIES, ORACLES, sf)
        except Exception as error:  # report and go on
            took, rows, verdict = 0, 0, f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += verdict not in ("equal", "rows-only")
        print(f"{name:36s} {took:6.2f}s {rows:8d} {verdict}", flush=True)
    print("NOT EQUAL:", bad)
