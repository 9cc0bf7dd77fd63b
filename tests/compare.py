"""Compare registered queries with their SQL in DuckDB: python tests/compare.py DIR [query ...]."""
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from rebaja.plans.queries import all_queries, all_sql  # noqa: E402
from rebaja.session import builder  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(path: str):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19].removesuffix("T00:00:00")
    return value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def difference(spark_rows, duck_rows, columns):
    """None when equal, else a short description."""
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} != {len(duck_rows)}"
    close = 0
    for a, b in zip(spark_rows, duck_rows):
        if a == b:
            continue
        bad = [(c, x, y) for c, x, y in zip(columns, a, b) if x != y]
        if all(isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 + 1e-9 * abs(x) for _, x, y in bad):
            close += 1
            continue
        return f"{bad[:6]} in {a[:6]} | {b[:6]}"
    return f"close {close}" if close else None


def compare(spark, con, path, name, text):
    df = all_queries()[name](spark, path)
    left, columns = rows_of([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    right, duck_columns = rows_of(cur.fetchall(), names)
    if columns != duck_columns:
        return f"columns {set(columns) ^ set(duck_columns)}", len(left)
    return difference(left, right, columns), len(left)


def main():
    path, wanted = sys.argv[1], sys.argv[2:]
    spark = builder("compare", "8", 8).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, texts, bad = connect(path), all_sql(), 0
    for name in wanted or list(all_queries()):
        start = time.time()
        try:
            if name in texts:
                diff, n = compare(spark, con, path, name, texts[name])
            else:
                diff, n = None, all_queries()[name](spark, path).count()
        except Exception as exc:  # report and go on with the next query
            diff, n = f"{type(exc).__name__}: {str(exc)[:500]}", -1
        bad += diff is not None
        mark = "FAIL" if diff else ("ok" if name in texts else "ran")
        print(f"\n{mark:5}{name} rows={n} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print(f"\n{bad} differing")


if __name__ == "__main__":
    main()
