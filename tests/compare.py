"""Side-by-side check of registered queries against their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{folder}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_norm(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def difference(df, con, sql: str) -> str | None:
    """None if equal, else a short description."""
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = _sorted_rows(expected_columns, cursor.fetchall())
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    actual = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    for got, want in zip(actual, expected):
        if got != want or [type(g) for g in got] != [type(w) for w in want]:
            return f"row {got} != {want}"
    return None


if __name__ == "__main__":
    from conftest import make_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = make_session(), duck(folder)
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            result = difference(query(spark, folder), con, sql) if sql else f"no SQL, {query(spark, folder).count()} rows"
        except Exception as error:  # report and go on to the next query
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += result is not None and sql is not None
        print(f"{name:40s} {time.time() - start:6.2f}s  {result or 'ok'}", flush=True)
    print("failures:", bad)
