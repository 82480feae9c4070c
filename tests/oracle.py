"""Run registered queries in Spark and their SQL in DuckDB and compare every value.

    python tests/oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, repr(float(v) + 0.0))
    return (3, str(v))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def compare(df, rows, con, sql) -> str | None:
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    expected = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(set(cols) ^ set(df.columns))}"
    types = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
    odd = [(n, t, types[n]) for n, t in df.dtypes if SPARK_TO_DUCK.get(t) != types[n]]
    got = canonical(df.columns, rows)
    want = canonical(cols, expected)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, a[1], b[1]) for c, a, b in zip(sorted(cols), g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ: {diff[:4]}"
    return f"types {odd}" if odd else None


def main() -> int:
    from airloom_session import session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = sys.argv[2:]
    spark = session()
    con = connect(sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, f"{DATA}/sf{sf}")
            rows = [tuple(r) for r in df.collect()]
            problem = compare(df, rows, con, oracles[name]) if name in oracles else None
            kind = "sql " if name in oracles else "rows"
        except Exception as e:  # report and go on
            rows, problem, kind = [], f"{type(e).__name__}: {str(e)[:600]}", "err "
        failed += problem is not None
        print(f"{kind} {name:28s} {len(rows):7d} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent))
    sys.exit(main())
