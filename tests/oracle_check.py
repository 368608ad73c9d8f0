"""Run named queries on Spark and their SQL twins on DuckDB and compare the rows.

usage: python tests/oracle_check.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidewire import plans  # noqa: E402
from tidewire.session import TABLES, clear_steps, get_session  # noqa: E402

ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.9g}"
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    if isinstance(v, dict):
        return str({k: canon(x) for k, x in v.items()})
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1e9 else str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=str)


def compare(spark, con, name: str, sf_dir: str):
    """(ok, message) for one query."""
    t0 = time.time()
    df = plans.queries()[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - t0
    sql = plans.oracles().get(name)
    if not sql:
        return True, f"{len(got)} rows, no SQL twin, {took:.1f}s"
    t0 = time.time()
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = cur.fetchall()
    duck = time.time() - t0
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} != {sorted(want_names)}"
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"{len(a)} vs {len(b)} rows; spark only {sorted(sa - sb, key=str)[:3]}; sql only {sorted(sb - sa, key=str)[:3]}"
    return True, f"{len(a)} rows, spark {took:.1f}s, sql {duck:.1f}s"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = sys.argv[2:]
    sf_dir = f"{ROOT}/sf{sf}"
    spark, con = get_session(os.environ.get("TEST_CPUS", "8")), connect(sf_dir)
    bad = 0
    for name in plans.queries():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, msg = compare(spark, con, name, sf_dir)
            clear_steps(spark)
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, msg, flush=True)
    print(f"{bad} failures")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
