"""Run registered queries next to their SQL and report differences.

Usage: python tests/compare.py [--sf 0.01] [--time] name-prefix ...
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (round(value, 6) + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, folder, query, sql):
    """(matches, message) for one query."""
    frame = query(spark, folder)
    got = frame.collect()
    gcols, grows = rows_of(frame.columns, got)
    if sql is None:
        # no SQL says what is right: a query that gives rows is all that can be seen here
        return bool(grows), f"rows only, not compared: {len(grows)}"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    ocols, orows = rows_of(cols, cur.fetchall())
    if gcols != ocols:
        return False, f"columns {gcols} != {ocols}"
    if grows == orows:
        return True, f"{len(grows)} rows"
    extra = [r for r in grows if r not in set(orows)][:3] if len(grows) < 200000 else []
    lost = [r for r in orows if r not in set(grows)][:3] if len(orows) < 200000 else []
    return False, f"{len(grows)} vs {len(orows)} rows\n   {gcols}\n   spark only {extra}\n   sql only   {lost}"


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.001")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    import __spark_entry__ as entry
    from quire.session import build_session

    folder = f"/root/testdata/sf{opts.sf}"
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.sql.session.timeZone": "Etc/UTC",
    })
    spark.sparkContext.setLogLevel("FATAL")
    con = connect(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in sorted(entry.queries().items()):
        if opts.names and not any(name.startswith(n) for n in opts.names):
            continue
        began = time.time()
        try:
            good, message = compare(spark, con, folder, query, oracles.get(name))
        except Exception as exc:  # reported, not hidden
            good, message = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:42s} {time.time() - began:6.2f}s {message}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
