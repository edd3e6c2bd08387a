"""Run registered queries against their SQL in DuckDB and report differences.

usage: python tools/compare.py [folder] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelwise.catalog import QUERIES, SQL  # noqa: E402
from panelwise.session import local_session  # noqa: E402

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([canon(row[i]) for i in order]) for row in data)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    bad = []
    for key in wanted:
        t = time.time()
        try:
            df = QUERIES[key](spark, folder)
            got = [tuple(row) for row in df.collect()]
            took = time.time() - t
            cols, mine = rows_of(df.columns, got)
            if key not in SQL:
                print(f"rows {key} {len(mine)} {took:.2f}s")
                continue
            t = time.time()
            res = con.execute(SQL[key])
            ocols, theirs = rows_of([c[0] for c in res.description], res.fetchall())
            sql_took = time.time() - t
            ok = cols == ocols and mine == theirs
            print(f"{'ok  ' if ok else 'DIFF'} {key} {len(mine)} {took:.2f}s sql {sql_took:.2f}s", flush=True)
            if not ok:
                bad.append(key)
                print("   ", cols, ocols, len(mine), len(theirs))
                extra = [m for m in mine if m not in set(theirs)][:3]
                lack = [m for m in theirs if m not in set(mine)][:3]
                print("    spark:", *extra, "\n    sql:  ", *lack)
        except Exception as e:  # noqa: BLE001
            bad.append(key)
            print(f"FAIL {key}: {str(e)[:600]}", flush=True)
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    raise SystemExit(main())
