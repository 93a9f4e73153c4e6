"""Run queries against their SQL in DuckDB and compare schema and rows.

usage: [FORCE_SPLIT=1] python tools/check_oracle.py [sf folder] [key or prefix* ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    return f"{type(v).__name__}:{v}"


def rows_of(table):
    names = sorted(table.column_names)
    data = table.select(names).to_pylist()
    return names, Counter("|".join(cell(r[n]) for n in names) for r in data), [str(table.schema.field(n).type) for n in names]


def main():
    from popweave.catalog import QUERIES, SQL
    from popweave.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [k for k in QUERIES if not args or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in args)]
    spark = local_session("check", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("FORCE_SPLIT"):  # split groups as in a large cluster
        spark.conf.set("popweave.spread", "300")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = []
    for k in keys:
        t0 = time.time()
        try:
            got = QUERIES[k](spark, folder).toArrow()
            t1 = time.time()
            names, rows, types = rows_of(got)
            if k not in SQL:
                print(f"rows   {k:10s} {got.num_rows:7d} rows  {t1 - t0:6.2f}s  (no SQL)")
                continue
            want = con.execute(SQL[k]).to_arrow_table()
            t2 = time.time()
            wn, wr, wt = rows_of(want)
            problems = []
            if names != wn:
                problems.append(f"columns {names} vs {wn}")
            elif rows != wr:
                a, b = rows - wr, wr - rows
                problems.append(f"{sum(a.values())} extra / {sum(b.values())} missing\n     extra   {list(a)[:3]}\n     missing {list(b)[:3]}")
            norm = lambda t: t.replace("large_", "").replace("timestamp[us, tz=UTC]", "timestamp[us]").replace("element", "item")
            if [norm(x) for x in types] != [norm(x) for x in wt]:
                problems.append("types " + ", ".join(f"{n}: {a} vs {b}" for n, a, b in zip(names, types, wt) if norm(a) != norm(b)))
            if got.num_rows == 0:
                problems.append("no rows")
            print(f"{'BAD ' if problems else 'ok  '}   {k:10s} {got.num_rows:7d} rows  {t1 - t0:6.2f}s sql {t2 - t1:5.2f}s", *problems, sep="\n     " if problems else " ")
            if problems:
                bad.append(k)
        except Exception as e:  # report and go on
            print(f"FAIL   {k}: {type(e).__name__} {str(e)[:700]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
            bad.append(k)
        sys.stdout.flush()
    print(f"{len(keys) - len(bad)} of {len(keys)} good; bad: {' '.join(bad)}")


if __name__ == "__main__":
    main()
