"""Compare registered queries with their SQL oracles: ``python tools/check.py [-d DIR] [pattern ...]``."""

import argparse
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

from gridpanel.queries import load_all

ap = argparse.ArgumentParser()
ap.add_argument("-d", default="/root/testdata/sf0.01")
ap.add_argument("patterns", nargs="*")
ap.add_argument("-v", action="store_true")
args = ap.parse_args()

spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = duckdb.connect()
for f in os.listdir(args.d):
    con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{args.d}/{f}'")


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, list):
        return str([norm(x) for x in v])
    return repr(v)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
bad = []
for name, q in load_all().items():
    if args.patterns and not any(re.search(p, name) for p in args.patterns):
        continue
    t = time.time()
    try:
        df = q.run(spark, args.d)
        rows = df.collect()
        cols = sorted(df.columns)
        got = sorted(tuple(norm(r[c]) for c in cols) for r in rows)
        note = f"{len(rows)} rows"
        sql = q.oracle()
        if sql:
            cur = con.execute(sql)
            names = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want_rows = cur.fetchall()
            pos = {n: i for i, n in enumerate(names)}
            if sorted(names) != cols:
                raise AssertionError(f"columns {cols} vs {sorted(names)}")
            diff_t = [(c, ty, types[c]) for c, ty in df.dtypes if TYPES.get(ty, ty) != types[c]]
            want = sorted(tuple(norm(r[pos[c]]) for c in cols) for r in want_rows)
            if got != want:
                ws, gs = set(want), set(got)
                a, b = [x for x in got if x not in ws][:3], [x for x in want if x not in gs][:3]
                raise AssertionError(f"{len(got)} vs {len(want)} rows; cols {cols}\n   spark {a}\n   duck  {b}")
            if not rows:
                note += " EMPTY"
            if diff_t:
                note += f" TYPES {diff_t}"
        else:
            note += " (no oracle)"
        print(f"ok   {name} {time.time() - t:.1f}s {note}", flush=True)
        if args.v:
            df.show(10, False)
    except Exception as e:  # noqa: BLE001
        bad.append(name)
        print(f"FAIL {name} {time.time() - t:.1f}s {type(e).__name__} {str(e)[:900]}", flush=True)
print("failed:", bad)
