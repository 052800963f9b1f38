"""Compare registered queries with their SQL twins: rows, column names, values.

usage: python scripts/check_oracle.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    got = rows_of(df.columns, df.collect())
    types = {n: t for n, t in df.dtypes}
    if sql is None:
        return None, len(got[1]), types, ""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    duck_types = {d[0]: str(d[1]) for d in rel.description}
    want = rows_of(names, rel.fetchall())
    ok = got == want
    note = ""
    if got[0] != want[0]:
        note = f"columns {got[0]} != {want[0]}"
    elif not ok:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        note = f"{len(got[1])} vs {len(want[1])} rows; spark only {sorted(a)[:3]}; sql only {sorted(b)[:3]}"
    for n, t in types.items():
        d = duck_types.get(n, "")
        if (t in ("int", "bigint") and d in ("HUGEINT", "DOUBLE")) or (t == "bigint") != (d == "BIGINT") or \
                (t == "double") != (d == "DOUBLE"):
            note += f" [type {n}: {t} vs {d}]"
    return ok, len(got[1]), types, note


def main():
    import duckdb

    from tideline.plans import load
    from tideline.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    queries, oracles = load()
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(part in name for part in args.names):
            continue
        start = time.time()
        try:
            ok, n, _, note = compare(spark, con, fn, oracles.get(name), args.sf)
            state = "rows" if ok is None else "ok" if ok else "DIFF"
        except Exception as exc:  # report and go on with the next query
            state, n, note = "FAIL", 0, str(exc)[:900]
        bad += state in ("DIFF", "FAIL")
        print(f"{state:5s} {name:28s} {n:7d} rows {time.time() - start:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
