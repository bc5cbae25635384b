"""Run registered queries against their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if hasattr(value, "asDict"):
        return tuple(sorted(value.asDict().items()))
    if hasattr(value, "tzinfo") and hasattr(value, "replace") and hasattr(value, "hour"):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    from spreadlake import checks
    from spreadlake.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(cores=8, partitions=8)
    queries, oracles = checks.load()
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    wanted = sys.argv[1:] or list(queries)
    names = [n for n in queries if any(n == w or n.startswith(w) for w in wanted)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            columns, got = df.columns, df.collect()
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"ERR  {name}: {str(e)[:600]}", flush=True)
            continue
        spent = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {spent:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(oracles[name])
            want_columns, want = rel.columns, rel.fetchall()
        except Exception as e:
            bad += 1
            print(f"SQL  {name}: {str(e)[:600]}", flush=True)
            continue
        if sorted(columns) != sorted(want_columns):
            bad += 1
            print(f"COLS {name}: {sorted(columns)} != {sorted(want_columns)}")
            continue
        a, b = rows_of(columns, got), rows_of(want_columns, want)
        ok = a == b
        bad += not ok
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(a)} vs {len(b)} rows {spent:.1f}s", flush=True)
        if not ok:
            sa, sb = set(a), set(b)
            print("   columns", sorted(columns))
            print("   only spark", sorted(sa - sb, key=repr)[:3])
            print("   only sql  ", sorted(sb - sa, key=repr)[:3])
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
