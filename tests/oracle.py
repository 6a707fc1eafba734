"""Local twin of the driver's correctness gate: Spark query vs DuckDB oracle.

Compares row count, column names and the order-insensitive multiset of rows
(doubles compared after rounding to 9 decimals; ``ORACLE_EXACT=1`` compares the
already-rounded values exactly, as a value hash would).
"""

from __future__ import annotations

import math
import os
import sys
import time

EXACT = os.environ.get("ORACLE_EXACT", "0") == "1"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return (v if EXACT else round(v, 9)) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "isoformat") and not isinstance(v, str):
        return v.isoformat()[:19]
    return v


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    import __spark_entry__ as e

    q = e.queries()[name]
    sql = e.oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    cols = sdf.columns
    srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"{name}: rows-only {len(srows)} ({t1 - t0:.1f}s)"
    con = con or duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    if sorted(dcols) != sorted(cols):
        return False, f"{name}: columns differ spark={cols} duck={dcols}"
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(_norm(r[i]) for i in idx) for r in drows_raw]
    if len(drows) != len(srows):
        return False, f"{name}: row count spark={len(srows)} duck={len(drows)}"
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a, b = sorted(srows, key=key), sorted(drows, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{name}: {len(bad)} rows differ, e.g. spark={bad[0][0]} duck={bad[0][1]}"
    return True, f"{name}: OK {len(srows)} rows ({t1 - t0:.1f}s)"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pitchlake.session import build_session

    sf = "/root/testdata/sf0.01"
    names = sys.argv[1:]
    spark = build_session()
    import __spark_entry__ as e

    names = names or list(e.queries())
    con = duck(sf)
    fails = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, sf, con)
        except Exception as exc:  # report and continue
            ok, msg = False, f"{n}: ERROR {type(exc).__name__}: {str(exc)[:400]}"
        fails += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - fails}/{len(names)} passed")
