"""Spark-vs-DuckDB comparison used by the tests and by hand:

    python tests/oracle_harness.py [name ...]

Mirrors the driver gate: columns sorted by name, row count, and an
order-insensitive multiset of rows (floats rounded to 6 digits)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def duck(sf=SF):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return str(v)


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT",
            "timestamp": "TIMESTAMP WITH TIME ZONE"}


def compare(spark, con, name, fn, sql, sf=SF):
    t0 = time.time()
    sdf = fn(spark, sf)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    out = {"name": name, "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2),
           "rows": (len(srows), len(drows))}
    if sorted(scols) != sorted(dcols):
        out["ok"] = False
        out["why"] = f"columns {sorted(scols)} vs {sorted(dcols)}"
        return out
    order = sorted(scols)
    stypes = dict((f.name, f.dataType.simpleString()) for f in sdf.schema.fields)
    dtypes = dict((d[0], str(d[1])) for d in res.description)
    bad_types = [(c, stypes[c], dtypes[c]) for c in order if TYPE_MAP.get(stypes[c].split("(")[0]) != dtypes[c].split("(")[0]]
    if bad_types:
        out["types"] = bad_types
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    sc = Counter(tuple(_norm(r[i]) for i in si) for r in srows)
    dc = Counter(tuple(_norm(r[i]) for i in di) for r in drows)
    out["ok"] = sc == dc
    if not out["ok"]:
        only_s = list((sc - dc).elements())[:3]
        only_d = list((dc - sc).elements())[:3]
        out["why"] = f"spark-only {only_s} | duck-only {only_d} | cols {order}"
    return out


def main(names):
    from vigil.session import get_session
    import __spark_entry__ as e
    spark = get_session("local[8]")
    qs, orc = e.queries(), e.oracle_sql()
    con = duck()
    names = names or sorted(qs)
    bad = 0
    for n in names:
        if n not in orc:
            t0 = time.time()
            try:
                cnt = qs[n](spark, SF).count()
                print(f"ROWS {n}: {cnt} rows {time.time()-t0:.1f}s", flush=True)
            except Exception as ex:  # noqa: BLE001
                bad += 1
                print(f"ERR  {n}: {type(ex).__name__}: {str(ex)[:400]}", flush=True)
            continue
        try:
            r = compare(spark, con, n, qs[n], orc[n])
        except Exception as ex:  # noqa: BLE001
            r = {"name": n, "ok": False, "why": f"{type(ex).__name__}: {str(ex)[:600]}"}
        bad += not r["ok"]
        tag = ("OK   " if r["ok"] else "FAIL ") if not r.get("types") else ("TYPE " if r["ok"] else "FAIL ")
        print(tag + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
