"""Local stand-in for the driver's correctness gate: run each registered Spark query
and its DuckDB oracle on the same parquet tables, compare row count, column names and
an order-insensitive value multiset.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quillmark.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    out = dict(name=name, rows=len(s_rows), oracle_rows=len(d_rows),
               spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if sorted(s_cols) != sorted(d_cols):
        out.update(ok=False, why=f"columns {sorted(s_cols)} vs {sorted(d_cols)}")
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    dorder = [d_cols.index(s_cols[i]) for i in order]
    a = sorted((tuple(_norm(r[i]) for i in order) for r in s_rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in dorder) for r in d_rows), key=repr)
    if len(a) != len(b):
        out.update(ok=False, why="row count")
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        out.update(ok=False, why=f"values differ, e.g. {diff}")
    else:
        out.update(ok=True)
    return out


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    import __spark_entry__ as E
    from quillmark.session import get_spark
    spark = get_spark()
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            r = compare(spark, con, name, qs[name], os_.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
