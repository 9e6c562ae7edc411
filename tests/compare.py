"""Run registered queries next to their SQL on DuckDB and compare rows.

    python tests/compare.py [sf_dir] [name ...]
"""

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    import decimal
    import math

    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return str(int(v)) if v == int(v) else repr(round(float(v), 6))
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return str(int(r)) if r == int(r) else repr(r)
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time() - t
    if sql is None:
        return f"rows {sum(got.values())} (no sql) {t1:.1f}s", True
    t = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    t2 = time.time() - t
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(cols)}", False
    if got == want:
        return f"ok {sum(got.values())} rows spark {t1:.1f}s sql {t2:.1f}s", True
    a, b = got - want, want - got
    return (
        f"DIFF spark {sum(got.values())} sql {sum(want.values())}; only spark {sum(a.values())} {list(a)[:3]}; "
        f"only sql {sum(b.values())} {list(b)[:3]}; cols {sorted(cols)}"
    ), False


def main(argv):
    from bodygrid.plans import load
    from bodygrid.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    reg = load()
    names = argv[1:] or list(reg.QUERIES)
    if names and names[0].startswith("@"):
        names = [n for n, f in reg.QUERIES.items() if f.__module__.endswith(names[0][1:])]
    spark = local_session(8)
    con = connect(sf)
    bad = 0
    for n in names:
        try:
            msg, ok = compare(spark, con, n, reg.QUERIES[n], reg.ORACLES.get(n), sf)
        except Exception as e:  # report and go on
            msg, ok = "ERROR " + str(e)[:1500], False
        bad += not ok
        print(n, msg, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
