"""Runs catalog queries next to their SQL and reports differences."""

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v + 0.0, 12)
    if isinstance(v, bool) or v is None:
        return v
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def difference(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, sum(got[1].values())
    res = con.execute(sql)
    want = table([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", 0
    a, b = got[1] - want[1], want[1] - got[1]
    if a or b:
        return (
            f"{sum(a.values())} only in spark {list(a)[:3]}\n   "
            f"{sum(b.values())} only in sql {list(b)[:3]}"
        ), 0
    return None, sum(got[1].values())


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from driftloom.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            diff, rows = difference(spark, con, fn, sqls.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            diff, rows = f"{type(exc).__name__}: {str(exc)[:600]}", 0
        mark = "ok  " if diff is None else "FAIL"
        bad += diff is not None
        print(f"{mark} {name} rows={rows} {'' if name in sqls else '(no sql) '}"
              f"{time.time() - t:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)
    spark.stop()
