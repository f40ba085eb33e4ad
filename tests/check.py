"""Compare registered queries with their SQL, row by row, order ignored."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """Empty text when equal, else the first difference."""
    df = fn(spark, sf_dir)
    a = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b = table([c[0] for c in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} / {len(b[1])}; only spark {sorted(set(a[1]) - set(b[1]), key=repr)[:2]}; only sql {sorted(set(b[1]) - set(a[1]), key=repr)[:2]}"
    kinds = lambda t: [sorted({type(v).__name__ for v in c if v is not None}) for c in zip(*t)]
    if kinds(a[1]) != kinds(b[1]):
        return f"types {kinds(a[1])} / {kinds(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(bad)} of {len(a[1])} rows, first {bad[0]}" if bad else "" if a[1] else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
             .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-")).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(f"/root/testdata/sf{sf}")
    q, o = entry.queries(), entry.oracle_sql()
    for name in q:
        if only and not any(name.startswith(p) for p in only):
            continue
        t = time.time()
        try:
            if name in o:
                res = compare(spark, con, q[name], o[name], f"/root/testdata/sf{sf}") or "ok"
            else:
                res = f"no sql, {len(q[name](spark, f'/root/testdata/sf{sf}').collect())} rows"
        except Exception as e:
            res = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        print(f"{name:34s} {time.time() - t:6.1f}s {res}", flush=True)
