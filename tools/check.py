"""Run registered queries against their SQL in DuckDB: check.py SF [name-prefix ...]."""

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() and abs(v) < 1e15 else v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return v
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


def connect(d):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def compare(spark, con, d, name, fn, sql):
    t0 = time.time()
    df = fn(spark, d)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time() - t0
    if sql is None:
        return "rows", len(got), t1, 0.0, None
    t0 = time.time()
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time() - t0
    if sorted(cols) != sorted(df.columns):
        return "FAIL", len(got), t1, t2, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    odd = [f"{c[0]}:{c[1]}" for c in cur.description if any(k in str(c[1]).upper() for k in ("HUGEINT", "DECIMAL"))]
    if odd:
        return "TYPE", len(got), t1, t2, f"{odd} equal={a == b}"
    if a == b:
        return "ok", len(got), t1, t2, None
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return "FAIL", len(got), t1, t2, f"{len(a)} vs {len(b)} rows, {len(diff)} differ; first {diff[:2]}"


def main():
    from undulate import build_session
    from undulate.plans import ORACLES, QUERIES, load_all

    load_all()
    sf, names = sys.argv[1], sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                         "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            st, n, t1, t2, msg = compare(spark, con, d, name, fn, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            st, n, t1, t2, msg = "ERR", 0, 0, 0, "".join(traceback.format_exception_only(e))[:600]
        bad += st in ("FAIL", "ERR", "TYPE")
        print(f"{st:5s} {name:34s} rows={n:<7d} spark={t1:.2f}s sql={t2:.2f}s {msg or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
