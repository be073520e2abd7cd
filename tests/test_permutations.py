"""Keyed permutations: bijections for every size, near uniform, and the p-values that rest on them."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from undulate.functions.scalar import permuted, permuted_sql
from undulate.operators import events as E
from undulate.operators.cohort import _rank_sum_counts


def images(spark, sizes, seeds):
    df = spark.createDataFrame([(n, s, i) for n in sizes for s in seeds for i in range(n)], "n long, s long, i long")
    return df.select("n", "s", "i", permuted(F.col("i"), F.col("n"), F.col("s")).alias("x"))


def test_a_bijection_for_every_size(spark):
    df = images(spark, (1, 2, 3, 7, 64, 101), (0, 1, 12345, 2_147_483_645))
    got = {}
    for r in df.collect():
        got.setdefault((r.n, r.s), []).append((r.i, r.x))
    for (n, _), own in got.items():
        assert sorted(x for _, x in own) == list(range(n))
    assert len({tuple(sorted(v)) for (n, _), v in got.items() if n == 101}) == 4
    con = duckdb.connect()
    for (n, s), own in got.items():
        sql = con.execute(f"SELECT i, {permuted_sql('i', str(n), str(s))} FROM range({n}) t(i)").fetchall()
        assert sorted(sql) == sorted(own)


def test_near_uniform(spark):
    """Places of each index over many seeds, and of pairs that stay neighbours."""
    n, reps = 8, 4000
    df = images(spark, (n,), range(17, 17 + 97 * reps, 97)).groupBy("i", "x").count().collect()
    chi = sum((r["count"] - reps / n) ** 2 / (reps / n) for r in df)
    assert len(df) == n * n and chi < 49 + 6 * (2 * 49) ** 0.5


def test_no_sort_in_the_plan(spark):
    plan = images(spark, (5,), (1,))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan


def test_leader_order_p(spark):
    fixed = [("fix", e, f"u{u}", u + 0.1 * (e % 3)) for e in range(8) for u in range(6)]
    loose = [("loose", e, f"u{u}", float((u * 7 + e * e * 5 + u * e * 3) % 11)) for e in range(8) for u in range(6)]
    df = spark.createDataFrame(fixed + loose, "run_id string, ev long, unit string, lat double")
    got = {r.run_id: r for r in E.leader_order_p(df, ["run_id"], "ev", "unit", "lat", 99).collect()}
    assert abs(got["fix"].w - 1) < 1e-9 and got["fix"].p == 0.01 and got["fix"].n == 6 and got["fix"].m == 8
    assert got["loose"].p > 0.05
    w = {r.run_id: r.w for r in E.kendall_w(df, ["run_id"], "ev", "unit", "lat").collect()}
    assert all(abs(w[k] - got[k].w) < 1e-12 for k in w)


def test_rank_sum_counts_of_unequal_samples():
    assert (_rank_sum_counts(40, 3) == _rank_sum_counts(3, 40)).all()
    naive = Counter()
    for a in range(7):
        for b in range(a + 1, 7):
            naive[a + b - 1] += 1
    assert _rank_sum_counts(5, 2).tolist() == [naive[u] for u in range(11)]


def test_recruitment_p(spark):
    rows = [("deep", e, f"u{u}", 0.02 * u * 10 + 0.01 * ((e * u) % 3), 10.0 * u) for e in range(6) for u in range(7)]
    rows += [("none", e, f"u{u}", float((u * 5 + e * 3) % 7), 10.0 * u) for e in range(6) for u in range(7)]
    rows += [("few", e, f"u{u}", float(u), 10.0 * u) for e in range(2) for u in range(7)] + [("flat", e, f"u{u}", float(u), 3.0) for e in range(9) for u in range(7)]
    rows += [("deep", 99, "u0", 50.0, 0.0), ("deep", 99, "u1", 0.0, 100.0)]  # too few units
    df = spark.createDataFrame(rows, "run_id string, ev long, unit string, t double, depth double")
    got = {r.run_id: r for r in E.recruitment_p(df, ["run_id"], "ev", "unit", "t", "depth", 199).collect()}
    assert set(got) == {"deep", "none"}
    for k, r in got.items():
        own = {}
        for q in rows:
            if q[0] == k and q[1] != 99:
                own.setdefault(q[1], []).append(q[3:])
        od = dd = 0.0
        for ev in own.values():
            mo, md = (sum(c) / len(ev) for c in zip(*ev))
            od += sum((o - mo) * (d - md) for o, d in ev)
            dd += sum((d - md) ** 2 for _, d in ev)
        assert abs(r.slope - od / dd) < 1e-9 and r.n_events == 6 and r.n_slopes == 6
    assert got["deep"].p == 1 / 200 and got["deep"].n_pos == 6 and got["none"].p > 0.02
