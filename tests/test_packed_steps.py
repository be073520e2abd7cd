"""Steps that shift or count packed rows give what the plain ones give, and less travels."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from undulate.operators import ml as L
from undulate.operators import nulls as U
from undulate.operators import pairs as P
from undulate.operators import sets as X
from undulate.operators import signal as S
from undulate.sources.tables import write_table


@pytest.fixture(scope="module")
def traces(spark):
    rnd = random.Random(4)
    rows = [(r, u, f, 2.5 if (r, u) == (0, 3) else round(rnd.random(), 2)) for r in range(3) for u in range(6) for f in range(20)]
    return spark.createDataFrame(rows + [(7, 0, f, 1.0 * f) for f in range(20)], "run_id long, unit long, frame long, v double").cache()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shifted_mean_pair_corr(traces):
    t = traces.withColumn("shift_id", F.explode(F.sequence(F.lit(0), F.lit(8))))
    t = S.circular_shift(t, ["run_id", "unit"], "frame", 20, U.shift_amount(F.col("shift_id"), F.col("unit"), 20, 3))
    want = {(r.run_id, r.shift_id): (r.n_units, r.mean_r) for r in P.mean_pair_corr(t, ["run_id", "shift_id"], "unit", "frame", "v").collect()}
    got = {(r.run_id, r.shift_id): (r.n_units, r.mean_r) for r in U.shifted_mean_pair_corr(traces, ["run_id"], "unit", "frame", "v", 20, 9, 3).collect()}
    assert set(got) == set(want) and len(got) == 36
    for k, (n, r) in want.items():
        assert got[k][0] == n and (got[k][1] is None if r is None else abs(got[k][1] - r) < 1e-12)


def test_pcs_above_null_packs_before_it_shifts(traces):
    df = L.pcs_above_null(traces.filter("run_id < 3"), ["run_id"], "unit", "frame", "v", 20, 3, 4, 3)
    assert len(df.collect()) == 3
    assert "collect_list" in plan_of(df).split("Generate")[-1]


def test_cross_correlogram_of_gaps_and_nulls(spark):
    rnd = random.Random(8)
    x = [(r, u, f, None if rnd.random() < 0.1 else rnd.random()) for r in range(2) for u in range(3) for f in range(15) if u == 0 or rnd.random() < 0.8]
    y = [(r, s, f, 1.0 if s == "c" else rnd.random()) for r in range(2) for s in "abc" for f in range(-2, 15) if s == "a" or rnd.random() < 0.8]
    df = P.cross_correlogram(spark.createDataFrame(x, "run_id long, unit long, frame long, a double"),
                             spark.createDataFrame(y, "run_id long, signal string, frame long, b double"), ["run_id", "unit"], "frame", "a", "b", 3)
    want = {}
    for r, u, f, a in x:
        for q, s, g, b in y:
            if r == q and abs(f - g) <= 3:
                want.setdefault((r, u, s, f - g), []).append((a, b))
    got = {(r.run_id, r.unit, r.signal, r.lag): (r.r, r.n) for r in df.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        both = np.array([p for p in v if p[0] is not None])
        assert got[k][1] == len(v)
        if k[2] == "c":
            assert got[k][0] is None
        elif len(both) > 2:
            assert abs(got[k][0] - np.corrcoef(both.T)[0, 1]) < 1e-9
    assert "Generate" not in plan_of(df)


def test_membership(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 1), (1, 0, 2), (1, 0, None)], "run_id long, x long, unit long")
    got = {(r.run_id, r.x): (r.a, r.b) for r in X.membership(df, ["run_id", "x"], a=F.col("unit") == 1, b=F.col("unit") == 2).collect()}
    assert got == {(0, 0): (True, True), (0, 1): (True, False), (1, 0): (False, True)}


def test_a_file_for_each_recording(spark, tmp_path):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        write_table(spark.range(4000).selectExpr("id % 4 AS run_id", "id AS v"), str(tmp_path / "t"))
    finally:
        spark.conf.set(name, old)
    assert all(len(glob.glob(str(tmp_path / f"t/run_id={r}/*.parquet"))) == 1 for r in range(4))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000
