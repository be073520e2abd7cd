"""Windows wider than a chunk: a row goes to few chunks, and results stay."""

import random

from pyspark.sql import functions as F

from undulate.operators import rolling as R
from undulate.operators import segments as S


def test_few_copies_of_a_row(spark):
    rnd = random.Random(5)
    rows = sorted({(k, rnd.randrange(-40_000, 40_000)) for k in range(2) for _ in range(300)})
    df = spark.createDataFrame(rows, "k long, t long")
    out = S.sliding(df, ["k"], "t", 3000, 2000, {"n": lambda w: F.count("*").over(w)}, 16)
    got = {(r.k, r.t): r.n for r in out.collect()}
    assert got == {(k, t): sum(a == k and t - 3000 <= b <= t + 2000 for a, b in rows) for k, t in rows}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "5000" in plan.split("Window")[-1] and "/ 16" not in plan


def test_longest_block_over_wide_gaps(spark):
    rows = [(0, 0), (0, 9_000_000), (0, 18_000_000), (0, 40_000_000), (0, 45_000_000), (1, -7)]
    df = spark.createDataFrame(rows, "k long, ms long")
    got = sorted(tuple(r) for r in R.longest_block(df, ["k"], "ms", 10_800_000).collect())
    assert got == [(0, 0, 18_000_000, 3), (1, -7, -7, 1)]
