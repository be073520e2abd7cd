"""Permutations worked out in tasks are those of the column function; no replicate is a row of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undulate.functions.scalar import mixed, mixed_values, mixing, permuted, permuted_values
from undulate.operators import events as E


def test_same_permutations_in_a_task(spark):
    for n in (1, 2, 7, 64):
        seeds = [0, 5, 123456789, 2_147_483_646]
        df = spark.createDataFrame([(s, i) for s in seeds for i in range(n)], "s long, i long")
        got = {(r.s, r.i): r.x for r in df.select("s", "i", permuted(F.col("i"), F.lit(n), F.col("s")).alias("x")).collect()}
        own = permuted_values(n, np.array(seeds))
        assert all(own[k, i] == got[s, i] for k, s in enumerate(seeds) for i in range(n))
    df = spark.createDataFrame([(-4, "a", k) for k in range(9)], "r long, e string, rep long")
    for r in df.select("rep", mixing(df, "r", "e").alias("h"), mixed(df, "r", "e", "rep").alias("m")).collect():
        assert mixed_values(np.array([r.h]), np.array([r.rep]))[0] == r.m


@pytest.mark.parametrize("parted, batch", [(1024, 10_000), (2, 3)])
def test_sums_over_parts_and_batches(spark, monkeypatch, parted, batch):
    rows = [(r, e, f"u{u}", float((u * 7 + e * e * 5 + u * e * 3 + r) % 11)) for r in range(3) for e in range(7 + r) for u in range(5 + r)]
    df = spark.createDataFrame(rows, "run_id long, ev long, unit string, lat double")
    want = {}
    for r in E.order_ranks(df, ["run_id"], "ev", "unit", "lat", 3, 0.5, 5).collect():
        want.setdefault((r.run_id, r.ev), []).append((r.unit, r._rank))
    null = {}
    seeds = spark.createDataFrame(list(want), "run_id long, ev long")
    for s in seeds.select("run_id", "ev", mixing(seeds, "run_id", "ev").alias("h")).collect():
        ranks = np.array([x for _, x in sorted(want[s.run_id, s.ev])])
        image = permuted_values(len(ranks), mixed_values(np.full(20, s.h), np.arange(20)))
        null[s.run_id] = null.get(s.run_id, 0) + ranks[image]
    monkeypatch.setattr(E, "PARTED", parted)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out = E.leader_order_p(df, ["run_id"], "ev", "unit", "lat", 20)
        got = {r.run_id: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert set(got) == {0, 1, 2} and "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    for k, r in got.items():
        w = 12 * null[k].var(axis=1) * r.n / (r.m**2 * (r.n**3 - r.n))
        assert r.p == (1 + (w.round(9) >= round(r.w, 9)).sum()) / 21


def test_recruitment_replicates_are_no_rows(spark):
    rows = [(0, e, u, float((u * 5 + e * 3) % 7), 10.0 * u) for e in range(5) for u in range(6)]
    df = E.recruitment_p(spark.createDataFrame(rows, "run_id long, ev long, unit long, t double, depth double"), ["run_id"], "ev", "unit", "t", "depth", 9)
    assert len(df.collect()) == 1 and "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
