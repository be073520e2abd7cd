"""Factors of recordings worked out in a task and of those that go by blocks."""

import math

import numpy as np
import pytest

from undulate.operators import ml as L
from undulate.plans import QUERIES, load_all

load_all()
T = 40


@pytest.fixture(scope="module")
def packed(spark):
    rng, rows = np.random.default_rng(4), []
    for r, n in enumerate((6, 9, 14, 1, 3)):
        x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, T)) + 0.5 * rng.normal(size=(n, T))
        if r == 2:
            x[5] = 0.0
        rows += [(r, u, [float(v) for v in x[u]]) for u in range(n)]
    return spark.createDataFrame(rows, "run_id long, unit long, x array<double>")


def values(df):
    return {(r.run_id, r.k): (r.var_explained, r.mean_abs_r, r.frac_sig, math.nan if r.k_star is None else r.k_star) for r in df.collect()}


def test_kstar_in_a_task(packed, monkeypatch):
    ks = [0, 1, 2, 3, 5, 8, 12, 20]
    whole = L.kstar_factors(packed, packed, ["run_id"], "unit", "x", T, ks, 5, 6, 5)
    got = values(whole)
    want = values(L.kstar(L.cv_residuals(packed, ["run_id"], "unit", "x", T, ks, 5), ["run_id"], "unit", T, 6, 5).filter("mean_abs_r IS NOT NULL"))
    assert {k for r, k in got if r == 0} == {0, 1, 2, 3, 5} and {k for r, k in got if r == 2} == {0, 1, 2, 3, 5, 8, 12}
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(L, "BLOCK", 8)
    blocks = values(L.kstar_factors(packed, packed, ["run_id"], "unit", "x", T, ks, 5, 6, 5))
    for other in (want, blocks):
        assert set(other) == set(got) and all(np.allclose(got[k], other[k], atol=1e-7, equal_nan=True) for k in got)


def test_factors_of_the_query(spark):
    rows = QUERIES["kstar_factors"](spark, "/root/testdata/sf0.001").collect()
    assert {r.k for r in rows} == {0, 1, 2, 3, 4, 5, 8, 12}  # 15 units
