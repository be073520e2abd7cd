"""Models of recordings of one block need no Gram rows from elsewhere; those of several blocks give the same."""

import numpy as np
import pytest

from undulate.operators import ml as L

T = 20


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(3)
    rows = [(r, u, rng.standard_normal(T).tolist()) for r in range(3) for u in range(4 + 3 * r)]
    return spark.createDataFrame(rows, "run_id long, unit long, x array<double>").cache()


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(r, f"s{i}", rng.standard_normal(T).tolist()) for r in range(3) for i in range(2)], "run_id long, name string, series array<double>").cache()


def values(df, keys):
    return {tuple(r[k] for k in keys): np.hstack([r[c] for c in df.columns if c not in keys]) for r in df.collect()}


def test_one_block_or_several(packed, design, monkeypatch):
    def all_three():
        return (values(L.cv_residuals(packed, ["run_id"], "unit", "x", T, [0, 2], 4), ["run_id", "unit", "k"]),
                values(L.encoding_r2(packed, design, ["run_id"], "unit", "x", T, 4), ["run_id", "unit"]),
                values(L.partial_corr_network(packed, ["run_id"], "unit", "x", T, 0.1), ["run_id", "a", "b"]))

    one = all_three()
    assert [len(x) for x in one] == [42, 21, 6 + 21 + 45]
    monkeypatch.setattr(L, "BLOCK", 3)  # runs of 4, 7 and 10 units have 2, 3 and 4 blocks
    for a, b in zip(one, all_three()):
        assert set(a) == set(b) and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_one_block_needs_no_rows(packed, monkeypatch):
    assert L._blocks_and_gram(packed, ["run_id"], "unit", "x", T, folds=4)[2].isEmpty()
    monkeypatch.setattr(L, "BLOCK", 5)
    assert {r.run_id for r in L._blocks_and_gram(packed, ["run_id"], "unit", "x", T, folds=4)[2].select("run_id").distinct().collect()} == {1, 2}


def test_partial_sums_of_few_runs_are_held(spark, packed, monkeypatch):
    whole = values(L.frame_gram(packed, ["run_id"], "x", T, 4), ["run_id", "fold", "i"])
    monkeypatch.setattr(L, "HELD", 1)
    few = values(L.frame_gram(packed, ["run_id"], "x", T, 4), ["run_id", "fold", "i"])
    assert set(whole) == set(few) and all(np.allclose(whole[k], few[k]) for k in whole)
