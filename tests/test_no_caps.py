"""Loops that end on convergence alone: long chains, many rounds, thick masks, large samples."""

import numpy as np
import pytest

from undulate.operators import cohort as C
from undulate.operators import events as E
from undulate.operators import graph as G
from undulate.operators import voxels as V


def test_family_of_105_hops(spark):
    e = spark.createDataFrame([(1, i, i + 1) for i in range(105)], "run_id long, src long, dst long")
    r = spark.createDataFrame([(1, 0)], "run_id long, node long")
    got = {x.node: x.order for x in G.bfs_levels(e, r, ["run_id"]).collect()}
    assert got == {i: i for i in range(106)}


def test_match_chain_of_100_links(spark):
    # a_i meets b_i and b_i+1, each score below the one before: one pair is free to match per round
    rows = [(1, i, i + d, 1.0 - (2 * i + d) / 1000) for i in range(50) for d in (0, 1)]
    s = spark.createDataFrame(rows, "run_id long, a long, b long, iou double")
    got = {(x.a, x.b) for x in G.mutual_best_matching(s, ["run_id"], "a", "b", "iou").collect()}
    assert got == {(i, i) for i in range(50)}


def test_first_wins_of_a_long_chain(spark):
    n = spark.createDataFrame([(1, i) for i in range(40)], "run_id long, u long")
    c = spark.createDataFrame([(1, i, i + 1) for i in range(39)], "run_id long, a long, b long")
    assert {x.u for x in G.first_wins(n, c, ["run_id"], "u").collect() if x.kept} == set(range(0, 40, 2))


def test_region_of_30_rounds(spark):
    t = np.sin(np.arange(40) / 3)
    rows = [(1, 0, 0, x, [float(v) for v in t * (2 if x else 3) + 0.01 * np.cos(x + np.arange(40))], 9.0 if x == 0 else 1.0) for x in range(32)]
    df = spark.createDataFrame(rows, "run_id long, z long, y long, x long, trace array<double>, score double")
    got = V.grow_regions(df, ["run_id"], "trace", "score", 5.0, 0.9).collect()
    assert {r.x: r.round for r in got} == {x: x for x in range(32)}


def test_depth_of_a_thick_mask(spark):
    rows = [(1, z, y, x) for z in range(3) for y in range(9) for x in range(9)] + [(2, z, y, x) for z in range(-11, 12) for y in range(1) for x in range(2)]
    df = spark.createDataFrame(rows, "run_id long, z long, y long, x long")
    for size in ((1.0, 1.0, 1.0), (5.0, 1.0, 1.5)):
        inside = set(rows)
        got = {(r.run_id, r.z, r.y, r.x): r.depth for r in V.mask_depth(df, ["run_id"], size).collect()}
        assert set(got) == inside
        for (k, z, y, x), d in got.items():
            want = min(np.sqrt(((a) * size[0]) ** 2 + (b * size[1]) ** 2 + (c * size[2]) ** 2)
                       for a in range(-4, 5) for b in range(-6, 7) for c in range(-6, 7) if (k, z + a, y + b, x + c) not in inside)
            assert abs(d - want) < 1e-9


@pytest.mark.parametrize("n_a,n_b", [(5, 20), (3, 4), (9, 12)])
def test_rank_sum_rule(spark, n_a, n_b):
    rng = np.random.default_rng(n_a)
    x = rng.permutation(n_a + n_b).astype(float)
    df = spark.createDataFrame([(1, "a" if i < n_a else "b", float(v)) for i, v in enumerate(x)], "k long, g string, v double")
    u = sum(p > q for p in x[:n_a] for q in x[n_a:])
    ways = {}

    def count(i, left, rank_sum):
        """Arrangements by U, over all choices of n_a ranks."""
        key = (i, left, rank_sum)
        if left == 0:
            return {rank_sum: 1}
        if i > n_a + n_b:
            return {}
        if key not in ways:
            a, b = count(i + 1, left - 1, rank_sum + i), count(i + 1, left, rank_sum)
            ways[key] = {s: a.get(s, 0) + b.get(s, 0) for s in a.keys() | b.keys()}
        return ways[key]

    got = C.mann_whitney(df, ["k"], "g", "a", "b", "v").first()
    assert got.u == u
    normal = C.mann_whitney(df, ["k"], "g", "a", "b", "v", method="normal").first().p
    if min(n_a, n_b) > 8:
        assert got.p == normal
        return
    dist = {s - n_a * (n_a + 1) // 2: w for s, w in count(1, n_a, 0).items()}
    total = sum(dist.values())
    tail = min(sum(w for s, w in dist.items() if s <= u), sum(w for s, w in dist.items() if s >= u))
    assert abs(got.p - min(1, 2 * tail / total)) < 1e-12 and got.p != normal


def test_signed_rank_rule(spark):
    d = [i * (1 if i % 3 else -1) for i in range(1, 31)]
    df = spark.createDataFrame([(1, float(x)) for x in d], "k long, d double")
    c = {0: 1}
    for k in range(1, 31):
        c = {s: c.get(s, 0) + c.get(s - k, 0) for s in c.keys() | {s + k for s in c}}
    w = sum(x for x in d if x > 0)
    tail = min(sum(v for s, v in c.items() if s <= w), sum(v for s, v in c.items() if s >= w))
    assert abs(C.wilcoxon_signed_rank(df, ["k"], "d").first().p - min(1, 2 * tail / 2**30)) < 1e-12
    assert C.wilcoxon_signed_rank(df, ["k"], "d", method="normal").first().p != min(1, 2 * tail / 2**30)


def test_zeta_is_infinite():
    assert abs(np.exp(E._log_zeta(2.0)) - np.pi**2 / 6) < 1e-13
    assert abs(E._log_zeta(1.2) - E._log_zeta(1.2, 300)) < 1e-12


def test_factor_folds_have_the_longer_blocks_first(spark):
    from undulate.operators import ml as L

    assert L.fold_edges(64, 5, longer_first=True) == [0, 13, 26, 39, 52, 64] and L.fold_edges(64, 5) == [0, 12, 25, 38, 51, 64]
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3, 64)).T @ rng.standard_normal((3, 9)) + 0.1 * rng.standard_normal((64, 9))
    packed = spark.createDataFrame([(1, i, [float(v) for v in x[:, i]]) for i in range(9)], "run_id long, unit long, trace array<double>")
    got = {r.unit: r.resid for r in L.cv_residuals(packed, ["run_id"], "unit", "trace", 64, [2], 5).collect()}
    for part in np.array_split(np.arange(64), 5):
        train = np.setdiff1d(np.arange(64), part)
        mu = x[train].mean(0)
        _, _, w = np.linalg.svd(x[train] - mu, full_matrices=False)
        d = x[part] - mu
        want = d - d @ w[:2].T @ w[:2]
        assert np.allclose(np.array([got[i] for i in range(9)]).T[part], want, atol=1e-6)
