"""NumPy re-statements of operators that have no SQL form, and invariances."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from undulate.operators import events as E
from undulate.operators import ml as L
from undulate.operators import nulls as U
from undulate.operators import pairs as P
from undulate.operators import ranks as Rk
from undulate.operators import rolling as R
from undulate.operators import voxels as V

RNG = np.random.default_rng(3)
T, N = 40, 12
X = RNG.normal(size=(2, N, T)) + RNG.normal(size=(2, 1, T))


@pytest.fixture(scope="module")
def traces(spark):
    rows = [(r, u, t, float(X[r, u, t])) for r in range(2) for u in range(N) for t in range(T)]
    return spark.createDataFrame(rows, "run_id long, unit long, frame long, v double").cache()


@pytest.fixture(scope="module")
def packed(traces):
    return P.pack(traces, ["run_id", "unit"], "frame", "v", "x")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_ranks_by_bins_equal_sort(spark, values):
    d = spark.createDataFrame([(0, float(v)) for v in values], "k long, v double")
    a = np.sort(np.array(values, float))
    for kw in ({"small": 2, "edges": 3}, {"bounded": True}):
        for r in Rk.ranked_values(d, ["k"], "v", **kw).collect():
            assert r["below"] == (a < r["v"]).sum() and r["c"] == (a == r["v"]).sum() and r["n"] == len(a)
    q = Rk.exact_quantiles(d, ["k"], "v", {"a": 0.1, "b": 0.5, "c1": 0.93}, small=2, edges=3).first()
    assert np.allclose([q["a"], q["b"], q["c1"]], np.quantile(a, [0.1, 0.5, 0.93]))


def test_bh_by_bins(spark):
    p = RNG.integers(1, 400, 300) / 400.0
    d = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(p)], "k long, i long, p double")
    import undulate.operators.ranks as ranks

    old = ranks.ranked_values.__defaults__
    ranks.ranked_values.__defaults__ = (None, False, 10, 5)
    try:
        got = {r["i"]: r["q"] for r in R.bh_qvalue(d, ["k"], "p").collect()}
    finally:
        ranks.ranked_values.__defaults__ = old
    o = np.argsort(p, kind="stable")
    q = np.empty(len(p))
    q[o] = np.minimum.accumulate((p[o] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    assert np.allclose([got[i] for i in range(len(p))], np.minimum(q, 1))


@pytest.mark.parametrize("block", [3, 256])
def test_pair_corr_blocks(traces, block):
    got = {(r["run_id"], r["a"], r["b"]): r["r"] for r in P.pair_corr(traces, ["run_id"], "unit", "frame", "v", block=block).collect()}
    assert len(got) == 2 * N * (N - 1) // 2
    for r in range(2):
        c = np.corrcoef(X[r])
        assert all(abs(got[(r, a, b)] - c[a, b]) < 1e-9 for a in range(N) for b in range(a + 1, N))


@pytest.mark.parametrize("block", [3, 256])
def test_best_lag_is_antisymmetric_in_order(traces, block):
    for r in P.best_lag_corr(traces, ["run_id"], "unit", "frame", "v", 2, block=block).collect():
        x, y = X[r["run_id"], r["a"]], X[r["run_id"], r["b"]]
        c = {s: np.corrcoef(x[s:] if s >= 0 else x[:T + s], y[:T - s] if s >= 0 else y[-s:])[0, 1] for s in range(-2, 3)}
        assert abs(c[r["lag"]] - r["r_best"]) < 1e-9 and abs(r["r_best"]) >= max(abs(v) for v in c.values()) - 1e-8


def test_participation_ratio_and_mean_r(traces):
    pr = {r["run_id"]: r["pr"] for r in P.participation_ratio(traces, ["run_id"], "unit", "frame", "v").collect()}
    mr = {r["run_id"]: r["mean_r"] for r in P.mean_pair_corr(traces, ["run_id"], "unit", "frame", "v").collect()}
    for r in range(2):
        c = np.corrcoef(X[r])
        w = np.linalg.eigvalsh(c)
        assert pr[r] == pytest.approx(w.sum() ** 2 / (w ** 2).sum())
        assert mr[r] == pytest.approx(c[np.triu_indices(N, 1)].mean())


def test_run_pca(packed):
    got = {(r["run_id"], r["pc"]): r for r in L.run_pca(packed, ["run_id"], "x", T, 3).collect()}
    for r in range(2):
        z = (X[r] - X[r].mean(1, keepdims=True)) / X[r].std(1, keepdims=True)
        w = np.sort(np.linalg.eigvalsh(z @ z.T / T))[::-1]
        assert np.allclose([got[(r, p)]["eigenvalue"] for p in (1, 2, 3)], w[:3])


def test_cv_residuals_equal_direct_pca(packed):
    got = {(r["run_id"], r["unit"], r["k"]): np.array(r["resid"]) for r in L.cv_residuals(packed, ["run_id"], "unit", "x", T, [0, 2], 4).collect()}
    e = L.fold_edges(T, 4)
    for r in range(2):
        z = X[r].T
        res = {0: np.zeros_like(z), 2: np.zeros_like(z)}
        for f in range(4):
            te = np.arange(e[f], e[f + 1])
            tr = np.setdiff1d(np.arange(T), te)
            mu = z[tr].mean(0)
            w = np.linalg.svd(z[tr] - mu, full_matrices=False)[2][:2]
            zt = z[te] - mu
            res[0][te], res[2][te] = zt, zt - zt @ w.T @ w
        for k in (0, 2):
            assert np.allclose(np.stack([got[(r, u, k)] for u in range(N)]).T, res[k])


def test_encoding_population_equals_direct_ridge(spark, packed):
    d = [(r, n, [float(v) for v in RNG.normal(size=T)]) for r in range(2) for n in ("a", "b")]
    des = spark.createDataFrame(d, "run_id long, name string, series array<double>")
    got = {(r["run_id"], r["unit"]): r for r in L.encoding_r2(packed, des, ["run_id"], "unit", "x", T, 4, 0.1).collect()}
    e = L.fold_edges(T, 4)
    for r in range(2):
        design = np.array([s for k, _, s in d if k == r])
        for u in (0, 5):
            ss = {"population": 0.0, "both": 0.0, "behavior": 0.0}
            tot = 0.0
            for f in range(4):
                te = np.arange(e[f], e[f + 1])
                tr = np.setdiff1d(np.arange(T), te)
                std = lambda a: (a - a[:, tr].mean(1, keepdims=True)) / a[:, tr].std(1, keepdims=True)
                z, b = std(X[r]), std(design)
                o = np.delete(z, u, 0)
                for name, w in (("population", o), ("both", np.vstack([b, o])), ("behavior", b)):
                    c = np.linalg.solve(w[:, tr] @ w[:, tr].T + 0.1 * len(tr) * np.eye(len(w)), w[:, tr] @ z[u, tr])
                    ss[name] += ((z[u, te] - c @ w[:, te]) ** 2).sum()
                tot += (z[u, te] ** 2).sum()
            for name in ss:
                assert got[(r, u)][f"r2_{name}"] == pytest.approx(1 - ss[name] / tot)


def test_partial_corr_equals_inverse(packed):
    got = {(r["run_id"], r["a"], r["b"]): r["partial_r"] for r in L.partial_corr_network(packed, ["run_id"], "unit", "x", T, 0.1).collect()}
    for r in range(2):
        z = (X[r] - X[r].mean(1, keepdims=True)) / X[r].std(1, keepdims=True)
        p = np.linalg.inv(z @ z.T + 0.1 * T * np.eye(N))
        s = -p / np.sqrt(np.outer(np.diag(p), np.diag(p)))
        assert all(abs(got[(r, a, b)] - s[a, b]) < 1e-8 for a in range(N) for b in range(a + 1, N))


def test_morans_i(spark):
    pts = RNG.normal(size=(20, 3))
    x = RNG.normal(size=20)
    p = spark.createDataFrame([(0, i, *map(float, pts[i])) for i in range(20)], "run_id long, unit long, z double, y double, x double")
    v = spark.createDataFrame([(0, i, float(x[i])) for i in range(20)], "run_id long, unit long, val double")
    got = L.morans_i(p, v, ["run_id"], "unit", ["z", "y", "x"], "val", 10).first()
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    np.fill_diagonal(d, np.inf)
    w = np.exp(-(d ** 2) / (2 * np.median(d.min(1)) ** 2))
    np.fill_diagonal(w, 0)
    xc = x - x.mean()
    assert got["morans_i"] == pytest.approx(20 / w.sum() * (xc @ w @ xc) / (xc @ xc))


def test_pca_shape(spark):
    pts = {tuple(map(int, np.round(p))) for p in RNG.normal(size=(80, 3)) * [2, 9, 4] + 30}
    m = spark.createDataFrame([(0, *p) for p in pts], "k long, z long, y long, x long")
    s = V.pca_shape(m, ["k"], (3.9, 1.0, 1.2)).first()
    a = np.array(sorted(pts)) * [3.9, 1.0, 1.2]
    w, u = np.linalg.eigh(np.cov(a.T, bias=True))
    assert np.allclose([s["w0"], s["w1"], s["w2"]], w[::-1])
    ax = u[:, 2] * np.sign(u[1, 2])
    assert np.allclose([s["az"], s["ay"], s["ax"]], ax, atol=1e-6)
    t = (a - a.mean(0)) @ ax
    assert s["length"] == pytest.approx(t.max() - t.min())


def _bfs(points, conn):
    left, out = set(points), []
    steps = [o[:3] for o in V.neighbours(conn) if o[:3] != (0, 0, 0)]
    while left:
        todo = [left.pop()]
        comp = set(todo)
        while todo:
            p = todo.pop()
            for o in steps:
                q = tuple(a + b for a, b in zip(p, o))
                if q in left:
                    left.remove(q)
                    comp.add(q)
                    todo.append(q)
        out.append(comp)
    return sorted(map(sorted, out))


@pytest.mark.parametrize("conn", [6, 26])
def test_components_equal_bfs(spark, conn):
    pts = {tuple(map(int, p)) for p in RNG.integers(0, 7, (110, 3))}
    m = spark.createDataFrame([(0, *p) for p in pts], "k long, z long, y long, x long")
    got = {}
    for r in V.connected_voxels(m, ["k"], conn).collect():
        got.setdefault(r["component"], []).append((r["z"], r["y"], r["x"]))
    assert sorted(map(sorted, got.values())) == _bfs(pts, conn)


def test_fill_holes_random(spark):
    pts = {tuple(map(int, p)) for p in RNG.integers(0, 6, (330, 3))}
    m = spark.createDataFrame([(0, *p) for p in pts], "k long, z long, y long, x long")
    lo, hi = np.min(list(pts), 0), np.max(list(pts), 0)
    box = {(z, y, x) for z in range(lo[0] - 1, hi[0] + 2) for y in range(lo[1] - 1, hi[1] + 2) for x in range(lo[2] - 1, hi[2] + 2)}
    outside = next(set(c) for c in _bfs(box - pts, 6) if tuple(lo - 1) in set(c))
    want = sorted(box - outside)
    got = sorted((r["z"], r["y"], r["x"]) for r in V.fill_holes(m, ["k"]).collect())
    assert got == [tuple(map(int, p)) for p in want]


def test_dilate_erode_containment(spark):
    pts = {tuple(map(int, p)) for p in RNG.integers(0, 6, (120, 3))}
    m = spark.createDataFrame([(0, *p) for p in pts], "k long, z long, y long, x long")
    key = lambda d: {(r["z"], r["y"], r["x"]) for r in d.collect()}
    b = V.ball(1)
    assert key(V.opening(m, ["k"], b)) <= pts <= key(V.closing(m, ["k"], b))


def test_split_seeds_spacing(spark):
    pts = [(0, y, x) for y in range(5) for x in range(24)]
    m = spark.createDataFrame([(0, *p) for p in pts], "k long, z long, y long, x long")
    s = V.split_by_seeds(m, ["k"], 4.0)
    assert s.count() == len(pts)
    seeds = [r["part"] for r in s.select("part").distinct().collect()]
    xy = [((v >> 21) & ((1 << 21) - 1), v & ((1 << 21) - 1)) for v in seeds]
    assert all(np.hypot(a[0] - b[0], a[1] - b[1]) > 4 for i, a in enumerate(xy) for b in xy[:i])


def test_remove_pc0(spark):
    u, t = RNG.normal(size=8), RNG.normal(size=30)
    x = 5 * np.outer(u, t - t.mean()) + 0.1 * RNG.normal(size=(8, 30))
    d = spark.createDataFrame([(0, i, x[i].tolist()) for i in range(8)], "run_id long, unit long, v array<double>")
    got = np.zeros_like(x)
    for r in V.remove_pc0(d, ["run_id"], "v", 30).collect():
        got[r["unit"]] = r["clean"]
    xc = x - x.mean(1, keepdims=True)
    a, s, b = np.linalg.svd(xc, full_matrices=False)
    assert np.allclose(got, x - s[0] * np.outer(a[:, 0], b[0]), atol=1e-6)


def test_activity_volume_peaks_where_signal_is(spark):
    v = RNG.normal(size=(1, 6, 6, 40)) * 0.05 + 1
    v[0, 3, 3, 20:24] += 2
    rows = [(0, 0, y, x, t, float(v[0, y, x, t])) for y in range(6) for x in range(6) for t in range(40)]
    d = spark.createDataFrame(rows, "run_id long, z long, y long, x long, t long, v double")
    a = V.activity_volume(d, ["run_id"], "t", "v", 40, (1, 6, 6), space=(0, 0.5, 0.5), wide=(0, 1.5, 1.5))
    top = a.orderBy(F.desc("z_act")).first()
    assert (top["y"], top["x"]) == (3, 3) and 20 <= top["t"] < 24


def test_surrogates_keep_counts(spark):
    ev = spark.createDataFrame([(0, int(t)) for t in sorted(RNG.choice(100, 20, False))], "k long, frame long")
    s = U.iei_shuffle_null(ev, ["k"], "frame", 5)
    first, last = ev.agg(F.min("frame"), F.max("frame")).first()
    g = s.groupBy("rep").agg(F.count("frame").alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b")).collect()
    assert all((r["n"], r["a"], r["b"]) == (20, first, last) for r in g)
    j = U.jitter_null(ev, "frame", 3, 100, ["k", "frame"], 4)
    assert j.count() == 80 and j.filter("frame < 0 OR frame >= 100").isEmpty()
    n = ev.groupBy("k").agg(F.count("frame").alias("n"))
    r = [x["frame"] for x in U.random_events(n, ["k"], "n", 100, 4, 1).orderBy("frame").collect()]
    assert len(r) == 20 and min(np.diff(r)) >= 4


def test_footprint_recurrence(spark):
    sets = [(0, e, u) for e, s in enumerate(([1, 2], [1, 2], [2, 3], [7])) for u in s]
    f = spark.createDataFrame(sets, "run_id long, f_start long, unit long")
    r = E.footprint_recurrence(f, ["run_id"], "unit").first()
    assert r["n_events"] == 4 and r["recurrence"] == pytest.approx(3 / 6)


def test_greedy_spacing_equals_loop(spark):
    v = RNG.permutation(60).astype(float)
    d = spark.createDataFrame([(0, t, float(x)) for t, x in enumerate(v)], "k long, t long, v double")
    kept = []
    for t in np.argsort(-v):
        if all(abs(t - k) >= 5 for k in kept):
            kept.append(int(t))
    got = sorted(r["t"] for r in R.spaced_by_score(d, ["k"], "t", "v", 5).collect())
    assert got == sorted(kept)
    assert sorted(r["t"] for r in R.spaced_by_score(d, ["k"], "t", "v", 5, k=3).collect()) == sorted(kept[:3])


def test_partition_count_invariance(spark, traces):
    a = {(r["run_id"], r["unit"], r["frame"]): r["med"] for r in R.rolling_median(traces.repartition(1), ["run_id", "unit"], "frame", "v", 3).collect()}
    b = {(r["run_id"], r["unit"], r["frame"]): r["med"] for r in R.rolling_median(traces.repartition(8), ["run_id", "unit"], "frame", "v", 3, chunk=16).collect()}
    assert a == b
