"""Vector operators against brute force."""

from collections import Counter

import numpy as np
from undulate.llm.op4_nn_descent import audited, near_duplicates
from undulate.llm.op5_block_search import nearest, products, rounded, search
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def rows(n=400, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n, d))
    out = [(int(i), [float(x) for x in np.float32(c)], int(i % 3), 1, "x") for i, c in enumerate(centre)]
    for j in range(60):  # near copies, of which one group is large
        c = centre[j % 7 if j < 40 else 0] + rng.standard_normal(d) * 0.08
        out.append((1000 + j, [float(x) for x in np.float32(c)], 1, 1, "x"))
    out += [(2000 + j, out[5][1], 1, 1, "x") for j in range(30)]
    out += [(3000, None, 1, 1, None), (3001, [0.0] * d, 1, 1, ""), (3002, [1.0, None] + [0.0] * (d - 2), None, 1, ""), (3003, [float("nan")] + [1.0] * (d - 1), 1, 1, ""),
            (3004, [float("inf")] + [1.0] * (d - 1), 1, 1, ""), (3100, [1.0, 2.0, 3.0], 1, 1, ""), (3200, [1.0, 2.0, 3.0], 1, 1, ""), (3300, [3.0, -1.0, 0.5], 1, 1, ""),
            (None, out[5][1], 1, 1, ""), out[5], out[100], (3400, [float(x) * 2 for x in out[5][1]], 1, 1, "")]
    return out


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_search(spark):
    data = rows()
    part = [(i, np.array(v, np.float64)) for i, v, *_ in data if i is not None and usable(v)]
    want = {}
    for q, x in part:
        if q % 100 == 0:
            d = want.setdefault(q, {})
            for i, y in part:
                if i != q and len(x) == len(y):
                    d[i] = min(d.get(i, np.inf), float(np.sqrt(((x - y) ** 2).sum())))
    want = Counter((q, r + 1, i, s) for q, d in want.items() for r, (s, i) in enumerate(sorted((s, i) for i, s in d.items())[:10]))
    df = spark.createDataFrame(data, SCHEMA)
    for blocks in ({}, {"query_block": 3, "block": 50}):
        assert Counter(map(tuple, search(df, F.col("id") % 100 == 0, **blocks).collect())) == want
    assert search(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_tiles():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-127, 128, (5, 3000)).astype(np.int8), rng.integers(-127, 128, (7, 3000)).astype(np.int8)
    assert (products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    x, y = rng.standard_normal((40, 9)), rng.standard_normal((500, 9)) * 1e-3
    q, s, e = rounded(y)
    assert np.allclose(np.linalg.norm(y - q * s[:, None], axis=1), e) and q.dtype == np.int8
    got = nearest(np.arange(40), x, np.arange(100, 600), y, 5, tile=(16, 64))
    for i in range(40):
        d = np.sqrt(((x[i] - y) ** 2).sum(axis=1))
        assert {c - 100 for qq, c, _ in got if qq == i} == set(np.argsort(d)[:5].tolist())


def test_near_duplicates(spark):
    data = rows()
    part = [(i, np.array(v, np.float64)) for i, v, *_ in data if i is not None and usable(v)]
    n = len(part)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and len(part[i][1]) == len(part[j][1]):
                x, y = part[i][1], part[j][1]
                near[i, j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9
    up = list(range(n))
    for i, j in np.argwhere(near):
        a, b = up[i], up[j]
        up = [min(a, b) if u in (a, b) else u for u in up]
    least = {}
    for (i, _), u in zip(part, up):
        least[u] = min(i, least.get(u, i))
    want = Counter((i, int(near[k].sum()), least[u], i == least[u]) for k, ((i, _), u) in enumerate(zip(part, up)))
    want += Counter((i, 0, i, i is not None) for i, v, *_ in data if i is None or not usable(v))
    got = Counter(map(tuple, near_duplicates(spark.createDataFrame(data, SCHEMA), k=5).collect()))
    assert got == want
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tight_groups_that_link_across_join(spark):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a, w = unit(rng.standard_normal((2, 64)))
    w = unit(w - (w @ a) * a)
    groups = [c + unit(rng.standard_normal((20, 64))) * 0.08 for c in (a, 0.94 * a + np.sqrt(1 - 0.94**2) * w)]
    inside, across = [unit(x) @ unit(x).T for x in groups], unit(groups[0]) @ unit(groups[1]).T
    assert min(x.min() for x in inside) > across.max() and across.min() >= 0.9
    x = np.concatenate([*groups, rng.standard_normal((500, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.component_id, r.n_links) for r in near_duplicates(df, recall=0.0).collect()}
    assert [got[i] for i in range(40)] == [(0, 39)] * 40
    assert all(got[i] == (i, 0) for i in range(40, 540))


def test_audit_counts_nodes_and_not_links(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((61, 64)))
    x = np.concatenate([x[:60], unit(x[:60] + unit(rng.standard_normal((60, 64))) * 0.2), unit(x[60] + unit(rng.standard_normal((700, 64))) * 0.05)])
    classes = spark.createDataFrame([(i, 64, 1, v.tolist()) for i, v in enumerate(x)], "node long, dim int, copies long, v array<double>")
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert (links[:120] == 1).all() and (links[120:] == 699).all()
    for lost, share in ((0, 1.0), (6, 0.9)):  # pairs of which nothing was found
        found = [(i, int(n)) for i, n in enumerate(links) if i >= 120 or i % 60 >= lost]
        assert abs(audited(classes, spark.createDataFrame(found, "node long, links long"), 0.9) - share) < 1e-9
