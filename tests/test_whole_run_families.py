"""Units of runs that a task works out whole against brute force and against the way in rounds."""

import random
from collections import deque

import numpy as np
import pytest

from undulate.operators import reports as B
from undulate.operators import voxels as V

SIZE = (3.9, 1.0, 1.2)


def made(names=int):
    rnd = random.Random(9)
    return sorted({(r, names(u), rnd.randrange(-2, 20), rnd.randrange(55, 75), rnd.randrange(-3, 20)) for r in range(3) for u in range(25) for _ in range(3 + u % 3)})


def nearest(rows):
    d = {}
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] < q[1]:
                k = p[0], p[1], q[1]
                d[k] = min(d.get(k, 1e9), sum(((a - b) * s) ** 2 for a, b, s in zip(p[2:], q[2:], SIZE)) ** 0.5)
    return d


def families(units, pairs):
    """(component, hops from the unit of greatest mean y) of each unit."""
    near = {u: set() for u in units}
    for r, a, b in pairs:
        near[r, a].add((r, b)), near[r, b].add((r, a))
    out = {}
    for s in sorted(units):
        if s in out:
            continue
        comp, todo = {s}, deque([s])
        while todo:
            for v in near[todo.popleft()] - comp:
                comp.add(v), todo.append(v)
        root = min(comp, key=lambda u: (-units[u], u))
        hops, todo = {root: 0}, deque([root])
        while todo:
            u = todo.popleft()
            for v in near[u] - set(hops):
                hops[v] = hops[u] + 1
                todo.append(v)
        out |= {u: (s[1], root[1], hops[u], len(comp)) for u in comp}
    return out


@pytest.mark.parametrize("names", [int, lambda u: f"u{u:02d}"])
@pytest.mark.parametrize("whole", [1 << 14, 90, 0])
def test_families_and_sweep(spark, monkeypatch, names, whole):
    rows, radii = made(names), [2.0, 4.0, 6.0]
    monkeypatch.setattr(V, "WHOLE", whole)
    kind = "long" if names is int else "string"
    df = spark.createDataFrame(rows + rows[:40], f"run_id long, unit {kind}, z long, y long, x long")
    units = {k: np.mean([p[3] for p in rows if p[:2] == k]) for k in {p[:2] for p in rows}}
    d = nearest(rows)
    want = {u: w[:3] for u, w in families(units, [k for k in d if d[k] <= 4 + 1e-9]).items()}
    out = V.unit_families(df, ["run_id"], "unit", 4.0, SIZE)
    assert {(r.run_id, r.unit): (r.component, r.root, r.order) for r in out.collect()} == want
    got = {r.radius: (r.n_units, r.largest, r.rho) for r in B.adjacency_sweep(df, None, ["run_id"], "unit", radii, SIZE).collect()}
    for radius in radii:
        f = families(units, [k for k in d if d[k] <= radius + 1e-9])
        size, rate = ([v for _, v in sorted(x.items())] for x in ({u: w[3] for u, w in f.items()}, {u: sum(p[:2] == u for p in rows) for u in units}))
        rank = lambda v: np.array([(sum(np.array(v) < x) + sum(np.array(v) <= x) + 1) / 2 for x in v])
        assert got[radius][:2] == (len(units), max(size))
        assert abs(got[radius][2] - np.corrcoef(rank(size), rank(rate))[0, 1]) < 1e-9
    if whole == 1 << 14:
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_rates_of_a_table(spark):
    rows = made()
    df = spark.createDataFrame(rows, "run_id long, unit long, z long, y long, x long")
    rates = df.groupBy("run_id", "unit").count().selectExpr("run_id", "unit", "CAST(count AS DOUBLE) AS rate")
    a, b = ([(r.radius, r.n_units, r.largest, round(r.rho, 9)) for r in B.adjacency_sweep(df, x, ["run_id"], "unit", [3.0], SIZE).collect()] for x in (None, rates))
    assert a == b
