"""Flooding against Kruskal's rule over all voxel edges, with tiles that parts cross."""

import random

import pytest

from undulate.operators import flooding as L
from undulate.operators import intervals as I
from undulate.operators import voxels as V

SCHEMA = "k string, z long, y long, x long, depth double"


def node(z, y, x):
    return (z << 42) + (y << 21) + x


def kruskal(depth, seeds, conn):
    """Seed of each voxel: edges from the deepest down, joined unless both sides have a seed."""
    half = [o[:3] for o in V.neighbours(conn) if o[:3] > (0, 0, 0)]
    edges = []
    for p, d in depth.items():
        for o in half:
            q = (p[0], *(a + b for a, b in zip(p[1:], o)))
            if q in depth:
                edges.append((-min(d, depth[q]), node(*p[1:]), node(*q[1:]), p, q))
    part = {p: p for p in depth}
    root = {p: seeds.get(p) for p in depth}
    for _, _, _, p, q in sorted(edges, key=lambda e: (e[3][0], *e[:3])):
        a, b = part[p], part[q]
        if a == b or (root[a] is not None and root[b] is not None):
            continue
        root[a] = root[a] if root[a] is not None else root[b]
        for r in [r for r, c in part.items() if c == b]:
            part[r] = a
    return {p: root[c] for p, c in part.items()}


@pytest.mark.parametrize("tile", [(16, 64), (2, 3), (1, 1)])
@pytest.mark.parametrize("conn", [6, 26])
def test_flooding_is_kruskals_forest(spark, monkeypatch, tile, conn):
    monkeypatch.setattr(I, "TILE", tile)
    monkeypatch.setattr(L, "TILE", tile)
    rnd = random.Random(conn)
    cells = {("ab"[rnd.randrange(2)], rnd.randrange(-1, 4), rnd.randrange(6), rnd.randrange(7)) for _ in range(230)}
    depth = {p: float(rnd.randrange(1, 5)) for p in cells}
    seeds = {p: node(*p[1:]) if p[1] >= 0 else 10**9 + i for i, p in enumerate(rnd.sample(sorted(cells), 9))}
    v = spark.createDataFrame([(*p, d) for p, d in depth.items()], SCHEMA)
    s = spark.createDataFrame([(*p, i) for p, i in seeds.items()], "k string, z long, y long, x long, seed long")
    got = {(r.k, r.z, r.y, r.x): r.part for r in L.flood(v, s, ["k"], conn=conn).collect()}
    assert got == kruskal(depth, seeds, conn)


@pytest.mark.parametrize("tile", [(16, 64), (2, 3)])
def test_peaks(spark, monkeypatch, tile):
    monkeypatch.setattr(I, "TILE", tile)
    rnd = random.Random(3)
    cells = {("a", rnd.randrange(4), rnd.randrange(8), rnd.randrange(9)): float(rnd.randrange(4)) for _ in range(150)}
    v = spark.createDataFrame([(*p, d) for p, d in cells.items()], SCHEMA)
    offs = V.ball(2.3, (1.5, 1.0, 1.0))
    key = lambda p: (cells[p], -node(*p[1:]))
    want = {p for p in cells if all(q not in cells or key(q) <= key(p) for o in offs for q in [(p[0], *(a + b for a, b in zip(p[1:], o)))])}
    assert {(r.k, r.z, r.y, r.x) for r in L.peaks(v, ["k"], "depth", offs).collect()} == want


def test_a_bay_goes_to_the_pool_that_it_opens_to(spark):
    """A wide and a narrow pool side by side; a bay of the wide one lies nearer to the narrow one's seed."""
    wide = {(0, y, x) for y in range(11) for x in range(11)}
    narrow = {(0, y, x) for y in range(14, 19) for x in range(9, 14)}
    bay = {(0, y, 8) for y in range(11, 17)}
    cells = wide | narrow | bay | {(0, 12, 9), (0, 13, 9), (0, 13, 10)} - {(0, 12, 9), (0, 13, 9), (0, 13, 10)}
    df = spark.createDataFrame([("r", *p) for p in cells], "k string, z long, y long, x long")
    near = {(r.z, r.y, r.x): r.part for r in V.split_by_seeds(df, ["k"], 4.0, (9.0, 1.0, 1.0)).collect()}
    flooded = {(r.z, r.y, r.x): r.part for r in V.split_by_flooding(df, ["k"], 4.0, (9.0, 1.0, 1.0)).collect()}
    assert set(near) == set(flooded) == cells and None not in flooded.values()
    assert near != flooded


def test_voxels_without_a_seed(spark):
    v = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 0, 0, 1, 2.0), ("a", 0, 0, 9, 1.0), ("b", 0, 0, 0, 1.0)], SCHEMA)
    s = spark.createDataFrame([("a", 0, 0, 0, 7)], "k string, z long, y long, x long, seed long")
    got = {(r.k, r.x): r.part for r in L.flood(v, s, ["k"]).collect()}
    assert got == {("a", 0): 7, ("a", 1): 7, ("a", 9): None, ("b", 0): None}
    assert L.flood(v.limit(0), s, ["k"]).count() == 0
