"""Runs, tiles, labels and distances against brute force over voxel sets, with tiles small enough that masks cross them."""

import itertools
import random

import numpy as np
import pytest

from undulate.operators import distance as D
from undulate.operators import intervals as I
from undulate.operators import voxels as V
from undulate.operators.blocks import components, whole_groups

SCHEMA = "run_id string, unit string, z long, y long, x long"


def masks(spark, seed, n=90, box=(6, 9, 11), units=3):
    """Units of two runs on one grid, with repeated voxels; negative coordinates occur."""
    rnd = random.Random(seed)
    rows = [(f"r{r}", f"u{u}", rnd.randrange(-2, box[0]), rnd.randrange(-3, box[1]), rnd.randrange(-1, box[2])) for r in range(2) for u in range(units) for _ in range(n * (u + 1))]
    return spark.createDataFrame(rows + rows[:20], SCHEMA), set(rows)


@pytest.fixture(params=[(16, 64), (2, 3)])
def tile(request, monkeypatch):
    monkeypatch.setattr(I, "TILE", request.param)
    return request.param


def moved(vox, offs, sign=1):
    return {(r, u, z + sign * a, y + sign * b, x + sign * c) for r, u, z, y, x in vox for a, b, c, *_ in offs}


def tuples(df, *cols):
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_dilate_erode_open_close(spark, tile):
    df, vox = masks(spark, 1)
    keys = ["run_id", "unit"]
    for offs in (V.ball(2), V.neighbours(6), [(0, 0, -2, 0.0), (0, 0, 2, 0.0), (1, 0, 0, 0.0)]):
        ero = lambda s: {p for p in {q for q in moved(s, offs, -1)} if moved({p}, offs) <= s}
        assert tuples(V.dilate(df, keys, offs), *SCHEMA.replace(",", "").split()[::2]) == moved(vox, offs)
        assert tuples(V.erode(df, keys, offs), *keys, "z", "y", "x") == ero(vox)
    offs = V.neighbours(6)
    assert tuples(V.closing(df, keys, offs), *keys, "z", "y", "x") == {p for p in moved(vox, offs) if moved({p}, offs) <= moved(vox, offs)}
    assert tuples(V.opening(df, keys, offs), *keys, "z", "y", "x") == moved(ero(vox), offs)
    inside = {p for p in moved(vox, offs) if 0 <= p[2] < 4 and 0 <= p[3] < 5 and 0 <= p[4] < 6}
    assert tuples(V.dilate(df, keys, offs, (4, 5, 6)), *keys, "z", "y", "x") == inside


def test_core_and_shell(spark, tile):
    df, vox = masks(spark, 2, n=25, box=(9, 14, 15))
    one, three, two = V.ball(1), V.ball(3), V.ball(2)
    core = {p for p in vox if moved({p}, one) <= vox}
    alone = {p for p in vox if p[:2] not in {q[:2] for q in core}}
    taken = {(p[0], *p[2:]) for p in vox}
    ring = {p for p in moved(vox, three) - moved(vox, two) if (p[0], *p[2:]) not in taken}
    ring = {p for p in ring if 0 <= p[2] < 9 and 0 <= p[3] < 14 and 0 <= p[4] < 15}
    got = V.core_shell_regions(df, ["run_id"], "unit", (9, 14, 15))
    want = {(*p[:2], "core", *p[2:]) for p in core | alone} | {(*p[:2], "shell", *p[2:]) for p in ring}
    assert {tuple(r) for r in got.select("run_id", "unit", "region", "z", "y", "x").collect()} == want


@pytest.mark.parametrize("conn,planar", [(6, False), (26, False), (26, True)])
def test_components(spark, tile, conn, planar):
    df, vox = masks(spark, 3, n=60)
    near = [o[:3] for o in V.neighbours(conn) if o[:3] != (0, 0, 0) and not (planar and o[0])]
    first = {}
    for p in sorted(vox):
        if p in first:
            continue
        todo, first[p] = [p], p
        while todo:
            r, u, z, y, x = todo.pop()
            for a, b, c in near:
                q = (r, u, z + a, y + b, x + c)
                if q in vox and q not in first:
                    first[q] = p
                    todo.append(q)
    got = V.connected_voxels(df, ["run_id", "unit"], conn, planar).collect()
    assert len(got) == len(vox)
    label = {}
    for r in got:
        root = first[r.run_id, r.unit, r.z, r.y, r.x]
        assert label.setdefault(root, r.component) == r.component
    assert len(set(zip((k[:2] + ((k[2],) if planar else ()) for k in label), label.values()))) == len(label)


def test_a_key_of_one_tile_needs_no_checkpoint(spark, monkeypatch):
    df, _ = masks(spark, 4)
    df = df.filter("z >= 0 AND y >= 0")
    seen = []
    real = I.cut_lineage
    monkeypatch.setattr(I, "cut_lineage", lambda d: seen.append(real(d)) or seen[-1])
    I.run_components(df, ["run_id", "unit"]).collect()
    assert [d.count() for d in seen] == [0]  # only the keys with several tiles are written, and there are none


@pytest.mark.parametrize("size", [(1.0, 1.0, 1.0), (3.9, 1.0, 1.2)])
def test_depths_and_reach(spark, tile, size):
    df, vox = masks(spark, 5, n=220, box=(6, 8, 8), units=2)
    far = lambda p, q: sum(((a - b) * s) ** 2 for a, b, s in zip(p, q, size))
    groups = {}
    for p in vox:
        groups.setdefault(p[:2], set()).add(p[2:])
    box = list(itertools.product(range(-4, 9), range(-5, 12), range(-3, 14)))
    for r in V.mask_depth(df, ["run_id", "unit"], size).collect():
        own = groups[r.run_id, r.unit]
        assert abs(r.depth**2 - min(far((r.z, r.y, r.x), q) for q in box if q not in own)) < 1e-9
    for radius, grid in ((2.5, None), (4.0, (6, 8, 8))):
        got = {tuple(r)[:5]: r.dist for r in D.reached(df, ["run_id", "unit"], radius, size, grid).select("run_id", "unit", "z", "y", "x", "dist").collect()}
        want = {}
        for k, own in groups.items():
            for p in box if grid is None else itertools.product(*map(range, grid)):
                d = min(far(p, q) for q in own) ** 0.5
                if d <= radius + 1e-9:
                    want[(*k, *p)] = d
        if grid is None:
            want = {k: v for k, v in want.items()}
            assert set(want) <= set(got)
            got = {k: v for k, v in got.items() if k in want}
        assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_envelope_of_long_columns():
    rng = np.random.default_rng(1)
    n = np.array([1, 2, 7, 400, 33])
    p = np.concatenate([np.sort(rng.choice(1000, k, replace=False)) for k in n])
    f = rng.random(len(p)) * rng.choice([0, 10, 5000], len(p))
    stretch = np.repeat(np.arange(5), 500)
    t = np.tile(np.arange(-20, 980, 2), 5)
    got = D.least(n, p, f, 1.44, stretch, t)
    ends = np.cumsum(n)
    for i in range(0, len(t), 7):
        own = slice(ends[stretch[i]] - n[stretch[i]], ends[stretch[i]])
        assert abs(got[i] - (f[own] + 1.44 * (t[i] - p[own]) ** 2).min()) < 1e-9


def test_groups_are_never_cut():
    import pyarrow as pa

    keys = np.repeat(np.arange(9), [1, 50, 3, 3, 200, 1, 1, 7, 2])
    batches = pa.table({"k": [str(k) for k in keys], "v": np.arange(len(keys))}).to_batches(max_chunksize=11)
    out = list(whole_groups(iter(batches), ["k"], rows=20))
    assert sum(t.num_rows for t in out) == len(keys)
    seen = [set(t.column("k").to_pylist()) for t in out]
    assert sum(map(len, seen)) == 9
    assert components(6, np.array([0, 1, 5]), np.array([1, 4, 3])).tolist() == [0, 0, 2, 3, 0, 3]


def test_empty_masks(spark):
    df = spark.createDataFrame([], SCHEMA)
    keys = ["run_id", "unit"]
    assert V.dilate(df, keys, V.ball(1)).count() == V.erode(df, keys, V.ball(1)).count() == V.connected_voxels(df, keys).count() == V.mask_depth(df, keys).count() == 0
    assert V.core_shell_regions(df, ["run_id"], "unit").count() == D.reached(df, keys, 2.0).count() == 0
