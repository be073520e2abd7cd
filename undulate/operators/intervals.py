"""Masks as runs: rows (z, y) of intervals along x, moved, merged and labelled tile by tile.

A tile is a block of ``TILE`` (z, y) rows of one key. Voxels or runs are shuffled once to their tile, and to tiles
that their offsets reach; in a task all tiles that fit into one Arrow table are worked on together with sorted arrays, so
the data moved are voxels (or runs), not voxels times offsets. A tile is bounded by the extents of the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from copy import copy

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undulate.operators.blocks import codes, components, group_starts, ragged, starts, whole_groups, with_columns
from undulate.operators.graph import connected_components
from undulate.session import cut_lineage

#: Planes and grid rows of a tile.
TILE = (16, 64)
Steps = list[tuple[int, int, int, int]]


#: Rows of a table of shells: each goes to every step of the outer offsets.
SHELL_ROWS = 1 << 15


#: Moved runs that are merged at a time.
MOVED = 1 << 21


def current_tile() -> tuple[int, int]:
    return TILE


def node_id(z: Column, y: Column, x: Column) -> Column:
    return F.shiftleft(z.cast("long"), 42) + F.shiftleft(y.cast("long"), 21) + x.cast("long")


def steps_of(offs) -> Steps:
    """Offsets (dz, dy, dx, …) as (dz, dy, first dx, last dx), an entry for each stretch along x."""
    rows: dict[tuple[int, int], list[int]] = {}
    for dz, dy, dx, *_ in offs:
        rows.setdefault((dz, dy), []).append(dx)
    out = []
    for (dz, dy), xs in sorted(rows.items()):
        xs = np.unique(xs)
        cut = np.flatnonzero(np.diff(xs) > 1)
        out += [(dz, dy, int(xs[i]), int(xs[j])) for i, j in zip(np.r_[0, cut + 1], np.r_[cut, len(xs) - 1])]
    return out


# ---- rows of intervals in a task -----------------------------------------------------------


class Rows:
    """Disjoint ascending intervals [a, b] of numbered grid rows; row r is (group, z, y) = (g[r], z[r], y[r])."""

    def __init__(self, g: np.ndarray, z: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Union of any intervals (z and y are counted from the tile's first row, less its margin)."""
        self.nz, self.ny = (int(z.max()) + 2, int(y.max()) + 2) if len(z) else (1, 1)
        row = (g * self.nz + z) * self.ny + y
        self.low = int(a.min()) - 2 if len(a) else 0
        self.wide = (int(b.max()) - self.low + 4) if len(b) else 4
        self.code = None
        if len(row) and int(row.max()) * self.wide >= 1 << 62:  # rows are numbered first where their codes leave no room
            self.code, row = np.unique(row, return_inverse=True)
        left, right = merged(row * self.wide + (a - self.low), row * self.wide + (b - self.low))
        if self.code is None:
            at = left // self.wide
            first = starts(at)
            self.code, number = at[first], np.cumsum(first) - 1
            shift = (number - at) * self.wide
            left, right = left + shift, right + shift
        self.left, self.right = left, right
        self._unpack()

    def _unpack(self) -> None:
        self.row = self.left // self.wide
        self.a = self.left - self.row * self.wide + self.low
        self.b = self.right - self.row * self.wide + self.low
        c = self.code[self.row]
        self.y, rest = c % self.ny, c // self.ny
        self.z, self.g = rest % self.nz, rest // self.nz

    def touching(self, dz: int, dy: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of intervals: j lies in the row at (dz, dy) from that of i and comes within ``pad``."""
        ok = (self.y + dy >= 0) & (self.y + dy < self.ny) & (self.z + dz >= 0) & (self.z + dz < self.nz)
        want = self.code[self.row] + dz * self.ny + dy
        at = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
        i = np.flatnonzero(ok & (self.code[at] == want))
        base = at[i] * self.wide - self.low
        lo = np.searchsorted(self.right, base + self.a[i] - pad)
        hi = np.searchsorted(self.left, base + self.b[i] + pad, side="right")
        owner, j = ragged(lo, np.maximum(hi - lo, 0))
        return i[owner], j

    def remove(self, other: Rows, group: np.ndarray | None = None) -> None:
        """Take away what ``other`` covers; group g here is group[g] there."""
        g = self.g if group is None else group[self.g]
        ok = (self.z < other.nz) & (self.y < other.ny)
        want = (g * other.nz + self.z) * other.ny + self.y
        at = np.minimum(np.searchsorted(other.code, want), len(other.code) - 1)
        i = np.flatnonzero(ok & (other.code[at] == want)) if len(other.code) else np.zeros(0, np.int64)
        base = at[i] * other.wide - other.low
        lo = np.searchsorted(other.right, base + self.a[i])
        hi = np.searchsorted(other.left, base + self.b[i], side="right")
        owner, j = ragged(lo, np.maximum(hi - lo, 0))
        i = i[owner]
        left = np.concatenate([self.left, self.left[i] + np.maximum(other.a[j] - self.a[i], 0)])
        right = np.concatenate([self.right, self.right[i] - np.maximum(self.b[i] - other.b[j], 0)])
        weight = np.concatenate([np.ones(len(self.left), np.int64), np.full(len(i), -(1 << 40))])
        self.left, self.right = covered(left, right, weight, 1)
        self._unpack()

    def moved(self, steps: Steps) -> tuple[np.ndarray, ...]:
        """(g, z, y, a, b) of every interval moved by every step."""
        cols = [(self.g, self.z + dz, self.y + dy, self.a + lo, self.b + hi) for dz, dy, lo, hi in steps]
        return tuple(np.concatenate(c) for c in zip(*cols))

    def shrunk(self, steps: Steps) -> tuple[np.ndarray, ...]:
        """(g, z, y, a, b): for every step the places from which it stays inside an interval; may be empty (b < a)."""
        cols = [(self.g, self.z - dz, self.y - dy, self.a - lo, self.b - hi) for dz, dy, lo, hi in steps]
        return tuple(np.concatenate(c) for c in zip(*cols))


def merged(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals that overlap or follow each other without a gap."""
    order = np.argsort(left, kind="stable")
    left, top = left[order], np.maximum.accumulate(right[order]) if len(right) else right
    first = np.ones(len(left), bool)
    first[1:] = left[1:] > top[:-1] + 1
    last = np.r_[first[1:], True] if len(left) else first
    return left[first], top[last]


def covered(left: np.ndarray, right: np.ndarray, weight: np.ndarray | int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the weights of the intervals that cover a place add up to ``least`` or more."""
    if not len(left):
        return left, right
    w = np.broadcast_to(np.asarray(weight, np.int64), left.shape)
    place, at = np.unique(np.concatenate([left, right + 1]), return_inverse=True)
    sums = np.cumsum(np.bincount(at, np.concatenate([w, -w]), len(place)).astype(np.int64))
    inside = sums >= least
    begins, ends = inside & ~np.r_[False, inside[:-1]], ~inside & np.r_[False, inside[:-1]]
    return place[begins], place[ends] - 1


# ---- tiles ---------------------------------------------------------------------------------


def to_tiles(df: DataFrame, keys: Sequence[str], reach: tuple[int, int] = (0, 0)) -> DataFrame:
    """Rows dealt to the tiles (tz, ty) of their key that lie within reach, sorted by key and tile."""
    def tile(c: str, size: int, far: int) -> Column:
        return F.floor(F.col(c) / size) if not far else F.explode(F.sequence(F.floor((F.col(c) - far) / size), F.floor((F.col(c) + far) / size)))

    out = df.withColumn("tz", tile("z", TILE[0], reach[0])).withColumn("ty", tile("y", TILE[1], reach[1]))
    return out.repartition(*keys, "tz", "ty").sortWithinPartitions(*keys, "tz", "ty")


def in_tiles(df: DataFrame, keys: Sequence[str], work: Callable, fields: str, reach: tuple[int, int] = (0, 0), extra: Sequence[str] = (), read: Sequence[str] = (), most: int = 1 << 18) -> DataFrame:
    """``work(table, g, z, y, a, b)`` over tables of whole tiles; it gives (rows, new columns) pairs.

    ``df`` has keys, z, y and x or a, b, besides ``extra`` columns and those that are only ``read``. g numbers the tiles of the table; z and y are counted
    from the tile's first row, plus the reach. A table has about ``most`` rows. ``rows`` are those of the table whose keys and extra columns come with the new columns.
    """
    keys, extra = list(keys), list(extra)
    ends = ["x"] if "x" in df.columns else ["a", "b"]
    rows = to_tiles(df.select(*keys, *extra, *read, "z", "y", *ends), keys, reach)
    by, pad, tile = [*keys, "tz", "ty"], reach, TILE

    def run(batches: Iterator) -> Iterator:
        for t in whole_groups(batches, by, most):
            g = np.cumsum(group_starts(t, by)) - 1
            n = lambda c: t.column(c).to_numpy().astype(np.int64)
            z, y = n("z") - n("tz") * tile[0] + pad[0], n("y") - n("ty") * tile[1] + pad[1]
            for own, new in work(t, g, z, y, n(ends[0]), n(ends[-1])):
                if len(own):
                    yield from with_columns(t, [*keys, *extra], own, **new)

    schema = T.StructType([*(df.schema[c] for c in (*keys, *extra)), *T.StructType.fromDDL(fields).fields])
    return rows.mapInArrow(run, schema)


def _first(g: np.ndarray) -> np.ndarray:
    return np.flatnonzero(starts(g)) if len(g) else g


def _placed(t, first: np.ndarray, g: np.ndarray, z: np.ndarray, y: np.ndarray, reach: tuple[int, int], tile: tuple[int, int]) -> dict[str, np.ndarray]:
    tz, ty = (t.column(c).to_numpy()[first[g]].astype(np.int64) for c in ("tz", "ty"))
    return {"z": z + tz * tile[0] - reach[0], "y": y + ty * tile[1] - reach[1]}


def _own(z: np.ndarray, y: np.ndarray, reach: tuple[int, int], tile: tuple[int, int]) -> np.ndarray:
    return (z >= reach[0]) & (z < reach[0] + tile[0]) & (y >= reach[1]) & (y < reach[1] + tile[1])


def x_runs(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal runs along x: ``keys, z, y, a, b, node``; voxels or runs may repeat and overlap."""
    tile = current_tile()

    def work(t, g, z, y, a, b):
        r, first = Rows(g, z, y, a, b), _first(g)
        yield first[r.g], {**_placed(t, first, r.g, r.z, r.y, (0, 0), tile), "a": r.a, "b": r.b}

    out = in_tiles(masks, keys, work, "z long, y long, a long, b long")
    return out.withColumn("node", node_id(F.col("z"), F.col("y"), F.col("a")))


def voxels_of(runs: DataFrame, *columns: str) -> DataFrame:
    """A row a voxel of runs, with the named columns besides z, y and x."""
    return runs.select(*columns, "z", "y", F.explode(F.sequence("a", "b")).alias("x"))


# ---- components ----------------------------------------------------------------------------


def _rows_near(conn: int, planar: bool) -> list[tuple[int, int]]:
    if planar:
        return [(0, 1)]
    return [(0, 1), (1, 0)] if conn == 6 else [(0, 1), (1, -1), (1, 0), (1, 1)]


def run_components(masks: DataFrame, keys: Sequence[str], conn: int = 26, planar: bool = False) -> DataFrame:
    """Runs with the component they belong to, named after its first run: ``keys, z, y, a, b, node, component``.

    Runs are joined inside their tile. Only of keys with several tiles, runs at borders meet those of the next tile, and the
    labels that touch there are joined by star contraction; a key inside one tile goes through no round and no checkpoint.
    """
    keys, pad = list(keys), 0 if conn == 6 else 1

    tile = current_tile()

    def work(t, g, z, y, a, b):
        r, first = Rows(g, z, y, a, b), _first(g)
        pairs = [r.touching(dz, dy, pad) for dz, dy in _rows_near(conn, planar)]
        label = components(len(r.a), *(np.concatenate(c) for c in zip(*pairs)))
        at = _placed(t, first, r.g, r.z, r.y, (0, 0), tile)
        node = (at["z"] << 42) + (at["y"] << 21) + r.a
        yield first[r.g], {**at, "a": r.a, "b": r.b, "node": node, "component": node[label]}

    runs = in_tiles(masks, keys, work, "z long, y long, a long, b long, node long, component long")
    at = F.struct(F.floor(F.col("z") / TILE[0]).alias("z"), F.floor(F.col("y") / TILE[1]).alias("y"))
    wide = masks.groupBy(*keys).agg(F.min(at).alias("_t0"), F.max(at).alias("_t1")).filter("_t0 <> _t1").select(*keys)
    wide = cut_lineage(wide)
    if wide.isEmpty():
        return runs
    across = cut_lineage(runs.join(wide, keys, "left_semi"))
    c = connected_components(_border_pairs(across, keys, conn, planar), keys, "src", "dst")
    c = c.select(*keys, F.col("node").alias("component"), F.col("component").alias("_c"))
    joined = across.join(c, [*keys, "component"], "left").withColumn("component", F.coalesce("_c", "component")).select(*runs.columns)
    return runs.join(wide, keys, "left_anti").unionByName(joined)


def _border_pairs(runs: DataFrame, keys: list[str], conn: int, planar: bool) -> DataFrame:
    """Labels of touching runs of different tiles."""
    inner = lambda c, n: F.pmod(F.col(c), F.lit(n))
    edge = inner("y", TILE[1]).isin(0, TILE[1] - 1)
    if not planar:
        edge |= inner("z", TILE[0]).isin(0, TILE[0] - 1)
    r = runs.filter(edge)
    pad = 0 if conn == 6 else 1
    step = F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in _rows_near(conn, planar)])
    tile = lambda: F.struct(F.floor(F.col("z") / TILE[0]), F.floor(F.col("y") / TILE[1]))
    s = r.select(*keys, "z", "y", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("component").alias("src"), tile().alias("_ts"), F.explode(step).alias("_s"))
    s = s.select(*keys, (F.col("z") + F.col("_s.dz")).alias("z"), (F.col("y") + F.col("_s.dy")).alias("y"), "_a", "_b", "src", "_ts")
    d = r.select(*keys, "z", "y", "a", "b", F.col("component").alias("dst"), tile().alias("_td"))
    j = s.join(d, [*keys, "z", "y"]).filter((F.col("_ts") != F.col("_td")) & (F.col("_a") <= F.col("b") + pad) & (F.col("a") <= F.col("_b") + pad))
    return j.select(*keys, "src", "dst").distinct()


# ---- morphology ----------------------------------------------------------------------------


def _reach(steps: Steps) -> tuple[int, int]:
    return max(abs(s[0]) for s in steps), max(abs(s[1]) for s in steps)


def _rows_within(df: DataFrame, grid) -> DataFrame:
    """Runs clipped to the grid."""
    if grid is None:
        return df
    df = df.filter(F.col("z").between(0, grid[0] - 1) & F.col("y").between(0, grid[1] - 1))
    df = df.withColumns({"a": F.greatest("a", F.lit(0).cast("long")), "b": F.least("b", F.lit(grid[2] - 1).cast("long"))})
    return df.filter("a <= b")


def dilated(masks: DataFrame, keys: Sequence[str], offs, grid=None) -> DataFrame:
    """Runs of the union of the moved masks."""
    steps = steps_of(offs)
    reach = _reach(steps)

    tile = current_tile()

    def work(t, g, z, y, a, b):
        r, first = Rows(g, z, y, a, b), _first(g)
        g2, z2, y2, a2, b2 = r.moved(steps)
        own = _own(z2, y2, reach, tile)
        if own.any():
            out = Rows(g2[own], z2[own], y2[own], a2[own], b2[own])
            yield first[out.g], {**_placed(t, first, out.g, out.z, out.y, reach, tile), "a": out.a, "b": out.b}

    return _rows_within(in_tiles(masks, keys, work, "z long, y long, a long, b long", reach), grid)


def _where_all(r: Rows, steps: Steps, reach: tuple[int, int], tile: tuple[int, int]) -> Rows:
    """Places from which every step stays inside."""
    g, z, y, a, b = r.shrunk(steps)
    own = _own(z, y, reach, tile) & (a <= b)
    out = Rows(g[own], z[own], y[own], a[own], b[own])
    row = np.searchsorted(out.code, (g[own] * out.nz + z[own]) * out.ny + y[own])
    out.left, out.right = covered(row * out.wide + (a[own] - out.low), row * out.wide + (b[own] - out.low), 1, len(steps))
    out._unpack()
    return out


def eroded(masks: DataFrame, keys: Sequence[str], offs) -> DataFrame:
    """Runs of the voxels all of whose offsets lie in the mask (outside the grid is background)."""
    steps = steps_of(offs)
    reach = _reach(steps)

    tile = current_tile()

    def work(t, g, z, y, a, b):
        first = _first(g)
        out = _where_all(Rows(g, z, y, a, b), steps, reach, tile)
        yield first[out.g], {**_placed(t, first, out.g, out.z, out.y, reach, tile), "a": out.a, "b": out.b}

    return in_tiles(masks, keys, work, "z long, y long, a long, b long", reach)


def shells(masks: DataFrame, run_keys: Sequence[str], unit: str, inner, outer, grid=None) -> DataFrame:
    """Runs, by unit, of what the outer offsets reach and the inner ones don't, without voxels of any mask of the run."""
    near, far = steps_of(inner), steps_of(outer)
    reach = tuple(map(max, _reach(near), _reach(far)))

    def own_rows(cols) -> Rows:
        ok = _own(cols[1], cols[2], reach, tile)
        return Rows(*(c[ok] for c in cols))

    tile = current_tile()

    def work(t, g, z, y, a, b):
        # a unit of a tile is a group of its own; the masks of the tile are those of all its units
        _, u = np.unique(codes(t.column(unit)), return_inverse=True)
        both, one = np.unique(g * (u.max() + 1) + u, return_inverse=True)
        at, where = both // (u.max() + 1), np.empty(len(both), np.int64)
        where[one] = np.arange(len(g))
        r = Rows(one, z, y, a, b)
        out = own_rows(r.moved(far))
        out.remove(own_rows(r.moved(near)))
        out.remove(Rows(g, z, y, a, b), at)
        yield where[out.g], {**_placed(t, _first(g), at[out.g], out.z, out.y, reach, tile), "a": out.a, "b": out.b}

    return _rows_within(in_tiles(masks, run_keys, work, "z long, y long, a long, b long", reach, [unit], most=SHELL_ROWS), grid)


def _reached(r: Rows, steps: Steps, reach: tuple[int, int], tile: tuple[int, int]) -> Rows:
    """Union of the runs moved by all steps, in the tile; few steps at a time however many there are."""
    out, part = None, max(1, MOVED // max(1, len(r.a)))
    for lo in range(0, len(steps), part):
        g, z, y, a, b = r.moved(steps[lo : lo + part])
        own = _own(z, y, reach, tile)
        cols = (g[own], z[own], y[own], a[own], b[own])
        if out is not None:
            cols = tuple(np.concatenate(c) for c in zip((out.g, out.z, out.y, out.a, out.b), cols))
        out = Rows(*cols)
    return out


def rings(masks: DataFrame, keys: Sequence[str], balls, grid=None) -> DataFrame:
    """Runs of what each of growing sets of offsets reaches beyond the one before: ``keys, z, y, a, b, ring``.

    The first set is what the first ring leaves out. Voxels are shuffled once; only runs leave a task.
    """
    steps = [steps_of(b) for b in balls]
    reach = tuple(map(max, zip(*map(_reach, steps))))

    tile = current_tile()

    def work(t, g, z, y, a, b):
        r, first = Rows(g, z, y, a, b), _first(g)
        inner = _reached(r, steps[0], reach, tile)
        for i, s in enumerate(steps[1:]):
            outer = _reached(r, s, reach, tile)
            out = copy(outer)
            out.remove(inner)
            yield first[out.g], {**_placed(t, first, out.g, out.z, out.y, reach, tile), "a": out.a, "b": out.b, "ring": np.full(len(out.a), i)}
            inner = outer

    return _rows_within(in_tiles(masks, keys, work, "z long, y long, a long, b long, ring long", reach, most=SHELL_ROWS), grid)
