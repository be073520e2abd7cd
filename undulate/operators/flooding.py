"""Splitting masks by flooding from seeds: a minimum spanning forest over voxel edges weighted by depth.

Flooding from the deepest place down gives every voxel the seed that it reaches over the highest pass. That is the tree
of the spanning forest, with one seed a tree, whose edges are the deepest: edge (u, v) weighs -min(depth u, depth v),
ties go by the ids of its ends, lower one first, so that the order is strict and the forest unique. Borůvka's rounds build it: each
part without a seed takes its lightest edge.

A tile does that with its own voxels for as long as the lightest edge stays inside (it sees the first voxels beyond).
Only keys of several tiles go on, with parts in place of voxels and the edges between them, in rounds that grow with the
logarithm of the parts. Edges between parts that have their seeds are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undulate.operators.blocks import jumped
from undulate.operators.graph import components_with_singletons
from undulate.operators.intervals import TILE, _first, _own, _placed, current_tile, in_tiles, node_id
from undulate.session import cut_lineage

NONE = -1


class _Voxels:
    """Voxels of a table of tiles, sorted, with their neighbours at an offset."""

    def __init__(self, g: np.ndarray, z: np.ndarray, y: np.ndarray, x: np.ndarray):
        self.nz, self.ny = int(z.max()) + 2, int(y.max()) + 2
        self.low, self.wide = int(x.min()) - 1, int(x.max()) - int(x.min()) + 3
        code = self._code(g, z, y, x)
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]
        keep = np.r_[True, self.code[1:] != self.code[:-1]]
        self.order, self.code = self.order[keep], self.code[keep]
        self.g, self.z, self.y, self.x = (c[self.order] for c in (g, z, y, x))

    def _code(self, g, z, y, x):
        return ((g * self.nz + z) * self.ny + y) * self.wide + (x - self.low)

    def at(self, dz: int, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j): voxel j lies at the offset from voxel i."""
        z, y, x = self.z + dz, self.y + dy, self.x + dx
        ok = (z >= 0) & (z < self.nz) & (y >= 0) & (y < self.ny) & (x >= self.low) & (x < self.low + self.wide)
        want = self._code(self.g, z, y, x)
        j = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
        i = np.flatnonzero(ok & (self.code[j] == want))
        return i, j[i]


def peaks(depths: DataFrame, keys: Sequence[str], v: str, offs, digits: int = 9) -> DataFrame:
    """``keys, z, y, x, seed``: voxels whose value is the greatest among those at the offsets (of equals the first id)."""
    offs = [o[:3] for o in offs if tuple(o[:3]) != (0, 0, 0)]
    reach = max((abs(o[0]) for o in offs), default=0), max((abs(o[1]) for o in offs), default=0)
    tile = current_tile()

    def work(t, g, z, y, x, _):
        first, n = _first(g), _Voxels(g, z, y, x)
        d = np.round(t.column(v).to_numpy()[n.order], digits)
        beaten = ~_own(n.z, n.y, reach, tile)
        for o in offs:
            i, j = n.at(*o)
            less = o < (0, 0, 0)  # of two equals the one that comes first wins
            beaten[i[(d[j] > d[i]) | ((d[j] == d[i]) & less)]] = True
        own = np.flatnonzero(~beaten)
        at = _placed(t, first, n.g[own], n.z[own], n.y[own], reach, tile)
        yield first[n.g[own]], {**at, "x": n.x[own], "seed": (at["z"] << 42) + (at["y"] << 21) + n.x[own]}

    rows = in_tiles(depths, keys, work, "z long, y long, x long, seed long", reach, read=[v])
    return rows.select(*keys, "z", "y", "x", "seed")


def _boruvka(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray, seed: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Part (least node) of each node. Parts with a seed, and those whose lightest edge leaves the inner nodes, take no edge."""
    part, rooted = np.arange(n), seed != NONE
    closed = ~inner
    edge_of = np.argsort(rank)  # edge with each rank
    while True:
        pa, pb = part[a], part[b]
        out = pa != pb
        best = np.full(n, len(a), np.int64)
        np.minimum.at(best, pa[out], rank[out])
        np.minimum.at(best, pb[out], rank[out])
        take = np.flatnonzero((part == np.arange(n)) & ~rooted & ~closed & (best < len(a)))
        if not len(take):
            return part
        e = edge_of[best[take]]
        other = np.where(pa[e] == take, pb[e], pa[e])
        far = ~inner[other]  # a voxel beyond the tile: what lies behind it isn't known here
        closed[take[far]] = True
        take, other = take[~far], other[~far]
        if not len(take):
            continue
        up = np.arange(n)
        up[take] = other
        mutual = take[(up[other] == take) & (take < other)]
        up[mutual] = mutual
        top = jumped(up)
        # the least node names a part; of the parts that meet at most one has a seed
        least = np.arange(n)
        np.minimum.at(least, top, np.arange(n))
        new = least[top]
        has, shut = np.zeros(n, bool), np.zeros(n, bool)
        parts = np.flatnonzero(part == np.arange(n))
        np.logical_or.at(has, new[parts], rooted[parts])
        np.logical_or.at(shut, new[parts], closed[parts])
        rooted, closed = has, shut
        part = new[part]


def flood(voxels: DataFrame, seeds: DataFrame, keys: Sequence[str], depth: str = "depth", conn: int = 6, digits: int = 9) -> DataFrame:
    """``keys, z, y, x, part``: the seed that floods each voxel; voxels that no seed reaches have none.

    ``voxels`` has keys, z, y, x and the depth (rounded to ``digits``), ``seeds`` keys, z, y, x and a non-negative ``seed``.
    """
    from undulate.operators.voxels import neighbours

    keys = list(keys)
    half = [o[:3] for o in neighbours(conn) if o[:3] > (0, 0, 0)]
    tile = current_tile()
    v = voxels.select(*keys, "z", "y", "x", F.round(depth, digits).alias("_d")).join(seeds.select(*keys, "z", "y", "x", F.col("seed").alias("_seed")), [*keys, "z", "y", "x"], "left")
    v = v.withColumn("_seed", F.coalesce("_seed", F.lit(NONE)).cast("long"))

    def work(t, g, z, y, x, _):
        first, n = _first(g), _Voxels(g, z, y, x)
        d, seed = t.column("_d").to_numpy()[n.order], t.column("_seed").to_numpy()[n.order]
        at = _placed(t, first, n.g, n.z, n.y, (1, 1), tile)
        node = (at["z"] << 42) + (at["y"] << 21) + n.x
        inner = _own(n.z, n.y, (1, 1), tile)
        pairs = [n.at(*o) for o in half]
        a, b = (np.concatenate(c) for c in zip(*pairs))
        ok = inner[a] | inner[b]
        a, b = a[ok], b[ok]
        w = -np.minimum(d[a], d[b])
        order = np.lexsort((node[b], node[a], w))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        part = _boruvka(len(node), a, b, rank, seed, inner)
        root = np.full(len(node), NONE)
        np.maximum.at(root, part, seed)
        own = np.flatnonzero(inner)
        blank = lambda m, k=np.int64: np.zeros(m, k)
        cols = {"z": at["z"][own], "y": at["y"][own], "x": n.x[own], "part": node[part[own]], "root": root[part[own]], "a": blank(len(own)), "b": blank(len(own)),
                "w": blank(len(own), float), "n1": blank(len(own)), "n2": blank(len(own))}
        yield first[n.g[own]], cols
        # edges that are open: between different parts, one of them without a seed; the ends are voxels
        e = np.flatnonzero((part[a] != part[b]) & ((root[part[a]] == NONE) | (root[part[b]] == NONE)))
        m = len(e)
        yield first[n.g[a[e]]], {"z": blank(m), "y": blank(m), "x": blank(m), "part": np.full(m, NONE), "root": blank(m), "a": node[a[e]], "b": node[b[e]],
                                 "w": w[e], "n1": node[a[e]], "n2": node[b[e]]}

    fields = "z long, y long, x long, part long, root long, a long, b long, w double, n1 long, n2 long"
    out = in_tiles(v, keys, work, fields, (1, 1), read=["_d", "_seed"])
    done = out.filter(F.col("part") != NONE)
    seed = F.when(F.col("root") != NONE, F.col("root"))
    tile_at = F.struct(F.floor(F.col("z") / TILE[0]).alias("z"), F.floor(F.col("y") / TILE[1]).alias("y"))
    wide = cut_lineage(voxels.groupBy(*keys).agg(F.min(tile_at).alias("_t0"), F.max(tile_at).alias("_t1")).filter("_t0 <> _t1").select(*keys))
    if wide.isEmpty():
        return done.select(*keys, "z", "y", "x", seed.alias("part"))
    held = cut_lineage(out.join(wide, keys, "left_semi"))
    own = held.filter(F.col("part") != NONE).select(*keys, "z", "y", "x", node_id(F.col("z"), F.col("y"), F.col("x")).alias("node"), "part", "root")
    ends = held.filter(F.col("part") == NONE).select(*keys, "a", "b", "w", "n1", "n2").distinct()
    name = lambda c: own.select(*keys, F.col("node").alias(c), F.col("part").alias(f"_{c}"))
    edges = ends.join(name("a"), [*keys, "a"]).join(name("b"), [*keys, "b"]).select(*keys, F.col("_a").alias("a"), F.col("_b").alias("b"), "w", "n1", "n2")
    roots = _joined_parts(own.select(*keys, "part", "root").distinct(), edges, keys)
    own = own.drop("root").join(roots, [*keys, "part"]).select(*keys, "z", "y", "x", seed.alias("part"))
    return done.join(wide, keys, "left_anti").select(*keys, "z", "y", "x", seed.alias("part")).unionByName(own)


def _joined_parts(parts: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``part, root`` of every part after Borůvka's rounds over the edges (a, b, w, n1, n2) of parts."""
    state, e = cut_lineage(parts.withColumn("now", F.col("part"))), edges
    while True:
        label = state.select(*keys, "now", "root").distinct()
        end = lambda c: label.select(*keys, F.col("now").alias(c), F.col("root").alias(f"r{c}"))
        e = e.filter("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct("w", "n1", "n2").alias("e"))
        e = e.groupBy(*keys, "a", "b").agg(F.min("e").alias("e")).join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"])
        e = cut_lineage(e.filter((F.col("ra") == NONE) | (F.col("rb") == NONE)))
        both = e.filter(F.col("ra") == NONE).select(*keys, F.col("a").alias("at"), "e", F.col("b").alias("to")).unionByName(
            e.filter(F.col("rb") == NONE).select(*keys, F.col("b").alias("at"), "e", F.col("a").alias("to")))
        picks = cut_lineage(both.groupBy(*keys, "at").agg(F.min(F.struct("e", "to")).alias("p")).select(*keys, "at", F.col("p.to").alias("to")))
        if picks.isEmpty():
            return state.select(*keys, "part", "root")
        met = label.join(components_with_singletons(label.withColumnRenamed("now", "at"), picks, keys, "at", "at", "to").withColumnRenamed("at", "now"), [*keys, "now"])
        met = cut_lineage(met.join(met.groupBy(*keys, "component").agg(F.max("root").alias("_root")), [*keys, "component"]).select(*keys, "now", "component", F.col("_root").alias("root")))
        state = cut_lineage(state.drop("root").join(met, [*keys, "now"]).select(*keys, "part", F.col("component").alias("now"), "root"))
        new = lambda c: met.select(*keys, F.col("now").alias(c), F.col("component").alias(f"_{c}"))
        e = e.join(new("a"), [*keys, "a"]).join(new("b"), [*keys, "b"]).select(*keys, F.col("_a").alias("a"), F.col("_b").alias("b"), "e.w", "e.n1", "e.n2")
