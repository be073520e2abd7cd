"""Exact distances on anisotropic grids, one pass an axis.

The squared distance of a voxel is the least, over the voxels of its column, of the squared distance of those in the
planes before plus that along the column: a lower envelope of parabolas. Rows are shuffled once an axis - along x with
their tile, along y and z as columns of 64 neighbouring x - and the envelopes of all columns of an Arrow table are built
together. Nothing grows with the distance but the voxels that are asked for. A group is bounded by the grid's extents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undulate.operators.blocks import group_starts, ragged, starts, whole_groups, with_columns
from undulate.operators.intervals import Rows, _first, _placed, current_tile, in_tiles, merged

#: Neighbouring x of which the columns are worked on together.
BLOCK = 64


def envelope(n: np.ndarray, p: np.ndarray, f: np.ndarray, w: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower envelopes of f[i] + w (t - p[i])² for stretches of n sources each, ascending p in a stretch.

    (stretch, source, from which t on it is the least) of the parabolas that show, in order. Stretches of about the same
    length go through the sources side by side.
    """
    first = np.cumsum(n) - n
    seg, src, bound = [], [], []
    size = np.ceil(np.log2(np.maximum(n, 1))).astype(int)
    for k in np.unique(size):
        own = np.flatnonzero(size == k)
        length = int(n[own].max())
        i = np.minimum(first[own][:, None] + np.arange(length), len(p) - 1)
        pp, ff = p[i].astype(np.float64), f[i]
        stack, begin, top = np.zeros((len(own), length), np.int64), np.full((len(own), length), -np.inf), np.zeros(len(own), np.int64)
        for q in range(1, length):
            todo = np.flatnonzero(n[own] > q)
            cut = np.empty(len(todo))
            wait = np.arange(len(todo))
            while len(wait):
                r = todo[wait]
                v = stack[r, top[r]]
                cut[wait] = (pp[r, q] + pp[r, v]) / 2 + (ff[r, q] - ff[r, v]) / (2 * w * (pp[r, q] - pp[r, v]))
                hidden = cut[wait] <= begin[r, top[r]]
                top[r[hidden]] -= 1
                wait = wait[hidden]
            top[todo] += 1
            stack[todo, top[todo]], begin[todo, top[todo]] = q, cut
        r, c = np.nonzero(np.arange(length) <= top[:, None])
        seg.append(own[r])
        src.append(first[own[r]] + stack[r, c])
        bound.append(begin[r, c])
    seg, src, bound = (np.concatenate(x) if x else np.zeros(0) for x in (seg, src, bound))
    order = np.lexsort((bound, seg))
    return seg[order].astype(np.int64), src[order].astype(np.int64), bound[order]


def least(n: np.ndarray, p: np.ndarray, f: np.ndarray, w: float, stretch: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Least of f + w (t - p)² over the sources of its stretch, for each target t."""
    seg, src, bound = envelope(n, p, f, w)
    low, high = int(min(t.min(), p.min())) - 1, int(max(t.max(), p.max())) + 1
    wide = high - low + 1
    at = np.searchsorted(seg * wide + (np.clip(bound, low, high) - low), stretch * wide + (t - low), side="right") - 1
    own = src[at]
    return f[own] + w * (t - p[own]) ** 2.0


def along(df: DataFrame, keys: Sequence[str], axis: str, other: str, size: float, radius: float | None, last: int | None = None) -> DataFrame:
    """``keys, z, y, x, f`` with the squared distances f carried on along an axis.

    Without a radius the rows are the inside of masks and what has no row is at 0; with one they are sources, and all
    voxels within the radius, 0…``last`` along the axis, come out.
    """
    keys = list(keys)
    by = [*keys, other, "_b"]
    rows = df.withColumn("_b", F.floor(F.col("x") / BLOCK)).repartition(*by).sortWithinPartitions(*by, "x", axis)
    reach = None if radius is None else int(radius / size + 1e-9)

    def run(batches: Iterator) -> Iterator:
        for t in whole_groups(batches, by):
            p, x, f = (t.column(c).to_numpy() for c in (axis, "x", "f"))
            new = group_starts(t, by) | starts(x)
            cut = new.copy()
            cut[1:] |= np.diff(p) > (1 if reach is None else 2 * reach + 1)
            first = np.flatnonzero(cut)
            n = np.diff(np.r_[first, len(p)])
            if reach is None:
                stretch = np.cumsum(cut) - 1
                ends = np.zeros(len(p) + 2 * len(n))
                pp = np.empty(len(ends), np.int64)
                at = np.arange(len(p)) + 2 * stretch + 1
                ends[at], pp[at] = f, p
                pp[first + 2 * np.arange(len(n))] = p[first] - 1
                pp[first + n + 2 * np.arange(len(n)) + 1] = p[first + n - 1] + 1
                d, rows_, to = least(n + 2, pp, ends, size * size, stretch, p), np.arange(len(p)), p
            else:
                lo, hi = p[first] - reach, p[first + n - 1] + reach
                if last is not None:
                    lo, hi = np.maximum(lo, 0), np.minimum(hi, last)
                stretch, to = ragged(lo, np.maximum(hi - lo + 1, 0))
                if not len(to):
                    continue
                d, rows_ = least(n, p, f, size * size, stretch, to), first[stretch]
                ok = d <= radius * radius + 1e-9
                # two stretches of a column may both reach a voxel between them
                column = (np.cumsum(new) - 1)[rows_]
                order = np.lexsort((d, to, column))
                order = order[ok[order]]
                once = order[starts(column[order], to[order])] if len(order) else order
                d, rows_, to = d[once], rows_[once], to[once]
            if len(to):
                yield from with_columns(t, [*keys, other, "x"], rows_, **{axis: to.astype(np.int64), "f": d})

    schema = T.StructType([*(df.schema[c] for c in (*keys, other, "x")), T.StructField(axis, T.LongType()), T.StructField("f", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def depths(masks: DataFrame, keys: Sequence[str], size=(1.0, 1.0, 1.0)) -> DataFrame:
    """``keys, z, y, x, depth``: distance of each mask voxel to the nearest voxel outside."""
    tile = current_tile()

    def work(t, g, z, y, a, b):
        r, first = Rows(g, z, y, a, b), _first(g)
        i, x = ragged(r.a, r.b - r.a + 1)
        f = np.minimum(x - r.a[i] + 1, r.b[i] - x + 1) * size[2]
        yield first[r.g[i]], {**_placed(t, first, r.g[i], r.z[i], r.y[i], (0, 0), tile), "x": x, "f": f * f}

    d = in_tiles(masks, keys, work, "z long, y long, x long, f double")
    d = along(along(d, keys, "y", "z", size[1], None), keys, "z", "y", size[0], None)
    return d.select(*keys, "z", "y", "x", F.sqrt("f").alias("depth"))


def reached(masks: DataFrame, keys: Sequence[str], radius: float, size=(1.0, 1.0, 1.0), grid=None) -> DataFrame:
    """``keys, z, y, x, dist``: distance to the mask of the key, of all voxels within ``radius`` (0 inside)."""
    far = int(radius / size[2] + 1e-9)

    tile = current_tile()

    def work(t, g, z, y, a, b):
        r, first = Rows(g, z, y, a, b), _first(g)
        key = r.row * (r.wide + 2 * far + 2) + far
        left, right = merged(key + r.a - r.low - far, key + r.b - r.low + far)
        i, at = ragged(left, right - left + 1)
        begin, end = key + r.a - r.low, key + r.b - r.low
        j = np.searchsorted(begin, at, side="right") - 1  # -1 before the first run of the table
        after, j = np.minimum(j + 1, len(begin) - 1), np.maximum(j, 0)
        gap = np.minimum(np.where(at >= begin[j], np.maximum(at - end[j], 0), begin[j] - at), np.where(begin[after] > at, begin[after] - at, 1 << 60)) * size[2]
        own = np.where((at >= begin[j]) & (np.maximum(at - end[j], 0) <= far), j, after)
        x = at - key[own] + r.low
        ok = gap <= radius + 1e-9
        if grid is not None:
            ok &= (x >= 0) & (x < grid[2])
        own, x, gap = own[ok], x[ok], gap[ok]
        yield first[r.g[own]], {**_placed(t, first, r.g[own], r.z[own], r.y[own], (0, 0), tile), "x": x, "f": gap * gap}

    top = (None, None) if grid is None else (grid[0] - 1, grid[1] - 1)
    d = in_tiles(masks, keys, work, "z long, y long, x long, f double")
    d = along(along(d, keys, "y", "z", size[1], radius, top[1]), keys, "z", "y", size[0], radius, top[0])
    return d.select(*keys, "z", "y", "x", F.sqrt("f").alias("dist"))
