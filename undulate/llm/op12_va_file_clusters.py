"""Centroid clustering over a VA-file: few-bit cells of all vectors first, full vectors only where the cells can't tell.

Components become integers, floor(scale * x). The layout pass writes them as raw little-endian rows to side files in the
shared folder, and a table of blocks beside them: ids, packed cell numbers (`bits` a component), file and offset. Cells of
a component have equal widths over the range of a bounded sample (the `sample` vectors of smallest id digest); the outer
ones reach to the least and the greatest value of all rows. A round looks up, for each component, cell and centroid, the
least and the greatest share of the distance - less what is common to all centroids, which their mean as the origin makes
small - and adds these to intervals. A centroid whose interval lies wholly above another's is out. Vectors with more than
one centroid left are fetched by offset and settled exactly, as are those that change their centroid: their components
move from one sum to the other. So a round reads the cells in turn and only parts of the vectors; nothing is shuffled but
sums of k * dims numbers a task. All arithmetic is in 64-bit integers; the result doesn't depend on partitions.

To the driver come the sample, k centroids and their sums. A file is named in the block table by the task attempt that
counted, so a lost executor leaves a file that nobody reads.

Left out: vectors that are null, of another length, with null or non-finite components, or with a component whose scaled
size is 2^27 or more (its squared distance fits no long). Zero vectors take part. Rows without an id take part but never
begin as a centroid. Repeated rows are rows of their own; of two rows with one id the smaller vector begins. With fewer than k
vectors with an id there are fewer centroids, with none no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undulate.llm.common import discard, shared_folder, stored
from undulate.llm.vectors import matrix

BLOCKS = "file string, offset long, n int, ids array<long>, cells binary, assigned binary, sums array<long>, low array<long>, high array<long>"
MEMBERS = "id long, cluster int, distance long"
REACH = 1 << 27


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector_col)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= REACH / scale))
    return vectors.where(F.coalesce((F.size(v) == dims) & fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def scaled(v: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(v * scale).astype(np.int64)


def packed(cells: np.ndarray, bits: int) -> bytes:
    return np.packbits((cells[..., None] >> np.arange(bits)) & 1).tobytes()


def unpacked(data: bytes, n: int, dims: int, bits: int) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * dims * bits).reshape(n, dims, bits)
    return flags @ (1 << np.arange(bits))


class Cells:
    """Where the cells of each component begin, and the least and greatest value in each of them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.bits, count = bits, 1 << bits
        self.inner = [np.unique(-(-np.arange(1, count) * (int(b) + 1 - int(a)) // count) + int(a)) for a, b in zip(low, high)]
        self.low = self.high = None

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges, v[:, d], side="right") for d, edges in enumerate(self.inner)], axis=1)

    def reach(self, low: np.ndarray, high: np.ndarray) -> None:
        """Bounds of the outer cells."""
        self.low = [np.r_[a, edges] for a, edges in zip(low, self.inner)]
        self.high = [np.r_[edges - 1, b] for b, edges in zip(high, self.inner)]

    def tables(self, centroids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Least and greatest share of each (cell, centroid), a table a component, and what no cell changes."""
        origin = centroids.sum(axis=0) // len(centroids)
        c = centroids - origin
        ends = [(-2 * np.outer(a - o, x), -2 * np.outer(b - o, x)) for a, b, o, x in zip(self.low, self.high, origin, c.T)]
        return [np.minimum(a, b) for a, b in ends], [np.maximum(a, b) for a, b in ends], (c * c).sum(axis=1)


def layout(kept: DataFrame, cells: Cells, scale: int, block: int) -> DataFrame:
    """Write the vectors to side files; the table of their blocks. Each task adds a row with its least and greatest values."""
    import pyarrow as pa

    folder = f"{shared_folder(kept.sparkSession)}/vectors"
    dims = len(cells.inner)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        out, at, low, high = None, 0, np.full(dims, REACH), np.full(dims, -REACH)
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                v = scaled(matrix(part.column("v")), scale)
                if out is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.vec"
                    fs, path = FileSystem.from_uri(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                out.write(v.astype("<i4").tobytes())
                low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
                yield block_row(uri, at, part.column("id"), packed(cells.of(v), cells.bits), np.full(len(v), -1, "<i4").tobytes())
                at += 4 * v.size
        if out is not None:
            out.close()
            yield task_row(low=low, high=high)

    return stored(kept.mapInArrow(write, BLOCKS), "blocks")


def _row(**values):
    import pyarrow as pa

    types = {"file": pa.string(), "offset": pa.int64(), "n": pa.int32(), "ids": pa.list_(pa.int64()), "cells": pa.binary(), "assigned": pa.binary(),
             **dict.fromkeys(("sums", "low", "high"), pa.list_(pa.int64()))}
    return pa.RecordBatch.from_arrays([pa.array([values.get(k)], t) for k, t in types.items()], names=list(types))


def block_row(uri: str, at: int, ids, cells: bytes, assigned: bytes):
    ids = ids.to_pylist()
    return _row(file=uri, offset=at, n=len(ids), ids=ids, cells=cells, assigned=assigned)


def task_row(**arrays: np.ndarray):
    return _row(**{k: v.tolist() for k, v in arrays.items()})


class Vectors:
    """Rows of side files by their offset; rows near each other come with one read."""

    def __init__(self, dims: int, gap: int = 16):
        self.dims, self.gap, self.uri, self.file = dims, gap, None, None

    def __call__(self, uri: str, offset: int, rows: np.ndarray) -> np.ndarray:
        from pyarrow.fs import FileSystem

        if uri != self.uri:
            self.close()
            fs, path = FileSystem.from_uri(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        width, out = 4 * self.dims, []
        for run in np.split(rows, np.flatnonzero(np.diff(rows) > self.gap) + 1):
            first, count = int(run[0]), int(run[-1] - run[0]) + 1
            got = np.frombuffer(self.file.read_at(count * width, offset + first * width), "<i4").reshape(count, self.dims)
            out.append(got[run - first])
        return np.concatenate(out).astype(np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def nearest(v: np.ndarray, left: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of those left to each vector; ties to the smaller number."""
    best, at = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64)
    for j, c in enumerate(centroids):
        i = np.flatnonzero(left[:, j])
        d = ((v[i] - c) ** 2).sum(axis=1)
        nearer = d < best[i]
        best[i[nearer]], at[i[nearer]] = d[nearer], j
    return at, best


def in_reach(data: bytes, n: int, dims: int, cells: Cells, tables: tuple) -> np.ndarray:
    """Which centroids the cells of n vectors leave in question."""
    least, most, fixed = tables
    own = unpacked(data, n, dims, cells.bits)
    low, high = np.tile(fixed, (n, 1)), np.tile(fixed, (n, 1))
    for d in range(dims):
        low += least[d][own[:, d]]
        high += most[d][own[:, d]]
    return low <= high.min(axis=1, keepdims=True)


def assigned_round(blocks: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """The blocks with new assignments; each task adds a row of what the sums and sizes of clusters change by."""
    import pyarrow as pa

    shared = blocks.sparkSession.sparkContext.broadcast((cells, centroids, cells.tables(centroids)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cl, c, tables = shared.value
        k, dims = c.shape
        fetch, sums = Vectors(dims), np.zeros((k, dims + 1), np.int64)
        for b in batches:
            for r in b.to_pylist():
                left = in_reach(r["cells"], r["n"], dims, cl, tables)
                before, now = np.frombuffer(r["assigned"], "<i4"), left.argmax(axis=1)
                open_ = left.sum(axis=1) > 1
                rows = np.flatnonzero(open_ | (now != before))
                if len(rows):
                    v = fetch(r["file"], r["offset"], rows)
                    now[rows], _ = nearest(v, left[rows], c)
                    moved = now[rows] != before[rows]
                    v, to, was = np.c_[v[moved], np.ones(moved.sum(), np.int64)], now[rows][moved], before[rows][moved]
                    np.add.at(sums, to, v)
                    np.subtract.at(sums, was[was >= 0], v[was >= 0])
                yield _row(**{**r, "assigned": now.astype("<i4").tobytes()})
        fetch.close()
        yield task_row(sums=sums.ravel())

    return blocks.where(F.col("n").isNotNull()).mapInArrow(work, BLOCKS)


def members(blocks: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """Cluster and squared distance of every vector; here all are read, as each one's distance is asked for."""
    import pyarrow as pa

    shared = blocks.sparkSession.sparkContext.broadcast((cells, centroids, cells.tables(centroids)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cl, c, tables = shared.value
        fetch = Vectors(c.shape[1])
        for b in batches:
            for r in b.to_pylist():
                left = in_reach(r["cells"], r["n"], c.shape[1], cl, tables)
                at, d = nearest(fetch(r["file"], r["offset"], np.arange(r["n"])), left, c)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["id", "cluster", "distance"])
        fetch.close()

    return blocks.where(F.col("n").isNotNull()).mapInArrow(work, MEMBERS)


def _added(blocks: DataFrame, column: str, how) -> np.ndarray:
    """One array from those of all tasks, position by position."""
    got = blocks.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(how("x").alias("x")).collect()
    return np.array([r.x for r in sorted(got, key=lambda r: r.at)], np.int64)


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64,
             seed: str = "1", bits: int = 6, sample: int = 4096, block: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector, and the centroids in whole numbers. The beginning centroids are the vectors
    with the k smallest sha256 of `seed:id`; after `rounds` rounds of assignment and floored means all are assigned once more."""
    kept = whole_vectors(vectors, id_col, vector_col, dims, scale)
    spark = kept.sparkSession
    named = kept.where(F.col("id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    first = named.orderBy("h", "v").limit(max(sample, k)).toArrow()
    if not first.num_rows:
        return spark.createDataFrame([], MEMBERS), np.zeros((0, dims), np.int64)
    drawn = scaled(matrix(first.column("v")), scale)
    centroids = drawn[:k]
    cells = Cells(drawn.min(axis=0), drawn.max(axis=0), bits)
    blocks = layout(kept, cells, scale, block)
    cells.reach(_added(blocks, "low", F.min), _added(blocks, "high", F.max))
    sums = np.zeros((len(centroids), dims + 1), np.int64)
    for _ in range(rounds):
        was, blocks = blocks, stored(assigned_round(blocks, cells, centroids), "blocks")
        discard(was)
        sums += _added(blocks, "sums", F.sum).reshape(sums.shape)
        n = sums[:, -1:]
        centroids = np.where(n > 0, sums[:, :-1] // np.maximum(n, 1), centroids)
    return members(blocks, cells, centroids), centroids


def digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The members with the sums of distances of their cluster and of all, and a digest of their centroid."""
    found = stored(found, "members")
    sums = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(j, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, d in sums.items()]
    of_cluster = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
