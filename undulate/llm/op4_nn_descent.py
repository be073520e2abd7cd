"""Embedding near-dedup by NN-descent.

Equal vectors collapse first. The neighbour graph begins with the nearest of each row in buckets of random hyperplanes.
In a round, every node brings its neighbours, and some of those that list it, together in one task; neighbours of a node
that are nearer to each other than what their lists hold take each other in. Rounds end when few lists change. Then

* pairs near the threshold are computed in double precision, and those that reach it are the links;
* where lists are saturated (the last neighbour is still linked) their nodes get new lists of neighbours outside their own
  component, again and again, until the last neighbour of each list is below the threshold or no other component is left;
* the members of a component meet in blocks of bounded size, and only the numbers of links leave a task;
* an audit compares the links of a sample of nodes with brute force over all rows. Each node counts alike, however many links
  it has, and those inside large components, which are counted exactly, don't count; nodes are asked until enough of the
  others were met, or all were asked. While it finds less than the wanted recall, the graph is refined again from further
  hyperplanes.

Rows without an id, and vectors that are null, zero or hold null or non-finite components, link with nothing; their
component is their own id. Vectors of different lengths don't link. Rows that repeat an id are vectors of their own. Other
columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undulate.llm.common import stored
from undulate.llm.components import connected_components
from undulate.llm.vectors import matrix, taking_part, usable

GRAPH = "a long, b long, sim float"
#: A half-precision product of unit vectors is off by less than this.
MARGIN = 0.004
#: The audit asks about so many nodes at once (later four times as many), until so many have told something about recall.
AUDIT, ENOUGH = 1024, 100
#: A node with more links than this, all of them counted, lies in a large component and tells nothing.
LARGE = 512


def halves(rows: np.ndarray) -> list[bytes]:
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    return [x.tobytes() for x in unit.astype("<f2")]


def packed(classes: DataFrame) -> DataFrame:
    """node, dim, half: the unit vector in half precision."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                yield pa.RecordBatch.from_arrays([own.column("node"), own.column("dim"), pa.array(halves(matrix(own.column("v"))))], names=["node", "dim", "half"])

    return classes.select("node", "dim", "v").mapInArrow(work, "node long, dim int, half binary")


def units(column) -> np.ndarray:
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), "<f2").reshape(len(got), -1).astype(np.float32)


def runs_of(batches: Iterator, by: list[str]) -> Iterator:
    """Tables with all rows of a key, from batches sorted by it."""
    import pyarrow as pa

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in by):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar of each list; an edge found more than once counts once."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return once.withColumn("_n", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("_n") <= k).drop("_n")


def bucket_neighbours(packs: DataFrame, n: int, k: int, seeds: range, size: int = 256) -> DataFrame:
    """Nearest rows of another root in buckets of about `size` rows with one sign pattern to random hyperplanes; full buckets are split."""
    import pyarrow as pa

    planes = max(1, int(np.ceil(np.log2(max(2, n / (size / 2))))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                x = units(own.column("half"))
                for s in seeds:
                    h = np.random.default_rng([s, int(d)]).standard_normal((int(d), planes)).astype(np.float32)
                    bucket = ((x @ h > 0) * (1 << np.arange(planes))).sum(axis=1) + (int(d) << 40)
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(x), pa.int32()), pa.array(bucket.astype(np.int64)), *(own.column(c) for c in ("node", "root", "half"))],
                                                     names=["seed", "bucket", "node", "root", "half"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["seed", "bucket", "part"]):
            node, root, x = t.column("node").to_numpy(), t.column("root").to_numpy(), units(t.column("half"))
            if len(node) < 2:
                continue
            for lo in range(0, len(node), 512):
                sims = x[lo : lo + 512] @ x.T
                sims[root[lo : lo + 512, None] == root[None, :]] = -2
                m = min(k, len(node) - 1)
                j = np.argpartition(-sims, m - 1, axis=1)[:, :m].ravel()
                i = np.repeat(np.arange(len(sims)), m)
                other = sims[i, j] > -2
                i, j = i[other], j[other]
                yield edge_batch(node[lo + i], node[j], sims[i, j])

    signed = packs.mapInArrow(sign, "seed int, bucket long, node long, root long, half binary")
    parts = signed.groupBy("seed", "bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    rows = signed.join(parts, ["seed", "bucket"]).withColumn("part", F.pmod(F.xxhash64("node", "seed"), F.col("parts")).cast("int"))
    by = ["seed", "bucket", "part"]
    return rows.select(*by, "node", "root", "half").repartition(*by).sortWithinPartitions(*by).mapInArrow(top, GRAPH)


def edge_batch(a: np.ndarray, b: np.ndarray, sim: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim.astype(np.float32))], names=["a", "b", "sim"])


def joined_round(graph: DataFrame, packs: DataFrame, k: int) -> DataFrame:
    """Pairs of neighbours of one node, of different roots, that are nearer than the last neighbour of a list that would take them in."""
    import pyarrow as pa

    last = graph.groupBy("a").agg(F.min("sim").alias("last"), F.count("*").alias("full"))
    back = graph.select(F.col("b").alias("mid"), F.col("a").alias("node"), "sim")
    back = back.withColumn("_n", F.row_number().over(W.partitionBy("mid").orderBy(F.desc("sim"), "node"))).where(F.col("_n") <= k).select("mid", "node")
    meet = graph.select(F.col("a").alias("mid"), F.col("b").alias("node")).unionByName(back).distinct()
    state = packs.join(last.withColumnRenamed("a", "node"), "node", "left").select("node", "root", "dim", "half", F.when(F.col("full") >= k, F.col("last")).otherwise(F.lit(-2.0)).cast("float").alias("last"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, dim = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.array([t.num_rows for t in held])
            t = pa.concat_tables(held)
            node, root, last, x = *(t.column(c).to_numpy() for c in ("node", "root", "last")), units(t.column("half"))
            for s in np.unique(sizes[sizes > 1]):  # groups of one size meet in one product
                g = np.flatnonzero(sizes == s)
                at = (np.cumsum(sizes) - sizes)[g][:, None] + np.arange(s)
                sims = np.matmul(x[at], x[at].transpose(0, 2, 1))
                sims[root[at][:, :, None] == root[at][:, None, :]] = -2
                i, j, l = np.nonzero(sims > last[at][:, :, None] + 1e-4)
                if len(i):
                    yield edge_batch(node[at[i, j]], node[at[i, l]], sims[i, j, l])

        for t in runs_of(batches, ["dim", "mid"]):
            if held and (rows >= 20_000 or t.column("dim")[0] != dim):
                yield from flush()
                held, rows = [], 0
            dim = t.column("dim")[0]
            held.append(t.select(["node", "root", "half", "last"]))
            rows += t.num_rows
        if held:
            yield from flush()

    rows = meet.join(state, "node").select("dim", "mid", "node", "root", "half", "last").repartition("mid").sortWithinPartitions("dim", "mid")
    return rows.mapInArrow(work, GRAPH)


def refined(graph: DataFrame, packs: DataFrame, n: int, k: int, few: float) -> DataFrame:
    """Rounds until fewer than a share `few` of all places change hands."""
    while True:
        marked = graph.withColumn("_old", F.lit(1))
        both = marked.unionByName(joined_round(graph, packs, k).withColumn("_old", F.lit(0)))
        once = both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("_old").alias("_old"))
        after = stored(once.withColumn("_n", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b")))
                       .where(F.col("_n") <= k).drop("_n"), "graph")
        fresh = after.where("_old = 0").count()
        graph = after.drop("_old")
        if fresh <= few * n * k:
            return graph


def links_of(graph: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of the graph whose cosine in double precision reaches the threshold."""
    v = classes.select("node", "v")
    pairs = graph.where(F.col("sim") >= threshold - MARGIN).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(v.toDF("a", "x"), "a").join(v.toDF("b", "y"), "b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return pairs.where(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")) >= threshold).select("a", "b")


def joined_components(graph: DataFrame, parts: DataFrame, packs: DataFrame, classes: DataFrame, threshold: float, k: int, seeds: range, few: float) -> DataFrame:
    """(node, root) of components that no saturated list keeps apart.

    A list that is full of linked neighbours may leave out links with other components. Its node gets a new list, of the
    nearest nodes of other components that have such lists as well (a list with room takes in its links by itself), and what
    links joins components. This ends when the last neighbour of each list is below the threshold, or when no two components
    are left; where nothing links though lists are full of pairs that may (in half precision), lists get longer.
    """
    while True:
        full = graph.groupBy("a").agg(F.min("sim").alias("last"), F.count("*").alias("n")).where((F.col("n") >= k) & (F.col("last") >= threshold - MARGIN))
        own = packs.drop("root").join(full.select(F.col("a").alias("node")), "node").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
        own = stored(own.select("node", "dim", "half", "root"), "saturated")
        n = own.count()
        if not n or own.select("root").distinct().limit(2).count() < 2:
            return parts
        graph = refined(stored(best(bucket_neighbours(own, n, k, seeds), k), "graph"), own, n, k, few)
        links = stored(links_of(graph, classes, threshold), "joins")
        if links.isEmpty():
            k *= 2
        else:
            parts = stored(connected_components(links.unionByName(parts.toDF("a", "b"))), "roots")


def counted_links(classes: DataFrame, roots: DataFrame, threshold: float, chunk: int = 512) -> DataFrame:
    """(node, links): rows linked with each node, over all pairs of a component, in blocks."""
    import pyarrow as pa

    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    rows = classes.join(roots, "node").join(sizes, "root")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = ["root", "lo", "hi"]
    rows = rows.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "copies", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, by):
            own, lo, hi = t.column("own").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            x, copies, node = matrix(t.column("v")), t.column("copies").to_numpy(), t.column("node").to_numpy()
            x = x / np.linalg.norm(x, axis=1)[:, None]
            i, j = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            for at in range(0, len(i), 512):
                rows_ = i[at : at + 512]
                near = (x[rows_] @ x[j].T >= threshold) & (node[rows_][:, None] != node[j][None, :])
                sums = [(node[rows_], near @ copies[j])] + ([(node[j], copies[rows_] @ near)] if lo != hi else [])
                for who, n in sums:
                    yield pa.RecordBatch.from_arrays([pa.array(who[n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["node", "links"])

    rows = rows.repartition(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(work, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def audited(classes: DataFrame, links: DataFrame, threshold: float, sample: int = AUDIT, enough: int = ENOUGH) -> float:
    """Mean over sampled nodes of the share of a node's links, by brute force over all rows, that were counted.

    Nodes without links, or with more than LARGE that were all counted, don't count; one with more than LARGE of which some
    are missing counts as 0, the share found outside its component.
    """
    import pyarrow as pa

    spark, groups = classes.sparkSession, max(1, -(-classes.count() // sample))
    group, at, step, met, shares = F.pmod(F.xxhash64("node"), F.lit(groups)), 0, 1, 0, 0.0
    while at < groups and met < enough:
        picked = classes.where(group.between(at, at + step - 1)).select("node", "v").toArrow()
        at, step = at + step, 4
        shared = spark.sparkContext.broadcast([(n, np.array(v)) for n, v in zip(picked.column("node").to_pylist(), picked.column("v").to_pylist())])

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = {}
            for n, v in shared.value:
                asked.setdefault(len(v), []).append((n, v / np.linalg.norm(v)))
            for b in batches:
                dims = b.column("dim").to_numpy()
                for d in np.unique(dims):
                    own = b.filter(pa.array(dims == d))
                    x, node, copies = matrix(own.column("v")), own.column("node").to_numpy(), own.column("copies").to_numpy()
                    x = x / np.linalg.norm(x, axis=1)[:, None]
                    for lo in range(0, len(asked.get(d, [])), 512):
                        part = asked[d][lo : lo + 512]
                        who, q = np.array([n for n, _ in part]), np.array([v for _, v in part])
                        n = ((q @ x.T >= threshold) & (who[:, None] != node[None, :])) @ copies
                        yield pa.RecordBatch.from_arrays([pa.array(who[n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["node", "links"])

        true = classes.select("node", "dim", "copies", "v").mapInArrow(work, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
        own = true.join(links, "node", "left").select("true", F.coalesce("links", F.lit(0)).alias("found"))
        share = F.when(F.col("found") <= LARGE, F.col("found") / F.col("true")).when(F.col("found") < F.col("true"), 0.0)
        r = own.agg(F.count(share).alias("n"), F.coalesce(F.sum(share), F.lit(0.0)).alias("s")).first()
        met, shares = met + r.n, shares + r.s
    return shares / met if met else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, k: int = 10, tables: int = 5, few: float = 0.01, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    part = taking_part(vectors, id_col, vector_col)
    classes = part.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn("dim", F.size("v"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    packs = stored(packed(classes).withColumn("root", F.col("node")), "packed")
    n, graph, seed, parts = classes.count(), None, 0, None
    while True:
        seeds = range(seed, seed + tables)
        found = bucket_neighbours(packs, n, k, seeds)
        seed += tables
        graph = stored(best(found if graph is None else found.unionByName(graph), k), "graph")
        graph = refined(graph, packs, n, k, few)
        links = links_of(graph, classes, threshold)
        parts = stored(connected_components(links if parts is None else links.unionByName(parts.toDF("a", "b"))), "roots")
        parts = joined_components(graph, parts, packs, classes, threshold, k, seeds, few)
        counts = stored(counted_links(classes, parts, threshold), "links")
        if audited(classes, counts, threshold) >= recall or seed >= n:
            break
    named = classes.select("node", "v", "first", "copies").join(parts, "node", "left").join(counts, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(ids, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = part.join(named, "v").select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id")
    own = F.col(id_col).cast("long")
    rest = vectors.where(~usable(F.col(vector_col)) | F.col(id_col).isNull()).select(own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
