"""Connected components and other iterative graph jobs on edge tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undulate.session import cut_lineage


def connected_components(edges: DataFrame, keys: Sequence[str], src: str, dst: str) -> DataFrame:
    """``keys, node, component`` for every node on an edge; component = least node id reachable.

    Alternating large-star / small-star rounds (Kiveris et al., 2014): the
    number of rounds grows with the logarithm of the component size. A round
    uses minima and joins only, so a hub is never gathered in one place. State
    is checkpointed each round; the driver sees one signature row.
    """
    keys = list(keys)
    e = edges.select(*keys, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e)
    last = None
    while True:
        sym = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        m = sym.groupBy(*keys, "u").agg(F.min("v").alias("_mv")).select(*keys, "u", F.least("u", "_mv").alias("m"))
        large = sym.filter("v > u").join(m, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        s = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(s, [*keys, "u"]).filter("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(s.withColumnRenamed("m", "v")).distinct())
        sig = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if sig == last:
            break
        last = sig
    roots = e.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def components_with_singletons(nodes: DataFrame, edges: DataFrame, keys, node: str, src: str, dst: str) -> DataFrame:
    """As above, with isolated nodes as their own component."""
    keys = list(keys)
    c = connected_components(edges, keys, src, dst).withColumnRenamed("node", node)
    return nodes.select(*keys, node).distinct().join(c, [*keys, node], "left").withColumn(
        "component", F.coalesce("component", F.col(node)))


def bfs_levels(edges: DataFrame, roots: DataFrame, keys) -> DataFrame:
    """Hop count from the nearest root along undirected edges (src, dst)."""
    keys = list(keys)
    sym = cut_lineage(edges.select(*keys, "src", "dst").unionByName(
        edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = cut_lineage(roots.select(*keys, "node").distinct().withColumn("order", F.lit(0).cast("long")))
    front = seen
    for i in count(1):
        nxt = sym.join(front.select(*keys, F.col("node").alias("src")), [*keys, "src"]).select(
            *keys, F.col("dst").alias("node")).distinct()
        nxt = cut_lineage(nxt.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn(
            "order", F.lit(i).cast("long")))
        if nxt.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(nxt))
        front = nxt
    return seen


def first_wins(nodes: DataFrame, conflicts: DataFrame, keys, node: str) -> DataFrame:
    """Greedy in node order: a node is kept unless an earlier *kept* node conflicts with it.

    ``conflicts`` has (keys, a, b), a before b. Each round decides every node
    whose earlier conflicting nodes are decided: it is dropped when one of them
    is kept, kept when all are dropped. Rounds equal the longest chain.
    """
    keys = list(keys)
    state = cut_lineage(nodes.select(*keys, F.col(node).alias("node")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    c = cut_lineage(conflicts.select(*keys, "a", "b").distinct())
    while True:
        st = state.select(*keys, F.col("node").alias("a"), F.col("kept").alias("_ka"))
        v = c.join(st, [*keys, "a"]).groupBy(*keys, F.col("b").alias("node")).agg(
            F.max(F.coalesce("_ka", F.lit(False)).cast("int")).alias("_hit"), F.max(F.col("_ka").isNull().cast("int")).alias("_open"))
        j = state.join(v, [*keys, "node"], "left")
        new = (F.when(F.col("kept").isNotNull(), F.col("kept"))
               .when(F.col("_hit") == 1, F.lit(False))
               .when(F.coalesce("_open", F.lit(0)) == 0, F.lit(True)))
        state = cut_lineage(j.select(*keys, "node", new.alias("kept")))
        if state.filter(F.col("kept").isNull()).isEmpty():
            break
    return state.select(*keys, F.col("node").alias(node), "kept")


def mutual_best_matching(scores: DataFrame, keys, a: str, b: str, score: str) -> DataFrame:
    """One-to-one matching: repeatedly accept pairs that are each other's best among the unmatched.

    Equals greedy matching by descending score (ties by ids). An optimal
    assignment is not attempted.
    """
    keys = list(keys)
    rest = cut_lineage(scores.select(*keys, a, b, score))
    out = None
    while True:
        # one strict order of pairs seen from either side
        o = F.struct((-F.col(score)).alias("s"), F.col(a).alias("x"), F.col(b).alias("y"))
        ba = rest.groupBy(*keys, a).agg(F.min(o).alias("_o")).select(*keys, a, F.col("_o.y").alias(b), (-F.col("_o.s")).alias(score))
        bb = rest.groupBy(*keys, b).agg(F.min(o).alias("_o")).select(*keys, F.col("_o.x").alias(a), b)
        hit = cut_lineage(ba.join(bb, [*keys, a, b]))
        if hit.isEmpty():
            break
        out = hit if out is None else cut_lineage(out.unionByName(hit))
        rest = cut_lineage(rest.join(hit.select(*keys, a), [*keys, a], "left_anti").join(
            hit.select(*keys, b), [*keys, b], "left_anti"))
        if rest.isEmpty():
            break
    return out if out is not None else rest
