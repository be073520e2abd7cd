"""Connected components of an edge table by alternating stars, one table in the shared folder a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undulate.llm.common import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (a, b); root is the smallest node of its component.

    Every edge points from the larger node down. A large star hangs the larger neighbours of a node on its least one, a
    small star the smaller ones; both keep components and end, in rounds that grow with the logarithm of their size,
    when each node hangs on its root. Minima of a hub are taken before the shuffle; the join back may be split by key.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
