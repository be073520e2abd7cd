"""Set operations on masks, runs and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_mask(a, b, keys) -> DataFrame:
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def subtract_mask(a, b, keys) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def intersect_mask(a, b, keys) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


def membership(df, keys, **sides) -> DataFrame:
    """Each key once, and for each named condition whether a row of the key meets it: all set operations in one grouping."""
    return df.groupBy(*keys).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in sides.items()])


def run_offsets(frames, group, run, t, order=None) -> DataFrame:
    """First concatenated frame of each run of a group (runs per group are few)."""
    n = frames.groupBy(*group, run).agg((F.max(t) + 1).alias("n_frames"))
    w = Window.partitionBy(*group).orderBy(order or run).rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("offset", F.coalesce(F.sum("n_frames").over(w), F.lit(0)).cast("long"))


def concat_runs(frames, group, run, t, order=None, centre: str | None = None, extra=()) -> DataFrame:
    """Stack the runs of a group on one frame axis; optionally remove each run's median of a column."""
    from undulate.operators.ranks import exact_quantiles

    off = run_offsets(frames, group, run, t, order)
    out = frames.join(off, [*group, run]).withColumn("cat_frame", F.col(t) + F.col("offset"))
    if centre:
        m = exact_quantiles(frames, [*group, run, *extra], centre, {"_med": 0.5})
        out = out.join(m, [*group, run, *extra]).withColumn(centre, F.col(centre) - F.col("_med")).drop("_med")
    return out


def overlap_sets(flags, keys, a: str, b: str) -> DataFrame:
    """Sizes of A∩B, A−B, B−A and their Jaccard index from two 0/1 columns."""
    x, y = F.coalesce(F.col(a).cast("int"), F.lit(0)), F.coalesce(F.col(b).cast("int"), F.lit(0))
    g = flags.groupBy(*keys).agg(
        F.sum(x * y).alias("common"), F.sum(x * (1 - y)).alias("only_a"), F.sum((1 - x) * y).alias("only_b"))
    tot = F.col("common") + F.col("only_a") + F.col("only_b")
    return g.withColumn("jaccard", F.col("common") / F.nullif(tot, F.lit(0)))


def merge_groups(masks, groups, keys, unit: str, voxel) -> tuple[DataFrame, DataFrame]:
    """Union the masks of each group into its representative and renumber 0..n−1 per key.

    ``groups`` maps ``unit`` → ``rep``; unlisted units stand for themselves.
    Returns the merged voxels (column ``new_id``) and the merge log.
    """
    keys = list(keys)
    g = masks.join(groups.select(*keys, unit, "rep"), [*keys, unit], "left").withColumn(
        "rep", F.coalesce("rep", F.col(unit)))
    reps = g.select(*keys, "rep").distinct()
    w = Window.partitionBy(*keys).orderBy("rep")
    ids = reps.withColumn("new_id", F.row_number().over(w).cast("long") - 1)
    merged = g.select(*keys, "rep", *voxel).distinct().join(ids, [*keys, "rep"])
    size = merged.groupBy(*keys, "new_id", "rep").agg(F.count(F.lit(1)).alias("volume"))
    members = g.select(*keys, "rep", unit).distinct().groupBy(*keys, "rep").agg(
        F.array_join(F.array_sort(F.collect_list(F.col(unit).cast("string"))), ";").alias("merged"),
        F.count(F.lit(1)).alias("group_size"))
    return merged, size.join(members, [*keys, "rep"])
