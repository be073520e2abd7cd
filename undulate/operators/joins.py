"""Joins: regions, sources, pairs across runs, intervals, windows around events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_sources(a, b, keys, values, suffixes=("_auto", "_human")) -> DataFrame:
    """Inner join of two result tables with suffixed value columns."""
    keys = list(keys)
    ra = a.select(*keys, *[F.col(v).alias(v + suffixes[0]) for v in values])
    rb = b.select(*keys, *[F.col(v).alias(v + suffixes[1]) for v in values])
    return ra.join(rb, keys)


def match_pairs_across_runs(pairs, group: str, run: str, cols: list[str]) -> DataFrame:
    """The same unit pair (a, b) in two runs of one group, run_a < run_b."""
    l = pairs.select(group, "a", "b", F.col(run).alias("run_1"), *[F.col(c).alias(c + "_1") for c in cols])
    r = pairs.select(group, "a", "b", F.col(run).alias("run_2"), *[F.col(c).alias(c + "_2") for c in cols])
    return l.join(r, [group, "a", "b"]).filter(F.col("run_1") < F.col("run_2"))


def nearest_k(points, keys, unit, xyz, k: int) -> DataFrame:
    """k nearest other units per unit within a recording, by blocks of units.

    Points of a recording are hashed into blocks; a pair of blocks is one task
    that returns each unit's k best of that block, and the merge keeps the k
    best of all. No task holds more than two blocks.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    keys = list(keys)
    block = 1024
    p = points.select(*keys, F.col(unit).alias("_u"), F.array(*[F.col(c).cast("double") for c in xyz]).alias("_p"))
    nb = p.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    p = p.join(nb, keys).withColumn("_blk", F.pmod(F.xxhash64("_u"), F.col("_nb")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    q = p.withColumn("_o", every)
    src = q.select(*keys, "_u", "_p", F.lit(0).alias("_side"), F.col("_blk").alias("_q"), F.col("_o").alias("_c")) \
        .unionByName(q.select(*keys, "_u", "_p", F.lit(1).alias("_side"), F.col("_o").alias("_q"), F.col("_blk").alias("_c")))
    ut = p.schema["_u"].dataType
    schema = T.StructType([p.schema[c] for c in keys] + [
        T.StructField("a", ut), T.StructField("b", ut), T.StructField("dist", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        pa, pb = np.stack(a["_p"].to_numpy()), np.stack(b["_p"].to_numpy())
        ua, ub = a["_u"].to_numpy(), b["_u"].to_numpy()
        rows = []
        for i in range(len(ua)):
            dist = np.sqrt(((pb - pa[i]) ** 2).sum(1))
            dist[ub == ua[i]] = np.inf
            o = np.lexsort((ub, dist))[:k]
            o = o[np.isfinite(dist[o])]
            rows.append(pd.DataFrame({"a": ua[i], "b": ub[o], "dist": dist[o]}))
        out = pd.concat(rows)
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[f.name for f in schema.fields]]

    best = src.groupBy(*keys, "_q", "_c").applyInPandas(run, schema)
    w = Window.partitionBy(*keys, "a").orderBy("dist", "b")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def onset_lag_pairs(onsets, keys, unit, t, max_lag: int) -> DataFrame:
    """Onsets of two different units with 1 ≤ t_b − t_a ≤ L.

    Each onset is sent to the L frames that may follow it and meets the onsets
    there on equality of (key, frame): no bucket wider than one frame.
    """
    keys = list(keys)
    a = onsets.select(*keys, F.col(unit).alias("a"), F.col(t).alias("t_a"),
                      F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"))
    a = a.withColumn("t_b", F.col("t_a") + F.col("lag"))
    b = onsets.select(*keys, F.col(unit).alias("b"), F.col(t).alias("t_b"))
    return a.join(b, [*keys, "t_b"]).filter(F.col("a") != F.col("b"))


def lag_pair_counts(onsets, keys, unit, t, max_lag: int) -> DataFrame:
    """Directed counts of (a then b within L frames)."""
    return onset_lag_pairs(onsets, keys, unit, t, max_lag).groupBy(*keys, "a", "b").agg(
        F.count(F.lit(1)).alias("n"))


def onset_lag_triplet_counts(onsets, keys, unit, t, max_lag: int) -> DataFrame:
    """Counts of a → b → c with both steps within L and three different units.

    The chain is counted through the middle onset: its predecessors per unit
    and its successors per unit are aggregated before they meet.
    """
    keys = list(keys)
    p = onset_lag_pairs(onsets, keys, unit, t, max_lag)
    first = p.groupBy(*keys, "a", "b", F.col("t_b").alias("t_m")).agg(F.count(F.lit(1)).alias("_n1"))
    second = p.groupBy(*keys, F.col("a").alias("b"), F.col("b").alias("c"), F.col("t_a").alias("t_m")).agg(
        F.count(F.lit(1)).alias("_n2"))
    return first.join(second, [*keys, "b", "t_m"]).filter(F.col("a") != F.col("c")).groupBy(*keys, "a", "b", "c").agg(
        F.sum(F.col("_n1") * F.col("_n2")).alias("n"))


def nearest_onset(left, right, keys, t, width: int, extra=()) -> DataFrame:
    """For each left row the nearest right onset within ±width frames (earlier wins ties); NULL when none."""
    keys = list(keys)
    r = right.select(*keys, F.col(t).alias("_rt"), F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("_dt"))
    r = r.withColumn(t, F.col("_rt") - F.col("_dt"))
    best = r.groupBy(*keys, t).agg(F.min_by("_dt", F.struct(F.abs("_dt"), F.col("_dt"))).alias("dt"))
    return left.join(best, [*keys, t], "left")


def window_around_events(events, frames, keys, ev_frame, t, pre: int, post: int, complete: bool = True,
                         on=None) -> DataFrame:
    """Frames −pre…post around each event (column ``offset``); incomplete windows dropped.

    ``on`` names the keys shared with ``frames`` (all keys by default).
    """
    on = list(on if on is not None else keys)
    if complete:
        span = frames.groupBy(*on).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
        events = events.join(span, on).filter(
            (F.col(ev_frame) - pre >= F.col("_lo")) & (F.col(ev_frame) + post <= F.col("_hi"))).drop("_lo", "_hi")
    e = events.withColumn("offset", F.explode(F.sequence(F.lit(-pre), F.lit(post)))).withColumn(
        t, F.col(ev_frame) + F.col("offset"))
    return e.join(frames, [*on, t])


def exclude_near(onsets, bounds, keys, t, width: int) -> DataFrame:
    """Drop onsets within ``width`` frames of a boundary."""
    keys = list(keys)
    near = bounds.select(*keys, F.col(t).alias("_b"), F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("_o"))
    near = near.select(*keys, (F.col("_b") + F.col("_o")).alias(t)).distinct()
    return onsets.join(near, [*keys, t], "left_anti")


def label_by_log(df, log, name: str) -> DataFrame:
    """Join with a curation log: 'kept', 'rejected' or 'unseen'."""
    l = log.groupBy(name).agg(F.max("kept").alias("_k"))
    return df.join(l, name, "left").withColumn(
        "label", F.when(F.col("_k") == 1, "kept").when(F.col("_k") == 0, "rejected").otherwise("unseen")).drop("_k")


def resolve_params(runs, session, run_params, session_key, run_key, names: dict[str, Column]) -> DataFrame:
    """Run override, else session value, else the default."""
    s = session.select(session_key, *[F.col(n).alias(f"_s_{n}") for n in names])
    r = run_params.select(run_key, *[F.col(n).alias(f"_r_{n}") for n in names])
    j = runs.join(s, session_key, "left").join(r, run_key, "left")
    return j.select(*runs.columns, *[F.coalesce(f"_r_{n}", f"_s_{n}", d).alias(n) for n, d in names.items()])


def attach_mask_source(runs, run: str = "run_id", source: str = "mask_source") -> DataFrame:
    """A run without masks of its own uses those of the named run."""
    return runs.withColumn("mask_run", F.coalesce(source, run))


def attach_dimension(df, dim, on) -> DataFrame:
    """Dimension lookup; the planner broadcasts the dimension when its measured size allows."""
    return df.join(dim, on, "left")


def exclude_other_masks(region, masks, voxel_keys, unit: str) -> DataFrame:
    """Region voxels not claimed by any other unit's mask.

    Per voxel the least and greatest claiming unit decide whether someone else
    claims it, so a voxel claimed by many units joins once.
    """
    voxel_keys = list(voxel_keys)
    claim = masks.groupBy(*voxel_keys).agg(F.min(unit).alias("_lo"), F.max(unit).alias("_hi"))
    j = region.join(claim, voxel_keys, "left")
    alone = F.col("_lo").isNull() | ((F.col("_lo") == F.col(unit)) & (F.col("_hi") == F.col(unit)))
    return j.filter(alone).drop("_lo", "_hi")
