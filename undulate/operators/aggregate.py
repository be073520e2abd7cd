"""Aggregations of traces, voxels and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undulate.operators.ranks import exact_quantiles, ranked_values


def region_mean_trace(regions, frames, voxel_keys, unit_keys, t, v) -> DataFrame:
    """Mean of the region's voxels per frame (hash join on the voxel, then partial + final average)."""
    return regions.join(frames, list(voxel_keys)).groupBy(*unit_keys, t).agg(
        F.avg(v).alias("value"), F.count(F.lit(1)).alias("n_vox"))


def binned_region_trace(regions, frames, voxel_keys, unit_keys, bin_col, t, v) -> DataFrame:
    return regions.join(frames, list(voxel_keys)).groupBy(*unit_keys, bin_col, t).agg(
        F.sum(v).alias("sum_v"), F.count(F.lit(1)).alias("n_vox"))


def core_shell_trace(region_traces, unit_keys, t) -> DataFrame:
    """mean(core) − mean(shell); a unit without a shell subtracts nothing."""
    w = region_traces.groupBy(*unit_keys, t).agg(
        F.max(F.when(F.col("region") == "core", F.col("value"))).alias("core"),
        F.max(F.when(F.col("region") == "shell", F.col("value"))).alias("shell"))
    return w.withColumn("value", F.col("core") - F.coalesce("shell", F.lit(0.0)))


def global_trace(frames, live, run_keys, voxel_keys, t, v, q: float = 0.1) -> DataFrame:
    """Mean of the live voxels per frame, as percent change against a low quantile of that mean."""
    run_keys = list(run_keys)
    g = frames.join(live, [*run_keys, *voxel_keys], "left_semi").groupBy(*run_keys, t).agg(F.avg(v).alias("mean_v"))
    f0 = g.groupBy(*run_keys).agg(F.percentile("mean_v", q).alias("_f0"))
    return g.join(f0, run_keys).withColumn(
        "global_dff", (F.col("mean_v") - F.col("_f0")) / F.nullif(F.col("_f0"), F.lit(0.0)) * 100.0).drop("_f0")


def depth_band(y: str, ny: int | Column, n: int) -> Column:
    """Equal-height layer number of a depth."""
    return F.floor(F.col(y) * n / (ny if isinstance(ny, Column) else F.lit(ny))).cast("long")


def project(frames, run_keys, keep_axes, v, mode: str, q: float = 0.5) -> DataFrame:
    agg = {"mean": F.avg(v), "max": F.max(v), "min": F.min(v), "percentile": F.percentile(v, q)}[mode]
    return frames.groupBy(*run_keys, *keep_axes).agg(agg.alias(v))


def bin_xy(frames, run_keys, y, x, v, b: int, ny: int, nx: int, others=()) -> DataFrame:
    """b×b mean binning; rows and columns beyond the last full bin are cropped."""
    f = frames.filter((F.col(y) < ny // b * b) & (F.col(x) < nx // b * b))
    return f.groupBy(*run_keys, *others, F.floor(F.col(y) / b).cast("long").alias(y),
                     F.floor(F.col(x) / b).cast("long").alias(x)).agg(F.avg(v).alias(v))


def frame_quantile_score(proj, run_keys, t, v, hi: float = 0.999, lo: float = 0.6) -> DataFrame:
    """Spread between two quantiles of each projected frame (its pixels bound the group)."""
    return proj.groupBy(*run_keys, t).agg((F.percentile(v, hi) - F.percentile(v, lo)).alias("score"))


def unit_morphology(masks, keys, vz: float = 1.0, vy: float = 1.0, vx: float = 1.0) -> DataFrame:
    """Voxel count, volume, centroid, bounding box and spans."""
    m = masks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_vox"), F.avg("z").alias("cz"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        *[f(a).alias(f"{n}_{a}") for a in ("z", "y", "x") for f, n in ((F.min, "min"), (F.max, "max"))])
    for a, s in (("z", vz), ("y", vy), ("x", vx)):
        m = m.withColumn(f"{a}span", F.col(f"max_{a}") - F.col(f"min_{a}") + 1)
        m = m.withColumn(f"{a}span_um", F.col(f"{a}span") * s)
    return m.withColumn("volume_um3", F.col("n_vox") * (vz * vy * vx))


def events_per_unit(events, units, keys, n_frames: int, rate: float, amp="amp", dur="duration") -> DataFrame:
    """Counts, rate per minute, amplitudes, durations and the active share; units without events count 0."""
    keys = list(keys)
    e = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(amp).alias("mean_amp"), F.percentile(amp, 0.5).alias("median_amp"),
        F.max(amp).alias("max_amp"), F.avg(dur).alias("mean_dur"), F.sum(dur).alias("_d"))
    minutes = n_frames / rate / 60.0
    return units.select(*keys).distinct().join(e, keys, "left").select(
        *keys, F.coalesce("n_events", F.lit(0)).alias("n_events"),
        (F.coalesce("n_events", F.lit(0)) / minutes).alias("rate_per_min"), "mean_amp", "median_amp", "max_amp",
        "mean_dur", (F.coalesce("_d", F.lit(0)) / n_frames).alias("active_fraction"))


def average_by_group(df, keys, values) -> DataFrame:
    """Run metrics averaged within a field of view, with the number of runs."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_runs"))


def gini_and_shares(df, keys, v, shares=(0.05, 0.1, 0.2)) -> DataFrame:
    """Gini coefficient and share of the total held by the top ceil(f·N) rows.

    Both are sums over distinct values with their rank offsets, so ties and hot
    values cost one row each.
    """
    keys = list(keys)
    r = ranked_values(df, keys, v)
    n, c, below, x = F.col("n"), F.col("c"), F.col("below"), F.col(v)
    aggs = [F.max(n).alias("n"), F.sum(x * c).alias("total"),
            F.sum(x * (c * below + c * (c + 1) / 2)).alias("_w")]
    for f in shares:
        k = F.ceil(n * F.lit(f) - F.lit(1e-9))
        above = n - below - c
        take = F.greatest(F.lit(0), F.least(c, k - above))
        aggs.append(F.sum(x * take).alias(f"_t{int(f * 100)}"))
    g = r.groupBy(*keys).agg(*aggs)
    tot = F.nullif(F.col("total"), F.lit(0.0))
    return g.select(
        *keys, "n", "total", ((2 * F.col("_w") / tot - (n + 1)) / n).alias("gini"),
        *[(F.col(f"_t{int(f * 100)}") / tot).alias(f"top{int(f * 100)}pct") for f in shares])


def histogram(df, keys, v, edges: list[float]) -> DataFrame:
    """Counts per bin [e_i, e_{i+1}), the last bin closed; values outside are left out."""
    last = len(edges) - 1
    b = None
    for i in range(last):
        hit = (F.col(v) >= edges[i]) & ((F.col(v) <= edges[i + 1]) if i == last - 1 else (F.col(v) < edges[i + 1]))
        b = F.when(hit, F.lit(i)) if b is None else b.when(hit, F.lit(i))
    return df.withColumn("bin", b.cast("long")).filter(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"))


def binned_mean_sem(df, keys, x, y, lo: float, width: float, min_n: int = 1) -> DataFrame:
    """Mean and standard error of y in equal bins of x; small bins give NULL."""
    b = F.floor((F.col(x) - lo) / width).cast("long")
    g = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("_m"), F.stddev_samp(y).alias("_s"))
    ok = F.col("n") >= min_n
    return g.select(*keys, "bin", "n", F.when(ok, F.col("_m")).alias("mean"),
                    F.when(ok, F.col("_s") / F.sqrt("n")).alias("sem"))


def fano_silent(counts, keys, n) -> DataFrame:
    """Variance/mean of the co-active count (population) and the share of silent frames."""
    return counts.groupBy(*keys).agg(
        (F.var_pop(n) / F.nullif(F.avg(n), F.lit(0.0))).alias("fano"),
        F.avg((F.col(n) == 0).cast("double")).alias("silent_fraction"), F.avg(n).alias("mean_count"))


def median_trace(df, run_keys, t, v) -> DataFrame:
    """Median across units per frame (exact for any number of units)."""
    return exact_quantiles(df, [*run_keys, t], v, {"median": 0.5})


def distinct_share(df, keys, item) -> DataFrame:
    """Number of distinct items and its share of the rows, counted in two mergeable steps."""
    per = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("_c").alias("n")).withColumn(
        "diversity", F.col("n_distinct") / F.col("n"))


def melt_metrics(df, ids, metrics) -> DataFrame:
    return df.unpivot(list(ids), list(metrics), "metric", "value")


def pivot_metric(df, ids, values: list[str], metric="metric", value="value") -> DataFrame:
    return df.groupBy(*ids).pivot(metric, values).agg(F.first(value))


def named_run_summary(df, keys, mask, v, p) -> DataFrame:
    """Number of masks, mean and median of v, share of p < 0.05."""
    n = df.select(*keys, mask).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_masks"))
    m = exact_quantiles(df, keys, v, {"median_v": 0.5})
    a = df.groupBy(*keys).agg(F.avg(v).alias("mean_v"), F.avg((F.col(p) < 0.05).cast("double")).alias("frac_sig"))
    return a.join(m, list(keys)).join(n, list(keys))


def share_of_variance(df, group, v, keys=()) -> DataFrame:
    """η²: between-group share of the sum of squares."""
    keys = list(keys)
    g = df.filter(F.col(v).isNotNull()).groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(v).alias("_m"), (F.var_pop(v) * F.count(v)).alias("_w"))
    t = g.groupBy(*keys).agg(
        F.sum("_w").alias("_w"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_groups"),
        (F.sum(F.col("_n") * F.col("_m") * F.col("_m"))
         - F.sum(F.col("_n") * F.col("_m")) * F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_b"))
    return t.select(*keys, "n", "n_groups",
                    (F.col("_b") / F.nullif(F.col("_b") + F.col("_w"), F.lit(0.0))).alias("eta2"))


