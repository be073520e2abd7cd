"""Composite tables built from the other operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undulate.operators.blocks import components
from undulate.operators.joins import window_around_events
from undulate.operators.nulls import shift_list
from undulate.operators.ranks import exact_quantiles, pearson, with_average_rank
from undulate.operators.rolling import gaussian_smooth_1d, island_table, refractory_seen
from undulate.operators.signal import linear_detrend, regress_out
from undulate.session import cut_lineage


def burst_bands(active, grid, run_keys, t, n_units: DataFrame, sigma: float, n_frames: int, k: float = 1.0) -> DataFrame:
    """Islands where the smoothed active share exceeds its mean + k·sd."""
    run_keys = list(run_keys)
    c = active.groupBy(*run_keys, t).agg(F.count(F.lit(1)).alias("_c"))
    s = grid.join(c, [*run_keys, t], "left").join(n_units, run_keys).withColumn("_f", F.coalesce("_c", F.lit(0)) / F.col("n_units"))
    s = gaussian_smooth_1d(s, run_keys, t, "_f", sigma, n_frames, "share")
    m = s.groupBy(*run_keys).agg((F.avg("share") + k * F.stddev_pop("share")).alias("_thr"))
    return island_table(s.join(m, run_keys).filter(F.col("share") > F.col("_thr")), run_keys, t, 1)


def rate_triggered_snippets(rate, signal, run_keys, t, r: str, v: str, pre: int, post: int, k: float = 2.0, min_sep: int = 3) -> DataFrame:
    """Mean ± SEM of a signal around frames whose rate exceeds mean + k·sd, close neighbours dropped."""
    run_keys = list(run_keys)
    m = rate.groupBy(*run_keys).agg((F.avg(r) + k * F.stddev_pop(r)).alias("_thr"))
    hit = refractory_seen(rate.join(m, run_keys).filter(F.col(r) > F.col("_thr")).select(*run_keys, t), run_keys, t, min_sep)
    w = window_around_events(hit.withColumnRenamed(t, "_ev"), signal.select(*run_keys, t, v), run_keys, "_ev", t, pre, post)
    return w.groupBy(*run_keys, "offset").agg(F.avg(v).alias("mean_v"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"), F.count(v).alias("n"))


def bimodality(df, keys, v: str) -> DataFrame:
    """Sarle's coefficient from sample skewness and excess kurtosis."""
    keys = list(keys)
    g = df.groupBy(*keys).agg(F.count(v).cast("double").alias("n"), F.skewness(v).alias("_g"), F.kurtosis(v).alias("_k"))
    n = F.col("n")
    s = F.col("_g") * F.sqrt(n * (n - 1)) / (n - 2)
    k = ((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * F.col("_k") + 6)
    return g.select(*keys, F.col("n").cast("long").alias("n"), ((s * s + 1) / (k + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))).alias("bc"))


def density_modes(df, keys, v: str, grid_n: int = 64, bins: int = 512) -> DataFrame:
    """Kernel density on a grid, its modes and the valley/peak ratio between the two highest.

    Rows collapse to fine bins first; the kernel then meets bins × grid points,
    whatever the number of rows.
    """
    from undulate.operators.rolling import local_maxima

    keys = list(keys)
    m = df.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.stddev_samp(v).alias("_s"), F.count(v).alias("_n"))
    m = m.withColumn("_h", 1.06 * F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    m = m.withColumn("_a", F.col("_lo") - 3 * F.col("_h")).withColumn("_w", (F.col("_hi") - F.col("_lo") + 6 * F.col("_h")))
    b = df.join(m, keys).withColumn("_b", F.floor((F.col(v) - F.col("_a")) / F.col("_w") * bins)).groupBy(*keys, "_b", "_h", "_w").agg(
        F.count(F.lit(1)).alias("_c"))
    g = b.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid_n - 1).cast("long"))))
    u = ((F.col("g") + 0.5) / grid_n - (F.col("_b") + 0.5) / bins) * F.col("_w") / F.col("_h")
    d = g.groupBy(*keys, "g").agg(F.sum(F.col("_c") * F.exp(-0.5 * u * u)).alias("d"))
    pk = local_maxima(d.withColumn("d", F.round("d", 9)), keys, "g", "d")
    top = pk.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("height"), -F.col("peak"))), asc=False), 1, 2).alias("_t"),
                                F.count(F.lit(1)).alias("n_modes"))
    x = top.withColumn("_p", -F.col("_t")[0]["col2"]).withColumn(
        "_q", F.when(F.size("_t") > 1, -F.try_element_at("_t", F.lit(2))["col2"])).withColumn(
        "_h2", F.when(F.size("_t") > 1, F.try_element_at("_t", F.lit(2))["height"]))
    val = d.join(x, keys).filter((F.col("g") >= F.least("_p", "_q")) & (F.col("g") <= F.greatest("_p", "_q"))).groupBy(*keys).agg(F.min("d").alias("_v"))
    return x.join(val, keys, "left").select(*keys, "n_modes", (F.col("_v") / F.col("_h2")).alias("valley_ratio"))


def coupled_fraction(traces, signals, run_keys, unit, signal, t, v, sv, n_frames: int, min_shift: int, n_shift: int) -> DataFrame:
    """Share of units beyond their own shift null, raw and after removing the run's mean trace."""
    from undulate.operators.nulls import coupling

    run_keys = list(run_keys)
    g = traces.groupBy(*run_keys, t).agg(F.avg(v).alias("_g"))
    res = regress_out(traces.join(g, [*run_keys, t]), [*run_keys, unit], v, "_g", "_res")
    both = traces.select(*run_keys, unit, t, F.col(v).alias("x")).withColumn("variant", F.lit("raw")).unionByName(
        res.select(*run_keys, unit, t, F.col("_res").alias("x")).withColumn("variant", F.lit("residual")))
    both = both.withColumn("uv", F.concat_ws("|", "variant", F.col(unit).cast("string")))
    c = coupling(both, signals, run_keys, "uv", signal, t, "x", sv, shift_list(n_shift, n_frames, min_shift))
    c = c.withColumn("variant", F.split_part("uv", F.lit("|"), F.lit(1)))
    return c.groupBy(*run_keys, signal, "variant").agg(
        F.avg((F.abs("r") > F.col("null_q")).cast("double")).alias("coupled_fraction"), F.count(F.lit(1)).alias("n"))


def group_slopes(df, keys, y: str, x: str) -> DataFrame:
    """OLS slope with standard error and r² per group."""
    n = F.count(F.when(F.col(x).isNotNull(), F.col(y))).cast("double")
    g = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"),
                              F.regr_syy(y, x).alias("_syy"), n.alias("n"))
    se = F.sqrt((1 - F.col("r2")) * F.col("_syy") / F.nullif(F.col("n") - 2, F.lit(0.0)) / F.col("_sxx"))
    return g.select(*keys, F.col("n").cast("long").alias("n"), "slope", se.alias("se"), "r2")


def adjacency_sweep(masks, rates, run_keys, unit: str, radii: list[float], size=(1.0, 1.0, 1.0)) -> DataFrame:
    """Family sizes and the relation of a unit value to its family size for several adjacency radii, in one job.

    ``rates`` has a row a unit (None: its number of voxels). Runs of few voxels are worked out whole in a task: families grow
    from radius to radius. Of other runs distances are computed once at the largest radius, which is a key of the component job.
    Rows collapse to counts of (radius, size, rate) before they are ranked.
    """
    from undulate.operators.voxels import by_size, in_whole_runs

    run_keys, radii = list(run_keys), sorted({float(r) for r in radii})
    few, many = by_size(masks, run_keys)

    def work(t, u):
        label, done = np.arange(len(u.n)), -1.0
        for r in radii:
            new = (u.dist > done + 1e-9) & (u.dist <= r + 1e-9)
            a, b = label[u.a[new]], label[u.b[new]]
            label, done = components(len(label), a[a != b], b[a != b])[label], r
            yield u.row, {"radius": np.full(len(label), r), "size": np.bincount(label, minlength=len(label))[label], "rate": u.n.astype(float)}

    c = in_whole_runs(few, run_keys, unit, max(radii), size, work, "radius double, size long, rate double")
    if many is not None:
        c = c.unionByName(_sweep_in_rounds(many, run_keys, unit, radii, size))
    if rates is not None:
        c = c.drop("rate").join(rates.select(*run_keys, unit, "rate"), [*run_keys, unit])
    c = cut_lineage(c.groupBy("radius", "size", "rate").agg(F.count(F.lit(1)).alias("_m")))  # few rows, read for both ranks
    c = with_average_rank(with_average_rank(c, ["radius"], "size", "_rs", rows="_m"), ["radius"], "rate", "_rr", rows="_m")
    c = c.join(c.filter("rate IS NOT NULL").groupBy("radius").agg(((F.sum("_m") + 1) / 2).alias("_mid")), "radius", "left")
    x = F.col("_rs") - F.col("_mid")
    y = F.col("_rr") - F.col("_mid")
    return c.groupBy("radius").agg(F.sum("_m").alias("n_units"), F.max("size").alias("largest"), _weighted_r(x, y).alias("rho"))


def _weighted_r(x, y):
    """Correlation of deviations x and y of which each stands for ``_m`` rows; NULL on a constant side."""
    s = lambda e: F.sum(F.col("_m") * e)
    return s(x * y) / F.nullif(F.sqrt(s(x * x) * s(y * y)), F.lit(0.0))


def _sweep_in_rounds(masks, run_keys, unit: str, radii: list[float], size) -> DataFrame:
    from undulate.operators.graph import components_with_singletons
    from undulate.operators.voxels import ZYX, unit_distance

    masks = masks.select(*run_keys, unit, *ZYX).distinct()
    e = unit_distance(masks, run_keys, unit, max(radii), size)
    lv = F.explode(F.array(*[F.lit(r) for r in radii]))
    n = masks.groupBy(*run_keys, unit).agg(F.count(F.lit(1)).cast("double").alias("rate"))
    c = components_with_singletons(n.select(*run_keys, unit).withColumn("radius", lv), e.withColumn("radius", lv).filter(F.col("dist") <= F.col("radius") + 1e-9),
                                   [*run_keys, "radius"], unit, "a", "b")
    sizes = c.groupBy(*run_keys, "radius", "component").agg(F.count(F.lit(1)).alias("size"))
    return c.join(sizes, [*run_keys, "radius", "component"]).join(n, [*run_keys, unit]).select(*run_keys, unit, "radius", "size", "rate")


def cutoff_sweep(events, keys, share: str, cutoffs: list[float]) -> DataFrame:
    """Counts of localized and extended events per cut-off on the recruited share."""
    e = events.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    ext = F.col(share) >= F.col("cutoff")
    g = e.groupBy(*keys, "cutoff").agg(F.count_if(~ext).alias("localized"), F.count_if(ext).alias("extended"))
    return g.withColumn("ratio", F.col("localized") / F.nullif(F.col("extended"), F.lit(0)))


def class_profile(counts, keys, n_local: str, n_global: str, values: list[str], bounded: bool = False) -> DataFrame:
    """Label each unit by its event counts and give medians per label."""
    lab = (F.when((F.col(n_local) == 0) & (F.col(n_global) == 0), "silent").when(F.col(n_global) == 0, "local_only")
           .when(F.col(n_local) == 0, "global_only").otherwise("mixed"))
    x = counts.withColumn("label", lab)
    k = [*keys, "label"]
    out = x.groupBy(*k).agg(F.count(F.lit(1)).alias("n_units"))
    for v in values:
        out = out.join(exact_quantiles(x, k, v, {f"median_{v}": 0.5}, bounded), k)
    return out


def extreme_rows(df, keys, t, row, v: str, q_lo: float, q_hi: float) -> DataFrame:
    """Rows of each frame whose mean lies outside quantile bounds of the recording's row means."""
    keys = list(keys)
    r = df.groupBy(*keys, t, row).agg(F.avg(v).alias("_m"))
    q = exact_quantiles(r, keys, "_m", {"_lo": q_lo, "_hi": q_hi})
    return r.join(q, keys).groupBy(*keys, t).agg(
        F.count_if(F.col("_m") > F.col("_hi")).alias("n_above"), F.count_if(F.col("_m") < F.col("_lo")).alias("n_below"))


def resolve_fov(runs, known, pair_status, run: str, session: str) -> DataFrame:
    """Field label from existing tables; else the session's group if every run pair of the session is known; else the run itself.

    ``pair_status``: session, run_a, run_b, same (1/0). An incomplete session is flagged.
    """
    n = runs.groupBy(session).agg(F.count(F.lit(1)).alias("_n"))
    p = pair_status.groupBy(session).agg(F.count(F.lit(1)).alias("_p"))
    comp = n.join(p, session, "left").select(session, (F.coalesce("_p", F.lit(0)) == F.col("_n") * (F.col("_n") - 1) / 2).alias("_full"))
    same = pair_status.filter("same = 1")
    links = same.select(F.col("run_a").alias(run), F.col("run_b").alias("_o")).unionByName(same.select(F.col("run_b").alias(run), F.col("run_a").alias("_o")))
    first = links.groupBy(run).agg(F.min("_o").alias("_o"))
    j = runs.join(known.select(run, F.col("fov").alias("_k")), run, "left").join(comp, session).join(first, run, "left")
    lab = F.when(F.col("_k").isNotNull(), F.col("_k")).when(F.col("_full"), F.least(F.col(run), F.coalesce("_o", F.col(run)))).otherwise(F.col(run))
    return j.select(run, session, lab.alias("fov"), (F.col("_k").isNull() & ~F.col("_full")).cast("long").alias("incomplete"))


def band_lag_profile(frames, signal, run_keys, band: str, t, v: str, s: str, max_lag: int, dip: tuple[int, int]) -> DataFrame:
    """Detrended band series against a signal over ±L frames: r at the dip window's minimum and the peak lag."""
    run_keys = list(run_keys)
    x = linear_detrend(frames, [*run_keys, band], t, v, "_u").select(*run_keys, band, t, "_u")
    sg = signal.select(*run_keys, F.col(t).alias("_t"), s).withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    sg = sg.withColumn(t, F.col("_t") + F.col("lag"))
    r = x.join(sg, [*run_keys, t]).groupBy(*run_keys, band, "lag").agg(pearson("_u", s).alias("r"))
    inside = F.col("lag").between(*dip)
    o = F.struct(F.round(F.abs("r"), 9), -F.abs(F.col("lag")), -F.col("lag"))
    return r.groupBy(*run_keys, band).agg(F.min(F.when(inside, F.col("r"))).alias("dip_r"), F.max_by("lag", o).cast("long").alias("peak_lag"))


def pool_curves(curves, keys, v: list[str], sizes: str | None = None) -> DataFrame:
    """Sum curves and count runs of a field."""
    aggs = [F.sum(c).alias(c) for c in v] + [F.count(F.lit(1)).alias("n_runs")]
    if sizes:
        aggs.append(F.flatten(F.collect_list(sizes)).alias(sizes))
    return curves.groupBy(*keys).agg(*aggs)


def event_window_batch(frames, seeds, windows, run_keys, t, v: str, s: str) -> DataFrame:
    """Seed correlation of every voxel inside each window: ``seed, window`` are keys of one job.

    ``windows``: run_keys, seed, window, w_from, w_to; each window is sent to
    its frames.
    """
    run_keys = list(run_keys)
    w = windows.withColumn(t, F.explode(F.sequence("w_from", "w_to"))).select(*run_keys, "seed", "window", t)
    w = w.join(seeds.select(*run_keys, "seed", t, s), [*run_keys, "seed", t])
    return frames.join(w, [*run_keys, t]).groupBy(*run_keys, "seed", "window", "z", "y", "x").agg(pearson(v, s).alias("r"))


def axis_reference(shape, plane, run_keys) -> DataFrame:
    """Median angle of the principal axes to image-Y and to the fitted surface normal, per run."""
    j = shape.join(plane, list(run_keys))
    n = F.sqrt(1 + F.col("b") ** 2 + F.col("c") ** 2)
    dot = F.abs((F.col("ay") - F.col("b") * F.col("az") - F.col("c") * F.col("ax")) / n)
    deg = lambda c: F.degrees(F.acos(F.least(F.lit(1.0), c)))
    return j.groupBy(*run_keys).agg(F.percentile(deg(F.abs("ay")), 0.5).alias("angle_y"), F.percentile(deg(dot), 0.5).alias("angle_normal"))
