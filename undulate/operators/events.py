"""Events, synchrony and behaviour locking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undulate.functions.scalar import mixed_values, mixing, permuted_values
from undulate.operators.blocks import codes, starts
from undulate.operators.joins import exclude_near, nearest_onset, window_around_events
from undulate.operators.ranks import pearson, with_average_rank
from undulate.operators.rolling import gaussian_smooth_1d, islands, peak_of_run, refractory, rising_edges
from undulate.operators.segments import CHUNK, sliding
from undulate.operators.signal import MAD_SCALE, robust_stats
from undulate.session import cut_lineage


def events_threshold(df, keys, t, v, thr: float, min_dur: int) -> DataFrame:
    return peak_of_run(df, keys, t, v, thr, min_dur)


def events_mad(df, keys, t, v, k: float = 3.5, floor: float = 0.0, min_dur: int = 1) -> DataFrame:
    """Runs above max(floor, median + k·1.4826·MAD) of the unit."""
    keys = list(keys)
    s = robust_stats(df, keys, v)
    thr = F.greatest(F.lit(floor), F.col("med") + k * MAD_SCALE * F.col("mad"))
    x = df.join(s.select(*keys, thr.alias("_thr")), keys).withColumn("_over", F.col(v) - F.col("_thr"))
    lab = islands(x.filter("_over > 0"), keys, t, 1, "f_start")
    return lab.groupBy(*keys, "f_start").agg(
        F.max(t).alias("f_end"), F.max_by(t, F.struct(F.col(v), -F.col(t))).alias("f_peak"), F.max(v).alias("amp"),
        F.count(F.lit(1)).alias("duration")).filter(F.col("duration") >= min_dur)


def event_crops(events, n_frames: Column, before: int = 5, after: int = 6, start="f_start", end="f_end") -> DataFrame:
    """[start − before, end + after) clipped to the recording."""
    return events.withColumn("crop_start", F.greatest(F.lit(0), F.col(start) - before)).withColumn(
        "crop_end", F.least(n_frames, F.col(end) + after))


def to_absolute(local, crops, keys, event, t, skip: Column | None = None) -> DataFrame:
    """Crop-local frame → run frame (→ raw frame when ``skip`` frames were dropped)."""
    j = local.join(crops.select(*keys, event, "crop_start"), [*keys, event])
    j = j.withColumn("abs_frame", F.col(t) + F.col("crop_start"))
    return j.withColumn("raw_frame", F.col("abs_frame") + skip) if skip is not None else j


def event_kinetics(events, frames, keys, t, v, max_after: int, base: int = 3, peak="f_peak") -> DataFrame:
    """Amplitude above the pre-event mean, rise, decay to ½ and 1/e (interpolated; NULL when censored), area.

    Each event meets its own window of frames; the first crossing is the least
    frame below the level, interpolated from the sample before it.
    """
    keys = list(keys)
    ev = events.select(*keys, "f_start", F.col(peak).alias("f_peak"))
    w = ev.withColumn("_o", F.explode(F.sequence(F.lit(-base), F.col("f_peak") - F.col("f_start") + max_after)))
    w = w.withColumn(t, F.col("f_start") + F.col("_o")).join(frames.select(*keys, t, F.col(v).alias("_v")), [*keys, t])
    b = w.groupBy(*keys, "f_start", "f_peak").agg(
        F.avg(F.when(F.col("_o") < 0, F.col("_v"))).alias("_b"), F.max(F.when(F.col(t) == F.col("f_peak"), F.col("_v"))).alias("_p"))
    b = b.withColumn("_b", F.coalesce("_b", F.lit(0.0))).withColumn("amp", F.col("_p") - F.col("_b"))
    x = w.join(b, [*keys, "f_start", "f_peak"]).withColumn("_u", F.col("_v") - F.col("_b"))
    after = F.col(t) > F.col("f_peak")
    aggs = [F.sum(F.when((F.col("_o") >= 0), F.col("_u"))).alias("auc")]
    levels = {"half": 0.5, "efold": 0.36787944117144233}
    for n, f in levels.items():
        aggs.append(F.min(F.when(after & (F.col("_u") <= f * F.col("amp")), F.col(t))).alias(f"_t_{n}"))
    aggs.append(F.map_from_entries(F.collect_list(F.struct(F.col(t), F.col("_u")))).alias("_m"))
    g = x.groupBy(*keys, "f_start", "f_peak", "amp").agg(*aggs)
    for n, f in levels.items():
        t1 = F.col(f"_t_{n}")
        u1, u0 = F.element_at("_m", t1), F.element_at("_m", t1 - 1)
        above, fall = u0 - f * F.col("amp"), u0 - u1
        # a peak at or below its base level may be followed by a sample as high: no crossing, hence ±inf or NaN as in IEEE division
        flat = F.when(above > 0, float("inf")).when(above < 0, float("-inf")).otherwise(float("nan"))
        share = F.when(fall != 0, above / F.nullif(fall, F.lit(0.0))).when(fall == 0, flat)
        g = g.withColumn(f"decay_{n}", F.when(t1.isNotNull(), (t1 - 1) + share - F.col("f_peak")))
    return g.select(*keys, "f_start", "f_peak", "amp", (F.col("f_peak") - F.col("f_start")).alias("rise"),
                    "decay_half", "decay_efold", "auc")


def coactivation_count(active, run_keys, unit, t) -> DataFrame:
    """Active units per frame (frames without any are absent)."""
    return active.groupBy(*run_keys, t).agg(F.count(F.lit(1)).alias("n_active"))


def participation(active, events, run_keys, unit, t, n_units: Column, width: int = 1) -> DataFrame:
    """Distinct units active within ±width of each event's frame, as a share of all units.

    Active frames are spread to their neighbours once and counted per frame;
    events then look their frame up.
    """
    run_keys = list(run_keys)
    near = active.select(*run_keys, unit, F.col(t).alias("_t"), F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("_o"))
    near = near.select(*run_keys, unit, (F.col("_t") + F.col("_o")).alias(t)).distinct()
    cnt = near.groupBy(*run_keys, t).agg(F.count(F.lit(1)).alias("n_near"))
    return events.join(cnt, [*run_keys, t], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0))).withColumn(
        "participation", F.col("n_near") / n_units)


def classify_event(n: Column, n_units: Column, f_global: float = 0.2, local_max: int = 2) -> Column:
    return F.when(n >= F.greatest(F.lit(2.0), n_units * f_global), "global").when(n <= local_max, "local").otherwise("multi")


def global_frames(active, run_keys, unit, t, n_units: DataFrame, f: float = 0.2, dilate: int = 1,
                  n_frames: int | None = None) -> DataFrame:
    """Frames within ±dilate of one with at least max(2, f·N) active units."""
    run_keys = list(run_keys)
    c = coactivation_count(active, run_keys, unit, t).join(n_units, run_keys)
    hit = c.filter(F.col("n_active") >= F.greatest(F.lit(2.0), F.col("n_units") * f))
    g = hit.select(*run_keys, F.col(t).alias("_t"), F.explode(F.sequence(F.lit(-dilate), F.lit(dilate))).alias("_o"))
    g = g.select(*run_keys, (F.col("_t") + F.col("_o")).alias(t)).distinct().filter(F.col(t) >= 0)
    return g.filter(F.col(t) < n_frames) if n_frames is not None else g


def population_footprints(active, run_keys, unit, t) -> DataFrame:
    """Islands of frames with any activity and the units taking part: one row per (island, unit)."""
    run_keys = list(run_keys)
    lab = islands(active.select(*run_keys, t).distinct(), run_keys, t, 1, "f_start")
    return active.join(lab, [*run_keys, t]).select(*run_keys, "f_start", unit).distinct()


def footprint_recurrence(footprints, run_keys, unit, event="f_start", min_cos: float = 0.5) -> DataFrame:
    """Share of event pairs whose unit sets have cosine n_ab/√(n_a·n_b) ≥ min_cos.

    Identical footprints collapse to one row with a multiplicity first. Pairs
    of the remaining distinct sets are compared block against block as 0/1
    matrices; only counts leave the tasks.
    """
    import numpy as np
    import pandas as pd

    run_keys = list(run_keys)
    sets = footprints.groupBy(*run_keys, event).agg(F.array_sort(F.collect_set(unit)).alias("_s"))
    d = sets.groupBy(*run_keys, "_s").agg(F.count(F.lit(1)).alias("_m"))
    tot = d.groupBy(*run_keys).agg(F.sum("_m").alias("n_events"), F.sum(F.col("_m") * (F.col("_m") - 1) / 2).alias("_same"),
                                   F.ceil(F.count(F.lit(1)) / 512).cast("int").alias("_nb"))
    b = d.join(tot.select(*run_keys, "_nb"), run_keys).withColumn("_blk", F.pmod(F.xxhash64("_s"), F.col("_nb")).cast("int"))
    b = b.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    b = b.withColumn("_bi", F.least("_blk", "_o")).withColumn("_bj", F.greatest("_blk", "_o"))
    schema = ", ".join(f"{k} {b.schema[k].dataType.simpleString()}" for k in run_keys) + ", hits double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = pdf["_bi"].iloc[0], pdf["_bj"].iloc[0]
        units = sorted({u for s in pdf["_s"] for u in s})
        pos = {u: i for i, u in enumerate(units)}
        m = np.zeros((len(pdf), len(units)))
        for i, s in enumerate(pdf["_s"]):
            m[i, [pos[u] for u in s]] = 1
        blk, w, n = pdf["_blk"].to_numpy(), pdf["_m"].to_numpy(dtype=float), m.sum(1)
        l, r = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
        cos = (m[l] @ m[r].T) / np.sqrt(n[l][:, None] * n[r][None, :])
        hit = (cos >= min_cos - 1e-12) * w[l][:, None] * w[r][None, :]
        total = np.triu(hit, 1).sum() if bi == bj else hit.sum()
        out = {k: [pdf[k].iloc[0]] for k in run_keys}
        return pd.DataFrame({**out, "hits": [float(total)]})

    h = b.groupBy(*run_keys, "_bi", "_bj").applyInPandas(run, schema).groupBy(*run_keys).agg(F.sum("hits").alias("_h"))
    n = F.col("n_events")
    return tot.join(h, run_keys).select(
        *run_keys, "n_events", F.when(n > 1, (F.col("_h") + F.col("_same")) / (n * (n - 1) / 2)).alias("recurrence"))


def co_onset_size(onsets, run_keys, unit, t, bin_frames: int) -> tuple[DataFrame, DataFrame]:
    """Distinct units starting per bin, and per run the mean, maximum and share of bins with ≥ 5."""
    run_keys = list(run_keys)
    per = onsets.select(*run_keys, unit, F.floor(F.col(t) / bin_frames).cast("long").alias("bin")).distinct()
    size = per.groupBy(*run_keys, "bin").agg(F.count(F.lit(1)).alias("size"))
    s = size.groupBy(*run_keys).agg(F.avg("size").alias("mean_size"), F.max("size").alias("max_size"),
                                    F.avg((F.col("size") >= 5).cast("double")).alias("frac_ge5"))
    return size, s


def size_law_aic(sizes, run_keys, exponents: list[float], rates: list[float], size="size") -> DataFrame:
    """AIC of a discrete power law and a geometric law of the co-onset sizes, each best over a grid.

    The likelihood needs only Σ ln s, Σ s and n per run, so the grid multiplies
    one row per run. The power law normaliser is the zeta function.
    """
    run_keys = list(run_keys)
    s = sizes.groupBy(*run_keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.log(size)).alias("_l"), F.sum(size).alias("_s"))
    pl = s.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(_log_zeta(a)).alias("z")) for a in exponents])))
    pl = pl.groupBy(*run_keys).agg(F.max(-F.col("_p.a") * F.col("_l") - F.col("_n") * F.col("_p.z")).alias("_ll_pl"))
    ex = s.withColumn("_q", F.explode(F.array(*[F.lit(r) for r in rates])))
    ex = ex.groupBy(*run_keys).agg(
        F.max(-F.col("_q") * (F.col("_s") - F.col("_n")) + F.col("_n") * F.log(1 - F.exp(-F.col("_q")))).alias("_ll_ex"))
    return pl.join(ex, run_keys).select(
        *run_keys, (2 - 2 * F.col("_ll_pl")).alias("aic_power"), (2 - 2 * F.col("_ll_ex")).alias("aic_exp"))


def _log_zeta(a: float, n: int = 10_000) -> float:
    """ln of the infinite sum of k^-a: n - 1 terms and the tail by Euler and Maclaurin."""
    import math

    tail = n ** (1 - a) / (a - 1) + n ** -a / 2 + a * n ** (-a - 1) / 12
    return math.log(math.fsum([*(k ** -a for k in range(1, n)), tail]))


def onset_correlogram(onsets, run_keys, unit, t, max_lag: int) -> DataFrame:
    """Cross-unit onset coincidences per lag 0…L: Σ_t n_t·n_{t+l} − Σ_units Σ_t o_t·o_{t+l}. No pair is formed."""
    run_keys = list(run_keys)
    o = onsets.select(*run_keys, unit, t).distinct()
    n = o.groupBy(*run_keys, t).agg(F.count(F.lit(1)).alias("_n"))
    lags = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_lag).cast("long")))

    def lagged(df, keys, w):
        a = df.select(*keys, F.col(t).alias("_t"), F.col(w).alias("_a")).withColumn("lag", lags)
        a = a.withColumn(t, F.col("_t") + F.col("lag"))
        return a.join(df.select(*keys, t, F.col(w).alias("_b")), [*keys, t]).groupBy(*run_keys, "lag").agg(
            F.sum(F.col("_a") * F.col("_b")).alias("_s"))

    all_ = lagged(n, run_keys, "_n")
    own = lagged(o.withColumn("_one", F.lit(1).cast("long")), [*run_keys, unit], "_one").withColumnRenamed("_s", "_own")
    return all_.join(own, [*run_keys, "lag"], "left").select(
        *run_keys, "lag", (F.col("_s") - F.coalesce("_own", F.lit(0))).alias("n"))


def onset_precision_hist(onsets, coupled, run_keys, unit, t, width: int) -> DataFrame:
    """Histogram of the nearest onset difference of coupled pairs (a, b), within ±width frames."""
    run_keys = list(run_keys)
    a = onsets.select(*run_keys, F.col(unit).alias("a"), t).join(coupled.select(*run_keys, "a", "b"), [*run_keys, "a"])
    b = onsets.select(*run_keys, F.col(unit).alias("b"), t)
    m = nearest_onset(a, b, [*run_keys, "b"], t, width)
    return m.filter(F.col("dt").isNotNull()).groupBy(*run_keys, "dt").agg(F.count(F.lit(1)).alias("n"))


def isolated_onsets(onsets, run_keys, unit, t, width: int = 1) -> DataFrame:
    """Onsets with no onset of another unit within ±width frames."""
    run_keys = list(run_keys)
    n = onsets.groupBy(*run_keys, t).agg(F.count(F.lit(1)).alias("_n"))
    near = n.select(*run_keys, F.col("_n"), F.col(t).alias("_t"), F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("_o"))
    tot = near.groupBy(*run_keys, (F.col("_t") + F.col("_o")).alias(t)).agg(F.sum("_n").alias("_all"))
    own = onsets.select(*run_keys, unit, F.col(t).alias("_t"), F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("_o"))
    own = own.groupBy(*run_keys, unit, (F.col("_t") + F.col("_o")).alias(t)).agg(F.count(F.lit(1)).alias("_own"))
    return onsets.join(tot, [*run_keys, t]).join(own, [*run_keys, unit, t]).filter(
        F.col("_all") == F.col("_own")).drop("_all", "_own")


def isolated_event_response(onsets, frames, pairs, run_keys, unit, t, v, post: int, near: float, far: float) -> DataFrame:
    """Mean value of other units in the frames after isolated onsets, near and far partners apart.

    ``pairs`` holds both directions (a = onset unit, b = other unit, dist_um).
    """
    run_keys = list(run_keys)
    iso = isolated_onsets(onsets, run_keys, unit, t).select(*run_keys, F.col(unit).alias("a"), F.col(t).alias("_t"))
    cls = F.when(F.col("dist_um") < near, "near").when(F.col("dist_um") > far, "far")
    p = pairs.select(*run_keys, "a", "b", cls.alias("group")).filter(F.col("group").isNotNull())
    x = iso.join(p, [*run_keys, "a"]).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(post))))
    x = x.withColumn(t, F.col("_t") + F.col("offset"))
    y = frames.select(*run_keys, F.col(unit).alias("b"), t, F.col(v).alias("_v"))
    return x.join(y, [*run_keys, "b", t]).groupBy(*run_keys, "group", "offset").agg(
        F.avg("_v").alias("mean_v"), F.count(F.lit(1)).alias("n"))


def slow_rates(onsets, units, run_keys, unit, t, n_frames: int, sigma: float) -> DataFrame:
    """Dense onset series smoothed by a Gaussian."""
    keys = [*run_keys, unit]
    grid = units.select(*keys).distinct().withColumn(
        t, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_frames - 1).cast("long"))))
    s = grid.join(onsets.select(*keys, t).distinct().withColumn("_o", F.lit(1.0)), [*keys, t], "left").fillna(0.0, ["_o"])
    return gaussian_smooth_1d(s, keys, t, "_o", sigma, n_frames, "rate").drop("_o")


def iei_stats(events, keys, t, n_frames: int, bin_frames: int, amp: str | None = None) -> DataFrame:
    """Interval CV (population), burstiness (sd−mean)/(sd+mean), Fano factor of binned counts.

    Intervals come from the previous event of the unit (a unit's events are
    bounded by its recording).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(t)
    e = events.withColumn("_iei", F.col(t) - F.lag(t).over(w))
    g = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.avg("_iei").alias("_m"), F.stddev_pop("_iei").alias("_s"))
    nb = n_frames // bin_frames
    b = events.filter(F.col(t) < nb * bin_frames).groupBy(*keys, F.floor(F.col(t) / bin_frames).alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"))
    f = b.groupBy(*keys).agg(F.sum("_c").alias("_s1"), F.sum(F.col("_c") * F.col("_c")).alias("_s2"))
    mean = F.col("_s1") / nb
    fano = (F.col("_s2") / nb - mean * mean) / mean
    return g.join(f.select(*keys, fano.alias("fano")), keys, "left").select(
        *keys, "n_events", (F.col("_s") / F.nullif(F.col("_m"), F.lit(0.0))).alias("iei_cv"),
        ((F.col("_s") - F.col("_m")) / F.nullif(F.col("_s") + F.col("_m"), F.lit(0.0))).alias("burstiness"), "fano")


def event_triggered_average(events, frames, keys, ev_frame, t, v, pre: int, post: int, group=(), base: tuple[int, int] | None = None,
                            on=None) -> DataFrame:
    """Mean and SEM per offset over complete windows, minus each event's mean in the ``base`` offsets."""
    w = window_around_events(events, frames, keys, ev_frame, t, pre, post, on=on)
    if base:
        ident = [*keys, ev_frame] + [g for g in group if g not in keys]
        b = w.filter(F.col("offset").between(*base)).groupBy(*ident).agg(F.avg(v).alias("_b"))
        w = w.join(b, ident).withColumn(v, F.col(v) - F.col("_b"))
    return w.groupBy(*group, "offset").agg(
        F.avg(v).alias("mean_v"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"), F.count(v).alias("n"))


def event_response(events, frames, keys, ev_frame, t, v, pre: int, post: int, on=None) -> DataFrame:
    """Per event: peak after the event, its latency, and the trapezoid area of [0, post], all above the pre-event mean."""
    keys = list(keys)
    w = window_around_events(events, frames, keys, ev_frame, t, pre, post, on=on)
    ident = [*keys, ev_frame]
    b = w.filter(F.col("offset") < 0).groupBy(*ident).agg(F.avg(v).alias("_b"))
    x = w.join(b, ident).withColumn("_u", F.col(v) - F.col("_b")).filter(F.col("offset") >= 0)
    edge = F.when(F.col("offset").isin(0, post), 0.5).otherwise(1.0)
    return x.groupBy(*ident).agg(
        F.max("_u").alias("peak"), F.max_by("offset", F.struct(F.col("_u"), -F.col("offset"))).alias("latency"),
        F.sum(F.col("_u") * edge).alias("area"))


def behavior_onsets(signal, keys, t, v, thr: Column | float, min_sep: int, quiet: int = 0, bounds: DataFrame | None = None,
                    edge: int = 0, n_frames: int | None = None) -> DataFrame:
    """Rising edges of a behaviour above a threshold: refractory, quiet before, away from edges and run boundaries."""
    keys = list(keys)
    s = signal.withColumn("_x", F.col(v) - thr)
    o = rising_edges(s, keys, t, "_x", 0.0)
    if quiet:
        # a quiet onset has no supra-threshold frame in the frames before it
        o = sliding(o, keys, t, quiet, -1, {"_q": lambda w: F.max((F.col("_x") > 0).cast("int")).over(w)}, CHUNK)
        o = o.filter(F.coalesce("_q", F.lit(0)) == 0)
    o = refractory(o.filter("edge").select(*keys, t), keys, t, min_sep)
    if edge:
        o = o.filter((F.col(t) >= edge) & (F.col(t) < n_frames - edge))
    return exclude_near(o, bounds, keys, t, edge) if bounds is not None else o


def derivative_onsets(signal, keys, t, v, q: float, min_sep: int) -> DataFrame:
    """Onsets of fast increase: first difference above its q-quantile."""
    from undulate.operators.rolling import diff_prepend

    keys = list(keys)
    x = diff_prepend(signal, keys, t, v, "_dv")
    thr = x.groupBy(*keys).agg(F.percentile("_dv", q).alias("_thr"))
    return behavior_onsets(x.join(thr, keys), keys, t, "_dv", F.col("_thr"), min_sep)


def bouts(signal, keys, t, v, thr: float, max_gap: int, min_dur: int) -> DataFrame:
    from undulate.operators.rolling import island_table

    b = island_table(signal.filter(F.col(v) > thr), keys, t, max_gap)
    return b.filter(F.col("f_end") - F.col("f_start") + 1 >= min_dur)


def state_grammar(frames, bout_table, keys, t, width: int = 5) -> DataFrame:
    """Label frames around bouts: pre, onset, sustained, post; all others quiet.

    Labels are written in that order and later ones overwrite. Every bout is
    exploded to the frames it labels; a frame keeps its highest priority.
    """
    keys = list(keys)
    c = lambda x: F.col(x)
    spans = F.array(
        F.struct(F.lit(1).alias("p"), (c("f_start") - width).alias("a"), (c("f_start") - 1).alias("b")),
        F.struct(F.lit(2).alias("p"), c("f_start").alias("a"), F.least(c("f_start") + width - 1, c("f_end")).alias("b")),
        F.struct(F.lit(3).alias("p"), (c("f_start") + width).alias("a"), c("f_end").alias("b")),
        F.struct(F.lit(4).alias("p"), (c("f_end") + 1).alias("a"), (c("f_end") + width).alias("b")))
    s = bout_table.select(*keys, F.explode(spans).alias("_s")).select(*keys, "_s.*").filter("a <= b")
    s = s.select(*keys, "p", F.explode(F.sequence("a", "b")).alias(t)).groupBy(*keys, t).agg(F.max("p").alias("_p"))
    name = F.when(c("_p") == 1, "pre").when(c("_p") == 2, "onset").when(c("_p") == 3, "sustained").when(c("_p") == 4, "post").otherwise("quiet")
    return frames.join(s, [*keys, t], "left").withColumn("state", name).drop("_p")


def leader_order(latencies, event_keys, unit_keys, value) -> DataFrame:
    """Mean latency rank per unit inside events (average ties), with its event count."""
    r = with_average_rank(latencies, event_keys, value, "_rank", bounded=True)  # units of one event
    n = latencies.groupBy(*event_keys).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n, list(event_keys)).withColumn("_rel", (F.col("_rank") - 1) / F.nullif(F.col("_n") - 1, F.lit(0)))
    return r.groupBy(*unit_keys).agg(F.avg("_rank").alias("mean_rank"), F.avg("_rel").alias("mean_rel"), F.count(F.lit(1)).alias("n_events"))


def order_ranks(latencies, run_keys, event, unit, value, least_events: int, least_share: float, least_units: int) -> DataFrame:
    """``run_keys, event, unit, _rank``: ranks of the units that take part in the order, absent ones at the event's mean."""
    run_keys = list(run_keys)
    latencies = cut_lineage(latencies.select(*run_keys, event, unit, value))  # read fourteen times below: its own steps are not planned as often
    total = latencies.select(*run_keys, event).distinct().groupBy(*run_keys).agg(F.count(F.lit(1)).alias("_all"))
    keep = latencies.groupBy(*run_keys, unit).agg(F.count(F.lit(1)).alias("_own")).join(total, run_keys)
    keep = keep.filter((F.col("_own") >= least_events) & (F.col("_own") >= least_share * F.col("_all"))).select(*run_keys, unit)
    enough = keep.groupBy(*run_keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_units)
    keep = keep.join(enough.select(*run_keys), run_keys)
    own = latencies.join(keep, [*run_keys, unit]).select(*run_keys, event, unit, F.col(value).cast("double").alias("_x"))
    mean = own.groupBy(*run_keys, event).agg(F.avg("_x").alias("_mean"))
    grid = mean.join(keep, run_keys).join(own, [*run_keys, event, unit], "left").withColumn("_x", F.coalesce("_x", "_mean"))
    return with_average_rank(grid, [*run_keys, event], "_x", "_rank", bounded=True)


def agreement(ranks, keys, unit) -> DataFrame:
    """``keys, n, m, w``: Kendall's W of n units over m events from their ranks."""
    keys = list(keys)
    s = ranks.groupBy(*keys, unit).agg(F.sum("_rank").alias("_r"), F.count(F.lit(1)).alias("_m"))
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("_m").alias("m"), (F.var_pop("_r") * F.count("_r")).alias("_ss"))
    m, n = F.col("m").cast("double"), F.col("n").cast("double")
    return g.select(*keys, "n", "m", (12 * F.col("_ss") / (m * m * (n * n * n - n))).alias("w"))


def kendall_w(latencies, run_keys, event, unit, value, least_events: int = 3, least_share: float = 0.5, least_units: int = 5) -> DataFrame:
    """Agreement of the order in which units join the events of a run.

    Units in at least ``least_events`` events and ``least_share`` of the run's
    events take part; where one is absent it gets the event's mean. Runs with
    fewer than ``least_units`` such units have no row.
    """
    return agreement(order_ranks(latencies, run_keys, event, unit, value, least_events, least_share, least_units), run_keys, unit)


PARTED = 1024  # events of a run in a part, which goes to one task
MOVED = 1 << 18  # permuted values a task works on at once


def permuted_sums(events: DataFrame, run_keys, event: str, values: list[str], n_rep: int, moved: Callable[..., np.ndarray]) -> DataFrame:
    """``run_keys, rep, _sum``: sums over a run's events of ``moved(permutations, *values)``, in parts of runs.

    ``events`` has a row for each event, with arrays of equal lengths as values. ``moved`` gets the permutations of some
    events of one length (events, replicates, length) and their arrays (events, length), and returns (events, replicates, sums).
    A part is the events of a run that one batch of a task holds; what leaves a task are its sums.
    """
    import pyarrow as pa

    run_keys = list(run_keys)
    count = events.groupBy(*run_keys).agg(F.ceil(F.count(F.lit(1)) / PARTED).alias("_np"))
    e = events.join(count, run_keys).withColumn("_part", F.pmod(F.xxhash64(event), F.col("_np")))
    e = e.select(*run_keys, "_part", mixing(e, *run_keys, event).alias("_h"), *values)
    # a number of its own keeps the tasks apart: the work is n_rep times what the sizes of the partitions tell
    e = e.repartition(3 * e.sparkSession.sparkContext.defaultParallelism, *run_keys, "_part").sortWithinPartitions(*run_keys, "_part").select(*run_keys, "_h", *values)
    schema = ", ".join(f"{c} {e.schema[c].dataType.simpleString()}" for c in run_keys) + ", rep int, _sum array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps = np.arange(n_rep, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            own = np.cumsum(starts(*(codes(b.column(c)) for c in run_keys))) - 1 if run_keys else np.zeros(b.num_rows, int)
            h = b.column("_h").to_numpy()
            lists = [b.column(v) for v in values]
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in lists]
            sizes = lists[0].value_lengths().to_numpy()
            first = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                if not n:
                    continue
                sums: dict[int, np.ndarray] = {}
                step = max(1, MOVED // (n * n_rep))
                for lo in range(0, len(rows), step):
                    at = rows[lo : lo + step]
                    image = permuted_values(n, mixed_values(h[at][:, None], reps).ravel()).reshape(len(at), n_rep, n)
                    got = moved(image, *(x[first[at][:, None] + np.arange(n)] for x in flat))
                    head = np.flatnonzero(starts(own[at]))
                    for k, s in zip(at[head].tolist(), np.add.reduceat(got, head, axis=0)):
                        sums[own[k]] = sums[own[k]] + s if own[k] in sums else s
                rows_of = np.searchsorted(own, np.fromiter(sums, int))  # a row of each run, for its keys
                for lo in range(0, len(rows_of), 256):
                    part = np.concatenate(list(sums.values())[lo : lo + 256])
                    keys = b.select(run_keys).take(pa.array(np.repeat(rows_of[lo : lo + 256], n_rep))) if run_keys else None
                    offsets = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [*(keys.columns if run_keys else []), pa.array(np.tile(reps.astype(np.int32), len(part) // n_rep)), pa.ListArray.from_arrays(offsets, part.ravel())],
                        names=[*run_keys, "rep", "_sum"])

    return e.mapInArrow(run, schema)


def leader_order_p(latencies, run_keys, event, unit, value, n_rep: int = 200, least_events: int = 3, least_share: float = 0.5, least_units: int = 5) -> DataFrame:
    """``run_keys, n, m, w, p``: W against ranks permuted among the units inside each event.

    The ranks of an event are one array (the units of one event bound it), and a keyed permutation tells which of them the
    i-th unit gets in a replicate: nothing is sorted per replicate, and tasks give on the units' sums of ranks only. Events are
    numbered by their ids in the key.
    """
    run_keys = list(run_keys)
    r = cut_lineage(order_ranks(latencies, run_keys, event, unit, value, least_events, least_share, least_units))
    obs = agreement(r, run_keys, unit)
    e = r.groupBy(*run_keys, event).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), "_rank"))), lambda x: x["_rank"]).alias("_ranks"))
    sums = permuted_sums(e, run_keys, event, ["_ranks"], n_rep, lambda image, ranks: np.take_along_axis(ranks[:, None, :], image, 2))
    added = F.reduce(F.collect_list("_sum"), F.transform(F.first("_sum"), lambda _: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    s = sums.groupBy(*run_keys, "rep").agg(added.alias("_s")).join(obs.select(*run_keys, "n", "m"), run_keys)
    mean = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    s = s.withColumn("_mean", mean).withColumn("_ss", F.aggregate("_s", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))))
    m, n = F.col("m").cast("double"), F.col("n").cast("double")
    null = s.select(*run_keys, (12 * F.col("_ss") / (m * m * (n * n * n - n))).alias("_w"))
    hits = null.join(obs, run_keys).groupBy(*run_keys).agg(F.sum((F.round("_w", 9) >= F.round("w", 9)).cast("long")).alias("_ge"))
    return obs.join(hits, run_keys).select(*run_keys, "n", "m", "w", ((1 + F.col("_ge")) / (1 + n_rep)).alias("p"))


def recruitment_p(points, run_keys, event, unit, onset: str, depth: str, n_rep: int = 2000, least_units: int = 5, least_range: float = 20.0,
                  least_events: int = 3, least_points: int = 10) -> DataFrame:
    """Do deeper units join later? ``run_keys, n_events, slope, p, n_pos, n_slopes``.

    Events with at least ``least_units`` units over ``least_range`` of depth take part. Onsets and depths are centred in their event and
    pooled for one slope; its p is two-sided, against depths permuted among the units inside each event. n_pos of n_slopes
    events have a slope above 0 (for a sign test). Runs with fewer events or points, or without a range, have no row.
    """
    run_keys = list(run_keys)
    key = [*run_keys, event]
    e = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(onset).cast("double").alias("o"), F.col(depth).cast("double").alias("d")))).alias("_p"),
                                 (F.max(depth) - F.min(depth)).alias("_range"), F.avg(F.col(onset).cast("double")).alias("_mo"), F.avg(F.col(depth).cast("double")).alias("_md"))
    e = e.filter((F.size("_p") >= least_units) & (F.col("_range") >= least_range)).withColumns({
        "_o": F.transform("_p", lambda x: x["o"] - F.col("_mo")), "_d": F.transform("_p", lambda x: x["d"] - F.col("_md")), "_n": F.size("_p").cast("long")})
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    e = cut_lineage(e.select(*key, "_o", "_d", "_n", total("_o", "_d").alias("_od"), total("_d", "_d").alias("_dd")))
    runs = e.groupBy(*run_keys).agg(F.count(F.lit(1)).alias("n_events"), F.sum("_n").alias("_points"), F.sum("_od").alias("_od"), F.sum("_dd").alias("_dd"),
                                    F.sum((F.col("_od") > 0).cast("long")).alias("n_pos"), F.sum((F.col("_dd") > 0).cast("long")).alias("n_slopes"))
    runs = runs.filter((F.col("n_events") >= least_events) & (F.col("_points") >= least_points) & (F.col("_dd") > 0))
    sums = permuted_sums(e, run_keys, event, ["_o", "_d"], n_rep, lambda image, o, d: (np.take_along_axis(d[:, None, :], image, 2) * o[:, None, :]).sum(2, keepdims=True))
    null = sums.groupBy(*run_keys, "rep").agg(F.sum(F.element_at("_sum", 1)).alias("_x"))
    hits = null.join(runs.select(*run_keys, "_od"), run_keys).groupBy(*run_keys).agg(F.sum((F.round(F.abs("_x"), 9) >= F.round(F.abs("_od"), 9)).cast("long")).alias("_ge"))
    return runs.join(hits, run_keys).select(*run_keys, "n_events", (F.col("_od") / F.col("_dd")).alias("slope"), ((1 + F.col("_ge")) / (1 + n_rep)).alias("p"), "n_pos", "n_slopes")


def slope_per_event(points, event_keys, y, x, min_n: int = 3) -> DataFrame:
    """Onset-against-position slope of every event with enough units."""
    return points.groupBy(*event_keys).agg(
        F.regr_slope(y, x).alias("slope"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)


def slope_summary(slopes, keys) -> DataFrame:
    """``n_events, mean_slope, n_pos`` of the events of a key; a slope of 0 that sums of doubles leave at 1e-16 is not positive."""
    return slopes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.avg("slope").alias("mean_slope"),
                                     F.count_if(F.round("slope", 12) > 0).alias("n_pos"))


def direction_class(slope: str, eps: float) -> Column:
    return F.when(F.col(slope) > eps, "down").when(F.col(slope) < -eps, "up").otherwise("flat")


def segment_extent(max_by_segment, event_keys, value, thr: float, rel: float = 0.5) -> DataFrame:
    """Localized or extended by how many segments reach ``thr`` and rel·max; localization = 1 − mean/max."""
    m = max_by_segment.groupBy(*event_keys).agg(F.max(value).alias("_mx"))
    j = max_by_segment.join(m, list(event_keys))
    hit = (F.col(value) >= thr) & (F.col(value) >= rel * F.col("_mx"))
    g = j.groupBy(*event_keys).agg(
        F.sum(hit.cast("long")).alias("n_recruited"), F.count(F.lit(1)).alias("n_segments"), F.avg(value).alias("_a"), F.max("_mx").alias("_mx"))
    kind = F.when(F.col("n_recruited") == 0, "none").when(F.col("n_recruited") * 2 <= F.col("n_segments"), "localized").otherwise("extended")
    return g.select(*event_keys, "n_recruited", "n_segments", kind.alias("kind"),
                    (1 - F.col("_a") / F.nullif(F.col("_mx"), F.lit(0.0))).alias("localization"))


def amplitude_vs_interval(events, keys, t, amp) -> DataFrame:
    """r between amplitude and the interval since the previous event."""
    w = Window.partitionBy(*keys).orderBy(t)
    e = events.withColumn("_iei", (F.col(t) - F.lag(t).over(w)).cast("double"))
    return e.groupBy(*keys).agg(pearson("_iei", amp).alias("r"), F.count("_iei").alias("n"))
