"""Signal conditioning of keyed traces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undulate.operators.rolling import gaussian_smooth_1d, rolling_mad
from undulate.operators.segments import CHUNK, previous, sliding

MAD_SCALE = 1.4826


def frame_to_time(t: str, rate: float | Column, skip_s: float | Column = 0.0) -> Column:
    return F.col(t) / rate - skip_s


def time_to_frame(time: str, rate: float | Column, skip_s: float | Column = 0.0) -> Column:
    return F.round((F.col(time) + skip_s) * rate).cast("long")


def skip_frames(skip_s: Column, rate: Column, mode: str = "round") -> Column:
    """Frames to drop: half-to-even rounding as in Python, or truncation."""
    x = skip_s * rate
    return (F.bround(x, 0) if mode == "round" else F.floor(x)).cast("long")


def f0_percentile(df, keys, t, v, q: float = 0.1, max_t: int | None = None, stride: int = 1,
                  out: str = "f0", floor: float | None = None) -> DataFrame:
    """Baseline per key: quantile over the (strided, leading) frames of one recording."""
    d = df
    if max_t is not None:
        d = d.filter(F.col(t) < max_t)
    if stride > 1:
        d = d.filter(F.pmod(F.col(t), F.lit(stride)) == 0)
    e = F.percentile(v, q)
    return d.groupBy(*keys).agg((F.greatest(e, F.lit(floor)) if floor is not None else e).alias(out))


def f0_modes(df, keys, t, v, n_frames: int | Column, last: int = 10, q: float = 0.2) -> DataFrame:
    """The alternative baselines side by side."""
    n = n_frames if isinstance(n_frames, Column) else F.lit(n_frames)
    c = F.col(t)
    tail, head = c >= n - last, c < F.floor(n * 0.2)
    return df.groupBy(*keys).agg(
        F.avg(F.when(tail, F.col(v))).alias("last_mean"),
        F.percentile(F.when(tail, F.col(v)), 0.5).alias("last_median"),
        F.percentile(v, q).alias("pct"),
        F.avg(F.when(head, F.col(v))).alias("first20_mean"),
    )


def f0_approx(df, keys, v, q: float = 0.2, accuracy: int = 10000) -> DataFrame:
    """One-pass mergeable quantile sketch; rank error at most n/accuracy."""
    return df.groupBy(*keys).agg(F.percentile_approx(v, q, accuracy).alias("f0"))


def dff(f: str, f0: str, eps: float = 0.0, percent: bool = False) -> Column:
    x = (F.col(f) - F.col(f0)) / (F.col(f0) + eps)
    return x * 100.0 if percent else x


def robust_z(df, keys, v, out: str = "z", eps: float = 0.0) -> DataFrame:
    """(v − median)/(1.4826·MAD + eps) per key; NULL where the divisor is 0. A key holds one recording's frames."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.percentile(v, 0.5).alias("_med"))
    d = df.join(m, keys).withColumn("_dev", F.abs(F.col(v) - F.col("_med")))
    s = d.groupBy(*keys).agg(F.percentile("_dev", 0.5).alias("_mad"))
    return (
        d.join(s, keys)
        .withColumn(out, (F.col(v) - F.col("_med")) / F.nullif(F.col("_mad") * MAD_SCALE + eps, F.lit(0.0)))
        .drop("_med", "_dev", "_mad")
    )


def robust_stats(df, keys, v, med="med", mad="mad") -> DataFrame:
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.percentile(v, 0.5).alias(med))
    d = df.join(m, keys).withColumn("_dev", F.abs(F.col(v) - F.col(med)))
    return d.groupBy(*keys, med).agg(F.percentile("_dev", 0.5).alias(mad))


def zscore(df, keys, v, out: str = "z", eps: float = 0.0) -> DataFrame:
    """Population z per key; NULL for a constant key when eps is 0."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    s = F.col("_s") + eps
    return df.join(m, keys).withColumn(
        out, F.when(s > 1e-12, (F.col(v) - F.col("_m")) / s)).drop("_m", "_s")


def unit_norm(df, keys, v, out: str = "u", eps: float = 1e-12) -> DataFrame:
    """Centre and divide by the L2 norm."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(v).alias("_m"), (F.var_pop(v) * F.count(v)).alias("_ss"))
    return df.join(m, keys).withColumn(
        out, (F.col(v) - F.col("_m")) / (F.sqrt("_ss") + eps)).drop("_m", "_ss")


def minmax_norm(df, keys, v, out: str = "n", eps: float = 1e-6) -> DataFrame:
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    return df.join(m, keys).withColumn(
        out, (F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)).drop("_lo", "_hi")


def frame_mean_subtract(df, run_keys, t, v, out: str = "v_sub") -> DataFrame:
    keys = [*run_keys, t]
    m = df.groupBy(*keys).agg(F.avg(v).alias("_m"))
    return df.join(m, keys).withColumn(out, F.col(v) - F.col("_m")).drop("_m")


def exp_bleach_correct(df, keys, t, v, rates: list[float], out: str = "corrected") -> DataFrame:
    """Fit a·exp(−b·t)+c for each b of a grid by closed-form regression, best b per key.

    The correction is v − fit + median(fit). A grid replaces the iterative
    solver: every b is an ordinary linear fit, so one grouped aggregate over
    (key, b) does all of them. A key whose best amplitude is not positive
    falls back to the straight line.
    """
    keys = list(keys)
    g = df.select(*keys, t, v, F.explode(F.array(*[F.lit(float(b)) for b in rates])).alias("_b"))
    g = g.withColumn("_e", F.exp(-F.col("_b") * F.col(t)))
    fits = g.groupBy(*keys, "_b").agg(
        F.regr_slope(v, "_e").alias("_a"), F.regr_intercept(v, "_e").alias("_c"),
        (F.regr_syy(v, "_e") - F.regr_sxy(v, "_e") * F.regr_sxy(v, "_e") / F.regr_sxx(v, "_e")).alias("_sse"))
    best = fits.groupBy(*keys).agg(
        F.min_by(F.struct("_a", "_b", "_c"), F.struct(F.round("_sse", 6), F.col("_b"))).alias("_f"))
    line = df.groupBy(*keys).agg(F.regr_slope(v, t).alias("_ls"), F.regr_intercept(v, t).alias("_li"))
    x = df.join(best, keys).join(line, keys)
    fit = F.when(F.col("_f._a") > 0, F.col("_f._a") * F.exp(-F.col("_f._b") * F.col(t)) + F.col("_f._c")).otherwise(
        F.col("_ls") * F.col(t) + F.col("_li"))
    x = x.withColumn("fit", fit).withColumn("rate", F.when(F.col("_f._a") > 0, F.col("_f._b")))
    m = x.groupBy(*keys).agg(F.percentile("fit", 0.5).alias("_mf"))
    return x.join(m, keys).withColumn(out, F.col(v) - F.col("fit") + F.col("_mf")).drop("_f", "_ls", "_li", "_mf")


def linear_detrend(df, keys, t, v, out: str = "detrended") -> DataFrame:
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.regr_slope(v, t).alias("_s"), F.regr_intercept(v, t).alias("_i"))
    return df.join(m, keys).withColumn(out, F.col(v) - F.col("_s") * F.col(t) - F.col("_i")).drop("_s", "_i")


def highpass(df, keys, t, v, cutoff: float, n_frames, out: str = "hp") -> DataFrame:
    """v minus a Gaussian low-pass whose −3 dB point is ``cutoff`` (cycles per frame).

    Stands for a zero-phase recursive filter: same purpose, finite response.
    """
    sigma = math.sqrt(math.log(2.0)) / (2.0 * math.pi * cutoff)
    s = gaussian_smooth_1d(df, keys, t, v, sigma, n_frames, "_lp")
    return s.withColumn(out, F.col(v) - F.col("_lp")).drop("_lp")


def gaussian_baseline_dff(df, keys, t, v, sigma: float, n_frames, eps: float = 1e-6, out: str = "dff_g") -> DataFrame:
    s = gaussian_smooth_1d(df, keys, t, v, sigma, n_frames, "_b")
    return s.withColumn(out, (F.col(v) - F.col("_b")) / (F.col("_b") + eps)).drop("_b")


def regress_out(df, keys, v, g, out: str = "resid", centred: bool = True) -> DataFrame:
    """Remove ``g`` from ``v``: slope cov/var with the mean kept, or mean(v·g)/var(g)."""
    keys = list(keys)
    beta = F.covar_pop(v, g) / F.nullif(F.var_pop(g), F.lit(0.0)) if centred else \
        F.avg(F.col(v) * F.col(g)) / F.nullif(F.var_pop(g), F.lit(0.0))
    m = df.groupBy(*keys).agg(F.coalesce(beta, F.lit(0.0)).alias("_beta"), F.avg(g).alias("_gm"))
    x = df.join(m, keys)
    r = F.col(v) - F.col("_beta") * ((F.col(g) - F.col("_gm")) if centred else F.col(g))
    return x.withColumn(out, r).drop("_beta", "_gm")


def _solve(n: int, a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Symmetric solve by Cramer's rule (n ≤ 4) in column arithmetic; NULL when singular."""
    def det(m):
        if len(m) == 1:
            return m[0][0]
        total = None
        for j, x in enumerate(m[0]):
            term = x * det([row[:j] + row[j + 1:] for row in m[1:]])
            total = term if total is None else (total + term if j % 2 == 0 else total - term)
        return total

    d = det(a)
    return [det([row[:k] + [b[i]] + row[k + 1:] for i, row in enumerate(a)]) / F.when(F.abs(d) > 1e-12, d)
            for k in range(n)]


def ols_coefficients(df, keys, y, xs: list[str]) -> DataFrame:
    """Slopes of y on 1 + xs per key from covariances (one aggregate, ≤ 4 regressors)."""
    keys = list(keys)
    aggs = [F.covar_pop(y, x).alias(f"_b{i}") for i, x in enumerate(xs)]
    aggs += [F.covar_pop(xs[i], xs[j]).alias(f"_a{i}{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    aggs += [F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)] + [F.avg(y).alias("_my")]
    s = df.groupBy(*keys).agg(*aggs)
    a = [[F.col(f"_a{min(i, j)}{max(i, j)}") for j in range(len(xs))] for i in range(len(xs))]
    sol = _solve(len(xs), a, [F.col(f"_b{i}") for i in range(len(xs))])
    s = s.select(*keys, "_my", *[f"_m{i}" for i in range(len(xs))],
                 *[c.alias(f"beta_{x}") for c, x in zip(sol, xs)])
    icpt = F.col("_my")
    for i, x in enumerate(xs):
        icpt = icpt - F.col(f"beta_{x}") * F.col(f"_m{i}")
    return s.select(*keys, icpt.alias("intercept"), *[f"beta_{x}" for x in xs])


def partial_out(df, keys, y, xs: list[str], out: str = "resid") -> DataFrame:
    """Residual of y on a constant and ≤ 4 regressors; y − mean where they are collinear."""
    keys = list(keys)
    c = ols_coefficients(df, keys, y, xs)
    m = df.groupBy(*keys).agg(F.avg(y).alias("_my"))
    x = df.join(c, keys).join(m, keys)
    fit = F.col("intercept")
    for r in xs:
        fit = fit + F.col(f"beta_{r}") * F.col(r)
    return x.withColumn(out, F.col(y) - F.coalesce(fit, F.col("_my"))).drop(
        "_my", "intercept", *[f"beta_{r}" for r in xs])


def motion_frames(tiles: DataFrame, keys, tile, pos, t, v, half: int, k: float = 2.5, pad: int = 2,
                  chunk: int = CHUNK) -> DataFrame:
    """Frames whose worst tile decorrelates from the previous frame.

    ``tiles`` holds (keys, tile, pos, t, v): the pixels of a tile. Score = max
    over tiles of 1 − r(frame, previous frame); flagged above rolling median +
    k·1.4826·MAD and padded by ±pad.
    """
    keys = list(keys)
    p = previous(tiles, [*keys, tile, pos], t, {"_p": v}, 1, chunk)
    ok = (F.var_pop(F.when(F.col("_p").isNotNull(), F.col(v))) > 1e-18) & (F.var_pop("_p") > 1e-18)
    r = p.filter(F.col("_p").isNotNull()).groupBy(*keys, t, tile).agg((1 - F.when(ok, F.corr(v, "_p"))).alias("_d"))
    s = r.groupBy(*keys, t).agg(F.coalesce(F.max("_d"), F.lit(0.0)).alias("score"))
    m = rolling_mad(s, keys, t, "score", half, chunk=chunk)
    m = m.withColumn("_f", (F.col("score") > F.col("med") + k * MAD_SCALE * F.col("mad")).cast("long"))
    return sliding(m, keys, t, pad, pad, {"motion": lambda w: F.max("_f").over(w)}, chunk).drop("_f", "med", "mad")


def drop_spikes(df, keys, pos, t, v, k: float = 2.0, chunk: int = CHUNK) -> DataFrame:
    """Frames whose mean normalised difference falls below −k·sd of the key's differences."""
    keys = list(keys)
    p = previous(df, [*keys, *pos], t, {"_p": v}, 1, chunk).filter(F.col("_p").isNotNull())
    d = p.groupBy(*keys, t).agg((F.avg(F.col(v) - F.col("_p")) / (F.avg(F.abs("_p")) + 1e-6)).alias("delta"))
    s = d.groupBy(*keys).agg(F.stddev_pop("delta").alias("_sd"))
    return d.join(s, keys).withColumn("drop", (F.col("delta") < -k * F.col("_sd")).cast("long")).drop("_sd")


def line_artifacts(df, keys, t, row, v, k: float = 3.0, share: float = 0.15) -> DataFrame:
    """Frames in which more than ``share`` of the rows have extreme variance (median ± k·1.4826·MAD of the frame's rows)."""
    keys = list(keys)
    rv = df.groupBy(*keys, t, row).agg(F.var_pop(v).alias("_var"))
    st = robust_stats(rv, [*keys, t], "_var", "_med", "_mad")
    x = rv.join(st, [*keys, t]).withColumn(
        "_ex", (F.abs(F.col("_var") - F.col("_med")) > k * MAD_SCALE * F.col("_mad")).cast("double"))
    return x.groupBy(*keys, t).agg(F.avg("_ex").alias("extreme_share")).withColumn(
        "artifact", (F.col("extreme_share") > share).cast("long"))


def remove_frames(df, bad: DataFrame, keys, t, new: str = "new_frame") -> DataFrame:
    """Drop listed frames and renumber; keeps the old number. Ordering is per recording."""
    keys = list(keys)
    kept = df.select(*keys, t).distinct().join(bad.select(*keys, t).distinct(), [*keys, t], "left_anti")
    from undulate.operators.segments import running_sum

    num = running_sum(kept.withColumn("_one", F.lit(1).cast("long")), keys, t, "_one", "_n")
    return df.join(num.select(*keys, t, (F.col("_n") - 1).alias(new)), [*keys, t])


def multi_unit_drop_frames(df, run_keys, unit, t, v, drop: float = -8.0, min_units: int = 3,
                           chunk: int = CHUNK) -> DataFrame:
    """Frames where at least ``min_units`` units fall by more than ``-drop`` at once."""
    p = previous(df, [*run_keys, unit], t, {"_p": v}, 1, chunk)
    return p.groupBy(*run_keys, t).agg(
        F.sum(F.when(F.col(v) - F.col("_p") < drop, 1).otherwise(0)).alias("n_drop")
    ).filter(F.col("n_drop") >= min_units)


def profile_shift(df, keys, t, pos, v, max_shift: int) -> DataFrame:
    """Integer shift of each frame's depth profile against the mean profile (highest r)."""
    from undulate.operators.ranks import pearson

    keys = list(keys)
    prof = df.groupBy(*keys, t, pos).agg(F.avg(v).alias("_v"))
    ref = prof.groupBy(*keys, pos).agg(F.avg("_v").alias("_ref"))
    x = prof.withColumn("shift", F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift))))
    x = x.withColumn(pos, F.col(pos) - F.col("shift")).join(ref, [*keys, pos])
    r = x.groupBy(*keys, t, "shift").agg(pearson("_v", "_ref").alias("r")).filter(F.col("r").isNotNull())
    best = F.max_by(F.struct("shift", "r"), F.struct(F.round("r", 9), -F.abs("shift"), -F.col("shift")))
    return r.groupBy(*keys, t).agg(best.alias("_b")).select(*keys, t, "_b.shift", "_b.r")


def trace_qa_features(df, keys, t, v, n_events: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per trace: peak SNR, negative share, skewness, lag-1 autocorrelation, drift between the outer thirds."""
    from undulate.operators.ranks import pearson

    keys = list(keys)
    st = robust_stats(df, keys, v)
    p = previous(df, keys, t, {"_p": v}, 1, chunk).join(st, keys)
    n = df.groupBy(*keys).agg((F.max(t) + 1).alias("_T"))
    p = p.join(n, keys)
    third = F.floor(F.col("_T") / 3)
    f = p.groupBy(*keys, "med", "mad").agg(
        F.max(v).alias("_mx"), F.avg((F.col(v) < 0).cast("double")).alias("neg_fraction"),
        F.skewness(v).alias("skew"), pearson(v, "_p").alias("lag1"),
        F.avg(F.when(F.col(t) < third, F.col(v))).alias("_a"),
        F.avg(F.when(F.col(t) >= F.col("_T") - third, F.col(v))).alias("_z"),
        F.stddev_pop(v).alias("_sd"))
    return f.select(
        *keys, ((F.col("_mx") - F.col("med")) / F.nullif(MAD_SCALE * F.col("mad"), F.lit(0.0))).alias("snr_peak"),
        "neg_fraction", F.when(F.col("_sd") > 1e-9, F.col("skew")).alias("skew"), "lag1",
        ((F.col("_z") - F.col("_a")) / (F.col("_sd") + 1e-9)).alias("drift"))


def snr(df, keys, v, eps: float = 0.0) -> DataFrame:
    """(p95 − median)/(MAD + eps); NULL where the divisor is 0."""
    keys = list(keys)
    p95 = df.groupBy(*keys).agg(F.percentile(v, 0.95).alias("_p"))
    return robust_stats(df, keys, v).join(p95, keys).select(
        *keys, ((F.col("_p") - F.col("med")) / F.nullif(F.col("mad") + eps, F.lit(0.0))).alias("snr"))


def state_mask(df, keys, v, q_hi: float, q_lo: float, out: str = "state") -> DataFrame:
    """'high' above the upper quantile of the key, 'low' below the lower, else 'mid'."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.percentile(v, q_hi).alias("_hi"), F.percentile(v, q_lo).alias("_lo"))
    x = df.join(m, keys)
    return x.withColumn(out, F.when(F.col(v) > F.col("_hi"), "high").when(F.col(v) < F.col("_lo"), "low")
                        .otherwise("mid")).drop("_hi", "_lo")


def circular_shift(df, keys, t, n_frames: int | Column, shift: Column) -> DataFrame:
    """Roll each series: the value of frame t moves to (t + shift) mod T."""
    n = n_frames if isinstance(n_frames, Column) else F.lit(n_frames)
    return df.withColumn(t, F.pmod(F.col(t) + shift, n).cast(df.schema[t].dataType))


def resample_linear(samples: DataFrame, grid: DataFrame, keys, time: str, v: str, at: str,
                    cell: float, out: str = "value") -> DataFrame:
    """Value at each grid time by linear interpolation, NULL outside the sampled range.

    Sample segments [t_i, t_{i+1}) are cut into time cells; a grid point meets
    only the segments of its cell.
    """
    from pyspark.sql import Window

    keys = list(keys)
    s = samples.groupBy(*keys, time).agg(F.avg(v).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(time)
    seg = s.select(*keys, F.col(time).alias("_t0"), F.col("_v").alias("_v0"),
                   F.lead(time).over(w).alias("_t1"), F.lead("_v").over(w).alias("_v1"))
    last = F.coalesce("_t1", "_t0")
    seg = seg.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("_t0") / cell), F.floor(last / cell))))
    g = grid.withColumn("_cell", F.floor(F.col(at) / cell))
    on = [k for k in keys if k in grid.columns]
    hits = seg.join(g.select(*on, at, "_cell").distinct(), [*on, "_cell"]).filter(
        (F.col(at) >= F.col("_t0"))
        & ((F.col("_t1").isNotNull() & (F.col(at) < F.col("_t1"))) | (F.col("_t1").isNull() & (F.col(at) == F.col("_t0")))))
    frac = (F.col(at) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    hits = hits.select(*keys, at, F.when(F.col("_t1").isNull(), F.col("_v0")).otherwise(
        F.col("_v0") + frac * (F.col("_v1") - F.col("_v0"))).alias(out))
    full = grid if set(keys) <= set(grid.columns) else grid.join(
        samples.select(*keys).distinct(), on)
    return full.join(hits, [*keys, at], "left")
