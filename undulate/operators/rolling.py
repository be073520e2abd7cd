"""Rolling and ordered operators on keyed frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undulate.operators.ranks import ranked_values
from undulate.operators.segments import CHUNK, previous, reflect_pad, running_last, sliding


def rolling_quantile(df: DataFrame, keys, t, v, before: int, after: int, q: float, out: str = "baseline",
                     pad: str | None = None, n_frames: int | Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """Quantile over [t−before, t+after].

    ``pad``: None truncates at the borders, ``'reflect'`` mirrors without the
    edge sample, ``'symmetric'`` mirrors with it, ``'nearest'`` repeats the ends.
    """
    src = _padded(df, keys, t, v, before, after, pad, n_frames)
    res = sliding(src, keys, t, before, after, {out: lambda w: F.percentile(v, q).over(w)}, chunk)
    if pad:
        res = res.filter((F.col(t) >= 0) & (F.col(t) < _n(n_frames)))
    return res


def _n(n_frames) -> Column:
    return n_frames if isinstance(n_frames, Column) else F.lit(n_frames)


def _padded(df, keys, t, v, before, after, pad, n_frames):
    if pad is None:
        return df
    if n_frames is None:
        raise ValueError("padding needs n_frames")
    if pad in ("reflect", "symmetric"):
        return reflect_pad(df, t, n_frames, before, after, repeat_edge=pad == "symmetric")
    if pad == "nearest":
        n, c = _n(n_frames), F.col(t).cast("long")
        return df.withColumn(t, F.explode(
            F.when(c == 0, F.sequence(F.lit(-before).cast("long"), c))
            .when(c == n - 1, F.sequence(c, c + after))
            .otherwise(F.array(c))))
    raise ValueError(pad)


def rolling_median(df, keys, t, v, half: int, out: str = "med", chunk: int = CHUNK) -> DataFrame:
    """Centred truncated median over ±half frames."""
    return rolling_quantile(df, keys, t, v, half, half, 0.5, out, chunk=chunk)


def rolling_mad(df, keys, t, v, half: int, med: str = "med", mad: str = "mad", chunk: int = CHUNK) -> DataFrame:
    """Median and MAD about the *local* median, over the truncated window ±half."""
    def dev(w):
        m = F.percentile(v, 0.5).over(w)
        return m

    res = sliding(df, keys, t, half, half, {
        med: dev, "_vals": lambda w: F.collect_list(v).over(w)}, chunk)
    d = F.array_sort(F.transform("_vals", lambda x: F.abs(x - F.col(med))))
    res = res.withColumn("_d", d)
    n = F.size("_d")
    lo = F.element_at("_d", F.floor((n + 1) / 2).cast("int"))
    hi = F.element_at("_d", F.ceil((n + 1) / 2).cast("int"))
    return res.withColumn(mad, (lo + hi) / 2).drop("_vals", "_d")


def rolling_mean(df, keys, t, v, before: int, after: int, out: str = "avg", chunk: int = CHUNK) -> DataFrame:
    return sliding(df, keys, t, before, after, {out: lambda w: F.avg(v).over(w)}, chunk)


def moving_avg_zero_padded(df, keys, t, v, width: int, out: str = "avg", chunk: int = CHUNK) -> DataFrame:
    """Box filter of ``width`` where missing border samples count as zero."""
    before, after = width // 2, (width - 1) // 2
    return sliding(df, keys, t, before, after,
                   {out: lambda w: F.sum(v).over(w) / F.lit(float(width))}, chunk)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    s = math.fsum(w)
    return [x / s for x in w]


def gaussian_smooth_1d(df, keys, t, v, sigma: float, n_frames, out: str = "smooth", chunk: int = CHUNK) -> DataFrame:
    """Gaussian along frames, cut at 4σ, borders mirrored with the edge sample. Needs dense frames."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    src = reflect_pad(df, t, n_frames, r, r, repeat_edge=True)
    res = sliding(src, keys, t, r, r, {"_l": lambda win: F.collect_list(v).over(win)}, chunk)
    res = res.filter((F.col(t) >= 0) & (F.col(t) < _n(n_frames)))
    weights = F.array(*[F.lit(x) for x in w])
    return res.withColumn(
        out, F.aggregate(F.zip_with("_l", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    ).drop("_l")


def diff_prepend(df, keys, t, v, out: str = "diff", chunk: int = CHUNK) -> DataFrame:
    """First difference; the first frame gives 0."""
    res = previous(df, keys, t, {"_p": v}, 1, chunk)
    return res.withColumn(out, F.coalesce(F.col(v) - F.col("_p"), F.lit(0.0))).drop("_p")


def rising_edges(df, keys, t, v, thr: float, out: str = "edge", chunk: int = CHUNK) -> DataFrame:
    """Frames where v > thr and the previous frame was not (a high first frame is no edge)."""
    res = previous(df, keys, t, {"_p": v}, 1, chunk)
    return res.withColumn(out, F.coalesce((F.col(v) > thr) & (F.col("_p") <= thr), F.lit(False))).drop("_p")


def dilate_flags(df, keys, t, flag, k: int, out: str = "dilated", chunk: int = CHUNK) -> DataFrame:
    return sliding(df, keys, t, k, k, {out: lambda w: F.max(flag).over(w)}, chunk)


def interp_bad_runs(df, keys, t, v, bad, out: str = "fixed", min_good: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Linear interpolation through flagged frames; ends held; unchanged with fewer good frames."""
    keys = list(keys)
    good = df.withColumn("_g", F.when(~F.col(bad), F.struct(F.col(t).alias("t"), F.col(v).alias("v"))))
    fwd = running_last(good, keys, t, "_g", "_l", chunk)
    back = running_last(fwd.withColumn("_nt", -F.col(t)), keys, "_nt", "_g", "_r", chunk).drop("_nt")
    n = df.groupBy(*keys).agg(F.sum((~F.col(bad)).cast("int")).alias("_n"))
    x = back.join(n, keys)
    dt = F.col("_r.t") - F.col("_l.t")
    mid = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * (F.col(t) - F.col("_l.t")) / dt
    return x.withColumn(
        out,
        F.when(~F.col(bad) | (F.col("_n") < min_good), F.col(v))
        .when(F.col("_l").isNull(), F.col("_r.v"))
        .when(F.col("_r").isNull(), F.col("_l.v"))
        .otherwise(mid),
    ).drop("_g", "_l", "_r", "_n")


def islands(df, keys, t, max_gap: int = 1, out: str = "island", chunk: int = CHUNK) -> DataFrame:
    """Label rows by the first frame of their island (successive frames at most ``max_gap`` apart)."""
    chunk = max(chunk, max_gap)
    w = sliding(df, keys, t, max_gap, -1, {"_near": lambda w: F.max(t).over(w)}, chunk)
    w = w.withColumn("_s", F.when(F.col("_near").isNull(), F.col(t))).drop("_near")
    return running_last(w, keys, t, "_s", out, chunk).drop("_s")


def island_table(df, keys, t, max_gap: int = 1, chunk: int = CHUNK) -> DataFrame:
    lab = islands(df, keys, t, max_gap, "f_start", chunk)
    return lab.groupBy(*keys, "f_start").agg(F.max(t).alias("f_end"), F.count(F.lit(1)).alias("n_frames"))


def hysteresis_events(df, keys, t, z, hi: float, lo: float, min_dur: int, chunk: int = CHUNK) -> DataFrame:
    """Events that start at z > hi and end at the first z < lo, end frame included.

    An event still open at the last frame T−1 ends there and is kept when
    T − start ≥ min_dur. ``keys, f_start, f_end, closed``.
    """
    keys = list(keys)
    m = df.withColumn("_m", F.when(F.col(z) > hi, F.lit(1)).when(F.col(z) < lo, F.lit(0)))
    s = running_last(m, keys, t, "_m", "_on", chunk)
    s = previous(s, keys, t, {"_was": "_on"}, 1, chunk)
    on, was = F.coalesce("_on", F.lit(0)), F.coalesce("_was", F.lit(0))
    edges = s.filter(on != was).select(*keys, F.col(t).alias("_t"), on.alias("_on"))
    ends = df.groupBy(*keys).agg(F.max(t).alias("_last"))
    # edges alternate start, end, start…: the partner of a start is the next edge
    st = edges.withColumn("_kind", on)
    w = Window.partitionBy(*keys).orderBy("_t")
    ev = st.withColumn("_next", F.lead("_t").over(w)).filter("_kind = 1").join(ends, keys)
    closed = F.col("_next").isNotNull()
    length = F.when(closed, F.col("_next") - F.col("_t")).otherwise(F.col("_last") + 1 - F.col("_t"))
    return ev.filter(length >= min_dur).select(
        *keys, F.col("_t").alias("f_start"), F.coalesce("_next", "_last").alias("f_end"), closed.alias("closed"))


def longest_block(df, keys, t, max_gap: int, chunk: int = CHUNK) -> DataFrame:
    """Integer times split where the gap exceeds ``max_gap``; the longest span per key (earliest of equals)."""
    keys = list(keys)
    b = island_table(df, keys, t, max_gap, chunk)
    span = F.struct((F.col("f_end") - F.col("f_start")).alias("s"), (-F.col("f_start")).alias("o"))
    return b.groupBy(*keys).agg(F.max_by(F.struct("f_start", "f_end", "n_frames"), span).alias("_x")).select(
        *keys, F.col("_x.f_start").alias("start"), F.col("_x.f_end").alias("stop"), F.col("_x.n_frames").alias("n"))


def refractory(df, keys, t, min_sep: int, chunk: int = CHUNK) -> DataFrame:
    """Greedy: keep an onset when it is at least ``min_sep`` after the last *kept* one.

    Onsets separated by a pause of min_sep start afresh (the first onset after
    such a pause is always kept), so the fold runs per burst, not per unit.
    Times are integers; a burst has at most one onset per frame.
    """
    keys = list(keys)
    d = islands(df.select(*keys, t).distinct(), keys, t, min_sep - 1, "_b", chunk)
    g = d.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(t)).alias("_l"))
    ty = df.schema[t].dataType.simpleString()
    kept = F.aggregate(
        "_l", F.array().cast(f"array<{ty}>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= min_sep),
                              F.concat(acc, F.array(x))).otherwise(acc))
    return g.select(*keys, F.explode(kept).alias(t))


def refractory_seen(df, keys, t, min_sep: int, chunk: int = CHUNK) -> DataFrame:
    """Variant: at least ``min_sep`` since the last onset *seen* (one row per onset)."""
    d = sliding(df, keys, t, min_sep - 1, -1, {"_near": lambda w: F.max(t).over(w)}, chunk)
    return d.filter(F.col("_near").isNull()).drop("_near")


def local_maxima(df, keys, t, v, chunk: int = CHUNK) -> DataFrame:
    """Strict local maxima with plateaus reported at their (floored) midpoint; borders are none."""
    keys = list(keys)
    p = previous(df, keys, t, {"_p": v}, 1, chunk)
    p = p.withColumn("_s", F.when(F.col("_p").isNull() | (F.col("_p") != F.col(v)), F.col(t)))
    run = running_last(p, keys, t, "_s", "_run", chunk)
    runs = run.groupBy(*keys, "_run").agg(
        F.max(t).alias("_e"), F.max(v).alias("height"), F.min_by("_p", t).alias("_left"))
    nxt = previous(df, keys, t, {"_n": v}, -1, chunk).select(*keys, F.col(t).alias("_e"), "_n")
    return (
        runs.join(nxt, [*keys, "_e"])
        .filter((F.col("_left") < F.col("height")) & (F.col("_n") < F.col("height")))
        .select(*keys, F.floor((F.col("_run") + F.col("_e")) / 2).cast("long").alias("peak"), "height")
    )


def find_peaks(df, keys, t, v, height: float | None = None, distance: int | None = None,
               prominence: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """Local maxima by height, then spacing (highest first), then prominence.

    Prominence looks from the peak to the next higher sample on either side
    (or the border): the greater of the two minima on the way is subtracted.
    The search runs over one packed trace per unit inside the JVM.
    """
    from undulate.operators.pairs import pack

    keys = list(keys)
    pk = local_maxima(df, keys, t, v, chunk)
    if height is not None:
        pk = pk.filter(F.col("height") >= height)
    if distance is not None and distance > 1:
        pk = spaced_by_score(pk, keys, "peak", "height", distance)
    tr = pack(df, keys, t, v, "_x")
    pk = pk.join(tr, keys)
    n = F.size("_x")
    left = F.reverse(F.slice("_x", F.lit(1), F.col("peak").cast("int")))
    right = F.slice("_x", F.col("peak").cast("int") + 2, n)

    def base(side: Column) -> Column:
        # running minimum until a sample above the peak; the flag stops it
        return F.aggregate(
            side, F.struct(F.col("height").alias("m"), F.lit(False).alias("stop")),
            lambda s, x: F.when(s["stop"] | (x > F.col("height")),
                                F.struct(s["m"].alias("m"), F.lit(True).alias("stop")))
            .otherwise(F.struct(F.least(s["m"], x).alias("m"), F.lit(False).alias("stop"))),
            lambda s: s["m"])

    pk = pk.withColumn("prominence", F.col("height") - F.greatest(base(left), base(right))).drop("_x")
    if prominence is not None:
        pk = pk.filter(F.col("prominence") >= prominence)
    return pk


def spaced_by_score(df, keys, t, score, min_sep: int, k: int | None = None) -> DataFrame:
    """Greedy by descending score: keep a position if every kept one is ≥ ``min_sep`` away.

    Positions split into bursts where neighbours are ≥ min_sep apart; bursts do
    not influence each other, so the fold sees one burst at a time. With ``k``
    the best k of the kept ones remain (the greedy order is by score, so this
    equals stopping after k).
    """
    keys = list(keys)
    d = islands(df, keys, t, min_sep - 1, "_b")
    rest = [c for c in df.columns if c not in keys]
    g = d.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(
        F.struct((-F.col(score)).alias("_o"), F.col(t).alias("_t"), F.struct(*rest).alias("_row")))).alias("_l"))
    ty = g.schema["_l"].dataType.simpleString()
    kept = F.aggregate(
        "_l", F.array().cast(ty),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["_t"] - x["_t"]) < min_sep), acc)
        .otherwise(F.concat(acc, F.array(x))))
    out = g.select(*keys, F.explode(kept).alias("_x")).select(*keys, "_x._row.*")
    if k is not None:
        wk = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(t))
        out = out.withColumn("_rn", F.row_number().over(wk)).filter(F.col("_rn") <= k).drop("_rn")
    return out


def peak_of_run(df, keys, t, z, thr: float, min_dur: int, chunk: int = CHUNK) -> DataFrame:
    """Argmax of each run with z > thr lasting ≥ min_dur frames (earliest of equals)."""
    keys = list(keys)
    lab = islands(df.filter(F.col(z) > thr), keys, t, 1, "f_start", chunk)
    return (
        lab.groupBy(*keys, "f_start")
        .agg(F.max(t).alias("f_end"), F.max_by(t, F.struct(F.col(z), -F.col(t))).alias("f_peak"),
             F.max(z).alias("amp"), F.count(F.lit(1)).alias("duration"))
        .filter(F.col("duration") >= min_dur)
    )


def bh_qvalue(df, keys, p, out: str = "q", bounded: bool = False) -> DataFrame:
    """Benjamini–Hochberg step-up over the non-NULL p of each key (a family of tests).

    q(p) is the least p'·n/#{≤p'} over p' ≥ p. It is a function of the value, so
    it is found on distinct values: a suffix minimum inside a rank bin, then the
    minima of the bins above.
    """
    keys = list(keys)
    r = ranked_values(df, keys, p, bounded=bounded)
    r = r.withColumn("_raw", F.col(p) * F.col("n") / (F.col("below") + F.col("c")))
    inside = Window.partitionBy(*keys, "bin").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    if bounded:
        q = r.select(*keys, p, F.least(F.lit(1.0), F.min("_raw").over(inside)).alias(out))
        return df.join(q, [*keys, p], "left")
    bins = r.groupBy(*keys, "bin").agg(F.min("_raw").alias("_bm"))
    above = bins.select(*keys, "bin", F.min("_bm").over(over).alias("_ab"))
    q = r.withColumn("_in", F.min("_raw").over(inside)).join(above, [*keys, "bin"]).select(
        *keys, p, F.least(F.lit(1.0), "_in", F.coalesce("_ab", F.lit(1.0))).alias(out))
    return df.join(q, [*keys, p], "left")


def zscore_within(df, keys, v, out: str = "z", eps: float = 1e-9) -> DataFrame:
    """(v − mean)/(sample sd + eps) per key; statistics by partial aggregation, not a window."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"))
    return df.join(m, keys).withColumn(out, (F.col(v) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def demean_within(df, keys, v, out: str = "centred") -> DataFrame:
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(v).alias("_m"))
    return df.join(m, keys).withColumn(out, F.col(v) - F.col("_m")).drop("_m")


def half_split(t: str, n_frames: int | Column) -> Column:
    """0 for the first floor(T/2) frames, else 1."""
    return F.when(F.col(t) < F.floor(_n(n_frames) / 2), F.lit(0)).otherwise(F.lit(1)).cast("long")


def array_split_part(t: str, n_frames: int | Column, k: int) -> Column:
    """Part number of k near-equal parts, the first T mod k of them one frame longer."""
    n = _n(n_frames)
    size, extra = F.floor(n / k), F.pmod(n, F.lit(k))
    cut = extra * (size + 1)
    c = F.col(t)
    return F.when(c < cut, F.floor(c / (size + 1))).otherwise(extra + F.floor((c - cut) / size)).cast("long")


def blocked_fold(t: str, n_frames: int | Column, k: int) -> Column:
    """Contiguous fold whose edges are floor(i·T/k)."""
    n = _n(n_frames)
    return (F.floor(((F.col(t) + 1) * k - 1) / n)).cast("long")


def lag_design(df, keys, t, v, max_lag: int, prefix: str = "lag", chunk: int = CHUNK) -> DataFrame:
    """Columns ``v[t−l]`` for l in −L…L; frames outside the recording take the key's mean."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(v).alias("_m"))
    lags = range(-max_lag, max_lag + 1)
    name = lambda l: f"{prefix}_{'m' if l < 0 else 'p'}{abs(l)}"
    exprs = {}
    for l in lags:
        exprs[name(l)] = (lambda l: lambda w: F.max(F.when(F.col("_at") == l, F.col(v))))(l)
    # one shuffle: each row is sent to the frames it is a lag of
    x = df.select(*keys, F.col(t).alias("_src"), F.col(v),
                  F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("_at"))
    x = x.withColumn(t, (F.col("_src") + F.col("_at")).cast(df.schema[t].dataType))
    wide = x.groupBy(*keys, t).agg(*[e(None).alias(n) for n, e in exprs.items()])
    # frames outside the recording are created by the shift: zero lag is absent there
    wide = wide.filter(F.col(name(0)).isNotNull()).join(m, keys)
    return wide.select(*keys, t, *[F.coalesce(n, "_m").alias(n) for n in exprs])


__all__ = [n for n in dir() if not n.startswith("_")]

