"""Queries over spectra and coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from undulate.operators import nulls as U
from undulate.operators import signal as S
from undulate.operators import spectral as X
from undulate.operators.rolling import bh_qvalue
from undulate.plans import inputs as I
from undulate.plans.registry import query, r6
from undulate.plans.select_q import POS, positions

K = ["run_id", "unit"]
G = ["run_id"]
KS = ["run_id", "unit", "signal"]
N = I.N_FRAMES
SEG = 20
STARTS = X.segment_starts(N, SEG)
BINS = [1, 2, 3, 4, 5]
T = f"WITH {I.TRACES}, {I.BEHAVIOR}"


def coef_sql(src: str, key: str, v: str, out: str) -> str:
    """CTE: complex coefficients per segment and bin."""
    return f"""
{out}_s AS (SELECT {key}, s, frame - s AS k, {v} AS v FROM {src}, (SELECT unnest({STARTS}) AS s) WHERE frame >= s AND frame < s + {SEG}),
{out}_l AS (SELECT {key}, s, regr_slope(v, k) AS b, regr_intercept(v, k) AS a FROM {out}_s GROUP BY ALL),
{out} AS (SELECT {key}, s, bin, sum((v - a - b * k) * (0.5 - 0.5 * cos(2 * pi() * k / {SEG})) * cos(2 * pi() * k * bin / {SEG})) AS re,
   sum(-(v - a - b * k) * (0.5 - 0.5 * cos(2 * pi() * k / {SEG})) * sin(2 * pi() * k * bin / {SEG})) AS im
  FROM {out}_s JOIN {out}_l USING ({key}, s), (SELECT unnest({BINS}) AS bin) GROUP BY ALL)
"""


COH = f"""{coef_sql('traces', 'run_id, unit', 'dff', 'fx')}, {coef_sql('behavior', 'run_id, signal', 'value', 'fy')},
cr AS (SELECT x.run_id, x.unit, y.signal, x.bin, avg(x.re * y.re + x.im * y.im) AS re, avg(x.re * y.im - x.im * y.re) AS im,
   avg(x.re * x.re + x.im * x.im) AS sxx, avg(y.re * y.re + y.im * y.im) AS syy FROM fx x JOIN fy y ON x.run_id = y.run_id AND x.s = y.s AND x.bin = y.bin GROUP BY ALL),
coh AS (SELECT run_id, unit, signal, bin, (re * re + im * im) / nullif(sxx * syy, 0) AS coh, re, im FROM cr)
"""


def coherence(spark, d):
    return X.welch_coherence(I.traces(spark, d), I.behavior(spark, d), G, "unit", "signal", "frame", "dff", "value", SEG, BINS)


@query("welch_coherence", f"{T}, {COH} SELECT run_id, unit, signal, bin, round(coh, 6) AS coh FROM coh")
def _(spark, d):
    return coherence(spark, d).select(*KS, "bin", r6("coh").alias("coh"))


@query("band_mean_coherence", f"""{T}, {COH} SELECT run_id, unit, signal, CASE WHEN bin <= 2 THEN 'slow' ELSE 'fast' END AS band, round(avg(coh), 6) AS coh FROM coh GROUP BY ALL""")
def _(spark, d):
    return X.band_mean(coherence(spark, d), KS, {"slow": (1, 2), "fast": (3, 5)}).select(*KS, "band", r6("coh").alias("coh"))


PHASE = "ph AS (SELECT run_id, unit, signal, atan2(sum(im), sum(re)) AS phase, avg(coh) AS coh FROM coh WHERE bin <= 2 GROUP BY ALL)"


@query("band_phase", f"""{T}, {COH}, {PHASE}
SELECT run_id, unit, signal, round(coh, 6) AS coh, round(phase, 5) + 0.0 AS phase, CASE WHEN abs(phase) < pi() / 3 THEN 'in' WHEN abs(phase) > 2 * pi() / 3 THEN 'anti' ELSE 'other' END AS kind FROM ph""")
def _(spark, d):
    return X.band_phase(coherence(spark, d), KS, 1, 2).select(*KS, r6("coh").alias("coh"), r6("phase", 5).alias("phase"), "kind")


@query("band_lag", f"""{T}, {COH} SELECT run_id, unit, signal, round(sum(-atan2(im, re) / (2 * pi() * bin / {SEG}.0) * coh) / sum(coh), 5) + 0.0 AS lag FROM coh WHERE bin BETWEEN 1 AND 3 GROUP BY ALL""")
def _(spark, d):
    return X.band_lag(coherence(spark, d), KS, 1, 3, SEG).select(*KS, r6("lag", 5).alias("lag"))


SHIFTS = U.shift_list(12, N, 5)

NULLC = f"""
{coef_sql('traces', 'run_id, unit', 'dff', 'fx')},
bs AS (SELECT b.run_id, b.signal, i, (b.frame + CASE WHEN i < 0 THEN 0 ELSE 5 + (7 * i) % ({N} - 10) END) % {N} AS frame, value FROM behavior b, (SELECT unnest(range(-1, 12)) AS i) WHERE signal = 'error'),
{coef_sql('bs', 'run_id, signal, i', 'value', 'fy')},
cr AS (SELECT x.run_id, x.unit, y.signal, i, x.bin, (power(avg(x.re * y.re + x.im * y.im), 2) + power(avg(x.re * y.im - x.im * y.re), 2)) / (avg(x.re * x.re + x.im * x.im) * avg(y.re * y.re + y.im * y.im)) AS coh
   FROM fx x JOIN fy y ON x.run_id = y.run_id AND x.s = y.s AND x.bin = y.bin WHERE x.bin <= 2 GROUP BY ALL),
bm AS (SELECT run_id, unit, signal, i, avg(coh) AS coh FROM cr GROUP BY ALL),
nn AS (SELECT o.run_id, o.unit, o.coh, (1 + count(*) FILTER (n.coh >= o.coh - 1e-12)) / 13.0::DOUBLE AS p, o.coh - avg(n.coh) AS excess, avg(n.coh) AS null_mean, quantile_cont(n.coh, 0.95) AS null_q
   FROM bm o JOIN bm n USING (run_id, unit, signal) WHERE o.i = -1 AND n.i >= 0 GROUP BY o.run_id, o.unit, o.coh),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p, unit) AS rk, count(*) OVER (PARTITION BY run_id) AS n FROM nn)
"""


def null_table(spark, d):
    b = I.behavior(spark, d).filter("signal = 'error'")
    return X.coherence_null(I.traces(spark, d), b, G, "unit", "signal", "frame", "dff", "value", SEG, [1, 2], SHIFTS)


@query("coherence_null", f"""{T}, {NULLC}
SELECT run_id, unit, round(coh, 6) AS coh, round(p, 6) AS p, round(excess, 6) + 0.0 AS excess, round(null_mean, 6) AS null_mean, round(null_q, 6) AS null_q,
  round(least(1.0, min(p * n / rk) OVER (PARTITION BY run_id ORDER BY p DESC, unit DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM rk""")
def _(spark, d):
    x = bh_qvalue(null_table(spark, d), G, "p")
    return x.select(*K, *[r6(c).alias(c) for c in ("coh", "p", "excess", "null_mean", "null_q", "q")])


@query("unit_pair_coherence", f"""WITH {I.TRACES}, {coef_sql('traces', 'run_id, unit', 'dff', 'fx')},
cr AS (SELECT x.run_id, x.unit AS a, y.unit AS b, x.bin, (power(avg(x.re * y.re + x.im * y.im), 2) + power(avg(x.re * y.im - x.im * y.re), 2)) / (avg(x.re * x.re + x.im * x.im) * avg(y.re * y.re + y.im * y.im)) AS coh
  FROM fx x JOIN fx y ON x.run_id = y.run_id AND x.s = y.s AND x.bin = y.bin AND x.unit < y.unit WHERE x.bin <= 3 GROUP BY ALL)
SELECT run_id, a, b, round(avg(coh), 6) AS coh FROM cr GROUP BY ALL""")
def _(spark, d):
    return X.unit_pair_coherence(I.traces(spark, d), G, "unit", "frame", "dff", SEG, [1, 2, 3]).select(*G, "a", "b", r6("coh").alias("coh"))


@query("phase_groups", f"""{T}, {COH}, {PHASE}, {POS},
g AS (SELECT run_id, unit, CASE WHEN coh > 0.3 AND abs(phase) < pi() / 3 THEN 'in' WHEN coh > 0.3 AND abs(phase) > 2 * pi() / 3 THEN 'anti' ELSE 'none' END AS grp FROM ph WHERE signal = 'click')
SELECT run_id, grp AS "group", count(*) AS n, round(avg(y), 6) AS mean_depth FROM g JOIN pos USING (run_id, unit) GROUP BY ALL""")
def _(spark, d):
    ph = X.band_phase(coherence(spark, d).filter("signal = 'click'"), K, 1, 2)
    g = X.phase_groups(ph, F.col("coh") > 0.3)
    return g.join(positions(spark, d), K).groupBy(*G, "group").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("mean_depth"))


@query("phase_group_agreement")
def _(spark, d):
    """Groups from the raw traces against those after detrending, high-pass and clipping of dips."""
    t, b = I.traces(spark, d), I.behavior(spark, d).filter("signal = 'click'")
    variants = {
        "raw": t.select(*K, "frame", "dff"),
        "detrended": S.linear_detrend(t, K, "frame", "dff", "x").select(*K, "frame", F.col("x").alias("dff")),
        "highpass": S.highpass(t, K, "frame", "dff", 0.04, N, "x").select(*K, "frame", F.col("x").alias("dff")),
        "no_dips": t.select(*K, "frame", F.least("dff", F.lit(150.0)).alias("dff")),
    }
    al = None
    for n, v in variants.items():
        v = v.withColumn("variant", F.lit(n))
        al = v if al is None else al.unionByName(v)
    al = al.select(*G, F.concat_ws("|", "variant", F.col("unit").cast("string")).alias("uv"), "frame", "dff")
    c = X.welch_coherence(al, b, G, "uv", "signal", "frame", "dff", "value", SEG, [1, 2])
    g = X.phase_groups(X.band_phase(c, [*G, "uv"], 1, 2), F.col("coh") > 0.3)
    g = g.select(*G, F.split_part("uv", F.lit("|"), F.lit(1)).alias("variant"), F.split_part("uv", F.lit("|"), F.lit(2)).cast("long").alias("unit"), "group")
    raw = g.filter("variant = 'raw'").select(*K, F.col("group").alias("g0"))
    return g.filter("variant <> 'raw'").join(raw, K).groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("group") == F.col("g0")).cast("double"))).alias("agreement"))


PB = [1, 2, 3, 4, 5, 6, 8, 10, 12, 15]


@query("bandpower_ratio", f"""WITH {I.TRACES},
m AS (SELECT run_id, unit, avg(dff) AS m FROM traces GROUP BY ALL),
p AS (SELECT t.run_id, t.unit, k, (power(sum((dff - m) * cos(2 * pi() * k * frame / {N})), 2) + power(sum((dff - m) * sin(2 * pi() * k * frame / {N})), 2)) / {N} AS pw
  FROM traces t JOIN m USING (run_id, unit), (SELECT unnest({PB}) AS k) GROUP BY ALL)
SELECT run_id, unit, round(sum(pw) FILTER (k <= 5) / sum(pw) FILTER (k > 5), 6) AS ratio FROM p GROUP BY ALL""")
def _(spark, d):
    p = X.periodogram(I.traces(spark, d), K, "frame", "dff", PB)
    return X.bandpower_ratio(p, K, (1, 5), (6, 15)).select(*K, r6("ratio").alias("ratio"))


@query("psd_peaks")
def _(spark, d):
    p = X.welch_psd(I.behavior(spark, d), ["run_id", "signal"], "frame", "value", SEG)
    return X.psd_peaks(p, ["run_id", "signal"]).select("run_id", "signal", "bin", r6("power", 3).alias("power"))

