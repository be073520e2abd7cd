"""Queries over pairwise dependence and nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from undulate.functions.scalar import mixed_sql
from undulate.operators import joins as J
from undulate.operators import nulls as U
from undulate.operators import pairs as P
from undulate.operators import signal as S
from undulate.operators.aggregate import binned_mean_sem
from undulate.operators.ranks import pearson, spearman
from undulate.plans import inputs as I
from undulate.plans.registry import i8, query, r6
from undulate.plans.select_q import ONSETS, PAIRS, POS, onsets, pairs, positions

K = ["run_id", "unit"]
R = ["run_id"]
N = I.N_FRAMES
T = f"WITH {I.TRACES}"
TZ = f"WITH {I.TRACES}, {I.ROBUST_Z}"
MS = 5  # least shift

DIST = """
dist AS (SELECT a.run_id, a.unit AS a, b.unit AS b, sqrt((a.z-b.z)*3.9*(a.z-b.z)*3.9 + (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*1.2*(a.x-b.x)*1.2) AS d,
  abs(a.y - b.y) AS dy, sqrt((a.z-b.z)*3.9*(a.z-b.z)*3.9 + (a.x-b.x)*1.2*(a.x-b.x)*1.2) AS dl
  FROM pos a JOIN pos b ON a.run_id = b.run_id AND a.unit < b.unit)
"""


def flags(spark, d, thr=1.0):
    z = S.robust_z(I.traces(spark, d), K, "dff")
    return z.select(*K, "frame", F.coalesce(F.col("z") > thr, F.lit(False)).cast("int").alias("on"))


def pair_table(spark, d):
    g = P.pair_geometry(positions(spark, d), R, "unit", "y", "x", "z", (3.9, 1.0, 1.2))
    return pairs(spark, d).join(g, [*R, "a", "b"])


@query("pair_corr", f"{T}, {PAIRS} SELECT run_id, a, b, round(r, 6) + 0.0 AS r FROM pairs")
def _(spark, d):
    return pairs(spark, d).select(*R, "a", "b", r6("r").alias("r"))


@query("mean_pair_corr", f"{T}, {PAIRS} SELECT run_id, 15 AS n_units, round(avg(r), 6) + 0.0 AS mean_r FROM pairs GROUP BY ALL")
def _(spark, d):
    return P.mean_pair_corr(I.traces(spark, d), R, "unit", "frame", "dff").select(*R, "n_units", r6("mean_r").alias("mean_r"))


@query("participation_ratio", f"""{T}, {PAIRS}
SELECT run_id, 15 AS n_units, round(225.0 / (15 + 2 * sum(r * r)), 6) AS pr, round(15.0 / (15 + 2 * sum(r * r)), 6) AS pr_per_unit FROM pairs GROUP BY ALL""")
def _(spark, d):
    return P.participation_ratio(I.traces(spark, d), R, "unit", "frame", "dff").select(
        *R, "n_units", r6("pr").alias("pr"), r6("pr_per_unit").alias("pr_per_unit"))


@query("duplicate_traces", f"{T}, {PAIRS} SELECT run_id, a, b, round(r, 6) AS r FROM pairs WHERE r > 0.25")
def _(spark, d):
    return P.duplicate_traces(I.traces(spark, d), R, "unit", "frame", "dff", 0.25).select(*R, "a", "b", r6("r").alias("r"))


LAGS = f"""
lagr AS (SELECT a.run_id, a.unit AS a, b.unit AS b, l.lag, covar_pop(a.dff, b.dff) / nullif(sqrt(var_pop(a.dff) * var_pop(b.dff)), 0) AS r
  FROM traces a JOIN (SELECT unnest(range(-3, 4)) AS lag) l ON true JOIN traces b ON b.run_id = a.run_id AND a.unit < b.unit AND b.frame = a.frame - l.lag GROUP BY ALL)
"""


@query("best_lag_corr", f"""{T}, {LAGS},
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, a, b ORDER BY round(abs(r), 8) DESC, abs(lag), lag) AS rn FROM lagr)
SELECT k.run_id, k.a, k.b, round(z.r, 6) + 0.0 AS r0, round(k.r, 6) + 0.0 AS r_best, k.lag FROM k JOIN lagr z USING (run_id, a, b) WHERE rn = 1 AND z.lag = 0""")
def _(spark, d):
    x = P.best_lag_corr(I.traces(spark, d), R, "unit", "frame", "dff", 3)
    return x.select(*R, "a", "b", r6("r0").alias("r0"), r6("r_best").alias("r_best"), "lag")


@query("cross_correlogram", f"""{T}, {I.BEHAVIOR}
SELECT t.run_id, t.unit, b.signal, l.lag, round(covar_pop(dff, value) / nullif(sqrt(var_pop(dff) * var_pop(value)), 0), 6) + 0.0 AS r, count(*) AS n
FROM traces t JOIN (SELECT unnest(range(-4, 5)) AS lag) l ON true JOIN behavior b ON b.run_id = t.run_id AND b.frame = t.frame - l.lag GROUP BY ALL""")
def _(spark, d):
    # the shorter side carries the lags
    c = P.cross_correlogram(I.traces(spark, d), I.behavior(spark, d), K, "frame", "dff", "value", 4)
    return c.select(*K, "signal", i8("lag").alias("lag"), r6("r").alias("r"), "n")


@query("correlogram_peak_level_derivative", f"""{T}, {I.BEHAVIOR},
g AS (SELECT run_id, frame, sum(dff) AS x FROM traces GROUP BY ALL),
e AS (SELECT run_id, frame, value AS y FROM behavior WHERE signal = 'error'),
s AS (SELECT 'level' AS kind, run_id, frame, x, y FROM g JOIN e USING (run_id, frame) UNION ALL
  SELECT 'derivative', run_id, frame, coalesce(x - lag(x) OVER w, 0), coalesce(y - lag(y) OVER w, 0) FROM g JOIN e USING (run_id, frame) WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
c AS (SELECT a.kind, a.run_id, l.lag, covar_pop(a.x, b.y) / nullif(sqrt(var_pop(a.x) * var_pop(b.y)), 0) AS r FROM s a JOIN (SELECT unnest(range(-5, 6)) AS lag) l ON true
  JOIN s b ON a.kind = b.kind AND a.run_id = b.run_id AND b.frame = a.frame - l.lag GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY kind, run_id ORDER BY round(abs(r), 9) DESC, abs(lag), lag) AS rn FROM c WHERE r IS NOT NULL)
SELECT kind, run_id, lag, round(r, 6) + 0.0 AS r FROM k WHERE rn = 1""")
def _(spark, d):
    from undulate.operators.rolling import diff_prepend

    g = I.traces(spark, d).groupBy(*R, "frame").agg(F.sum("dff").alias("x"))
    e = I.behavior(spark, d).filter("signal = 'error'").select(*R, "frame", F.col("value").alias("y"))
    dg = diff_prepend(g, R, "frame", "x", "dx").select(*R, "frame", F.col("dx").alias("x"))
    de = diff_prepend(e, R, "frame", "y", "dy").select(*R, "frame", F.col("dy").alias("y"))
    out = None
    for kind, a, b in (("level", g, e), ("derivative", dg, de)):
        c = P.peak_lag(P.cross_correlogram(a, b, R, "frame", "x", "y", 5), R).withColumn("kind", F.lit(kind))
        out = c if out is None else out.unionByName(c)
    return out.select("kind", *R, i8("lag").alias("lag"), r6("r").alias("r"))


SHIFT = f"{MS} + (7 * i + 13 * unit) % ({N} - 2 * {MS})"


@query("circular_shift", f"""{T}
SELECT run_id, unit, i AS shift_id, (frame + {SHIFT}) % {N} AS frame, dff FROM traces, (SELECT unnest(range(3)) AS i)""")
def _(spark, d):
    t = I.traces(spark, d).withColumn("shift_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return S.circular_shift(t, K, "frame", N, U.shift_amount(F.col("shift_id"), F.col("unit"), N, MS)).select(*K, "shift_id", "frame", "dff")


COUPLING = f"""
ts AS (SELECT t.run_id, t.unit, b.signal, covar_pop(dff, value) / sqrt(var_pop(dff) * var_pop(value)) AS r FROM traces t JOIN behavior b USING (run_id, frame) GROUP BY ALL),
tn AS (SELECT t.run_id, t.unit, b.signal, i, covar_pop(dff, value) / sqrt(var_pop(dff) * var_pop(value)) AS r FROM (SELECT unnest(range(40)) AS i) q JOIN traces t ON true
  JOIN behavior b ON b.run_id = t.run_id AND (b.frame + {MS} + (7 * i) % ({N} - 2 * {MS})) % {N} = t.frame GROUP BY ALL),
cp AS (SELECT s.run_id, s.unit, s.signal, any_value(s.r) AS r, (1 + count(*) FILTER (abs(n.r) >= abs(s.r) - 1e-12)) / 41.0::DOUBLE AS p,
  quantile_cont(abs(n.r), 0.95) AS null_q, avg(abs(n.r)) AS null_mean, stddev_pop(abs(n.r)) AS null_sd FROM ts s JOIN tn n USING (run_id, unit, signal) GROUP BY ALL)
"""


def coupling0(spark, d):
    return U.coupling(I.traces(spark, d), I.behavior(spark, d), R, "unit", "signal", "frame", "dff", "value", U.shift_list(40, N, MS))


@query("coupling_shift_null", f"""{T}, {I.BEHAVIOR}, {COUPLING}
SELECT run_id, unit, signal, round(r, 6) + 0.0 AS r, round(p, 6) AS p, round(null_q, 6) AS null_q, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd FROM cp""")
def _(spark, d):
    return coupling0(spark, d).select(*K, "signal", *[r6(c).alias(c) for c in ("r", "p", "null_q", "null_mean", "null_sd")])


@query("coupling_best_lag", f"""{T}, {I.BEHAVIOR},
sh AS (SELECT run_id, signal, -1 AS i, frame, value FROM behavior UNION ALL
  SELECT run_id, signal, i, (frame + {MS} + (7 * i) % ({N} - 2 * {MS})) % {N}, value FROM behavior, (SELECT unnest(range(40)) AS i)),
lr AS (SELECT t.run_id, t.unit, s.signal, s.i, l, coalesce(covar_pop(dff, value) / nullif(sqrt(var_pop(dff) * var_pop(value)), 0), 0) AS r
  FROM traces t CROSS JOIN (SELECT unnest(range(-3, 4)) AS l) JOIN sh s ON s.run_id = t.run_id AND s.frame = t.frame - l GROUP BY ALL),
bl AS (SELECT run_id, unit, signal, i, r, l FROM (SELECT *, row_number() OVER (PARTITION BY run_id, unit, signal, i ORDER BY round(abs(r), 11) DESC, l) AS k FROM lr) WHERE k = 1)
SELECT o.run_id, o.unit, o.signal, round(any_value(o.r), 6) + 0.0 AS r, any_value(o.l) AS lag, round((1 + count(*) FILTER (abs(n.r) >= abs(o.r) - 1e-12)) / 41.0::DOUBLE, 6) AS p
FROM bl o JOIN bl n ON o.run_id = n.run_id AND o.unit = n.unit AND o.signal = n.signal AND n.i >= 0 WHERE o.i = -1 GROUP BY o.run_id, o.unit, o.signal""")
def _(spark, d):
    c = U.coupling(I.traces(spark, d), I.behavior(spark, d), R, "unit", "signal", "frame", "dff", "value",
                   U.shift_list(40, N, MS), max_lag=3)
    return c.select(*K, "signal", r6("r").alias("r"), "lag", r6("p").alias("p"))


@query("pair_null_threshold", f"""{T},
zn AS (SELECT t.run_id, t.unit, t.frame, (dff - m) / sd AS zz FROM traces t JOIN (SELECT run_id, unit, avg(dff) AS m, stddev_pop(dff) AS sd FROM traces GROUP BY ALL) USING (run_id, unit)),
sh AS (SELECT run_id, unit, i, (frame + {SHIFT}) % {N} AS frame, zz FROM zn, (SELECT unnest(range(8)) AS i)),
nr AS (SELECT a.run_id, a.i, a.unit AS a, b.unit AS b, avg(a.zz * b.zz) AS r FROM sh a JOIN sh b ON a.run_id = b.run_id AND a.i = b.i AND a.frame = b.frame AND a.unit < b.unit GROUP BY ALL),
th AS (SELECT run_id, quantile_cont(r, 0.975) AS hi, quantile_cont(r, 0.025) AS lo FROM nr GROUP BY ALL),
ob AS (SELECT a.run_id, a.unit AS a, b.unit AS b, avg(a.zz * b.zz) AS r FROM zn a JOIN zn b ON a.run_id = b.run_id AND a.frame = b.frame AND a.unit < b.unit GROUP BY ALL)
SELECT run_id, round(any_value(hi), 6) AS hi, round(any_value(lo), 6) AS lo, round(avg(CASE WHEN r > hi THEN 1.0 ELSE 0 END), 6) AS frac_pos, round(avg(CASE WHEN r < lo THEN 1.0 ELSE 0 END), 6) AS frac_neg
FROM ob JOIN th USING (run_id) GROUP BY ALL""")
def _(spark, d):
    from undulate.operators.ranks import exact_quantiles

    t = I.traces(spark, d).withColumn("shift_id", F.explode(F.sequence(F.lit(0), F.lit(7))))
    sh = S.circular_shift(t, K, "frame", N, U.shift_amount(F.col("shift_id"), F.col("unit"), N, MS))
    null = P.pair_corr(sh, [*R, "shift_id"], "unit", "frame", "dff")
    th = exact_quantiles(null, R, "r", {"hi": 0.975, "lo": 0.025})
    j = pairs(spark, d).join(th, R)
    return j.groupBy(*R).agg(r6(F.max("hi")).alias("hi"), r6(F.max("lo")).alias("lo"),
                             r6(F.avg((F.col("r") > F.col("hi")).cast("double"))).alias("frac_pos"),
                             r6(F.avg((F.col("r") < F.col("lo")).cast("double"))).alias("frac_neg"))


@query("null_summary_mean_pair", f"""{T},
zn AS (SELECT t.run_id, t.unit, t.frame, (dff - m) / sd AS zz FROM traces t JOIN (SELECT run_id, unit, avg(dff) AS m, stddev_pop(dff) AS sd FROM traces GROUP BY ALL) USING (run_id, unit)),
sh AS (SELECT run_id, unit, i, CASE WHEN i < 0 THEN frame ELSE (frame + {SHIFT}) % {N} END AS frame, zz FROM zn, (SELECT unnest(range(-1, 30)) AS i)),
mr AS (SELECT run_id, i, (sum(s * s) / {N} - 15) / (15 * 14) AS r FROM (SELECT run_id, i, frame, sum(zz) AS s FROM sh GROUP BY ALL) GROUP BY ALL),
o AS (SELECT run_id, r AS o FROM mr WHERE i < 0)
SELECT run_id, round(any_value(o), 6) + 0.0 AS observed, round((1 + count(*) FILTER (r >= o)) / 31.0, 6)::DOUBLE AS p_one, round((o - avg(r)) / stddev_pop(r), 5) + 0.0 AS z
FROM mr JOIN o USING (run_id) WHERE i >= 0 GROUP BY run_id, o""")
def _(spark, d):
    t = I.traces(spark, d)
    obs = P.mean_pair_corr(t, R, "unit", "frame", "dff")
    null = U.shifted_mean_pair_corr(t, R, "unit", "frame", "dff", N, 30, MS)
    s = U.null_summary(obs, null, R, "mean_r")
    return s.select(*R, r6("observed").alias("observed"), r6("p_one").alias("p_one"), r6("z", 5).alias("z"))


@query("pooled_null_p", f"""WITH {I.COHORT}
SELECT a.run_id, a.fov, round((1 + (SELECT count(*) FROM cohort b WHERE b.fov = a.fov AND b.acctbal * 30 >= a.mean_price)) / (1.0 + (SELECT count(*) FROM cohort b WHERE b.fov = a.fov)), 8)::DOUBLE AS p FROM cohort a""")
def _(spark, d):
    c = I.cohort(spark, d)
    obs = c.select("run_id", "fov", F.col("mean_price").alias("x"))
    null = c.select("fov", (F.col("acctbal") * 30).alias("x"))
    return U.pooled_p(obs, null, ["fov"], "x").select("run_id", "fov", F.round("p", 8).alias("p"))


SYNC = f"""
act AS (SELECT run_id, unit, frame FROM rz WHERE z > 2),
sh AS (SELECT run_id, -1 AS i, frame FROM act UNION ALL SELECT run_id, i, (frame + {SHIFT}) % {N} FROM act, (SELECT unnest(range(50)) AS i)),
cn AS (SELECT run_id, i, frame, count(*) AS c FROM sh GROUP BY ALL),
lv AS (SELECT run_id, i, unnest(['k2', 'k3', 'k5', 'f10', 'f25']) AS level, unnest([count(*) FILTER (c >= 2), count(*) FILTER (c >= 3), count(*) FILTER (c >= 5),
   count(*) FILTER (c >= greatest(2, ceil(0.1 * 15))), count(*) FILTER (c >= greatest(2, ceil(0.25 * 15)))]) / {N}.0::DOUBLE AS share FROM cn GROUP BY run_id, i),
sp AS (SELECT run_id, level, coalesce(max(share) FILTER (i = -1), 0) AS observed, coalesce(sum(share) FILTER (i >= 0), 0) / 50 AS null_mean FROM lv GROUP BY ALL)
"""


def synchrony(spark, d):
    """How much more often are several units active together than independent units would be?"""
    t = I.traces(spark, d)
    act = S.robust_z(t, K, "dff").filter("z > 2").select(*K, "frame")
    n = t.select(*K).distinct().groupBy(*R).agg(F.count(F.lit(1)).alias("n_units"))
    s = U.synchrony_profile(act, R, "unit", "frame", N, n, [2, 3, 5], [0.1, 0.25], 50, MS)
    return s.select(*R, "level", r6("observed").alias("observed"), r6("null_mean").alias("null_mean"), r6("ratio", 5).alias("ratio"))


query("synchrony_profile", f"""{TZ}, {SYNC}
SELECT run_id, level, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(observed / greatest(null_mean, 1.0 / ({N} * 50)), 5) AS ratio FROM sp""")(synchrony)


@query("binary_mi", f"""{TZ},
f AS (SELECT run_id, unit, frame, CASE WHEN z > 1 THEN 1 ELSE 0 END AS v FROM rz),
c AS (SELECT a.run_id, a.unit AS a, b.unit AS b, sum(a.v * b.v)::DOUBLE AS n11, sum(a.v)::DOUBLE AS na, sum(b.v)::DOUBLE AS nb FROM f a JOIN f b ON a.run_id = b.run_id AND a.frame = b.frame AND a.unit < b.unit GROUP BY ALL),
t AS (SELECT run_id, a, b, n11, unnest([n11, na - n11, nb - n11, {N} - na - nb + n11]) AS n, unnest([na, na, {N} - na, {N} - na]) AS pa, unnest([nb, {N} - nb, nb, {N} - nb]) AS pb FROM c)
SELECT run_id, a, b, CAST(n11 AS BIGINT) AS n_both, round(sum(CASE WHEN n > 0 THEN n / {N} * log2((n / {N}) / ((pa / {N}) * (pb / {N}))) ELSE 0 END), 6) + 0.0 AS mi FROM t GROUP BY ALL""")
def _(spark, d):
    m = P.binary_mi(flags(spark, d), R, "unit", "frame", "on")
    return m.select(*R, "a", "b", "n_both", r6("mi").alias("mi"))


@query("coactive_corr", f"""{T},
p AS (SELECT a.run_id, a.unit AS a, b.unit AS b, CASE WHEN a.dff > 10 AND b.dff > 10 THEN a.dff END AS x, CASE WHEN a.dff > 10 AND b.dff > 10 THEN b.dff END AS y FROM traces a JOIN traces b ON a.run_id = b.run_id AND a.frame = b.frame AND a.unit < b.unit)
SELECT run_id, a, b, count(x) AS n_both, CASE WHEN count(x) >= 10 THEN round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) + 0.0 ELSE 0 END AS r FROM p GROUP BY ALL""")
def _(spark, d):
    c = P.coactive_corr(I.traces(spark, d), R, "unit", "frame", "dff", 10.0)
    return c.select(*R, "a", "b", "n_both", r6("r").alias("r"))


@query("coactivation_index", f"""{TZ},
f AS (SELECT run_id, unit, frame, CASE WHEN z > 1 THEN 1 ELSE 0 END AS v FROM rz)
SELECT a.run_id, a.unit AS a, b.unit AS b, round(sum(a.v * b.v) / nullif(sqrt(sum(a.v) * sum(b.v)), 0), 6) AS "index" FROM f a JOIN f b ON a.run_id = b.run_id AND a.frame = b.frame AND a.unit < b.unit GROUP BY ALL""")
def _(spark, d):
    return P.coactivation_index(flags(spark, d), R, "unit", "frame", "on").select(*R, "a", "b", r6("index").alias("index"))


def spearman_sql(src: str, key: str, x: str, y: str) -> str:
    """CTE body: rank correlation per key with mid ranks."""
    mid = lambda c: f"(rank() OVER (PARTITION BY {key} ORDER BY {c}) + (count(*) OVER (PARTITION BY {key}, {c}) - 1) / 2.0::DOUBLE)"
    return (f"SELECT {key}, covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) AS rho, count(*) AS n FROM "
            f"(SELECT {key}, {mid(x)} AS rx, {mid(y)} AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY ALL")


@query("spearman", f"""WITH {I.COHORT}, s AS ({spearman_sql('cohort', 'fov', 'n_orders', 'acctbal')})
SELECT fov, n, round(rho, 6) + 0.0 AS rho FROM s""")
def _(spark, d):
    return spearman(I.cohort(spark, d), ["fov"], "n_orders", "acctbal").select("fov", "n", r6("rho").alias("rho"))


@query("corr_vs_distance", f"""{T}, {PAIRS}, {POS}, {DIST},
j AS (SELECT * FROM pairs JOIN dist USING (run_id, a, b)), s AS ({spearman_sql('j', 'run_id', 'r', 'd')}),
m AS (SELECT run_id, avg(r) FILTER (d < 30) AS near_r, avg(r) FILTER (d > 75) AS far_r FROM j GROUP BY ALL)
SELECT run_id, n, round(rho, 6) + 0.0 AS rho, round(near_r, 6) + 0.0 AS near_r, round(far_r, 6) + 0.0 AS far_r FROM s JOIN m USING (run_id)""")
def _(spark, d):
    j = pair_table(spark, d)
    s = spearman(j, R, "r", "dist_um")
    m = j.groupBy(*R).agg(F.avg(F.when(F.col("dist_um") < 30, F.col("r"))).alias("near_r"), F.avg(F.when(F.col("dist_um") > 75, F.col("r"))).alias("far_r"))
    return s.join(m, R).select(*R, "n", r6("rho").alias("rho"), r6("near_r").alias("near_r"), r6("far_r").alias("far_r"))


@query("corr_distance_profile", f"""{T}, {PAIRS}, {POS}, {DIST}
SELECT run_id, CAST(floor(d / 25) AS BIGINT) AS bin, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(avg(r), 6) + 0.0 END AS mean, CASE WHEN count(*) >= 3 THEN round(stddev_samp(r) / sqrt(count(*)), 6) END AS sem
FROM pairs JOIN dist USING (run_id, a, b) GROUP BY ALL""")
def _(spark, d):
    b = binned_mean_sem(pair_table(spark, d), R, "dist_um", "r", 0.0, 25.0, 3)
    return b.select(*R, "bin", "n", r6("mean").alias("mean"), r6("sem").alias("sem"))


DECAYS = [5.0, 10.0, 20.0, 40.0, 80.0, 160.0, 320.0]


@query("corr_decay_length", f"""{T}, {PAIRS}, {POS}, {DIST},
g AS (SELECT run_id, lam, regr_slope(r, exp(-d / lam)) AS a, regr_syy(r, exp(-d / lam)) - power(regr_sxy(r, exp(-d / lam)), 2) / regr_sxx(r, exp(-d / lam)) AS sse
  FROM pairs JOIN dist USING (run_id, a, b), (SELECT unnest({DECAYS}::DOUBLE[]) AS lam) GROUP BY ALL)
SELECT run_id, lam, round(a, 5) + 0.0 AS amp FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(sse, 10), lam) AS rn FROM g) WHERE rn = 1""")
def _(spark, d):
    j = pair_table(spark, d).withColumn("lam", F.explode(F.array(*[F.lit(x) for x in DECAYS])))
    e = F.exp(-F.col("dist_um") / F.col("lam"))
    g = j.withColumn("e", e).groupBy(*R, "lam").agg(
        F.regr_slope("r", "e").alias("amp"),
        (F.regr_syy("r", "e") - F.pow(F.regr_sxy("r", "e"), F.lit(2.0)) / F.regr_sxx("r", "e")).alias("sse"))
    return g.groupBy(*R).agg(F.min_by(F.struct("lam", "amp"), F.struct(F.round("sse", 10), "lam")).alias("x")).select(
        *R, "x.lam", r6("x.amp", 5).alias("amp"))


@query("distance_matched_contrast", f"""{T}, {PAIRS}, {POS}, {DIST},
b AS (SELECT run_id, floor(d / 25) AS bin, avg(r) FILTER (dl < 40) - avg(r) FILTER (dl >= 40) AS diff FROM pairs JOIN dist USING (run_id, a, b) GROUP BY ALL
  HAVING count(*) FILTER (dl < 40) >= 2 AND count(*) FILTER (dl >= 40) >= 2)
SELECT run_id, count(*) AS n_bins, round(avg(diff), 6) + 0.0 AS contrast FROM b GROUP BY ALL""")
def _(spark, d):
    j = pair_table(spark, d).withColumn("bin", F.floor(F.col("dist_um") / 25))
    al = F.col("dlat_um") < 40
    b = j.groupBy(*R, "bin").agg(
        F.avg(F.when(al, F.col("r"))).alias("x"), F.avg(F.when(~al, F.col("r"))).alias("y"),
        F.sum(al.cast("int")).alias("nx"), F.sum((~al).cast("int")).alias("ny")).filter("nx >= 2 AND ny >= 2")
    return b.groupBy(*R).agg(F.count(F.lit(1)).alias("n_bins"), r6(F.avg(F.col("x") - F.col("y"))).alias("contrast"))


@query("sequential_pairs", f"""{T}, {LAGS}, {POS}, {DIST},
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, a, b ORDER BY round(abs(r), 8) DESC, abs(lag), lag) AS rn FROM lagr),
s AS (SELECT k.run_id, k.a, k.b, k.lag, abs(k.r) - abs(z.r) AS gain, k.r FROM k JOIN lagr z USING (run_id, a, b) WHERE rn = 1 AND z.lag = 0)
SELECT run_id, a, b, lag, round(r, 6) AS r, round(d / abs(lag), 6) AS speed, CAST(sign(lag) AS BIGINT) AS direction FROM s JOIN dist USING (run_id, a, b)
WHERE lag <> 0 AND gain > 0.05 AND abs(r) > 0.3""")
def _(spark, d):
    x = P.best_lag_corr(I.traces(spark, d), R, "unit", "frame", "dff", 3)
    x = x.filter((F.col("lag") != 0) & (F.abs("r_best") - F.abs("r0") > 0.05) & (F.abs("r_best") > 0.3))
    g = P.pair_geometry(positions(spark, d), R, "unit", "y", "x", "z", (3.9, 1.0, 1.2))
    return x.join(g, [*R, "a", "b"]).select(*R, "a", "b", "lag", r6("r_best").alias("r"),
                                            r6(F.col("dist_um") / F.abs("lag")).alias("speed"), i8(F.signum("lag")).alias("direction"))


@query("negative_pairs_variants", f"""{T}, {PAIRS}, {I.ROBUST_Z},
l AS (SELECT run_id, unit, regr_slope(dff, frame) AS s, regr_intercept(dff, frame) AS i FROM traces GROUP BY ALL),
dt AS (SELECT t.run_id, t.unit, t.frame, dff - s * frame - i AS v FROM traces t JOIN l USING (run_id, unit)),
bn AS (SELECT run_id, unit, frame, CASE WHEN z > 1 THEN 1.0::DOUBLE ELSE 0 END AS v FROM rz),
al AS (SELECT 'raw' AS kind, run_id, unit, frame, dff AS v FROM traces UNION ALL SELECT 'detrended', * FROM dt UNION ALL SELECT 'binary', * FROM bn),
r AS (SELECT a.kind, a.run_id, a.unit AS a, b.unit AS b, covar_pop(a.v, b.v) / nullif(sqrt(var_pop(a.v) * var_pop(b.v)), 0) AS r FROM al a JOIN al b ON a.kind = b.kind AND a.run_id = b.run_id AND a.frame = b.frame AND a.unit < b.unit GROUP BY ALL)
SELECT kind, run_id, count(*) FILTER (r < -0.2) AS n_negative, count(r) AS n_pairs FROM r GROUP BY ALL""")
def _(spark, d):
    t = I.traces(spark, d)
    z = S.robust_z(t, K, "dff")
    parts = {"raw": t.select(*K, "frame", F.col("dff").alias("v")),
             "detrended": S.linear_detrend(t, K, "frame", "dff", "v").select(*K, "frame", "v"),
             "binary": z.select(*K, "frame", (F.col("z") > 1).cast("double").alias("v"))}
    al = None
    for k, x in parts.items():
        x = x.withColumn("kind", F.lit(k))
        al = x if al is None else al.unionByName(x)
    r = P.pair_corr(al, ["kind", "run_id"], "unit", "frame", "v")
    return r.groupBy("kind", *R).agg(F.sum((F.coalesce(F.round("r", 9), F.lit(0.0)) < -0.2).cast("long")).alias("n_negative"), F.count("r").alias("n_pairs"))


@query("tuning_similarity", f"""{T}, {I.BEHAVIOR}, {PAIRS},
c AS (SELECT t.run_id, t.unit, b.signal, covar_pop(dff, value) / sqrt(var_pop(dff) * var_pop(value)) AS r FROM traces t JOIN behavior b USING (run_id, frame) GROUP BY ALL),
cs AS (SELECT a.run_id, a.unit AS a, b.unit AS b, sum(a.r * b.r) / sqrt(sum(a.r * a.r) * sum(b.r * b.r)) AS cs FROM c a JOIN c b ON a.run_id = b.run_id AND a.signal = b.signal AND a.unit < b.unit GROUP BY ALL),
j AS (SELECT run_id, r, cs FROM pairs JOIN cs USING (run_id, a, b)), s AS ({spearman_sql('j', 'run_id', 'r', 'cs')})
SELECT run_id, n, round(rho, 6) + 0.0 AS rho FROM s""")
def _(spark, d):
    j = I.traces(spark, d).join(I.behavior(spark, d), ["run_id", "frame"])
    c = j.groupBy(*K, "signal").agg(pearson("dff", "value").alias("r"))

    def cosine(x, y):
        import numpy as np

        n = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        return {"cs": np.divide(x @ y.T, n, out=np.full(n.shape, np.nan), where=n > 0)}

    cs = P.block_pairs(P.pack(c, K, "signal", "r"), R, "unit", "trace", cosine, {"cs": "double"})
    s = spearman(pairs(spark, d).join(cs, [*R, "a", "b"]), R, "r", "cs")
    return s.select(*R, "n", r6("rho").alias("rho"))


@query("conditional_coupling", f"""{T}, {I.BEHAVIOR},
q AS (SELECT run_id, quantile_cont(value, 0.5) AS m FROM behavior WHERE signal = 'view' GROUP BY ALL),
still AS (SELECT run_id, frame FROM behavior JOIN q USING (run_id) WHERE signal = 'view' AND value < m)
SELECT t.run_id, t.unit, b.signal, round(covar_pop(dff, value) / nullif(sqrt(var_pop(dff) * var_pop(value)), 0), 6) + 0.0 AS r, count(*) AS n
FROM traces t JOIN still USING (run_id, frame) JOIN behavior b USING (run_id, frame) WHERE b.signal <> 'view' GROUP BY ALL""")
def _(spark, d):
    b = I.behavior(spark, d)
    v = b.filter("signal = 'view'")
    q = v.groupBy(*R).agg(F.percentile("value", 0.5).alias("m"))
    still = v.join(q, R).filter("value < m").select(*R, "frame")
    j = I.traces(spark, d).join(still, [*R, "frame"]).join(b.filter("signal <> 'view'"), [*R, "frame"])
    return j.groupBy(*K, "signal").agg(r6(pearson("dff", "value")).alias("r"), F.count(F.lit(1)).alias("n"))


@query("partial_corr_behavior", f"""{T}, {I.BEHAVIOR},
x AS (SELECT t.run_id, t.unit, t.dff, a.value AS a, c.value AS c FROM traces t JOIN behavior a ON a.run_id = t.run_id AND a.frame = t.frame AND a.signal = 'click'
  JOIN behavior c ON c.run_id = t.run_id AND c.frame = t.frame AND c.signal = 'view'),
r AS (SELECT run_id, unit, covar_pop(dff, a) / sqrt(var_pop(dff) * var_pop(a)) AS ya, covar_pop(dff, c) / sqrt(var_pop(dff) * var_pop(c)) AS yc, covar_pop(a, c) / sqrt(var_pop(a) * var_pop(c)) AS ac FROM x GROUP BY ALL)
SELECT run_id, unit, round((ya - yc * ac) / sqrt((1 - yc * yc) * (1 - ac * ac)), 6) + 0.0 AS click_given_view, round((yc - ya * ac) / sqrt((1 - ya * ya) * (1 - ac * ac)), 6) + 0.0 AS view_given_click FROM r""")
def _(spark, d):
    b = I.behavior(spark, d).filter(F.col("signal").isin("click", "view")).groupBy(*R, "frame").agg(
        F.max(F.when(F.col("signal") == "click", F.col("value"))).alias("a"), F.max(F.when(F.col("signal") == "view", F.col("value"))).alias("c"))
    j = I.traces(spark, d).join(b, [*R, "frame"])
    r = j.groupBy(*K).agg(pearson("dff", "a").alias("ya"), pearson("dff", "c").alias("yc"), pearson("a", "c").alias("ac"))
    part = lambda x, y, w: (x - y * w) / F.sqrt((1 - y * y) * (1 - w * w))
    return r.select(*K, r6(part(F.col("ya"), F.col("yc"), F.col("ac"))).alias("click_given_view"),
                    r6(part(F.col("yc"), F.col("ya"), F.col("ac"))).alias("view_given_click"))


@query("state_gated_pairs", f"""{T}, {I.BEHAVIOR},
q AS (SELECT run_id, quantile_cont(value, 0.6) AS hi, quantile_cont(value, 0.4) AS lo FROM behavior WHERE signal = 'click' GROUP BY ALL),
st AS (SELECT run_id, frame, CASE WHEN value > hi THEN 'high' ELSE 'low' END AS state FROM behavior JOIN q USING (run_id) WHERE signal = 'click' AND (value > hi OR value < lo)),
p AS (SELECT a.run_id, state, a.unit AS a, b.unit AS b, covar_pop(a.dff, b.dff) / nullif(sqrt(var_pop(a.dff) * var_pop(b.dff)), 0) AS r
  FROM traces a JOIN st USING (run_id, frame) JOIN traces b ON b.run_id = a.run_id AND b.frame = a.frame AND a.unit < b.unit GROUP BY ALL)
SELECT run_id, state, count(r) AS n_pairs, round(avg(r), 6) + 0.0 AS mean_r FROM p GROUP BY ALL""")
def _(spark, d):
    b = S.state_mask(I.behavior(spark, d).filter("signal = 'click'"), R, "value", 0.6, 0.4).filter("state <> 'mid'")
    t = I.traces(spark, d).join(b.select(*R, "frame", "state"), [*R, "frame"])
    p = P.pair_corr(t, [*R, "state"], "unit", "frame", "dff")
    return p.groupBy(*R, "state").agg(F.count("r").alias("n_pairs"), r6(F.avg("r")).alias("mean_r"))


@query("corr_degree", f"""{T}, {PAIRS},
e AS (SELECT run_id, a AS unit, r FROM pairs UNION ALL SELECT run_id, b, r FROM pairs)
SELECT run_id, unit, CAST(sum(CASE WHEN abs(r) > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS degree FROM e GROUP BY ALL""")
def _(spark, d):
    return P.corr_degree(pairs(spark, d), R, 0.2).select(*K, "degree")


@query("same_fov_reproducibility", f"""{T}, {PAIRS},
m AS (SELECT p.run_id // 3 AS fov, p.run_id AS run_1, q.run_id AS run_2, p.r AS r_1, q.r AS r_2, (p.run_id * 1000 + q.run_id) AS k FROM pairs p JOIN pairs q
  ON p.a = q.a AND p.b = q.b AND p.run_id // 3 = q.run_id // 3 AND p.run_id < q.run_id), s AS ({spearman_sql('m', 'run_1, run_2', 'r_1', 'r_2')})
SELECT run_1, run_2, n, round(rho, 6) + 0.0 AS rho FROM s WHERE n > 20""")
def _(spark, d):
    p = pairs(spark, d).withColumn("fov", F.floor(F.col("run_id") / 3).cast("long"))
    m = J.match_pairs_across_runs(p, "fov", "run_id", ["r"])
    return spearman(m, ["run_1", "run_2"], "r_1", "r_2").filter("n > 20").select("run_1", "run_2", "n", r6("rho").alias("rho"))


@query("sequence_counts", f"""{TZ}, {ONSETS}
SELECT a.run_id, a.unit AS a, b.unit AS b, b.frame - a.frame AS lag, count(*) AS n FROM ons a JOIN ons b ON a.run_id = b.run_id AND a.unit <> b.unit
 AND b.frame - a.frame BETWEEN 1 AND 3 GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, d):
    p = J.onset_lag_pairs(onsets(spark, d), R, "unit", "frame", 3)
    return p.groupBy(*R, "a", "b", i8("lag").alias("lag")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("onset_correlogram", f"""{TZ}, {ONSETS}
SELECT a.run_id, b.frame - a.frame AS lag, count(*) AS n FROM ons a JOIN ons b ON a.run_id = b.run_id AND a.unit <> b.unit
 AND b.frame - a.frame BETWEEN 0 AND 5 GROUP BY ALL""")
def _(spark, d):
    from undulate.operators.events import onset_correlogram

    return onset_correlogram(onsets(spark, d), R, "unit", "frame", 5).select(*R, "lag", "n").filter("n > 0")


@query("jitter_null_events", f"""{TZ}, {ONSETS},
x AS (SELECT run_id, unit, rep, abs(frame + {mixed_sql('rep', 'run_id', 'unit', 'frame')} % 11 - 5) AS x FROM ons, (SELECT unnest(range(10)) AS rep))
SELECT run_id, unit, rep::INTEGER AS rep, CASE WHEN x >= {N} THEN 2 * ({N} - 1) - x ELSE x END AS frame FROM x""")
def _(spark, d):
    return U.jitter_null(onsets(spark, d), "frame", 5, N, K + ["frame"], 10)


@query("iei_shuffle_null", f"""{TZ}, {ONSETS},
e AS (SELECT *, frame - lag(frame) OVER w AS iei, row_number() OVER w AS k, first_value(frame) OVER w AS t0 FROM ons WINDOW w AS (PARTITION BY run_id, unit ORDER BY frame)),
r AS (SELECT e.*, rep FROM e, (SELECT unnest(range(10)) AS rep))
SELECT run_id, unit, rep::INTEGER AS rep, (t0 + sum(CASE WHEN k > 1 THEN iei ELSE 0 END) OVER (PARTITION BY run_id, unit, rep ORDER BY CASE WHEN k = 1 THEN -1 ELSE {mixed_sql('rep', 'run_id', 'unit', 'k')} END, k ROWS UNBOUNDED PRECEDING))::BIGINT AS frame FROM r""")
def _(spark, d):
    return U.iei_shuffle_null(onsets(spark, d), K, "frame", 10)


@query("random_events_null", f"""{TZ}, {ONSETS},
n AS (SELECT run_id, unit, count(*) AS n FROM ons GROUP BY ALL), r AS (SELECT n.*, rep FROM n, (SELECT unnest(range(10)) AS rep)),
g AS (SELECT r.*, f AS frame FROM r, (SELECT unnest(range({N})) AS f) WHERE f % 3 = {mixed_sql('rep', 'run_id', 'unit', '-1')} % 3)
SELECT run_id, unit, rep::INTEGER AS rep, frame FROM (SELECT *, row_number() OVER (PARTITION BY run_id, unit, rep ORDER BY {mixed_sql('rep', 'run_id', 'unit', 'frame')}, frame) AS k FROM g) WHERE k <= n""")
def _(spark, d):
    n = onsets(spark, d).groupBy(*K).agg(F.count(F.lit(1)).alias("n"))
    return U.random_events(n, K, "n", N, 3, 10)


@query("label_permutation", f"""WITH {POS}, r AS (SELECT run_id, unit, z, rep FROM pos, (SELECT unnest(range(10)) AS rep)),
a AS (SELECT run_id, rep, unit, row_number() OVER (PARTITION BY run_id, rep ORDER BY unit) AS k FROM r),
b AS (SELECT run_id, rep, z, row_number() OVER (PARTITION BY run_id, rep ORDER BY {mixed_sql('rep', 'run_id', 'unit')}, unit) AS k FROM r)
SELECT run_id, rep::INTEGER AS rep, unit, z FROM a JOIN b USING (run_id, rep, k)""")
def _(spark, d):
    return U.label_permutation(positions(spark, d), R, "unit", "z", 10)
