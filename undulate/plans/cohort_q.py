"""Queries over cohort statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from undulate.functions.scalar import norm_cdf_sql
from undulate.functions.scalar import MIX_P, mixed_sql
from undulate.operators import aggregate as A
from undulate.operators import cohort as C
from undulate.operators import pairs as P
from undulate.operators import signal as S
from undulate.operators.nulls import label_permutation
from undulate.operators.ranks import spearman
from undulate.plans import inputs as I
from undulate.plans.aggregate_q import EVENTS, unit_events
from undulate.plans.events_q import grammar, GRAMMAR
from undulate.plans.pairs_q import spearman_sql
from undulate.plans.registry import i8, query, r6
from undulate.plans.select_q import PAIRS, POS, pairs, positions

K = ["run_id", "unit"]
G = ["run_id"]
N = I.N_FRAMES
T = f"WITH {I.TRACES}"
TZ = f"WITH {I.TRACES}, {I.ROBUST_Z}"

FOV2 = f"""{I.COHORT},
sup AS (SELECT CAST(s_nationkey AS BIGINT) AS fov, avg(s_acctbal) AS human FROM supplier GROUP BY ALL),
fv AS (SELECT fov, subject, genotype, avg(acctbal) AS auto, any_value(human) AS human FROM cohort JOIN sup USING (fov) GROUP BY ALL),
df AS (SELECT *, auto - human AS d FROM fv)
"""


def fov_sources(spark, d):
    c = I.cohort(spark, d).groupBy("fov", "subject", "genotype").agg(F.avg("acctbal").alias("auto"))
    s = I.table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("fov")).agg(F.avg("s_acctbal").alias("human"))
    return c.join(s, "fov").withColumn("d", F.col("auto") - F.col("human"))


@query("wilcoxon_exact", f"""WITH {FOV2},
r AS (SELECT subject, d, row_number() OVER (PARTITION BY subject ORDER BY abs(d)) AS rk, count(*) OVER (PARTITION BY subject) AS n FROM df),
o AS (SELECT subject, any_value(n) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w FROM r GROUP BY ALL),
e AS (SELECT o.subject, o.n, o.w, m, (SELECT coalesce(sum(k), 0) FROM range(1, 17) q(k) WHERE k <= o.n AND (m >> (k - 1)) & 1 = 1) AS s FROM o, range(1024) t(m) WHERE m < (1 << o.n))
SELECT subject, n, CAST(w AS DOUBLE) AS w_plus, round(least(1.0, 2 * least(avg(CASE WHEN s <= w THEN 1.0 ELSE 0 END), avg(CASE WHEN s >= w THEN 1.0 ELSE 0 END))), 6) AS p FROM e GROUP BY ALL""")
def _(spark, d):
    w = C.wilcoxon_signed_rank(fov_sources(spark, d), ["subject"], "d", bounded=True)
    return w.select("subject", "n", "w_plus", r6("p").alias("p"))


def wz(n: str, w: str, tie: str) -> str:
    return f"(({w} - {n} * ({n} + 1) / 4.0::DOUBLE) / sqrt({n} * ({n} + 1) * (2 * {n} + 1) / 24.0::DOUBLE - {tie} / 48.0::DOUBLE))"


@query("wilcoxon_normal", f"""WITH {I.COHORT},
d AS (SELECT fov, n_orders - 10 AS d FROM cohort WHERE n_orders <> 10),
r AS (SELECT fov, d, rank() OVER (PARTITION BY fov ORDER BY abs(d)) + (count(*) OVER (PARTITION BY fov, abs(d)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY fov) AS n, count(*) OVER (PARTITION BY fov, abs(d)) AS t FROM d),
o AS (SELECT fov, any_value(n) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w, sum(t * t - 1)::DOUBLE AS tie FROM r GROUP BY ALL)
SELECT fov, n, w AS w_plus, round(least(1.0, 2 * least({norm_cdf_sql(wz('n', 'w', 'tie'))}, {norm_cdf_sql('(-' + wz('n', 'w', 'tie') + ')')})), 5) AS p FROM o""")
def _(spark, d):
    c = I.cohort(spark, d)
    w = C.wilcoxon_signed_rank(c, ["fov"], "n_orders", mu=10.0, method="normal")
    return w.select("fov", "n", "w_plus", r6("p", 5).alias("p"))


MWU = f"""
rk AS (SELECT metric, genotype, value, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY metric, value) AS t FROM mlong),
mw AS (SELECT metric, count(*) FILTER (genotype = 'wt') AS n_a, count(*) FILTER (genotype = 'mut') AS n_b, sum(rk) FILTER (genotype = 'wt') AS ra, sum(t * t - 1)::DOUBLE AS tie,
  avg(value) FILTER (genotype = 'wt') AS ma, avg(value) FILTER (genotype = 'mut') AS mb, var_samp(value) FILTER (genotype = 'wt') AS va, var_samp(value) FILTER (genotype = 'mut') AS vb,
  quantile_cont(value, 0.5) FILTER (genotype = 'wt') AS qa, quantile_cont(value, 0.5) FILTER (genotype = 'mut') AS qb FROM rk GROUP BY ALL),
mu AS (SELECT *, ra - n_a * (n_a + 1) / 2.0::DOUBLE AS u, n_a::DOUBLE * n_b AS ab, n_a + n_b AS n FROM mw),
mz AS (SELECT *, (abs(u - ab / 2) - 0.5) / sqrt(ab / 12 * ((n + 1) - tie / (n * (n - 1)))) AS zz FROM mu),
mp AS (SELECT *, least(1.0, 2 * {norm_cdf_sql('(-zz)')}) AS p FROM mz)
"""


@query("mann_whitney_effects", f"""WITH {I.COHORT_LONG}, {MWU}
SELECT metric, n_a, n_b, u, round(p, 5) AS p, round(2 * u / ab - 1, 6) + 0.0 AS cliffs_delta, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n - 2)) * (1 - 3.0::DOUBLE / (4 * n - 9)), 6) + 0.0 AS hedges_g,
  round(qa, 4) AS median_a, round(qb, 4) AS median_b FROM mp""")
def _(spark, d):
    m = C.mann_whitney(I.cohort_long(spark, d), ["metric"], "genotype", "wt", "mut", "value")
    return m.select("metric", "n_a", "n_b", "u", r6("p", 5).alias("p"), r6("cliffs_delta").alias("cliffs_delta"),
                    r6("hedges_g").alias("hedges_g"), r6("median_a", 4).alias("median_a"), r6("median_b", 4).alias("median_b"))


FOVM = """
fm AS (SELECT fov, subject, genotype, metric, avg(value) AS value FROM mlong GROUP BY ALL)
"""


@query("compare_groups_fov", f"""WITH {I.COHORT_LONG}, {FOVM},
{MWU.replace('FROM mlong', 'FROM fm')},
k AS (SELECT *, row_number() OVER (ORDER BY p, metric) AS i, count(*) OVER () AS m FROM mp)
SELECT metric, n_a, n_b, u, round(p, 5) AS p, round(least(1.0, min(p * m / i) OVER (ORDER BY p DESC, metric DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 5) AS q,
 round(2 * u / ab - 1, 6) + 0.0 AS cliffs_delta, CAST(least(n_a, n_b) < 11 AS BIGINT) AS low_power FROM k""")
def _(spark, d):
    f = I.cohort_long(spark, d).groupBy("fov", "subject", "genotype", "metric").agg(F.avg("value").alias("value"))
    m = C.compare_groups(f, [], "genotype", "wt", "mut", low_n=11)
    return m.select("metric", "n_a", "n_b", "u", r6("p", 5).alias("p"), r6("q", 5).alias("q"), r6("cliffs_delta").alias("cliffs_delta"), i8("low_power").alias("low_power"))


@query("confound_rho", f"""WITH {I.COHORT_LONG}, {FOVM},
c AS (SELECT fov, count(*)::DOUBLE AS n_runs FROM cohort GROUP BY ALL),
j AS (SELECT metric, value, n_runs FROM fm JOIN c USING (fov)), s AS ({spearman_sql('j', 'metric', 'value', 'n_runs')})
SELECT metric, n, round(rho, 6) + 0.0 AS rho FROM s""")
def _(spark, d):
    l = I.cohort_long(spark, d)
    f = l.groupBy("fov", "metric").agg(F.avg("value").alias("value"), F.count(F.lit(1)).cast("double").alias("n_runs"))
    return spearman(f, ["metric"], "value", "n_runs", bounded=True).select("metric", "n", r6("rho").alias("rho"))


@query("subject_medians", f"""WITH {I.COHORT_LONG}, {FOVM} SELECT metric, genotype, subject, round(quantile_cont(value, 0.5), 5) AS median, count(*) AS n_fov FROM fm GROUP BY ALL""")
def _(spark, d):
    f = I.cohort_long(spark, d).groupBy("fov", "subject", "genotype", "metric").agg(F.avg("value").alias("value"))
    return C.subject_medians(f, ["metric", "genotype"], "subject", "value", bounded=True).select("metric", "genotype", "subject", r6("median", 5).alias("median"), "n_fov")


@query("within_group_direction", f"""WITH {FOV2}
SELECT genotype, count(*) AS n_fov, count(*) FILTER (d > 0) AS n_up, round(power(2.0, 1 - count(*)), 10) AS min_p FROM df GROUP BY ALL""")
def _(spark, d):
    return fov_sources(spark, d).groupBy("genotype").agg(F.count(F.lit(1)).alias("n_fov"), F.count_if(F.col("d") > 0).alias("n_up")).withColumn(
        "min_p", F.round(C.minimum_p(F.col("n_fov")), 10))


@query("compare_sources", f"""WITH {FOV2}, s AS ({spearman_sql('df', 'genotype', 'auto', 'human')}),
a AS (SELECT genotype, avg(CASE WHEN sign(d) = sign(auto - 4500) THEN 1.0 ELSE 0 END) AS g FROM df GROUP BY ALL)
SELECT genotype, n, round(rho, 6) + 0.0 AS rho, round(g, 6) AS sign_agreement FROM s JOIN a USING (genotype)""")
def _(spark, d):
    f = fov_sources(spark, d)
    s = spearman(f, ["genotype"], "auto", "human", bounded=True)
    a = f.groupBy("genotype").agg(r6(F.avg((F.signum("d") == F.signum(F.col("auto") - 4500)).cast("double"))).alias("sign_agreement"))
    return s.join(a, "genotype").select("genotype", "n", r6("rho").alias("rho"), "sign_agreement")


RI = """
g AS (SELECT genotype, fov, count(*)::DOUBLE AS n, avg(acctbal) AS mx, avg(mean_price) AS my, regr_sxx(mean_price, acctbal) AS sxx, regr_sxy(mean_price, acctbal) AS sxy, regr_syy(mean_price, acctbal) AS syy FROM cohort GROUP BY ALL),
w AS (SELECT genotype, sum(n) AS nn, count(*)::DOUBLE AS gg, sum(sxx) AS wxx, sum(sxy) AS wxy, sum(syy) AS wyy, sum(n * n) AS n2, sum(n * mx) / sum(n) AS gx, sum(n * my) / sum(n) AS gy FROM g GROUP BY ALL),
w2 AS (SELECT *, wxy / wxx AS bw, (wyy - wxy / wxx * wxy) / (nn - gg - 1) AS se2 FROM w),
b AS (SELECT g.genotype, sum(n * power(my - gy - bw * (mx - gx), 2)) / (max(gg) - 1) AS msb FROM g JOIN w2 USING (genotype) GROUP BY ALL),
v AS (SELECT w2.*, greatest(0, (msb - se2) / ((nn - n2 / nn) / (gg - 1))) AS su2 FROM w2 JOIN b USING (genotype)),
k AS (SELECT g.*, v.nn, v.gg, v.se2, v.su2, g.n * v.se2 / (v.se2 + g.n * v.su2) AS nk FROM g JOIN v USING (genotype)),
q AS (SELECT genotype, nn, gg, se2, su2, sum(nk) AS a, sum(nk * mx) AS b, sum(sxx + nk * mx * mx) AS c, sum(nk * my) AS p, sum(sxy + nk * mx * my) AS q FROM k GROUP BY ALL)
"""


@query("random_intercept_slope", f"""WITH {I.COHORT}, {RI}
SELECT genotype, CAST(nn AS BIGINT) AS n, CAST(gg AS BIGINT) AS n_groups, round((c * p - b * q) / (a * c - b * b), 3) AS intercept, round((a * q - b * p) / (a * c - b * b), 5) AS slope,
 round(sqrt(se2 * a / (a * c - b * b)), 5) AS se, round(2 * {norm_cdf_sql('(-abs((a * q - b * p) / (a * c - b * b) / sqrt(se2 * a / (a * c - b * b))))')}, 5) AS p, round(se2 / 1e6, 4) AS var_within, round(su2 / 1e6, 4) AS var_group FROM q""")
def _(spark, d):
    m = C.random_intercept_slope(I.cohort(spark, d), ["genotype"], "fov", "mean_price", "acctbal")
    return m.select("genotype", "n", "n_groups", r6("intercept", 3).alias("intercept"), r6("slope", 5).alias("slope"), r6("se", 5).alias("se"),
                    r6("p", 5).alias("p"), r6(F.col("var_within") / 1e6, 4).alias("var_within"), r6(F.col("var_group") / 1e6, 4).alias("var_group"))


@query("random_intercept_mean", f"""WITH {I.COHORT_LONG},
g AS (SELECT metric, fov, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM mlong GROUP BY ALL),
w AS (SELECT metric, sum(n) AS nn, count(*)::DOUBLE AS gg, sum(ss) AS ss, sum(n * n) AS n2, sum(n * m) / sum(n) AS gm FROM g GROUP BY ALL),
b AS (SELECT g.metric, sum(n * power(m - gm, 2)) / (max(gg) - 1) AS msb FROM g JOIN w USING (metric) GROUP BY ALL),
v AS (SELECT metric, ss / (nn - gg) AS se2, greatest(0, (msb - ss / (nn - gg)) / ((nn - n2 / nn) / (gg - 1))) AS su2 FROM w JOIN b USING (metric)),
e AS (SELECT metric, sum(m / (su2 + se2 / n)) / sum(1 / (su2 + se2 / n)) AS mean, sqrt(1 / sum(1 / (su2 + se2 / n))) AS se, count(*) AS n_groups FROM g JOIN v USING (metric) GROUP BY ALL)
SELECT metric, n_groups, round(mean, 4) AS mean, round(se, 4) AS se FROM e""")
def _(spark, d):
    m = C.random_intercept_mean(I.cohort_long(spark, d), ["metric"], "fov", "value")
    return m.select("metric", "n_groups", r6("mean", 4).alias("mean"), r6("se", 4).alias("se"))


@query("depth_gradient_fov", f"""{T}, {POS}, {I.RUNS},
u AS (SELECT run_id, unit, sum(dff) AS act FROM traces GROUP BY ALL),
j AS (SELECT fov, act, y FROM u JOIN pos USING (run_id, unit) JOIN runs USING (run_id)), s AS ({spearman_sql('j', 'fov', 'act', 'y')})
SELECT fov, n, round(rho, 6) + 0.0 AS rho FROM s""")
def _(spark, d):
    u = I.traces(spark, d).groupBy(*K).agg(I.total().alias("act"))
    j = u.join(positions(spark, d), K).join(I.runs(spark, d).select("run_id", "fov"), "run_id")
    return spearman(j, ["fov"], "act", "y").select("fov", "n", r6("rho").alias("rho"))


@query("depth_tercile_means", f"""{T}, {POS},
u AS (SELECT run_id, unit, sum(dff) AS act FROM traces GROUP BY ALL),
q AS (SELECT run_id, quantile_cont(y, 1/3.0) AS a, quantile_cont(y, 2/3.0) AS b FROM pos GROUP BY ALL)
SELECT run_id, CASE WHEN y <= a THEN 'superficial' WHEN y <= b THEN 'middle' ELSE 'deep' END AS band, count(*) AS n, round(avg(act), 5) AS mean_act FROM u JOIN pos USING (run_id, unit) JOIN q USING (run_id) GROUP BY ALL""")
def _(spark, d):
    p = positions(spark, d)
    q = p.groupBy(*G).agg(F.percentile("y", 1 / 3.0).alias("a"), F.percentile("y", 2 / 3.0).alias("b"))
    u = I.traces(spark, d).groupBy(*K).agg(I.total().alias("act"))
    band = F.when(F.col("y") <= F.col("a"), "superficial").when(F.col("y") <= F.col("b"), "middle").otherwise("deep")
    return u.join(p, K).join(q, G).groupBy(*G, band.alias("band")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("act"), 5).alias("mean_act"))


@query("band_pair_contrast", f"""{T}, {POS}, {PAIRS}
SELECT p.run_id, round(avg(r) FILTER (floor(a.y / 5) = floor(b.y / 5)), 6) + 0.0 AS within_r, round(avg(r) FILTER (floor(a.y / 5) <> floor(b.y / 5)), 6) + 0.0 AS between_r
FROM pairs p JOIN pos a ON a.run_id = p.run_id AND a.unit = p.a JOIN pos b ON b.run_id = p.run_id AND b.unit = p.b GROUP BY ALL""")
def _(spark, d):
    p = positions(spark, d).select("run_id", "unit", F.floor(F.col("y") / 5).alias("band"))
    j = pairs(spark, d).join(p.select("run_id", F.col("unit").alias("a"), F.col("band").alias("ba")), [*G, "a"]).join(
        p.select("run_id", F.col("unit").alias("b"), F.col("band").alias("bb")), [*G, "b"])
    same = F.col("ba") == F.col("bb")
    return j.groupBy(*G).agg(r6(F.avg(F.when(same, F.col("r")))).alias("within_r"), r6(F.avg(F.when(~same, F.col("r")))).alias("between_r"))


@query("independence_controls", f"""{TZ},
snr AS (SELECT run_id, unit, (quantile_cont(dff, 0.95) - any_value(med)) / (any_value(mad) + 1e-9) AS s FROM traces JOIN rz_mad USING (run_id, unit) GROUP BY ALL),
hi AS (SELECT run_id, unit FROM snr JOIN (SELECT run_id, quantile_cont(s, 0.5) AS m FROM snr GROUP BY ALL) USING (run_id) WHERE s >= m),
ef AS (SELECT DISTINCT run_id, frame FROM traces WHERE dff > 80),
v AS (SELECT 'all' AS subset, t.run_id, unit, frame, dff FROM traces t UNION ALL SELECT 'high_snr', t.run_id, t.unit, frame, dff FROM traces t SEMI JOIN hi USING (run_id, unit)
  UNION ALL SELECT 'event_frames', t.run_id, t.unit, t.frame, dff FROM traces t SEMI JOIN ef USING (run_id, frame)
  UNION ALL SELECT 'first_half', run_id, unit, frame, dff FROM traces WHERE frame < 30 UNION ALL SELECT 'second_half', run_id, unit, frame, dff FROM traces WHERE frame >= 30),
p AS (SELECT a.subset, a.run_id, a.unit AS a, b.unit AS b, covar_pop(a.dff, b.dff) / nullif(sqrt(var_pop(a.dff) * var_pop(b.dff)), 0) AS r FROM v a JOIN v b ON a.subset = b.subset AND a.run_id = b.run_id AND a.frame = b.frame AND a.unit < b.unit GROUP BY ALL),
q AS (SELECT subset, run_id, count(r) AS n_pairs, (1 + sqrt(1 + 8 * count(r))) / 2 AS n, sum(r * r) AS s2, avg(r) AS mean_r, avg(CASE WHEN abs(r) > 0.3 THEN 1.0 ELSE 0 END) AS frac_strong FROM p GROUP BY ALL)
SELECT subset, run_id, n_pairs, round(mean_r, 6) + 0.0 AS mean_r, round(frac_strong, 6) AS frac_strong, round(CASE WHEN n_pairs >= 3 THEN n / (n + 2 * s2) END, 6) AS eff_dim FROM q""")
def _(spark, d):
    t = I.traces(spark, d)
    s = S.snr(t, K, "dff", eps=1e-9)
    hi = s.join(s.groupBy(*G).agg(F.percentile("snr", 0.5).alias("_m")), G).filter("snr >= _m").select(*K)
    ef = t.filter("dff > 80").select(*G, "frame").distinct()
    sub = {"all": t, "high_snr": t.join(hi, K, "left_semi"), "event_frames": t.join(ef, [*G, "frame"], "left_semi"),
           "first_half": t.filter("frame < 30"), "second_half": t.filter("frame >= 30")}
    v = None
    for n, x in sub.items():
        x = x.select(F.lit(n).alias("subset"), *K, "frame", "dff")
        v = x if v is None else v.unionByName(x)
    p = P.pair_corr(v, ["subset", "run_id"], "unit", "frame", "dff")
    q = p.groupBy("subset", *G).agg(F.count("r").alias("n_pairs"), r6(F.avg("r")).alias("mean_r"), F.sum(F.col("r") * F.col("r")).alias("_s2"),
                                    r6(F.avg((F.coalesce(F.abs("r"), F.lit(0.0)) > 0.3).cast("double"))).alias("frac_strong"))
    n = (1 + F.sqrt(1 + 8 * F.col("n_pairs"))) / 2  # units that vary
    return q.select("subset", *G, "n_pairs", "mean_r", "frac_strong", r6(F.when(F.col("n_pairs") >= 3, n / (n + 2 * F.col("_s2")))).alias("eff_dim"))


@query("stability_halves", f"""{T},
h AS (SELECT run_id, unit, sum(n_ev) FILTER (frame < 30)::DOUBLE AS a, sum(n_ev) FILTER (frame >= 30)::DOUBLE AS b FROM traces GROUP BY ALL), s AS ({spearman_sql('h', 'run_id', 'a', 'b')})
SELECT run_id, n, round(rho, 6) + 0.0 AS rho FROM s""")
def _(spark, d):
    h = I.traces(spark, d).groupBy(*K).agg(F.sum(F.when(F.col("frame") < 30, F.col("n_ev"))).alias("a"), F.sum(F.when(F.col("frame") >= 30, F.col("n_ev"))).alias("b"))
    return spearman(h, G, "a", "b", bounded=True).select(*G, "n", r6("rho").alias("rho"))


@query("cohen_kappa_runs", f"""{T},
l AS (SELECT run_id, unit, CASE WHEN sum(n_ev) > 70 THEN 'high' WHEN sum(n_ev) > 62 THEN 'mid' ELSE 'low' END AS lab FROM traces GROUP BY ALL),
p AS (SELECT a.run_id // 3 AS fov, a.lab AS a, b.lab AS b FROM l a JOIN l b ON a.unit = b.unit AND a.run_id // 3 = b.run_id // 3 AND a.run_id < b.run_id),
n AS (SELECT fov, count(*) AS n, count(*) FILTER (a = b) AS same FROM p GROUP BY ALL),
ra AS (SELECT fov, a AS l, count(*) AS k FROM p GROUP BY ALL), rb AS (SELECT fov, b AS l, count(*) AS k FROM p GROUP BY ALL),
e AS (SELECT ra.fov, sum(ra.k * coalesce(rb.k, 0))::DOUBLE AS e, max(ra.k) AS mx FROM ra LEFT JOIN rb USING (fov, l) GROUP BY ALL)
SELECT fov, n, round(same / n, 6) AS agreement, round(mx / n, 6) AS majority, round((same / n - e / (n * n)) / (1 - e / (n * n)), 6) + 0.0 AS kappa FROM n JOIN e USING (fov)""")
def _(spark, d):
    l = I.traces(spark, d).groupBy(*K).agg(F.sum("n_ev").alias("s"))
    l = l.select(F.floor(F.col("run_id") / 3).cast("long").alias("fov"), "run_id", "unit", F.when(F.col("s") > 70, "high").when(F.col("s") > 62, "mid").otherwise("low").alias("lab"))
    a, b = l.withColumnsRenamed({"lab": "a", "run_id": "r1"}), l.withColumnsRenamed({"lab": "b", "run_id": "r2"})
    p = a.join(b, ["fov", "unit"]).filter("r1 < r2")
    k = C.cohen_kappa(p, ["fov"], "a", "b")
    return k.select("fov", i8("n").alias("n"), r6("agreement").alias("agreement"), r6("majority").alias("majority"), r6("kappa").alias("kappa"))


@query("threshold_sensitivity", f"""{TZ},
th AS (SELECT unnest([2.0, 3.0, 4.0]::DOUBLE[]) AS thr),
f AS (SELECT g.run_id, thr, g.frame, coalesce(c, 0) AS c FROM (SELECT DISTINCT run_id, frame FROM traces) g JOIN th ON true LEFT JOIN (SELECT run_id, thr, frame, count(*) AS c FROM rz, th WHERE z > thr GROUP BY ALL) x USING (run_id, thr, frame))
SELECT run_id, thr, round(var_pop(c) / nullif(avg(c), 0), 6) AS fano, round(avg(CASE WHEN c = 0 THEN 1.0 ELSE 0 END), 6) AS silent_fraction FROM f GROUP BY ALL""")
def _(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff").withColumn("thr", F.explode(F.array(*[F.lit(x) for x in (2.0, 3.0, 4.0)])))
    c = z.groupBy(*G, "thr", "frame").agg(F.sum(F.coalesce(F.col("z") > F.col("thr"), F.lit(False)).cast("long")).alias("n"))
    f = A.fano_silent(c, [*G, "thr"], "n")
    return f.select(*G, "thr", r6("fano").alias("fano"), r6("silent_fraction").alias("silent_fraction"))


@query("parameter_sweep", f"""{TZ}, p AS (SELECT hi, lo FROM (SELECT unnest([1.0, 2.0, 3.0]::DOUBLE[]) AS hi), (SELECT unnest([30.0, 80.0]::DOUBLE[]) AS lo)),
x AS (SELECT hi, lo, run_id, count(*) AS n FROM rz, p WHERE z > hi AND dff > lo GROUP BY ALL)
SELECT hi, lo, CAST(sum(n) AS BIGINT) AS n_hits, max(n) - min(n) AS spread FROM x GROUP BY ALL""")
def _(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff")
    x = z.withColumn("hi", F.explode(F.array(*[F.lit(v) for v in (1.0, 2.0, 3.0)]))).withColumn("lo", F.explode(F.array(F.lit(30.0), F.lit(80.0))))
    n = x.filter((F.col("z") > F.col("hi")) & (F.col("dff") > F.col("lo"))).groupBy("hi", "lo", *G).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("hi", "lo").agg(F.sum("n").alias("n_hits"), (F.max("n") - F.min("n")).alias("spread"))


@query("enrichment_set_distance")
def _(spark, d):
    """Mean pairwise distance of the most active third of a run's units against label permutations."""
    from undulate.operators.topk import top_share_rows

    u = I.traces(spark, d).groupBy(*K).agg(I.total().alias("act"))
    top = top_share_rows(u, G, "act", 1 / 3, ["unit"]).select(*K, F.lit(1).alias("in_set"))
    lab = positions(spark, d).join(top, K, "left").fillna(0, ["in_set"]).select(*K, "in_set")
    perm = label_permutation(lab, G, "unit", "in_set", 20).select(*G, "rep", "unit", "in_set")
    both = lab.withColumn("rep", F.lit(-1)).select(*G, "rep", "unit", "in_set").unionByName(perm).filter("in_set = 1")
    j = both.join(positions(spark, d), K)
    # mean squared distance of all pairs of a set = 2·n/(n−1)·Σ var, no pair formed
    g = j.groupBy(*G, "rep").agg(F.count(F.lit(1)).alias("n"), (F.var_pop("z") + F.var_pop("y") + F.var_pop("x")).alias("v"))
    g = g.withColumn("msd", 2 * F.col("n") / (F.col("n") - 1) * F.col("v"))
    o = g.filter("rep = -1").select(*G, F.col("msd").alias("obs"))
    return g.filter("rep >= 0").join(o, G).groupBy(*G, "obs").agg(
        ((1 + F.sum((F.col("msd") <= F.col("obs")).cast("long"))) / (1 + F.count(F.lit(1)))).alias("p"), F.avg("msd").alias("null_mean"))


@query("chi2_state_events", f"""{TZ}, {I.BEHAVIOR}, {EVENTS}, {GRAMMAR},
t AS (SELECT run_id, count(*) FILTER (state <> 'quiet' AND e) AS a, count(*) FILTER (state <> 'quiet' AND NOT e) AS b, count(*) FILTER (state = 'quiet' AND e) AS c, count(*) FILTER (state = 'quiet' AND NOT e) AS d
  FROM (SELECT s.*, (run_id, frame) IN (SELECT (run_id, f_peak) FROM evt WHERE amp > 150) AS e FROM st s) GROUP BY ALL),
x AS (SELECT *, (a+b+c+d) * power(a::DOUBLE*d - b::DOUBLE*c, 2) / nullif((a+b)::DOUBLE*(c+d)*(a+c)*(b+d), 0) AS chi FROM t)
SELECT run_id, round(chi, 6) AS chi2, round(2 * {norm_cdf_sql('(-sqrt(chi))')}, 5) AS p FROM x""")
def _(spark, d):
    g = grammar(spark, d)
    e = unit_events(spark, d).filter("amp > 150").select(*G, F.col("f_peak").alias("frame")).distinct().withColumn("e", F.lit(True))
    j = g.join(e, [*G, "frame"], "left").withColumn("e", F.coalesce("e", F.lit(False))).withColumn("q", F.col("state") == "quiet")
    t = j.groupBy(*G).agg(F.count_if(~F.col("q") & F.col("e")).alias("a"), F.count_if(~F.col("q") & ~F.col("e")).alias("b"),
                          F.count_if(F.col("q") & F.col("e")).alias("c"), F.count_if(F.col("q") & ~F.col("e")).alias("d"))
    return C.chi2_2x2(t, G, "a", "b", "c", "d").select(*G, r6("chi2").alias("chi2"), r6("p", 5).alias("p"))


@query("sign_test_fov", f"""WITH {FOV2},
s AS (SELECT genotype, count(*) AS n, count(*) FILTER (d > 0) AS k FROM df GROUP BY ALL)
SELECT genotype, n, k AS n_pos, round(least(1.0, 2 * (SELECT sum(exp(lgamma(s.n + 1) - lgamma(i + 1) - lgamma(s.n - i + 1) - s.n * ln(2))) FROM range(0, 40) r(i) WHERE i <= least(s.k, s.n - s.k))), 6) AS p FROM s""")
def _(spark, d):
    s = fov_sources(spark, d).groupBy("genotype").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("n_pos"))
    return s.withColumn("p", r6(C.sign_test(F.col("n_pos"), F.col("n"))))


# Poisson(1) weights of uniform numbers with 2^31 - 1 steps: how many of the cumulative probabilities lie below
POISSON_CDF = "(SELECT list(c ORDER BY k) FROM (SELECT k, sum(exp(-1.0::DOUBLE) / gamma(k + 1)) OVER (ORDER BY k) AS c FROM range(0, 13) t(k)))"


@query("bootstrap_ci_triggered_mean", f"""WITH {I.COHORT}, p AS (SELECT {POISSON_CDF} AS cdf),
r AS (SELECT fov, rep, mean_price AS v, {mixed_sql('rep', 'run_id')} / {MIX_P}.0::DOUBLE AS u FROM cohort, (SELECT unnest(range(100)) AS rep) WHERE mean_price IS NOT NULL),
w AS (SELECT fov, rep, v, len(list_filter(cdf, lambda c: u > c)) AS w FROM r, p),
m AS (SELECT fov, rep, sum(w * v) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL),
ci AS (SELECT fov, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY ALL),
b AS (SELECT fov, avg(mean_price) AS mean, count(mean_price) AS n FROM cohort GROUP BY ALL)
SELECT fov, round(mean, 4) AS mean, n, round(lo, 4) AS ci_lo, round(hi, 4) AS ci_hi FROM b JOIN ci USING (fov)""")
def _(spark, d):
    b = C.bootstrap_ci(I.cohort(spark, d), ["fov"], ["run_id"], "mean_price", 100)
    return b.select("fov", r6("mean", 4).alias("mean"), "n", r6("ci_lo", 4).alias("ci_lo"), r6("ci_hi", 4).alias("ci_hi"))


