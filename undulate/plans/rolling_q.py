"""Queries over rolling, ordered and selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from undulate.functions.scalar import mixed_sql
from undulate.operators import rolling as R
from undulate.operators import signal as S
from undulate.plans import inputs as I
from undulate.plans.registry import i8, query, r6

K = ["run_id", "unit"]
T = f"WITH {I.TRACES}"
TZ = f"WITH {I.TRACES}, {I.ROBUST_Z}"
N = I.N_FRAMES


@query("rolling_quantile_reflect", f"""{T},
pad AS (SELECT run_id, unit, frame, dff FROM traces
  UNION ALL SELECT run_id, unit, -frame, dff FROM traces WHERE frame BETWEEN 1 AND 5
  UNION ALL SELECT run_id, unit, 2*({N}-1) - frame, dff FROM traces WHERE frame BETWEEN {N}-1-4 AND {N}-2)
SELECT run_id, unit, frame, b AS baseline FROM (SELECT run_id, unit, frame, round(quantile_cont(dff, 0.1) OVER
  (PARTITION BY run_id, unit ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS b FROM pad)
WHERE frame BETWEEN 0 AND {N}-1""")
def _(spark, d):
    x = R.rolling_quantile(I.traces(spark, d), K, "frame", "dff", 5, 4, 0.1, pad="reflect", n_frames=N)
    return x.select(*K, "frame", r6("baseline").alias("baseline"))


@query("rolling_quantile_truncated", f"""{T}
SELECT run_id, unit, frame, round(quantile_cont(dff, 0.2) OVER
  (PARTITION BY run_id, unit ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), 6) + 0.0 AS baseline FROM traces""")
def _(spark, d):
    x = R.rolling_quantile(I.traces(spark, d), K, "frame", "dff", 6, 5, 0.2)
    return x.select(*K, "frame", r6("baseline").alias("baseline"))


@query("rolling_quantile_symmetric", f"""{T},
pad AS (SELECT run_id, unit, frame, dff FROM traces
  UNION ALL SELECT run_id, unit, -frame - 1, dff FROM traces WHERE frame BETWEEN 0 AND 3
  UNION ALL SELECT run_id, unit, 2*{N} - 1 - frame, dff FROM traces WHERE frame BETWEEN {N}-4 AND {N}-1)
SELECT run_id, unit, frame, b AS baseline FROM (SELECT run_id, unit, frame, round(quantile_cont(dff, 0.2) OVER
  (PARTITION BY run_id, unit ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS b FROM pad)
WHERE frame BETWEEN 0 AND {N}-1""")
def _(spark, d):
    x = R.rolling_quantile(I.traces(spark, d), K, "frame", "dff", 4, 4, 0.2, pad="symmetric", n_frames=N)
    return x.select(*K, "frame", r6("baseline").alias("baseline"))


@query("rolling_quantile_nearest", f"""{T},
pad AS (SELECT run_id, unit, frame, dff FROM traces
  UNION ALL SELECT run_id, unit, -k, dff FROM traces, (SELECT unnest(range(1, 4)) AS k) WHERE frame = 0
  UNION ALL SELECT run_id, unit, {N} - 1 + k, dff FROM traces, (SELECT unnest(range(1, 4)) AS k) WHERE frame = {N}-1)
SELECT run_id, unit, frame, b AS baseline FROM (SELECT run_id, unit, frame, round(quantile_cont(dff, 0.3) OVER
  (PARTITION BY run_id, unit ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) + 0.0 AS b FROM pad)
WHERE frame BETWEEN 0 AND {N}-1""")
def _(spark, d):
    x = R.rolling_quantile(I.traces(spark, d), K, "frame", "dff", 3, 3, 0.3, pad="nearest", n_frames=N)
    return x.select(*K, "frame", r6("baseline").alias("baseline"))


@query("rolling_median_mad", f"""{T},
m AS (SELECT *, quantile_cont(dff, 0.5) OVER w AS med, list(dff) OVER w AS l FROM traces
  WINDOW w AS (PARTITION BY run_id, unit ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT run_id, unit, frame, round(med, 6) + 0.0 AS med,
  round(list_aggregate(list_transform(l, lambda x: abs(x - med)), 'quantile_cont', 0.5), 6) + 0.0 AS mad FROM m""")
def _(spark, d):
    x = R.rolling_mad(I.traces(spark, d), K, "frame", "dff", 5)
    return x.select(*K, "frame", r6("med").alias("med"), r6("mad").alias("mad"))


@query("rolling_mean_centred", f"""{T}
SELECT run_id, unit, frame, round(avg(dff) OVER w, 6) + 0.0 AS avg2,
  round(sum(dff) OVER v / 5, 6) + 0.0 AS box5 FROM traces
WINDOW w AS (PARTITION BY run_id, unit ORDER BY frame ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
       v AS (PARTITION BY run_id, unit ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(spark, d):
    x = R.rolling_mean(I.traces(spark, d), K, "frame", "dff", 1, 0, "avg2")
    x = R.moving_avg_zero_padded(x, K, "frame", "dff", 5, "box5")
    return x.select(*K, "frame", r6("avg2").alias("avg2"), r6("box5").alias("box5"))


def gaussian_sql(sigma: float, src: str, keys: str, t: str, v: str, n: int, out: str) -> str:
    """CTE computing the mirrored Gaussian by a weights table."""
    r = int(4 * sigma + 0.5)
    return f"""
{out}_w AS (SELECT k, exp(-0.5 * (k / {sigma}) * (k / {sigma})) / sum(exp(-0.5 * (k / {sigma}) * (k / {sigma}))) OVER () AS w
   FROM (SELECT unnest(range(-{r}, {r} + 1)) AS k)),
{out} AS (SELECT {keys}, a.{t}, sum(w * b.{v}) AS smooth FROM
   (SELECT {keys}, {t}, k, w, CASE WHEN {t} + k < 0 THEN -({t} + k) - 1
      WHEN {t} + k >= {n} THEN 2 * {n} - 1 - ({t} + k) ELSE {t} + k END AS src FROM {src}, {out}_w) a
   JOIN (SELECT {keys}, {t} AS src, {v} FROM {src}) b USING ({keys}, src) GROUP BY {keys}, a.{t})
"""


@query("gaussian_smooth_1d", f"""{T}, {gaussian_sql(1.5, 'traces', 'run_id, unit', 'frame', 'dff', N, 'g')}
SELECT run_id, unit, frame, round(smooth, 6) + 0.0 AS smooth FROM g""")
def _(spark, d):
    x = R.gaussian_smooth_1d(I.traces(spark, d), K, "frame", "dff", 1.5, N)
    return x.select(*K, "frame", r6("smooth").alias("smooth"))


@query("diff_prepend", f"""{T}
SELECT run_id, unit, frame, round(coalesce(dff - lag(dff) OVER (PARTITION BY run_id, unit ORDER BY frame), 0), 6) + 0.0 AS diff
FROM traces""")
def _(spark, d):
    x = R.diff_prepend(I.traces(spark, d), K, "frame", "dff")
    return x.select(*K, "frame", r6("diff").alias("diff"))


@query("rising_edges", f"""{TZ}
SELECT run_id, unit, frame FROM (SELECT *, lag(z) OVER (PARTITION BY run_id, unit ORDER BY frame) AS p FROM rz)
WHERE z > 1.0 AND p <= 1.0""")
def _(spark, d):
    x = R.rising_edges(S.robust_z(I.traces(spark, d), K, "dff"), K, "frame", "z", 1.0)
    return x.filter("edge").select(*K, "frame")


@query("dilate_flags", f"""{TZ}
SELECT run_id, unit, frame, CAST(max(CASE WHEN z > 2 THEN 1 ELSE 0 END) OVER
  (PARTITION BY run_id, unit ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS dilated FROM rz""")
def _(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff").withColumn("f", F.coalesce(F.col("z") > 2, F.lit(False)).cast("long"))
    return R.dilate_flags(z, K, "frame", "f", 2).select(*K, "frame", "dilated")


@query("interp_bad_runs", f"""{TZ},
g AS (SELECT *, z > 2 AS bad FROM rz),
h AS (SELECT *, last_value(CASE WHEN NOT bad THEN frame END IGNORE NULLS) OVER a AS lt,
    last_value(CASE WHEN NOT bad THEN dff END IGNORE NULLS) OVER a AS lv,
    first_value(CASE WHEN NOT bad THEN frame END IGNORE NULLS) OVER b AS rt,
    first_value(CASE WHEN NOT bad THEN dff END IGNORE NULLS) OVER b AS rv,
    sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, unit) AS n FROM g
  WINDOW a AS (PARTITION BY run_id, unit ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY run_id, unit ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT run_id, unit, frame, round(CASE WHEN NOT bad OR n < 3 THEN dff WHEN lt IS NULL THEN rv WHEN rt IS NULL THEN lv
  ELSE lv + (rv - lv) * (frame - lt) / (rt - lt) END, 6) + 0.0 AS fixed FROM h""")
def _(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff").withColumn("bad", F.col("z") > 2)
    x = R.interp_bad_runs(z, K, "frame", "dff", "bad")
    return x.select(*K, "frame", r6("fixed").alias("fixed"))


@query("gaps_and_islands", f"""{TZ},
a AS (SELECT run_id, unit, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY run_id, unit ORDER BY frame) <= 3
   THEN 0 ELSE 1 END AS s FROM rz WHERE z > 1.5),
b AS (SELECT *, sum(s) OVER (PARTITION BY run_id, unit ORDER BY frame) AS g FROM a)
SELECT run_id, unit, min(frame) AS f_start, max(frame) AS f_end, count(*) AS n_frames FROM b GROUP BY run_id, unit, g""")
def _(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff").filter("z > 1.5")
    return R.island_table(z, K, "frame", 3).select(*K, "f_start", "f_end", "n_frames")


@query("hysteresis_events", f"""{TZ},
m AS (SELECT *, CASE WHEN z > 2 THEN 1 WHEN z < 0.5 THEN 0 END AS m FROM rz),
s AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY run_id, unit ORDER BY frame
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM m),
e AS (SELECT *, lag(st, 1, 0) OVER (PARTITION BY run_id, unit ORDER BY frame) AS was FROM s),
x AS (SELECT run_id, unit, frame, st, lead(frame) OVER (PARTITION BY run_id, unit ORDER BY frame) AS nxt FROM e WHERE st <> was)
SELECT run_id, unit, frame AS f_start, coalesce(nxt, {N} - 1) AS f_end, CAST(nxt IS NOT NULL AS BIGINT) AS closed FROM x
WHERE st = 1 AND coalesce(nxt, {N}) - frame >= 2""")
def _(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff")
    e = R.hysteresis_events(z, K, "frame", "z", 2.0, 0.5, 2)
    return e.select(*K, "f_start", "f_end", i8("closed").alias("closed"))


@query("longest_block", f"""WITH {I.TRACES},
t AS (SELECT DISTINCT run_id, CAST(us // 1000 AS BIGINT) AS ms FROM ev WHERE event_type = 'error'),
a AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY run_id ORDER BY ms) <= 10800000 THEN 0 ELSE 1 END AS s FROM t),
b AS (SELECT *, sum(s) OVER (PARTITION BY run_id ORDER BY ms) AS g FROM a),
c AS (SELECT run_id, min(ms) AS start, max(ms) AS stop, count(*) AS n FROM b GROUP BY run_id, g)
SELECT run_id, start, stop, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY stop - start DESC, start) AS rn FROM c)
WHERE rn = 1""")
def _(spark, d):
    t = I.keyed_events(spark, d).filter("event_type = 'error'").select(
        "run_id", F.floor(F.col("us") / 1000).cast("long").alias("ms")).distinct()
    return R.longest_block(t, ["run_id"], "ms", 10_800_000, ).select("run_id", "start", "stop", "n")


REFR = f"""WITH RECURSIVE {I.TRACES}, {I.ROBUST_Z},
on_ AS (SELECT run_id, unit, frame FROM (SELECT *, lag(z) OVER (PARTITION BY run_id, unit ORDER BY frame) AS p FROM rz)
  WHERE z > 1.0 AND p <= 1.0),
k AS (SELECT run_id, unit, min(frame) AS frame FROM on_ GROUP BY ALL
  UNION ALL SELECT k.run_id, k.unit, (SELECT min(o.frame) FROM on_ o WHERE o.run_id = k.run_id AND o.unit = k.unit
     AND o.frame >= k.frame + 5) FROM k WHERE k.frame IS NOT NULL)
SELECT run_id, unit, frame FROM k WHERE frame IS NOT NULL"""


@query("refractory_greedy", REFR)
def _(spark, d):
    x = R.rising_edges(S.robust_z(I.traces(spark, d), K, "dff"), K, "frame", "z", 1.0).filter("edge")
    return R.refractory(x, K, "frame", 5).select(*K, "frame")


@query("refractory_seen", f"""{TZ},
on_ AS (SELECT run_id, unit, frame FROM (SELECT *, lag(z) OVER (PARTITION BY run_id, unit ORDER BY frame) AS p FROM rz)
  WHERE z > 1.0 AND p <= 1.0)
SELECT run_id, unit, frame FROM (SELECT *, lag(frame) OVER (PARTITION BY run_id, unit ORDER BY frame) AS q FROM on_)
WHERE q IS NULL OR frame - q >= 5""")
def _(spark, d):
    x = R.rising_edges(S.robust_z(I.traces(spark, d), K, "dff"), K, "frame", "z", 1.0).filter("edge")
    return R.refractory_seen(x, K, "frame", 5).select(*K, "frame")


LOCMAX = """
r0 AS (SELECT *, lag(dff) OVER w AS p FROM traces WINDOW w AS (PARTITION BY run_id, unit ORDER BY frame)),
r1 AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> dff THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, unit ORDER BY frame) AS g FROM r0),
r2 AS (SELECT run_id, unit, g, min(frame) AS s, max(frame) AS e, max(dff) AS height FROM r1 GROUP BY ALL),
r3 AS (SELECT *, lag(height) OVER w AS hl, lead(height) OVER w AS hr FROM r2 WINDOW w AS (PARTITION BY run_id, unit ORDER BY g)),
pk AS (SELECT run_id, unit, (s + e) // 2 AS peak, height FROM r3 WHERE hl < height AND hr < height)
"""

SPACED = """list_reduce(list_prepend([]::BIGINT[], list_transform(l, lambda p: [p])), lambda acc, p: CASE WHEN len(list_filter(acc, lambda q: abs(q - p[1]) < {sep})) > 0 THEN acc ELSE list_concat(acc, p) END)"""

PROMINENT = f"""
pb AS (SELECT kp.*, (SELECT max(frame) FROM traces t WHERE t.run_id = kp.run_id AND t.unit = kp.unit AND t.frame < peak AND t.dff > height) AS lh,
  (SELECT min(frame) FROM traces t WHERE t.run_id = kp.run_id AND t.unit = kp.unit AND t.frame > peak AND t.dff > height) AS rh FROM kp),
pc AS (SELECT pb.run_id, pb.unit, pb.peak, pb.height, min(CASE WHEN t.frame <= peak AND t.frame > coalesce(lh, -1) THEN dff END) AS lm,
  min(CASE WHEN t.frame >= peak AND t.frame < coalesce(rh, {N}) THEN dff END) AS rm FROM pb JOIN traces t ON t.run_id = pb.run_id AND t.unit = pb.unit GROUP BY ALL),
pp AS (SELECT run_id, unit, peak, height, height - greatest(lm, rm) AS prominence FROM pc)
"""


def spaced_peaks(height: float, sep: int) -> str:
    """Peaks of at least a height, greedily by height with a least distance: table kp."""
    return f"""kl AS (SELECT run_id, unit, list(peak ORDER BY height DESC, peak) AS l FROM pk WHERE height >= {height} GROUP BY ALL),
kp AS (SELECT run_id, unit, peak, height FROM (SELECT run_id, unit, unnest({SPACED.format(sep=sep)}) AS peak FROM kl) JOIN pk USING (run_id, unit, peak))"""


@query("find_peaks_prominence", f"""{T}, {LOCMAX},
b AS (SELECT pk.*, (SELECT max(frame) FROM traces t WHERE t.run_id = pk.run_id AND t.unit = pk.unit AND t.frame < peak AND t.dff > height) AS lh,
  (SELECT min(frame) FROM traces t WHERE t.run_id = pk.run_id AND t.unit = pk.unit AND t.frame > peak AND t.dff > height) AS rh
  FROM pk WHERE height >= 20),
c AS (SELECT b.run_id, b.unit, b.peak, b.height, min(CASE WHEN t.frame <= peak AND t.frame > coalesce(lh, -1) THEN dff END) AS lm,
  min(CASE WHEN t.frame >= peak AND t.frame < coalesce(rh, {N}) THEN dff END) AS rm
  FROM b JOIN traces t ON t.run_id = b.run_id AND t.unit = b.unit GROUP BY ALL)
SELECT run_id, unit, peak, height, round(height - greatest(lm, rm), 6) + 0.0 AS prominence FROM c
WHERE height - greatest(lm, rm) >= 30""")
def _(spark, d):
    p = R.find_peaks(I.traces(spark, d), K, "frame", "dff", height=20.0, prominence=30.0)
    return p.select(*K, "peak", "height", r6("prominence").alias("prominence"))


@query("find_peaks_distance", f"""{T}, {LOCMAX}, {spaced_peaks(20, 4)}, {PROMINENT}
SELECT run_id, unit, peak, height, round(prominence, 6) + 0.0 AS prominence FROM pp""")
def _(spark, d):
    p = R.find_peaks(I.traces(spark, d), K, "frame", "dff", height=20.0, distance=4)
    return p.select(*K, "peak", "height", r6("prominence").alias("prominence"))


@query("peak_of_run", f"""{TZ},
a AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY run_id, unit ORDER BY frame) = 1 THEN 0 ELSE 1 END AS s
  FROM rz WHERE z > 1.0),
b AS (SELECT *, sum(s) OVER (PARTITION BY run_id, unit ORDER BY frame) AS g FROM a)
SELECT run_id, unit, min(frame) AS f_start, max(frame) AS f_end, arg_max(frame, z - frame * 1e-12) AS f_peak,
  round(max(dff), 6) AS amp, count(*) AS duration FROM b GROUP BY run_id, unit, g HAVING count(*) >= 2""")
def _(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff")
    p = R.peak_of_run(z.filter("z > 1.0").withColumn("q", F.col("dff")), K, "frame", "q", -1.0, 2)
    return p.select(*K, "f_start", "f_end", "f_peak", r6("amp").alias("amp"), "duration")


@query("bh_qvalue", f"""WITH {I.COHORT},
p AS (SELECT fov, run_id, (1 + floor(abs(acctbal)) % 997) / 1000.0 AS p FROM cohort),
a AS (SELECT *, row_number() OVER (PARTITION BY fov ORDER BY p, run_id) AS rk, count(*) OVER (PARTITION BY fov) AS n FROM p)
SELECT fov, run_id, p, round(least(1.0, min(p * n / rk) OVER (PARTITION BY fov ORDER BY p DESC, run_id DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q FROM a""")
def _(spark, d):
    p = I.cohort(spark, d).select("fov", "run_id", (
        (1 + F.pmod(F.floor(F.abs("acctbal")).cast("double"), F.lit(997.0))) / 1000.0).alias("p"))
    return R.bh_qvalue(p, ["fov"], "p").select("fov", "run_id", "p", F.round("q", 8).alias("q"))


@query("zscore_within_group", f"""WITH {I.COHORT}
SELECT run_id, round((mean_price - avg(mean_price) OVER w) / (stddev_samp(mean_price) OVER w + 1e-9), 6) + 0.0 AS z,
  round(mean_price - avg(mean_price) OVER w, 6) + 0.0 AS centred FROM cohort WINDOW w AS (PARTITION BY fov)""")
def _(spark, d):
    c = R.demean_within(R.zscore_within(I.cohort(spark, d), ["fov"], "mean_price"), ["fov"], "mean_price")
    return c.select("run_id", r6("z").alias("z"), r6("centred").alias("centred"))


@query("split_halves_thirds_folds", f"""{T}
SELECT run_id, unit, CASE WHEN frame < {N} // 2 THEN 0 ELSE 1 END AS half,
  ntile(7) OVER (PARTITION BY run_id, unit ORDER BY frame) - 1 AS part,
  (SELECT count(*) - 1 FROM range(7) r(i) WHERE (r.i * {N}) // 7 <= frame) AS fold, frame FROM traces""")
def _(spark, d):
    return I.traces(spark, d).select(
        *K, R.half_split("frame", N).alias("half"), R.array_split_part("frame", N, 7).alias("part"),
        R.blocked_fold("frame", N, 7).alias("fold"), "frame")


@query("lag_design", f"""{T}, {I.BEHAVIOR},
m AS (SELECT run_id, signal, avg(value) AS m FROM behavior GROUP BY ALL)
SELECT run_id, signal, frame, round(coalesce(lag(value, 2) OVER w, m), 6) + 0.0 AS lag_p2,
 round(coalesce(lag(value, 1) OVER w, m), 6) + 0.0 AS lag_p1, round(value, 6) + 0.0 AS lag_p0,
 round(coalesce(lead(value, 1) OVER w, m), 6) + 0.0 AS lag_m1, round(coalesce(lead(value, 2) OVER w, m), 6) + 0.0 AS lag_m2
FROM behavior JOIN m USING (run_id, signal) WINDOW w AS (PARTITION BY run_id, signal ORDER BY frame)""")
def _(spark, d):
    x = R.lag_design(I.behavior(spark, d), ["run_id", "signal"], "frame", "value", 2)
    return x.select("run_id", "signal", "frame", *[r6(c).alias(c) for c in ("lag_p2", "lag_p1", "lag_p0", "lag_m1", "lag_m2")])


@query("topk_spaced", f"""{TZ}, s AS (SELECT run_id, unit, list(frame ORDER BY z DESC, frame) AS l FROM rz WHERE z IS NOT NULL GROUP BY ALL),
k AS (SELECT run_id, unit, unnest(({SPACED.format(sep=6)})[1:4]) AS frame FROM s)
SELECT run_id, unit, frame, round(z, 6) + 0.0 AS z FROM (SELECT k.*, z, max(z) OVER (PARTITION BY run_id, unit) AS b FROM k JOIN rz USING (run_id, unit, frame)) WHERE z >= 0.5 * b""")
def _(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff").filter(F.col("z").isNotNull()).select(*K, "frame", "z")
    x = R.spaced_by_score(z, K, "frame", "z", 6, k=4)
    best = x.groupBy(*K).agg(F.max("z").alias("_b"))
    return x.join(best, K).filter(F.col("z") >= 0.5 * F.col("_b")).select(*K, "frame", r6("z").alias("z"))


@query("topk_nms", f"""{T}, s AS (SELECT run_id, unit, list(frame ORDER BY dff DESC, frame) AS l FROM traces WHERE dff > 0 GROUP BY ALL),
k AS (SELECT run_id, unit, unnest(({SPACED.format(sep=4)})[1:3]) AS frame FROM s)
SELECT run_id, unit, frame, round(dff, 6) AS dff FROM k JOIN traces USING (run_id, unit, frame)""")
def _(spark, d):
    x = R.spaced_by_score(I.traces(spark, d).filter("dff > 0").select(*K, "frame", "dff"), K, "frame", "dff", 4, k=3)
    return x.select(*K, "frame", r6("dff").alias("dff"))


@query("topk_mean_per_unit", f"""{T}
SELECT run_id, unit, round(avg(dff), 6) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY run_id, unit ORDER BY dff DESC) AS rn
 FROM traces) WHERE rn <= 3 GROUP BY ALL""")
def _(spark, d):
    from undulate.operators.pairs import pack
    from undulate.operators.topk import topk_mean

    p = pack(I.traces(spark, d), K, "frame", "dff")
    return p.select(*K, r6(topk_mean("trace", 3)).alias("top3"))


@query("top_n_units", f"""{T}
SELECT run_id, unit, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, unit) AS rn
  FROM (SELECT run_id, unit, CAST(sum(n_ev) AS BIGINT) AS n FROM traces GROUP BY ALL)) WHERE rn <= 5""")
def _(spark, d):
    from undulate.operators.topk import top_n

    n = I.traces(spark, d).groupBy(*K).agg(F.sum("n_ev").alias("n"))
    return top_n(n, ["run_id"], "n", 5, ["unit"]).select(*K, "n")


@query("hub_units_top_share", f"""{T},
a AS (SELECT run_id, unit, sum(dff) AS s FROM traces GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, unit) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM a)
SELECT run_id, unit, round(s, 4) AS s FROM b WHERE rn <= ceil(0.1 * n)""")
def _(spark, d):
    from undulate.operators.topk import top_share_rows

    n = I.traces(spark, d).groupBy(*K).agg(I.total().alias("s"))
    return top_share_rows(n, ["run_id"], "s", 0.1, ["unit"]).select(*K, r6("s", 4).alias("s"))


@query("first_label_wins", f"""WITH {I.MASKS}
SELECT run_id, z, y, x, min(unit) AS unit FROM masks GROUP BY ALL""")
def _(spark, d):
    from undulate.operators.topk import first_label_wins

    return first_label_wins(I.masks(spark, d), ["run_id", "z", "y", "x"], "unit")


@query("natural_run_order", """SELECT n_name, row_number() OVER (ORDER BY CAST(regexp_extract(n_name, '([0-9]+)$', 1) AS INT), n_name) AS pos
FROM nation""")
def _(spark, d):
    from undulate.operators.topk import natural_order

    return natural_order(I.table(spark, d, "nation").select("n_name"), "n_name", "pos")


@query("sample_pairs_by_hash", f"""WITH {I.MASKS} SELECT * FROM masks WHERE {mixed_sql('run_id', 'unit', 'z', 'y', 'x')} % 1000000 < 100000""")
def _(spark, d):
    from undulate.operators.topk import hash_sample

    return hash_sample(I.masks(spark, d), ["run_id", "unit", "z", "y", "x"], 0.1)
