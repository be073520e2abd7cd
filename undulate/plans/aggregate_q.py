"""Queries over aggregations, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from undulate.functions import scalar as C
from undulate.operators import aggregate as A
from undulate.operators import rolling as R
from undulate.operators import sets as X
from undulate.operators import signal as S
from undulate.plans import inputs as I
from undulate.plans.registry import i8, query, r6

K = ["run_id", "unit"]
N = I.N_FRAMES
T = f"WITH {I.TRACES}"
TZ = f"WITH {I.TRACES}, {I.ROBUST_Z}"
VK = ["run_id", "z", "y", "x"]


@query("global_trace", f"""WITH {I.VOXELS},
m AS (SELECT run_id, z, y, x, avg(v) AS m FROM vox GROUP BY ALL),
c AS (SELECT run_id, quantile_cont(m, 0.05) AS c FROM m GROUP BY ALL),
g AS (SELECT v.run_id, t, avg(v + 1.0) AS g FROM vox v JOIN m USING (run_id, z, y, x) JOIN c USING (run_id) WHERE m > c GROUP BY ALL),
f AS (SELECT run_id, quantile_cont(g, 0.1) AS f0 FROM g GROUP BY ALL)
SELECT run_id, t, round((g - f0) / f0 * 100, 6) + 0.0 AS global_dff FROM g JOIN f USING (run_id)""")
def _(spark, d):
    from undulate.operators.select import live_voxels

    v = I.voxels_long(spark, d)
    live = live_voxels(v, ["run_id"], ["z", "y", "x"], "v", 0.05)
    g = A.global_trace(v.withColumn("v", F.col("v") + 1.0), live, ["run_id"], ["z", "y", "x"], "t", "v")
    return g.select("run_id", "t", r6("global_dff").alias("global_dff"))


@query("depth_band_trace", f"""WITH {I.VOXELS} SELECT run_id, y * 3 // 5 AS band, t, round(avg(v), 6) + 0.0 AS m, count(*) AS n FROM vox GROUP BY ALL""")
def _(spark, d):
    return I.voxels_long(spark, d).groupBy("run_id", A.depth_band("y", 5, 3).alias("band"), "t").agg(
        r6(F.avg("v")).alias("m"), F.count(F.lit(1)).alias("n"))


@query("projections", f"""WITH {I.VOXELS} SELECT run_id, y, x, round(avg(v), 6) + 0.0 AS mean_v, round(max(v), 6) + 0.0 AS max_v,
 round(min(v), 6) + 0.0 AS min_v FROM vox GROUP BY ALL""")
def _(spark, d):
    return I.voxels_long(spark, d).groupBy("run_id", "y", "x").agg(
        r6(F.avg("v")).alias("mean_v"), r6(F.max("v")).alias("max_v"), r6(F.min("v")).alias("min_v"))


@query("project_top_planes_percentile", f"""WITH {I.VOXELS} SELECT run_id, t, y, x, round(quantile_cont(v, 0.75), 6) + 0.0 AS v FROM vox WHERE z < 2 GROUP BY ALL""")
def _(spark, d):
    return A.project(I.voxels_long(spark, d).filter("z < 2"), ["run_id"], ["t", "y", "x"], "v", "percentile", 0.75).select(
        "run_id", "t", "y", "x", r6("v").alias("v"))


@query("bin_xy", f"""WITH {I.VOXELS} SELECT run_id, z, t, y // 2 AS y, x // 2 AS x, round(avg(v), 6) + 0.0 AS v FROM vox WHERE y < 4 AND x < 4 GROUP BY ALL""")
def _(spark, d):
    return A.bin_xy(I.voxels_long(spark, d), ["run_id"], "y", "x", "v", 2, 5, 5, ["z", "t"]).select(
        "run_id", "z", "t", "y", "x", r6("v").alias("v"))


@query("frame_quantile_score", f"""WITH {I.VOXELS},
p AS (SELECT run_id, t, y, x, max(v) AS v FROM vox GROUP BY ALL)
SELECT run_id, t, round(quantile_cont(v, 0.999) - quantile_cont(v, 0.6), 6) AS score FROM p GROUP BY ALL""")
def _(spark, d):
    p = A.project(I.voxels_long(spark, d), ["run_id"], ["t", "y", "x"], "v", "max")
    return A.frame_quantile_score(p, ["run_id"], "t", "v").select("run_id", "t", r6("score").alias("score"))


@query("binned_region_trace", f"""WITH {I.VOXELS}
SELECT run_id, label, y AS bin, t, round(sum(v), 6) + 0.0 AS sum_v, count(*) AS n_vox FROM vox GROUP BY ALL""")
def _(spark, d):
    v = I.voxels_long(spark, d)
    reg = I.voxel_traces(spark, d).select("run_id", "z", "y", "x", F.col("label"), F.col("y").alias("bin"))
    b = A.binned_region_trace(reg, v.drop("label"), VK, ["run_id", "label"], "bin", "t", "v")
    return b.select("run_id", "label", "bin", "t", r6("sum_v").alias("sum_v"), "n_vox")


EVENTS = """
sup AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY run_id, unit ORDER BY frame) = 1 THEN 0 ELSE 1 END AS s FROM rz WHERE z > 1.0),
isl AS (SELECT *, sum(s) OVER (PARTITION BY run_id, unit ORDER BY frame) AS g FROM sup),
evt AS (SELECT run_id, unit, min(frame) AS f_start, max(frame) AS f_end, arg_max(frame, dff - frame * 1e-9) AS f_peak, max(dff) AS amp, count(*) AS duration
  FROM isl GROUP BY run_id, unit, g)
"""


def unit_events(spark, d, min_dur: int = 1):
    z = S.robust_z(I.traces(spark, d), K, "dff").filter("z > 1.0")
    lab = R.islands(z, K, "frame", 1, "f_start")
    return lab.groupBy(*K, "f_start").agg(
        F.max("frame").alias("f_end"), F.max_by("frame", F.struct("dff", -F.col("frame"))).alias("f_peak"),
        F.max("dff").alias("amp"), F.count(F.lit(1)).alias("duration")).filter(F.col("duration") >= min_dur)


@query("events_per_unit", f"""{TZ}, {EVENTS},
e AS (SELECT run_id, unit, count(*) AS n, avg(amp) AS ma, quantile_cont(amp, 0.5) AS md, max(amp) AS mx, avg(duration) AS mdur, sum(duration) AS d FROM evt GROUP BY ALL)
SELECT u.run_id, u.unit, coalesce(n, 0) AS n_events, round(coalesce(n, 0) / ({N} / 2.0 / 60), 6) AS rate_per_min, round(ma, 6) AS mean_amp,
 round(md, 6) AS median_amp, round(mx, 6) AS max_amp, round(mdur, 6) AS mean_dur, round(coalesce(d, 0) / {N}.0, 6) AS active_fraction
FROM (SELECT DISTINCT run_id, unit FROM traces) u LEFT JOIN e USING (run_id, unit)""")
def _(spark, d):
    e = A.events_per_unit(unit_events(spark, d), I.traces(spark, d), K, N, 2.0)
    return e.select(*K, "n_events", *[r6(c).alias(c) for c in (
        "rate_per_min", "mean_amp", "median_amp", "max_amp", "mean_dur", "active_fraction")])


@query("run_to_fov_average", f"""WITH {I.COHORT} SELECT fov, genotype, round(avg(mean_price), 4) AS mean_price, round(avg(n_orders), 6) AS n_orders,
 count(*) AS n_runs FROM cohort GROUP BY ALL""")
def _(spark, d):
    return A.average_by_group(I.cohort(spark, d), ["fov", "genotype"], ["mean_price", "n_orders"]).select(
        "fov", "genotype", r6("mean_price", 4).alias("mean_price"), r6("n_orders").alias("n_orders"), "n_runs")


@query("melt_metrics", f"WITH {I.COHORT_LONG} SELECT run_id, metric, round(value, 6) AS value FROM mlong")
def _(spark, d):
    return A.melt_metrics(I.cohort(spark, d), ["run_id"], ["mean_price", "n_orders", "acctbal"]).select(
        "run_id", "metric", r6("value").alias("value"))


@query("pivot_metric", f"WITH {I.COHORT} SELECT run_id, round(mean_price, 6) AS mean_price, round(n_orders, 6) AS n_orders, round(acctbal, 6) + 0.0 AS acctbal FROM cohort")
def _(spark, d):
    p = A.pivot_metric(I.cohort_long(spark, d), ["run_id"], ["mean_price", "n_orders", "acctbal"])
    return p.select("run_id", *[r6(c).alias(c) for c in ("mean_price", "n_orders", "acctbal")])


@query("named_run_summary", f"""WITH {I.COHORT} SELECT fov, count(DISTINCT n_orders) AS n_masks, round(avg(mean_price), 4) AS mean_v,
 round(quantile_cont(mean_price, 0.5), 4) AS median_v, round(avg(CASE WHEN acctbal / 10000 < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS frac_sig FROM cohort GROUP BY ALL""")
def _(spark, d):
    c = I.cohort(spark, d).withColumn("p", F.col("acctbal") / 10000)
    return A.named_run_summary(c, ["fov"], "n_orders", "mean_price", "p").select(
        "fov", "n_masks", r6("mean_v", 4).alias("mean_v"), r6("median_v", 4).alias("median_v"), r6("frac_sig").alias("frac_sig"))


@query("gini_top_shares", f"""{T},
u AS (SELECT run_id, unit, CAST(sum(n_ev) AS BIGINT) AS c FROM traces GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY c) AS i, row_number() OVER (PARTITION BY run_id ORDER BY c DESC) AS j,
   count(*) OVER (PARTITION BY run_id) AS n FROM u)
SELECT run_id, any_value(n) AS n, round((2.0 * sum(i * c) / sum(c) - (any_value(n) + 1)) / any_value(n), 6) AS gini,
 round(sum(CASE WHEN j <= ceil(0.05 * n) THEN c ELSE 0 END) / sum(c), 6) AS top5pct, round(sum(CASE WHEN j <= ceil(0.1 * n) THEN c ELSE 0 END) / sum(c), 6) AS top10pct,
 round(sum(CASE WHEN j <= ceil(0.2 * n) THEN c ELSE 0 END) / sum(c), 6) AS top20pct FROM r GROUP BY run_id""")
def _(spark, d):
    u = I.keyed_events(spark, d).groupBy(*K).agg(F.count(F.lit(1)).cast("double").alias("events"))
    g = A.gini_and_shares(u, ["run_id"], "events")
    return g.select("run_id", "n", *[r6(c).alias(c) for c in ("gini", "top5pct", "top10pct", "top20pct")])


@query("histogram", f"""WITH {I.COHORT} SELECT genotype, CAST(least(floor(mean_price / 50000), 9) AS BIGINT) AS bin, count(*) AS n FROM cohort
WHERE mean_price BETWEEN 0 AND 500000 GROUP BY ALL""")
def _(spark, d):
    return A.histogram(I.cohort(spark, d), ["genotype"], "mean_price", [50000.0 * i for i in range(11)])


@query("binned_mean_sem", f"""WITH {I.COHORT},
b AS (SELECT genotype, CAST(floor((acctbal + 1000) / 1500) AS BIGINT) AS bin, count(*) AS n, avg(mean_price) AS m, stddev_samp(mean_price) AS s FROM cohort GROUP BY ALL)
SELECT genotype, bin, n, CASE WHEN n >= 5 THEN round(m, 4) END AS mean, CASE WHEN n >= 5 THEN round(s / sqrt(n), 4) END AS sem FROM b""")
def _(spark, d):
    b = A.binned_mean_sem(I.cohort(spark, d), ["genotype"], "acctbal", "mean_price", -1000.0, 1500.0, 5)
    return b.select("genotype", "bin", "n", r6("mean", 4).alias("mean"), r6("sem", 4).alias("sem"))


@query("fano_silent_fraction", f"""{TZ},
c AS (SELECT run_id, frame, sum(CASE WHEN z > 2 THEN 1 ELSE 0 END) AS n FROM rz GROUP BY ALL)
SELECT run_id, round(var_pop(n) / avg(n), 6) AS fano, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS silent_fraction, round(avg(n), 6) AS mean_count FROM c GROUP BY ALL""")
def _(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff")
    c = z.groupBy("run_id", "frame").agg(F.sum(F.coalesce(F.col("z") > 2, F.lit(False)).cast("long")).alias("n"))
    f = A.fano_silent(c, ["run_id"], "n")
    return f.select("run_id", *[r6(c).alias(c) for c in ("fano", "silent_fraction", "mean_count")])


@query("median_trace", f"{T} SELECT run_id, frame, round(quantile_cont(dff, 0.5), 6) AS median FROM traces GROUP BY ALL")
def _(spark, d):
    return A.median_trace(I.traces(spark, d), ["run_id"], "frame", "dff").select("run_id", "frame", r6("median").alias("median"))


@query("distinct_footprints_share", f"""{TZ},
f AS (SELECT run_id, frame, string_agg(CAST(unit AS VARCHAR), ',' ORDER BY unit) AS fp FROM rz WHERE z > 3 GROUP BY ALL)
SELECT run_id, count(DISTINCT fp) AS n_distinct, count(*) AS n, round(count(DISTINCT fp) / count(*), 6) AS diversity FROM f GROUP BY ALL""")
def _(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff").filter("z > 3")
    f = z.groupBy("run_id", "frame").agg(F.array_join(F.array_sort(F.collect_list("unit")).cast("array<string>"), ",").alias("fp"))
    s = A.distinct_share(f, ["run_id"], "fp")
    return s.select("run_id", "n_distinct", i8("n").alias("n"), r6("diversity").alias("diversity"))


@query("eta_squared", f"""WITH {I.COHORT_LONG},
g AS (SELECT metric, avg(value) AS gm FROM mlong GROUP BY ALL),
f AS (SELECT metric, fov, avg(value) AS m, count(*) AS n FROM mlong GROUP BY ALL),
b AS (SELECT metric, sum(n * (m - gm) * (m - gm)) AS sb, count(*) AS n_groups FROM f JOIN g USING (metric) GROUP BY ALL),
t AS (SELECT metric, sum((value - gm) * (value - gm)) AS st, count(*) AS n FROM mlong JOIN g USING (metric) GROUP BY ALL)
SELECT metric, n, n_groups, round(sb / st, 6) AS eta2 FROM b JOIN t USING (metric)""")
def _(spark, d):
    e = A.share_of_variance(I.cohort_long(spark, d), "fov", "value", ["metric"])
    return e.select("metric", i8("n").alias("n"), "n_groups", r6("eta2").alias("eta2"))


# ---- sets ----------------------------------------------------------------------------------

@query("mask_boolean_ops", f"""WITH {I.MASKS}, {I.MASKS_OTHER},
a AS (SELECT run_id, z, y, x FROM masks WHERE unit % 2 = 0 GROUP BY ALL), b AS (SELECT run_id, z, y, x FROM masks WHERE unit % 2 = 1 GROUP BY ALL)
SELECT 'union' AS op, run_id, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY ALL
UNION ALL SELECT 'subtract', run_id, count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY ALL
UNION ALL SELECT 'intersect', run_id, count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY ALL""")
def _(spark, d):
    m = I.masks(spark, d)
    s = X.membership(m, VK, a=F.col("unit") % 2 == 0, b=F.col("unit") % 2 == 1)
    n = s.groupBy("run_id").agg(F.count_if(F.col("a") | F.col("b")).alias("union"), F.count_if(F.col("a") & ~F.col("b")).alias("subtract"),
                                F.count_if(F.col("a") & F.col("b")).alias("intersect"))
    return n.unpivot("run_id", ["union", "subtract", "intersect"], "op", "n").filter("n > 0").select("op", "run_id", "n")


@query("concat_runs", f"""{T},
m AS (SELECT run_id, unit, quantile_cont(dff, 0.5) AS med FROM traces GROUP BY ALL)
SELECT run_id // 3 AS fov, run_id, unit, frame + (run_id % 3) * {N} AS cat_frame, round(dff - med, 6) + 0.0 AS dff FROM traces JOIN m USING (run_id, unit)""")
def _(spark, d):
    t = I.traces(spark, d).withColumn("fov", F.floor(F.col("run_id") / 3).cast("long"))
    c = X.concat_runs(t, ["fov"], "run_id", "frame", centre="dff", extra=["unit"])
    return c.select("fov", "run_id", "unit", "cat_frame", r6("dff").alias("dff"))


@query("concat_pooled_runs", """
WITH daily AS (SELECT l_returnflag AS flag, l_linestatus AS status, CAST(year(l_shipdate) AS BIGINT) AS yr, CAST(dayofyear(l_shipdate) - 1 AS BIGINT) AS frame,
   round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL),
n AS (SELECT flag, status, yr, max(frame) + 1 AS n FROM daily GROUP BY ALL),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY flag, status ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n)
SELECT flag, status, yr, CAST(frame + off AS BIGINT) AS cat_frame, v FROM daily JOIN o USING (flag, status, yr)""")
def _(spark, d):
    l = I.table(spark, d, "lineitem")
    daily = l.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
                      F.year("l_shipdate").cast("long").alias("yr"), (F.dayofyear("l_shipdate") - 1).cast("long").alias("frame")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("v"))
    c = X.concat_runs(daily, ["flag", "status"], "yr", "frame")
    return c.select("flag", "status", "yr", "cat_frame", "v")


@query("overlap_sets", f"""WITH {I.COHORT},
f AS (SELECT fov, CASE WHEN mean_price > 250000 THEN 1 ELSE 0 END AS a, CASE WHEN acctbal > 4000 THEN 1 ELSE 0 END AS b FROM cohort)
SELECT fov, CAST(sum(a * b) AS BIGINT) AS common, CAST(sum(a * (1 - b)) AS BIGINT) AS only_a, CAST(sum((1 - a) * b) AS BIGINT) AS only_b,
 round(sum(a * b) / sum(greatest(a, b)), 6) AS jaccard FROM f GROUP BY ALL""")
def _(spark, d):
    c = I.cohort(spark, d).select("fov", (F.col("mean_price") > 250000).alias("a"), (F.col("acctbal") > 4000).alias("b"))
    return X.overlap_sets(c, ["fov"], "a", "b").select("fov", i8("common").alias("common"), i8("only_a").alias("only_a"),
                                                       i8("only_b").alias("only_b"), r6("jaccard").alias("jaccard"))


@query("merge_groups", f"""WITH {I.MASKS},
g AS (SELECT run_id, unit - unit % 3 AS rep, unit, z, y, x FROM masks),
v AS (SELECT run_id, rep, count(*) AS volume FROM (SELECT DISTINCT run_id, rep, z, y, x FROM g) GROUP BY ALL),
m AS (SELECT run_id, rep, string_agg(CAST(unit AS VARCHAR), ';' ORDER BY unit) AS merged, count(*) AS group_size FROM (SELECT DISTINCT run_id, rep, unit FROM g) GROUP BY ALL)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY rep) - 1 AS new_id, rep, volume, merged, group_size FROM v JOIN m USING (run_id, rep)""")
def _(spark, d):
    m = I.masks(spark, d)
    groups = m.select(*K).distinct().withColumn("rep", F.col("unit") - F.pmod("unit", F.lit(3)))
    _, log = X.merge_groups(m, groups, ["run_id"], "unit", ["z", "y", "x"])
    return log.select("run_id", "new_id", "rep", "volume", "merged", "group_size")


# ---- scalar functions ----------------------------------------------------------------------

@query("string_helpers", """
SELECT s_suppkey, regexp_extract(s_name, '([0-9]+)$', 1)::BIGINT AS id, printf('dend_%03d', s_suppkey) AS unit_name,
 lpad(regexp_replace(CAST(s_nationkey AS VARCHAR), '[^0-9]', '', 'g'), 3, '0') AS padded, split_part(s_name, '#', 2) AS part,
 'Supplier_' || s_nationkey AS stem, regexp_matches('2024-01-' || lpad(CAST(s_suppkey AS VARCHAR), 2, '0'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS is_date FROM supplier""")
def _(spark, d):
    s = I.table(spark, d, "supplier")
    return s.select(
        "s_suppkey", C.unit_id("s_name").alias("id"), C.unit_name("s_suppkey").alias("unit_name"),
        C.digits_padded(F.col("s_nationkey").cast("string")).alias("padded"),
        C.run_key_part(F.regexp_replace("s_name", "#", "/"), 1).alias("part"),
        C.clean_stem(F.concat(F.lit("a/b/Supplier-"), F.col("s_nationkey").cast("string"), F.lit(".ome.tif"))).alias("stem"),
        C.is_iso_date(F.concat(F.lit("2024-01-"), F.when(F.length(F.col("s_suppkey").cast("string")) >= 2, F.substring(F.col("s_suppkey").cast("string"), 1, 2))
                               .otherwise(F.lpad(F.col("s_suppkey").cast("string"), 2, "0")))).alias("is_date"))


@query("math_helpers", """
SELECT c_custkey, round(least(greatest(c_acctbal, -500.0), 5000.0), 6) + 0.0 AS clipped, round(atanh(least(greatest(c_acctbal / 10000, -0.999999), 0.999999)), 6) + 0.0 AS fz,
 round(degrees(acos(least(greatest(c_acctbal / 10000, -1.0), 1.0))), 6) AS deg, round(log10(c_acctbal + 1001), 6) + 0.0 AS lg,
 round(sqrt(c_acctbal * c_acctbal + c_custkey * c_custkey), 6) AS hyp, CAST(sign(c_acctbal) AS BIGINT) AS sg,
 round(c_custkey + (1 / exp(1) - 1) / (-0.9) * 2, 6) AS cross_e FROM customer""")
def _(spark, d):
    c = I.table(spark, d, "customer")
    return c.select(
        "c_custkey", r6(C.clip("c_acctbal", -500.0, 5000.0)).alias("clipped"), r6(C.fisher_z(F.col("c_acctbal") / 10000)).alias("fz"),
        r6(C.angle_deg(F.col("c_acctbal") / 10000)).alias("deg"), r6(F.log10(F.col("c_acctbal") + 1001)).alias("lg"),
        r6(F.hypot("c_acctbal", F.col("c_custkey").cast("double"))).alias("hyp"), i8(F.signum("c_acctbal")).alias("sg"),
        r6(C.cross_time(F.col("c_custkey").cast("double"), F.lit(1.0), F.col("c_custkey") + F.lit(2.0), F.lit(0.1), F.exp(F.lit(-1.0)))).alias("cross_e"))


@query("array_helpers", """
SELECT vec_id, round(list_aggregate(list_sort(embedding::DOUBLE[], 'DESC')[1:3], 'avg'), 6) AS top3, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total,
 list_position(embedding, list_max(embedding)) - 1 AS argmax, round(embedding[64]::DOUBLE - embedding[63]::DOUBLE, 6) + 0.0 AS last_diff, round(embedding[60]::DOUBLE, 6) + 0.0 AS rolled_first,
 round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS sq FROM embeddings""")
def _(spark, d):
    e = I.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select(
        "vec_id", r6(C.array_mean(C.top_k("e", 3))).alias("top3"), r6(F.element_at(C.cumsum("e"), -1)).alias("total"),
        C.argmax("e").alias("argmax"), r6(F.element_at(C.diff("e"), -1)).alias("last_diff"),
        r6(F.element_at(C.roll("e", 5), 1)).alias("rolled_first"), r6(C.dot("e", "e")).alias("sq"))


@query("json_helpers", """
SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CASE WHEN value > 100 THEN NULL ELSE value END AS back FROM events""")
def _(spark, d):
    e = I.table(spark, d, "events")
    doc = C.to_json_nan_safe({"v": F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))})
    return e.select("event_id", C.json_number("props", "k").alias("k"), C.json_number(doc, "v").alias("back"))


@query("acc_magnitude", """
WITH m AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_discount, 0.5) AS md, quantile_cont(l_tax, 0.5) AS mt FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt((l_quantity - mq) * (l_quantity - mq) + (l_discount - md) * (l_discount - md) + (l_tax - mt) * (l_tax - mt)), 6) AS acc
FROM lineitem JOIN m USING (l_suppkey)""")
def _(spark, d):
    l = I.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    m = l.groupBy("l_suppkey").agg(F.percentile("l_quantity", 0.5).alias("mq"), F.percentile("l_discount", 0.5).alias("md"),
                                   F.percentile("l_tax", 0.5).alias("mt"))
    return l.join(m, "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(
        C.acc_magnitude("l_quantity", "l_discount", "l_tax", "mq", "md", "mt")).alias("acc"))


@query("contrast_and_norms", f"""{T}, {I.BEHAVIOR},
q AS (SELECT run_id, signal, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi, quantile_cont(value, 0.5) AS med,
  quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS rg, max(value) FILTER (frame < 10) AS first_max FROM behavior GROUP BY ALL)
SELECT run_id, signal, frame, round(least(greatest((value - lo) / (hi - lo), 0), 1), 6) AS stretched, round((value - med) / rg, 6) + 0.0 AS ranged,
 round(value / first_max, 6) AS rel FROM behavior JOIN q USING (run_id, signal)""")
def _(spark, d):
    b = I.behavior(spark, d)
    q = b.groupBy("run_id", "signal").agg(F.percentile("value", F.array(*[F.lit(x) for x in (0.02, 0.98, 0.5, 0.95, 0.05)])).alias("q"),
                                          F.max(F.when(F.col("frame") < 10, F.col("value"))).alias("fm"))
    x = b.join(q, ["run_id", "signal"])
    return x.select("run_id", "signal", "frame", r6(C.contrast_stretch("value", F.col("q")[0], F.col("q")[1])).alias("stretched"),
                    r6((F.col("value") - F.col("q")[2]) / (F.col("q")[3] - F.col("q")[4])).alias("ranged"), r6(F.col("value") / F.col("fm")).alias("rel"))


