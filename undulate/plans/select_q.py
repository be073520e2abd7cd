"""Queries over selection and join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from undulate.operators import aggregate as A
from undulate.operators import joins as J
from undulate.operators import select as X
from undulate.operators import signal as S
from undulate.operators import rolling as R
from undulate.operators.pairs import grid_near_pairs, pair_corr, pair_geometry, unit_pairs
from undulate.plans import inputs as I
from undulate.plans.registry import i8, query, r6

K = ["run_id", "unit"]
N = I.N_FRAMES
T = f"WITH {I.TRACES}"
TZ = f"WITH {I.TRACES}, {I.ROBUST_Z}"
VK = ["run_id", "z", "y", "x"]

ONSETS = """
ons AS (SELECT run_id, unit, frame FROM (SELECT *, lag(z) OVER (PARTITION BY run_id, unit ORDER BY frame) AS p FROM rz)
  WHERE z > 1.0 AND p <= 1.0)
"""


def onsets(spark, d):
    z = S.robust_z(I.traces(spark, d), K, "dff")
    return R.rising_edges(z, K, "frame", "z", 1.0).filter("edge").select(*K, "frame")


@query("skip_and_crop", f"""{T}, {I.RUNS}
SELECT run_id, unit, frame - CAST(round_even(skip_s * frame_rate, 0) AS BIGINT) AS frame, dff
FROM traces JOIN runs USING (run_id) WHERE frame >= round_even(skip_s * frame_rate, 0) AND frame < {N} - 4""")
def _(spark, d):
    t = I.traces(spark, d).join(I.runs(spark, d).select("run_id", "frame_rate", "skip_s"), "run_id")
    t = t.withColumn("_k", S.skip_frames(F.col("skip_s"), F.col("frame_rate")))
    return X.skip_and_crop(t, "frame", None, F.col("_k"), F.lit(4), F.lit(N)).select(*K, "frame", "dff")


@query("crop_deep_rows", f"""WITH {I.VOXELS} SELECT run_id, z, y, x, t, round(v, 6) AS v FROM vox WHERE y < 4""")
def _(spark, d):
    v = X.skip_and_crop(I.voxels_long(spark, d), "t", "y", F.lit(0), deep_rows=1, ny=5)
    return v.select(*VK, "t", r6("v").alias("v"))


@query("select_units", f"""{T},
busy AS (SELECT run_id, unit FROM traces GROUP BY ALL HAVING sum(n_ev) > 65)
SELECT run_id, unit, frame, dff, 'only' AS mode FROM traces SEMI JOIN busy USING (run_id, unit)
UNION ALL SELECT run_id, unit, frame, dff, 'except' FROM traces ANTI JOIN busy USING (run_id, unit)""")
def _(spark, d):
    t = I.traces(spark, d)
    busy = t.groupBy(*K).agg(F.sum("n_ev").alias("n")).filter("n > 65").select(*K)
    cols = [*K, "frame", "dff"]
    a = X.select_units(t, "unit", "only", busy, K).select(*cols, F.lit("only").alias("mode"))
    return a.unionByName(X.select_units(t, "unit", "except", busy, K).select(*cols, F.lit("except").alias("mode")))


@query("sample_frames", f"""{T}
SELECT run_id, unit, frame, 'stride' AS how FROM traces WHERE frame % 7 = 0
UNION ALL SELECT run_id, unit, frame, 'even' FROM traces WHERE frame IN (SELECT DISTINCT i * {N - 1} // 8 FROM range(9) r(i))""")
def _(spark, d):
    t = I.traces(spark, d)
    a = X.sample_frames(t, "frame", every=7).select(*K, "frame", F.lit("stride").alias("how"))
    return a.unionByName(X.sample_frames(t, "frame", n=9, n_frames=N).select(*K, "frame", F.lit("even").alias("how")))


@query("decimate", f"""{T} SELECT run_id, unit, frame // 4 AS frame, dff FROM traces WHERE frame % 4 = 0""")
def _(spark, d):
    return X.decimate(I.traces(spark, d), "frame", 4).select(*K, "frame", "dff")


@query("valid_region", f"""WITH {I.VOXELS} SELECT run_id, z, y, x FROM vox GROUP BY ALL
HAVING stddev_pop(v) > 0.12 AND max(v) - min(v) > 0.5""")
def _(spark, d):
    return X.valid_region(I.voxels_long(spark, d), VK, "v", 0.12, 0.5)


@query("live_voxels", f"""WITH {I.VOXELS},
m AS (SELECT run_id, z, y, x, avg(v) AS m FROM vox GROUP BY ALL),
c AS (SELECT run_id, quantile_cont(m, 0.15) AS c FROM m GROUP BY ALL)
SELECT run_id, z, y, x, round(m, 6) + 0.0 AS mean_v FROM m JOIN c USING (run_id) WHERE m > c""")
def _(spark, d):
    return X.live_voxels(I.voxels_long(spark, d), ["run_id"], ["z", "y", "x"], "v", 0.15).select(
        *VK, r6("mean_v").alias("mean_v"))


@query("tissue_mask_mean_sd", f"""WITH {I.VOXELS},
m AS (SELECT run_id, z, y, x, avg(v) AS m FROM vox GROUP BY ALL),
c AS (SELECT run_id, avg(m) + 0.5 * stddev_pop(m) AS c FROM m GROUP BY ALL)
SELECT run_id, z, y, x, round(m, 6) + 0.0 AS mean_v FROM m JOIN c USING (run_id) WHERE m > c""")
def _(spark, d):
    return X.tissue_mean_sd(I.voxels_long(spark, d), ["run_id"], ["z", "y", "x"], "v", 0.5).select(
        *VK, r6("mean_v").alias("mean_v"))


@query("activity_mask_modes", f"""WITH {I.VOXELS},
s AS (SELECT run_id, z, y, x, max(v) AS mx, avg(v) AS m, stddev_pop(v) AS sd, quantile_cont(v, 0.5) AS med FROM vox GROUP BY ALL),
d AS (SELECT v.run_id, v.z, v.y, v.x, quantile_cont(abs(v.v - med), 0.5) AS mad FROM vox v JOIN s USING (run_id, z, y, x) GROUP BY ALL),
c AS (SELECT run_id, quantile_cont(sd, 0.8) AS c FROM s GROUP BY ALL)
SELECT run_id, z, y, x, 'mad' AS mode FROM s JOIN d USING (run_id, z, y, x) WHERE mx > med + 2.5 * 1.4826 * mad
UNION ALL SELECT run_id, z, y, x, 'std' FROM s JOIN c USING (run_id) WHERE sd > c
UNION ALL SELECT run_id, z, y, x, 'peak_z' FROM s WHERE (mx - m) / sd > 2.5""")
def _(spark, d):
    v = I.voxels_long(spark, d)
    parts = [X.activity_mask(v, ["run_id"], ["z", "y", "x"], "v", m, l).select(*VK, F.lit(m).alias("mode"))
             for m, l in (("mad", 2.5), ("std", 0.8), ("peak_z", 2.5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


MORPH = f"""WITH {I.MASKS},
m AS (SELECT run_id, unit, count(*) AS n_vox, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, max(z) - min(z) + 1 AS zspan,
  max(y) - min(y) + 1 AS yspan, max(x) - min(x) + 1 AS xspan FROM masks GROUP BY ALL)"""


def morphology(spark, d):
    return A.unit_morphology(I.masks(spark, d), K, 3.9, 1.0, 1.2)


@query("unit_morphology", MORPH + """
SELECT run_id, unit, n_vox, round(cz, 6) AS cz, round(cy, 6) AS cy, round(cx, 6) AS cx, zspan, yspan, xspan,
 round(n_vox * CAST(4.68 AS DOUBLE), 4) AS volume_um3 FROM m""")
def _(spark, d):
    return morphology(spark, d).select(*K, "n_vox", r6("cz").alias("cz"), r6("cy").alias("cy"), r6("cx").alias("cx"),
                                       "zspan", "yspan", "xspan", r6("volume_um3", 4).alias("volume_um3"))


@query("volume_geometry_gates", MORPH + """
SELECT run_id, unit, n_vox FROM m WHERE n_vox * 4.68 BETWEEN 2700 AND 2900 AND yspan / 40.0 >= 0.3 AND yspan * 1.0 / xspan >= 0.2
 AND yspan * 1.0 / zspan >= 0.8""")
def _(spark, d):
    m = X.volume_gate(morphology(spark, d), 2700, 2900)
    return X.geometry_gate(m, 0.3, 40, 0.2, 0.8).select(*K, "n_vox")


@query("shape_reject_sheet", MORPH + """
SELECT run_id, unit, n_vox FROM m WHERE NOT (xspan * 1.2 > 59.5 AND xspan * 1.2 > 1.5 * yspan * 1.0)""")
def _(spark, d):
    return X.shape_reject_sheet(morphology(spark, d), 59.5, 1.5).select(*K, "n_vox")


@query("clamp_artifact", f"""WITH {I.VOXELS} SELECT run_id, z, y, x, t, round(CASE WHEN v < -0.2 THEN 0.0 ELSE v END, 6) + 0.0 AS zeroed,
 round(least(greatest(v, -0.1), 0.15), 6) + 0.0 AS clipped FROM vox""")
def _(spark, d):
    return I.voxels_long(spark, d).select(*VK, "t", r6(X.clamp_artifact("v", zero_below=-0.2)).alias("zeroed"),
                                          r6(X.clamp_artifact("v", floor=-0.1, cap=0.15)).alias("clipped"))


@query("sampled_valid_voxels", f"""WITH {I.VOXELS} SELECT run_id, z, y, x FROM vox WHERE t IN (0, 32, 63) GROUP BY ALL
HAVING count(v) = 3 AND max(v) > min(v)""")
def _(spark, d):
    return X.sampled_valid_voxels(I.voxels_long(spark, d), VK, "t", "v", [0, 32, 63])


@query("supra_threshold_scale", f"""{T},
p AS (SELECT run_id, quantile_cont(dff, 0.95) FILTER (dff > 0) AS scale FROM traces GROUP BY ALL)
SELECT run_id, unit, frame, round(CASE WHEN dff >= 50 THEN dff ELSE 0 END / scale, 6) AS v FROM traces JOIN p USING (run_id)""")
def _(spark, d):
    from undulate.operators.ranks import exact_quantiles

    t = I.traces(spark, d)
    p = exact_quantiles(t.filter("dff > 0"), ["run_id"], "dff", {"scale": 0.95})
    return t.join(p, "run_id").select(*K, "frame", r6(X.supra_threshold("dff", 50.0) / F.col("scale")).alias("v"))


@query("voxels_in_regions_mean", f"""WITH {I.MASKS}, {I.VOXELS}
SELECT m.run_id, m.unit, v.t, round(avg(v.v), 6) + 0.0 AS value, count(*) AS n_vox
FROM masks m JOIN vox v ON v.run_id = m.run_id AND v.z = m.z - 1 AND v.y = m.y % 5 AND v.x = m.x % 5 GROUP BY ALL""")
def _(spark, d):
    m = I.masks(spark, d).select(*K, (F.col("z") - 1).alias("z"), F.pmod("y", F.lit(5)).alias("y"),
                                 F.pmod("x", F.lit(5)).alias("x"))
    # several mask rows fall on one voxel: count them before the join
    m = m.groupBy(*K, "z", "y", "x").agg(F.count(F.lit(1)).alias("w"))
    j = m.join(I.voxels_long(spark, d), VK)
    return j.groupBy(*K, "t").agg(
        r6(F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("value"), F.sum("w").alias("n_vox"))


@query("merge_sources", f"""WITH {I.COHORT},
a AS (SELECT fov, avg(mean_price) AS m FROM cohort WHERE subject < 5 GROUP BY ALL),
b AS (SELECT CAST(s_nationkey AS BIGINT) AS fov, avg(s_acctbal) AS m FROM supplier GROUP BY ALL)
SELECT fov, round(a.m, 4) AS m_auto, round(b.m, 4) AS m_human FROM a JOIN b USING (fov)""")
def _(spark, d):
    a = I.cohort(spark, d).groupBy("fov").agg(F.avg("mean_price").alias("m"))
    b = I.table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("fov")).agg(
        F.avg("s_acctbal").alias("m"))
    return J.merge_sources(a, b, ["fov"], ["m"]).select("fov", r6("m_auto", 4).alias("m_auto"), r6("m_human", 4).alias("m_human"))


PAIRS = """
zn AS (SELECT t.run_id, t.unit, t.frame, (dff - m) / sd AS zz FROM traces t JOIN
  (SELECT run_id, unit, avg(dff) AS m, stddev_pop(dff) AS sd FROM traces GROUP BY ALL) USING (run_id, unit)),
pairs AS (SELECT a.run_id, a.unit AS a, b.unit AS b, avg(a.zz * b.zz) AS r FROM zn a JOIN zn b
  ON a.run_id = b.run_id AND a.frame = b.frame AND a.unit < b.unit GROUP BY ALL)
"""


def pairs(spark, d):
    return pair_corr(I.traces(spark, d), ["run_id"], "unit", "frame", "dff")


@query("match_pairs_across_runs", f"""{T}, {PAIRS}
SELECT p.run_id // 3 AS fov, p.a, p.b, p.run_id AS run_1, q.run_id AS run_2, round(p.r, 6) + 0.0 AS r_1, round(q.r, 6) + 0.0 AS r_2
FROM pairs p JOIN pairs q ON p.a = q.a AND p.b = q.b AND p.run_id // 3 = q.run_id // 3 AND p.run_id < q.run_id""")
def _(spark, d):
    p = pairs(spark, d).withColumn("fov", F.floor(F.col("run_id") / 3).cast("long"))
    m = J.match_pairs_across_runs(p, "fov", "run_id", ["r"])
    return m.select("fov", "a", "b", "run_1", "run_2", r6("r_1").alias("r_1"), r6("r_2").alias("r_2"))


POS = """
pos AS (SELECT user_id // 15 AS run_id, user_id % 15 AS unit, CAST(p_size AS DOUBLE) AS z, CAST(p_partkey % 97 AS DOUBLE) AS y,
  CAST(p_partkey % 31 AS DOUBLE) AS x FROM (SELECT DISTINCT user_id FROM events) JOIN part ON p_partkey = user_id)
"""


def positions(spark, d):
    u = I.table(spark, d, "events").select("user_id").distinct()
    p = I.table(spark, d, "part").select("p_partkey", "p_size")
    return u.join(p, F.col("user_id") == F.col("p_partkey")).select(
        F.floor(F.col("user_id") / 15).cast("long").alias("run_id"), F.pmod("user_id", F.lit(15)).cast("long").alias("unit"),
        F.col("p_size").cast("double").alias("z"), F.pmod("p_partkey", F.lit(97)).cast("double").alias("y"),
        F.pmod("p_partkey", F.lit(31)).cast("double").alias("x"))


@query("unit_pairs", f"""WITH {POS}
SELECT a.run_id, a.unit AS a, b.unit AS b FROM pos a JOIN pos b ON a.run_id = b.run_id AND a.unit < b.unit""")
def _(spark, d):
    return unit_pairs(positions(spark, d), ["run_id"], "unit")


@query("near_pairs_radius", """
SELECT a.p_partkey AS a, b.p_partkey AS b, round(sqrt((a.p_size - b.p_size) * (a.p_size - b.p_size)
  + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice)), 6) AS dist
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) < 3
 AND (a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) < 9""")
def _(spark, d):
    p = I.table(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return grid_near_pairs(p, ["p_brand"], "p_partkey", ["p_size", "p_retailprice"], 3.0).select(
        "a", "b", r6("dist").alias("dist"))


@query("pair_geometry", f"""WITH {POS},
p AS (SELECT a.run_id, a.unit AS a, b.unit AS b, (a.z - b.z) * 3.9 AS dz, a.y - b.y AS dy, (a.x - b.x) * 1.2 AS dx
  FROM pos a JOIN pos b ON a.run_id = b.run_id AND a.unit < b.unit)
SELECT run_id, a, b, round(sqrt(dz*dz + dy*dy + dx*dx), 6) AS dist_um, round(abs(dy), 6) AS ddepth_um, round(sqrt(dz*dz + dx*dx), 6) AS dlat_um,
 CASE WHEN sqrt(dz*dz + dx*dx) < 15 AND abs(dy) > 3 THEN 'column' WHEN abs(dy) < 3 AND sqrt(dz*dz + dx*dx) > 15 THEN 'row' ELSE 'other' END AS kind FROM p""")
def _(spark, d):
    g = pair_geometry(positions(spark, d), ["run_id"], "unit", "y", "x", "z", (3.9, 1.0, 1.2))
    kind = F.when((F.col("dlat_um") < 15) & (F.col("ddepth_um") > 3), "column").when(
        (F.col("ddepth_um") < 3) & (F.col("dlat_um") > 15), "row").otherwise("other")
    return g.select("run_id", "a", "b", r6("dist_um").alias("dist_um"), r6("ddepth_um").alias("ddepth_um"),
                    r6("dlat_um").alias("dlat_um"), kind.alias("kind"))


@query("nearest_k_units", f"""WITH {POS},
p AS (SELECT a.run_id, a.unit AS a, b.unit AS b, sqrt((a.z-b.z)*(a.z-b.z) + (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) AS dist
  FROM pos a JOIN pos b ON a.run_id = b.run_id AND a.unit <> b.unit)
SELECT run_id, a, b, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, a ORDER BY dist, b) AS rank FROM p)
WHERE rank <= 4""")
def _(spark, d):
    return J.nearest_k(positions(spark, d), ["run_id"], "unit", ["z", "y", "x"], 4).select(
        "run_id", "a", "b", r6("dist").alias("dist"), "rank")


@query("onset_lag_pairs", f"""{TZ}, {ONSETS}
SELECT a.run_id, a.unit AS a, b.unit AS b, count(*) AS n FROM ons a JOIN ons b ON a.run_id = b.run_id AND a.unit <> b.unit
 AND b.frame - a.frame BETWEEN 1 AND 2 GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, d):
    return J.lag_pair_counts(onsets(spark, d), ["run_id"], "unit", "frame", 2).filter("n >= 3")


@query("onset_lag_triplets", f"""{TZ}, {ONSETS},
p AS (SELECT a.run_id, a.unit AS a, b.unit AS b, a.frame AS fa, b.frame AS fb FROM ons a JOIN ons b ON a.run_id = b.run_id
  AND a.unit <> b.unit AND b.frame - a.frame BETWEEN 1 AND 2)
SELECT p.run_id, p.a, p.b, q.b AS c, count(*) AS n FROM p JOIN p q ON q.run_id = p.run_id AND q.a = p.b AND q.fa = p.fb AND q.b <> p.a
GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, d):
    t = J.onset_lag_triplet_counts(onsets(spark, d), ["run_id"], "unit", "frame", 2)
    return t.filter("n >= 3").select("run_id", "a", "b", "c", i8("n").alias("n"))


@query("nearest_onset_match", f"""{TZ}, {I.BEHAVIOR}, {ONSETS},
bo AS (SELECT DISTINCT run_id, frame FROM (SELECT *, lag(value) OVER (PARTITION BY run_id, signal ORDER BY frame) AS p FROM behavior
   WHERE signal = 'error') WHERE value > 200 AND p <= 200)
SELECT o.run_id, o.unit, o.frame, (SELECT first(b.frame - o.frame ORDER BY abs(b.frame - o.frame), b.frame - o.frame) FROM bo b
   WHERE b.run_id = o.run_id AND abs(b.frame - o.frame) <= 3) AS dt FROM ons o""")
def _(spark, d):
    b = I.behavior(spark, d).filter("signal = 'error'")
    b = R.rising_edges(b, ["run_id"], "frame", "value", 200.0).filter("edge").select("run_id", "frame")
    return J.nearest_onset(onsets(spark, d), b, ["run_id"], "frame", 3).select(*K, "frame", i8("dt").alias("dt"))


@query("window_around_events", f"""{TZ}, {ONSETS}
SELECT o.run_id, o.unit, o.frame AS f_on, t.frame - o.frame AS "offset", t.dff FROM ons o JOIN traces t ON t.run_id = o.run_id
  AND t.unit = o.unit AND t.frame BETWEEN o.frame - 3 AND o.frame + 4 WHERE o.frame - 3 >= 0 AND o.frame + 4 <= {N - 1}""")
def _(spark, d):
    o = onsets(spark, d).withColumnRenamed("frame", "f_on")
    w = J.window_around_events(o, I.traces(spark, d), K, "f_on", "frame", 3, 4)
    return w.select(*K, "f_on", i8("offset").alias("offset"), "dff")


@query("exclude_near_boundaries", f"""{TZ}, {ONSETS}
SELECT o.* FROM ons o WHERE NOT EXISTS (SELECT 1 FROM range(7) r(i) WHERE abs(o.frame - r.i * 10) <= 2)""")
def _(spark, d):
    o = onsets(spark, d)
    b = o.select("run_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(10))))
    return J.exclude_near(o, b, ["run_id"], "frame", 2)


@query("curation_labels", """
SELECT d.doc_id, CASE WHEN q = 1 THEN 'kept' WHEN q = 0 THEN 'rejected' ELSE 'unseen' END AS label
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)""")
def _(spark, d):
    log = I.table(spark, d, "labels").select("doc_id", F.col("quality").alias("kept"))
    return J.label_by_log(I.table(spark, d, "documents").select("doc_id"), log, "doc_id").select("doc_id", "label")


@query("exclude_other_masks", f"""WITH {I.MASKS},
r AS (SELECT run_id, unit, z, y, x + 1 AS x FROM masks)
SELECT run_id, unit, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE m.run_id = r.run_id AND m.z = r.z AND m.y = r.y
  AND m.x = r.x AND m.unit <> r.unit) GROUP BY ALL""")
def _(spark, d):
    m = I.masks(spark, d)
    r = m.withColumn("x", F.col("x") + 1)
    return J.exclude_other_masks(r, m, VK, "unit").groupBy(*K).agg(F.count(F.lit(1)).alias("n"))


@query("resolve_params", f"""WITH {I.RUNS}
SELECT run_id, CASE WHEN run_id % 5 = 0 THEN run_id * 0.5::DOUBLE WHEN subject % 2 = 0 THEN 10.0::DOUBLE + subject ELSE 7.0::DOUBLE END AS skip FROM runs""")
def _(spark, d):
    r = I.runs(spark, d).select("run_id", "subject")
    sess = r.select("subject").distinct().filter("subject % 2 = 0").select("subject", (F.lit(10.0) + F.col("subject")).alias("skip"))
    over = r.filter("run_id % 5 = 0").select("run_id", (F.col("run_id") * F.lit(0.5)).alias("skip"))
    return J.resolve_params(r, sess, over, "subject", "run_id", {"skip": F.lit(7.0)}).select("run_id", "skip")


@query("attach_mask_source", f"""WITH {I.RUNS}
SELECT run_id, CASE WHEN run_id % 3 = 0 THEN run_id ELSE run_id - run_id % 3 END AS mask_run FROM runs""")
def _(spark, d):
    r = I.runs(spark, d).withColumn("mask_source", F.expr("CASE WHEN run_id % 3 > 0 THEN run_id - run_id % 3 END"))
    return J.attach_mask_source(r).select("run_id", "mask_run")


@query("attach_genotype", f"""{T}, {I.RUNS} SELECT t.run_id, unit, genotype, fov, round(avg(dff), 6) AS m FROM traces t JOIN runs USING (run_id) GROUP BY ALL""")
def _(spark, d):
    t = I.traces(spark, d).groupBy(*K).agg(r6(F.avg("dff")).alias("m"))
    return J.attach_dimension(t, I.runs(spark, d), "run_id").select(*K, "genotype", "fov", "m")


@query("export_wide", f"""{T} SELECT run_id, frame, {", ".join(f"max(CASE WHEN unit = {u} THEN dff END) AS dend_{u:03d}" for u in range(15))}
FROM traces GROUP BY ALL""")
def _(spark, d):
    from undulate.sources.tables import export_wide

    return export_wide(I.traces(spark, d), ["run_id", "frame"], "unit", "dff", list(range(15)), "dend_{:03d}")


@query("wide_to_long", f"""{T} SELECT run_id, unit, frame, dff FROM traces""")
def _(spark, d):
    from undulate.sources.tables import export_wide, wide_to_long

    w = export_wide(I.traces(spark, d), ["run_id", "frame"], "unit", "dff", list(range(15)), "dend_{:03d}")
    return wide_to_long(w, ["run_id", "frame"], "dend_").select(
        "run_id", F.regexp_extract("unit", r"(\d+)$", 1).cast("long").alias("unit"), "frame", F.col("dff"))


@query("get_run", f"""WITH {I.RUNS} SELECT run_id, genotype FROM runs WHERE subject = 0 AND run_id % 3 = 1""")
def _(spark, d):
    from undulate.sources.tables import get_run

    r = I.runs(spark, d).withColumn("run", F.pmod("run_id", F.lit(3)))
    return get_run(r, subject=0, run=1).select("run_id", "genotype")


@query("json_metrics", """SELECT event_type AS section, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k,
 count(json_extract(props, '$.absent')) AS missing FROM events GROUP BY ALL""")
def _(spark, d):
    e = I.table(spark, d, "events").withColumn("j", F.from_json("props", "k BIGINT, absent DOUBLE"))
    return e.groupBy(F.col("event_type").alias("section")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("j.k").alias("k"), F.count("j.absent").alias("missing"))


@query("merge_metrics_latest", """SELECT user_id, event_type AS section, arg_max(value, ts) AS value FROM events GROUP BY ALL""")
def _(spark, d):
    from undulate.sources.tables import latest_metrics

    return latest_metrics(I.table(spark, d, "events").select("user_id", F.col("event_type").alias("section"), "value", "ts"),
                          ["user_id", "section"], "ts").select("user_id", "section", "value")


@query("run_catalog", """
WITH p AS (SELECT url, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '/([^/?#]*)$', 1) AS name FROM pages)
SELECT host, name, url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN contains(name, '1') THEN 0 WHEN contains(name, '2') THEN 1 ELSE 2 END, name, url) AS rn
  FROM p WHERE NOT contains(url, 'private')) WHERE rn = 1""")
def _(spark, d):
    from undulate.sources.tables import prefer

    p = I.table(spark, d, "pages").select(
        "url", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"),
        F.regexp_extract("url", r"/([^/?#]*)$", 1).alias("name")).filter(~F.contains(F.col("url"), F.lit("private")))
    return prefer(p, ["host"], "name", ["1", "2"], ["url"]).select("host", "name", "url")


@query("incremental_runs", """
WITH a AS (SELECT o_custkey AS run_id, max(o_orderdate) AS last_in FROM orders GROUP BY 1),
b AS (SELECT o_custkey AS run_id, max(l_shipdate) AS done FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY 1)
SELECT a.run_id, b.done IS NULL AS never FROM a LEFT JOIN b USING (run_id) WHERE b.done IS NULL OR a.last_in > b.done""")
def _(spark, d):
    from undulate.sources.tables import stale_runs

    o, l = I.table(spark, d, "orders"), I.table(spark, d, "lineitem")
    a = o.groupBy(F.col("o_custkey").alias("run_id")).agg(F.max("o_orderdate").alias("mtime"))
    b = o.join(l.filter("l_linenumber = 1"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_custkey").alias("run_id")).agg(F.max("l_shipdate").alias("mtime"))
    return stale_runs(a, b, "run_id").select("run_id", F.col("never").alias("never"))
