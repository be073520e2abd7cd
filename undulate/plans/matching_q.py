"""Queries over matching and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from undulate.operators import matching as M
from undulate.operators.assignment import optimal_matching
from undulate.operators.graph import mutual_best_matching
from undulate.operators.pairs import coactive_corr
from undulate.plans import inputs as I
from undulate.plans.registry import i8, query, r6

G = ["run_id"]
K = ["run_id", "unit"]
N = I.N_FRAMES
W = f"WITH {I.MASKS}, {I.MASKS_OTHER}"
T = f"WITH {I.TRACES}"

OV = """
ab AS (SELECT a.run_id, a.unit AS a, b.unit AS b, count(*) AS n_ab FROM masks a JOIN masks2 b USING (run_id, z, y, x) GROUP BY ALL),
na AS (SELECT run_id, unit AS a, count(*) AS n_a FROM masks GROUP BY ALL), nb AS (SELECT run_id, unit AS b, count(*) AS n_b FROM masks2 GROUP BY ALL),
ov AS (SELECT *, n_ab / (n_a + n_b - n_ab) AS iou, 2 * n_ab / (n_a + n_b) AS dice, n_ab / least(n_a, n_b) AS overlap_coef, n_ab / n_a AS frac_a, n_ab / n_b AS frac_b FROM ab JOIN na USING (run_id, a) JOIN nb USING (run_id, b))
"""


def overlap(spark, d):
    return M.overlap_matrix(I.masks(spark, d), I.masks_other(spark, d), G, "unit")


@query("overlap_matrix", f"{W}, {OV} SELECT run_id, a, b, n_ab, round(iou, 6) AS iou, round(dice, 6) AS dice, round(overlap_coef, 6) AS overlap_coef, round(frac_a, 6) AS frac_a, round(frac_b, 6) AS frac_b FROM ov")
def _(spark, d):
    return overlap(spark, d).select(*G, "a", "b", "n_ab", *[r6(c).alias(c) for c in ("iou", "dice", "overlap_coef", "frac_a", "frac_b")])


# order masks: many small units, many of them alike
SIM = """
um AS (SELECT DISTINCT l_orderkey // 200 AS run_id, l_orderkey % 200 AS unit, l_linenumber::BIGINT AS z, 0 AS y, l_suppkey % 4 AS x FROM lineitem),
un AS MATERIALIZED (SELECT run_id, unit, count(*) AS n FROM um GROUP BY ALL),
sm AS (SELECT a.run_id, a.unit AS a, b.unit AS b, count(*) AS n_ab FROM um a JOIN um b USING (run_id, z, y, x) WHERE a.unit < b.unit GROUP BY ALL),
sp AS MATERIALIZED (SELECT s.run_id, a, b, n_ab, 2 * n_ab / (x.n + y.n) AS dice FROM sm s JOIN un x ON x.run_id = s.run_id AND x.unit = a JOIN un y ON y.run_id = s.run_id AND y.unit = b WHERE 2 * n_ab / (x.n + y.n) > 0.7)
"""


def alike(spark, d):
    l = I.table(spark, d, "lineitem")
    return l.select(F.floor(F.col("l_orderkey") / 200).cast("long").alias("run_id"), F.pmod("l_orderkey", F.lit(200)).cast("long").alias("unit"),
                    F.col("l_linenumber").cast("long").alias("z"), F.lit(0).cast("long").alias("y"), F.pmod("l_suppkey", F.lit(4)).cast("long").alias("x")).distinct()


@query("similar_pairs_dice", f"WITH {SIM} SELECT run_id, a, b, n_ab, round(dice, 6) AS dice FROM sp")
def _(spark, d):
    return M.similar_pairs(alike(spark, d), G, "unit", 0.7).select(*G, "a", "b", "n_ab", r6("dice").alias("dice"))


@query("dedup_dice_first_wins", f"""WITH RECURSIVE {SIM},
cf AS MATERIALIZED (SELECT un.run_id, un.unit, coalesce(list(a) FILTER (a IS NOT NULL), []) AS e FROM un LEFT JOIN sp ON sp.run_id = un.run_id AND sp.b = un.unit GROUP BY ALL),
st AS (SELECT r.run_id, -1::BIGINT AS u, []::BIGINT[] AS kept FROM (SELECT DISTINCT run_id FROM um) r
  UNION ALL SELECT s.run_id, s.u + 1, CASE WHEN c.unit IS NOT NULL AND NOT list_has_any(s.kept, c.e) THEN list_append(s.kept, s.u + 1) ELSE s.kept END
  FROM st s LEFT JOIN cf c ON c.run_id = s.run_id AND c.unit = s.u + 1 WHERE s.u < 199)
SELECT un.run_id, un.unit, list_contains(f.kept, un.unit) AS kept FROM un JOIN (SELECT run_id, kept FROM st WHERE u = 199) f USING (run_id)""")
def _(spark, d):
    return M.dedup_dice(alike(spark, d), G, "unit", 0.7).select(*K, "kept")


@query("best_match", f"""{W}, {OV}
SELECT run_id, a, b, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY run_id, a ORDER BY iou DESC, b) AS rn FROM ov WHERE iou >= 0.5) WHERE rn = 1""")
def _(spark, d):
    return M.best_match(overlap(spark, d), G, 0.5).select(*G, "a", "b", r6("iou").alias("iou"))


@query("novel_and_lost", f"""{W}, {OV},
m AS (SELECT run_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY run_id, a ORDER BY iou DESC, b) AS rn FROM ov WHERE iou >= 0.73) WHERE rn = 1)
SELECT run_id, a, b, 'matched' AS status FROM m UNION ALL SELECT run_id, a, NULL, 'novel' FROM na ANTI JOIN m USING (run_id, a) UNION ALL SELECT run_id, NULL, b, 'lost' FROM nb ANTI JOIN m USING (run_id, b)""")
def _(spark, d):
    a = I.masks(spark, d).select(*G, F.col("unit").alias("a")).distinct()
    b = I.masks_other(spark, d).select(*G, F.col("unit").alias("b")).distinct()
    return M.novel_and_lost(overlap(spark, d), a, b, G, 0.73)


@query("one_to_one_match_prf", f"""WITH RECURSIVE {I.MASKS}, {I.MASKS_OTHER}, {OV},
o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iou DESC, a, b) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM ov),
g AS (SELECT run_id, 0::BIGINT AS i, []::BIGINT[] AS ua, []::BIGINT[] AS ub, []::DOUBLE[] AS s FROM (SELECT DISTINCT run_id FROM o)
  UNION ALL SELECT g.run_id, g.i + 1, CASE WHEN ok THEN list_append(ua, o.a) ELSE ua END, CASE WHEN ok THEN list_append(ub, o.b) ELSE ub END, CASE WHEN ok THEN list_append(s, o.iou) ELSE s END
  FROM g JOIN o ON o.run_id = g.run_id AND o.i = g.i + 1, LATERAL (SELECT NOT list_contains(ua, o.a) AND NOT list_contains(ub, o.b) AS ok)),
f AS (SELECT g.run_id, s FROM g JOIN (SELECT run_id, max(i) AS i FROM g GROUP BY ALL) USING (run_id, i)),
c AS (SELECT run_id, thr, len(list_filter(s, lambda q: q >= thr)) AS tp FROM f, (SELECT unnest([0.1, 0.5, 0.74]::DOUBLE[]) AS thr)),
k AS (SELECT run_id, (SELECT count(*) FROM na WHERE na.run_id = c.run_id) AS ka, (SELECT count(*) FROM nb WHERE nb.run_id = c.run_id) AS kb, thr, tp FROM c)
SELECT run_id, thr, tp, round(tp / ka, 6) AS "precision", round(tp / kb, 6) AS recall, round(2 * tp / (ka + kb), 6) AS f1 FROM k""")
def _(spark, d):
    ov = overlap(spark, d)
    m = mutual_best_matching(ov, G, "a", "b", "iou")
    n = lambda t, c: t.select(*K).distinct().groupBy(*G).agg(F.count(F.lit(1)).alias(c))
    p = M.precision_recall(m, n(I.masks(spark, d), "n_a"), n(I.masks_other(spark, d), "n_b"), G, [0.1, 0.5, 0.74])
    return p.select(*G, "thr", "tp", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


# every way to give the first i units of a run distinct partners or none, by the set of partners used: the best total of each
BEST = """
ua AS (SELECT run_id, a, row_number() OVER (PARTITION BY run_id ORDER BY a) AS i FROM (SELECT DISTINCT run_id, a FROM ov)),
o AS (SELECT ov.run_id, i, b, round(iou, 9) AS s FROM ov JOIN ua USING (run_id, a) WHERE iou > 0),
dp AS (SELECT DISTINCT run_id, 0::BIGINT AS i, 0::BIGINT AS used, 0.0::DOUBLE AS best FROM ua
  UNION ALL SELECT run_id, i, used, max(best) FROM (
    SELECT d.run_id, d.i + 1 AS i, d.used, d.best FROM dp d JOIN ua ON ua.run_id = d.run_id AND ua.i = d.i + 1
    UNION ALL SELECT d.run_id, d.i + 1, d.used | (1::BIGINT << o.b::INT), d.best + o.s FROM dp d JOIN o ON o.run_id = d.run_id AND o.i = d.i + 1 AND (d.used >> o.b::INT) & 1 = 0) GROUP BY run_id, i, used)
"""


@query("optimal_match_total", f"""WITH RECURSIVE {I.MASKS}, {I.MASKS_OTHER}, {OV}, {BEST}
SELECT run_id, round(max(best), 6) AS total, round(max(best), 6) AS bound FROM dp GROUP BY run_id""")
def _(spark, d):
    """The greatest total overlap of a one-to-one matching, and the bound that its duals give."""
    m = optimal_matching(overlap(spark, d), G, "a", "b", "iou")
    return m.groupBy(*G).agg(r6(F.sum("iou")).alias("total"), r6(F.sum(F.coalesce("dual_a", F.lit(0.0)) + F.coalesce("dual_b", F.lit(0.0)))).alias("bound"))


T2 = "t2 AS (SELECT run_id, unit, frame, n_ev::DOUBLE AS v FROM traces)"


def second(spark, d):
    return I.traces(spark, d).select(*K, "frame", F.col("n_ev").cast("double").alias("dff"))


@query("functional_recall", f"""WITH {I.MASKS}, {I.MASKS_OTHER}, {I.TRACES}, {T2}, {OV},
c AS (SELECT o.run_id, o.b, covar_pop(x.dff, y.v) / sqrt(var_pop(x.dff) * var_pop(y.v)) AS r FROM ov o JOIN traces x ON x.run_id = o.run_id AND x.unit = o.a JOIN t2 y ON y.run_id = o.run_id AND y.unit = o.b AND y.frame = x.frame WHERE frac_b >= 0.05 GROUP BY o.run_id, o.a, o.b),
b AS (SELECT u.run_id, u.unit, max(r) AS r FROM (SELECT DISTINCT run_id, unit FROM t2) u LEFT JOIN c ON c.run_id = u.run_id AND c.b = u.unit GROUP BY ALL)
SELECT run_id, count(*) AS n_ref, round(quantile_cont(r, 0.5), 6) AS median_best_r, round(avg(CASE WHEN r >= 0.5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN r >= 0.7 THEN 1.0 ELSE 0 END), 6) AS recall_7, round(avg(CASE WHEN r >= 0.8 THEN 1.0 ELSE 0 END), 6) AS recall_8 FROM b GROUP BY ALL""")
def _(spark, d):
    f = M.functional_recall(overlap(spark, d), I.traces(spark, d), second(spark, d), G, "unit", "frame", "dff", 0.05)
    return f.select(*G, "n_ref", r6("median_best_r").alias("median_best_r"), *[r6(f"recall_{i}").alias(f"recall_{i}") for i in (5, 7, 8)])


@query("signal_recall")
def _(spark, d):
    s = M.signal_recall(overlap(spark, d), I.traces(spark, d), second(spark, d), G, "unit", "frame", "dff", 8, 20)
    return s.select(*G, "b", "n_units", r6("multiple_r", 5).alias("multiple_r"))


@query("split_half_reliability", f"""WITH {I.VOXELS},
h AS (SELECT run_id, label, t, avg(v) FILTER (y < 2) AS a, avg(v) FILTER (y >= 2) AS b FROM vox GROUP BY ALL),
l AS (SELECT run_id, label, regr_slope(a, t) AS sa, regr_intercept(a, t) AS ia, regr_slope(b, t) AS sb, regr_intercept(b, t) AS ib FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
d AS (SELECT run_id, label, t, a - sa * t - ia AS a, b - sb * t - ib AS b FROM h JOIN l USING (run_id, label)),
n AS (SELECT x.run_id, x.label, x.t, x.a, y.b AS sb FROM d x JOIN d y ON x.run_id = y.run_id AND x.label = y.label AND y.t = (x.t + 20) % 64)
SELECT run_id, label, round(covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)), 6) + 0.0 AS r, (SELECT round(covar_pop(n.a, sb) / sqrt(var_pop(n.a) * var_pop(sb)), 6) + 0.0 FROM n WHERE n.run_id = d.run_id AND n.label = d.label) AS r_shifted FROM d GROUP BY ALL""")
def _(spark, d):
    from undulate.operators.ranks import pearson
    from undulate.operators.signal import linear_detrend

    h = I.voxels_long(spark, d).groupBy(*G, "label", "t", (F.col("y") < 2).alias("top")).agg(F.avg("v").alias("v"))
    h = linear_detrend(h, [*G, "label", "top"], "t", "v", "u")
    w = h.groupBy(*G, "label", "t").agg(F.max(F.when(F.col("top"), F.col("u"))).alias("a"), F.max(F.when(~F.col("top"), F.col("u"))).alias("b")).dropna(subset=["a", "b"])
    s = w.select(*G, "label", F.pmod(F.col("t") + 44, F.lit(64)).alias("t"), F.col("b").alias("sb"))
    j = w.join(s, [*G, "label", "t"])
    return j.groupBy(*G, "label").agg(r6(pearson("a", "b")).alias("r"), r6(pearson("a", "sb")).alias("r_shifted"))


@query("trace_agreement", f"""{T}, {T2},
r AS (SELECT t.run_id, t.unit, covar_pop(dff, v) / sqrt(var_pop(dff) * var_pop(v)) AS r FROM traces t JOIN t2 USING (run_id, unit, frame) GROUP BY ALL)
SELECT run_id, count(*) AS n, round(quantile_cont(r, 0.5), 6) AS median_r, round(avg(r), 6) AS mean_r, round(min(r), 6) AS min_r FROM r GROUP BY ALL""")
def _(spark, d):
    a = M.trace_agreement(I.traces(spark, d), second(spark, d), G, "unit", "frame", "dff")
    return a.select(*G, "n", *[r6(c).alias(c) for c in ("median_r", "mean_r", "min_r")])


@query("voxel_coverage", f"""{W}, u AS (SELECT DISTINCT run_id, z, y, x FROM masks2), r AS (SELECT DISTINCT run_id, z, y, x FROM masks)
SELECT r.run_id, count(*) AS n_ref, round(avg(CASE WHEN u.z IS NULL THEN 0.0 ELSE 1 END), 6) AS coverage FROM r LEFT JOIN u USING (run_id, z, y, x) GROUP BY ALL""")
def _(spark, d):
    return M.voxel_coverage(I.masks_other(spark, d), I.masks(spark, d), G).select(*G, "n_ref", r6("coverage").alias("coverage"))


@query("label_confusion", """SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL""")
def _(spark, d):
    return M.confusion(I.table(spark, d, "labels"), [], "quality", "toxic")


@query("branch_groups", f"""WITH RECURSIVE {I.MASKS}, {I.TRACES},
sm AS (SELECT a.run_id, a.unit AS a, b.unit AS b, count(*) AS n_ab FROM masks a JOIN masks b USING (run_id, z, y, x) WHERE a.unit < b.unit GROUP BY ALL),
un AS (SELECT run_id, unit, count(*) AS n FROM masks GROUP BY ALL),
p AS (SELECT a.run_id, a.unit AS a, b.unit AS b, CASE WHEN a.dff > 10 AND b.dff > 10 THEN a.dff END AS x, CASE WHEN a.dff > 10 AND b.dff > 10 THEN b.dff END AS y FROM traces a JOIN traces b ON a.run_id = b.run_id AND a.frame = b.frame AND a.unit < b.unit),
co AS (SELECT run_id, a, b, CASE WHEN count(x) >= 10 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) ELSE 0 END AS r FROM p GROUP BY ALL),
e AS (SELECT s.run_id, s.a, s.b FROM sm s JOIN un x ON x.run_id = s.run_id AND x.unit = s.a JOIN un y ON y.run_id = s.run_id AND y.unit = s.b JOIN co ON co.run_id = s.run_id AND co.a = s.a AND co.b = s.b WHERE n_ab / (x.n + y.n - n_ab) > 0.02 AND r > 0.2),
sy AS (SELECT run_id, a, b FROM e UNION SELECT run_id, b, a FROM e),
rc AS (SELECT run_id, unit AS root, unit AS node FROM un UNION SELECT rc.run_id, rc.root, sy.b FROM rc JOIN sy ON sy.run_id = rc.run_id AND sy.a = rc.node),
l AS (SELECT run_id, root AS unit, min(node) AS component FROM rc GROUP BY ALL)
SELECT run_id, unit, component FROM l WHERE (run_id, component) IN (SELECT (run_id, component) FROM l GROUP BY ALL HAVING count(*) >= 2)""")
def _(spark, d):
    m = I.masks(spark, d)
    ov = M.overlap_matrix(m, m, G, "unit", self_pairs=True)
    co = coactive_corr(I.traces(spark, d), G, "unit", "frame", "dff", 10.0)
    return M.branch_groups(ov, co, m, G, "unit", 0.02, 0.2).select(*K, "component")


@query("fov_union", f"""{W},
f AS (SELECT run_id // 2 AS fov, run_id % 2 AS pos, unit, z, y, x FROM masks),
p0 AS (SELECT fov, 0 AS pos, min(unit) AS unit, z, y, x FROM f WHERE pos = 0 GROUP BY ALL),
j AS (SELECT f.*, p0.unit IS NOT NULL AS c FROM f LEFT JOIN p0 USING (fov, z, y, x) WHERE f.pos = 1),
ok AS (SELECT fov, unit FROM j GROUP BY ALL HAVING avg(CASE WHEN c THEN 1.0 ELSE 0 END) < 0.35),
p1 AS (SELECT fov, 1 AS pos, min(unit) AS unit, z, y, x FROM j SEMI JOIN ok USING (fov, unit) WHERE NOT c GROUP BY ALL)
SELECT fov, pos, unit, count(*) AS n FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1) GROUP BY ALL""")
def _(spark, d):
    m = I.masks(spark, d).select(F.floor(F.col("run_id") / 2).cast("long").alias("fov"), F.pmod("run_id", F.lit(2)).alias("pos"), "unit", "z", "y", "x")
    u = M.fov_union(m, ["fov"], "pos", "unit", [0, 1], 0.35)
    return u.groupBy("fov", "pos", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("frame_offset_audit", """SELECT floor(datediff('day', o_orderdate, l_shipdate) / 100.0)::BIGINT AS d, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(spark, d):
    o = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("s"))
    l = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.datediff("l_shipdate", F.lit("1990-01-01")).alias("i"))
    a = M.frame_offset_audit(o, l, ["k"], "s", "i")
    return a.groupBy(i8(F.floor(F.col("_d") / 100)).alias("d")).agg(F.sum("n").alias("n"))


@query("contamination_flag", f"""{T},
g AS (SELECT run_id, frame, avg(dff) AS g FROM traces GROUP BY ALL),
r AS (SELECT t.run_id, t.unit, covar_pop(dff, g) / sqrt(var_pop(dff) * var_pop(g)) AS r FROM traces t JOIN g USING (run_id, frame) GROUP BY ALL)
SELECT run_id, round(avg(r), 6) AS mean_r, avg(r) > 0.27 AS contaminated FROM r GROUP BY ALL""")
def _(spark, d):
    from undulate.operators.ranks import pearson

    t = I.traces(spark, d)
    g = t.groupBy(*G, "frame").agg(F.avg("dff").alias("g"))
    r = t.join(g, [*G, "frame"]).groupBy(*K).agg(pearson("dff", "g").alias("r"))
    return r.groupBy(*G).agg(r6(F.avg("r")).alias("mean_r"), (F.avg("r") > 0.27).alias("contaminated"))
