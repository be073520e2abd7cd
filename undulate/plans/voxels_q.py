"""Queries over sparse 3-D operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from undulate.operators import voxels as V
from undulate.operators.pairs import pair_corr
from undulate.operators.signal import ols_coefficients
from undulate.plans import inputs as I
from undulate.plans.registry import query, r6
from undulate.plans.rolling_q import gaussian_sql

G = ["run_id"]
K = ["run_id", "unit"]
VK = ["run_id", "z", "y", "x"]
UV = ["run_id", "unit", "z", "y", "x"]
GRID = (I.NZ, I.NY, I.NX)
M = f"WITH {I.MASKS}"
X = f"WITH {I.VOXELS}"


def offs_sql(name: str, offs) -> str:
    rows = ", ".join(f"({a}, {b}, {c}, {d}::DOUBLE)" for a, b, c, d in offs)
    return f"{name}(dz, dy, dx, dd) AS (VALUES {rows})"


INGRID = f"z BETWEEN 0 AND {I.NZ - 1} AND y BETWEEN 0 AND {I.NY - 1} AND x BETWEEN 0 AND {I.NX - 1}"


@query("dilate_ball", f"""{M}, {offs_sql('o', V.ball(2))},
d AS (SELECT DISTINCT run_id, unit, z + dz AS z, y + dy AS y, x + dx AS x FROM masks, o)
SELECT run_id, unit, count(*) AS n_vox, CAST(sum(z * 10000 + y * 100 + x) AS BIGINT) AS checksum FROM d WHERE {INGRID} GROUP BY ALL""")
def _(spark, d):
    m = V.dilate(I.masks(spark, d), K, V.ball(2), GRID)
    return m.groupBy(*K).agg(F.count(F.lit(1)).alias("n_vox"), F.sum(F.expr("z * 10000 + y * 100 + x")).alias("checksum"))


@query("erode_run_union", f"""{M}, {offs_sql('o', V.neighbours(6))}, u AS (SELECT DISTINCT run_id, z, y, x FROM masks)
SELECT run_id, z, y, x FROM (SELECT run_id, z - dz AS z, y - dy AS y, x - dx AS x, count(*) AS n FROM u, o GROUP BY ALL) WHERE n = 7""")
def _(spark, d):
    return V.erode(I.masks(spark, d).select(*VK).distinct(), G, V.neighbours(6))


@query("open_close", f"""{M}, {offs_sql('o', V.neighbours(6))}, u AS (SELECT DISTINCT run_id, z, y, x FROM masks),
e AS (SELECT run_id, z - dz AS z, y - dy AS y, x - dx AS x FROM u, o GROUP BY ALL HAVING count(*) = 7),
op AS (SELECT DISTINCT run_id, z + dz AS z, y + dy AS y, x + dx AS x FROM e, o),
d AS (SELECT DISTINCT run_id, z + dz AS z, y + dy AS y, x + dx AS x FROM u, o),
cl AS (SELECT run_id, z - dz AS z, y - dy AS y, x - dx AS x FROM d, o GROUP BY ALL HAVING count(*) = 7)
SELECT 'open' AS op, run_id, count(*) AS n FROM op GROUP BY ALL UNION ALL SELECT 'close', run_id, count(*) FROM cl GROUP BY ALL""")
def _(spark, d):
    u = I.masks(spark, d).select(*VK).distinct()
    a = V.opening(u, G, V.neighbours(6)).groupBy(*G).agg(F.count(F.lit(1)).alias("n")).select(F.lit("open").alias("op"), *G, "n")
    b = V.closing(u, G, V.neighbours(6)).groupBy(*G).agg(F.count(F.lit(1)).alias("n")).select(F.lit("close").alias("op"), *G, "n")
    return a.unionByName(b)


CORE = f"""{offs_sql('b1', V.ball(1))}, {offs_sql('b3', V.ball(3))},
er AS (SELECT run_id, unit, z - dz AS z, y - dy AS y, x - dx AS x FROM masks, b1 GROUP BY ALL HAVING count(*) = 7),
core AS (SELECT * FROM er UNION ALL SELECT m.* FROM masks m ANTI JOIN er USING (run_id, unit)),
nr AS (SELECT run_id, unit, z + dz AS z, y + dy AS y, x + dx AS x, min(dd) AS dd FROM masks, b3 GROUP BY ALL),
shell AS (SELECT run_id, unit, z, y, x FROM nr ANTI JOIN masks USING (run_id, z, y, x) WHERE dd > 2 + 1e-9 AND {INGRID})
"""


@query("core_shell_regions", f"""{M}, {CORE}
SELECT run_id, unit, 'core' AS region, count(*) AS n FROM core GROUP BY ALL UNION ALL SELECT run_id, unit, 'shell', count(*) FROM shell GROUP BY ALL""")
def _(spark, d):
    r = V.core_shell_regions(I.masks(spark, d), G, "unit", GRID)
    return r.groupBy(*K, "region").agg(F.count(F.lit(1)).alias("n"))


@query("core_shell_trace", f"""WITH {I.VOXELS},
sc AS (SELECT vec_id, vec_id // 50 AS run_id, label AS unit FROM embeddings),
g AS (SELECT run_id, label AS unit, t, avg(v) FILTER (x < 3) AS core, avg(v) FILTER (x >= 3) AS shell FROM vox GROUP BY ALL)
SELECT run_id, unit, t, round(core - coalesce(shell, 0), 6) + 0.0 AS value FROM g WHERE core IS NOT NULL""")
def _(spark, d):
    from undulate.operators.aggregate import core_shell_trace, region_mean_trace

    v = I.voxels_long(spark, d)
    reg = I.voxel_traces(spark, d).select(*VK, F.col("label").alias("unit"), F.when(F.col("x") < 3, "core").otherwise("shell").alias("region"))
    m = region_mean_trace(reg, v.drop("label"), VK, [*K, "region"], "t", "v")
    return core_shell_trace(m, K, "t").filter("core IS NOT NULL").select(*K, "t", r6("value").alias("value"))


@query("distance_rings", f"""{M}, {offs_sql('b', V.ball(4.0, (3.9, 1.0, 1.2)))},
nr AS (SELECT run_id, unit, z + dz AS z, y + dy AS y, x + dx AS x, min(dd) AS dist FROM masks, b GROUP BY ALL)
SELECT run_id, unit, CASE WHEN dist <= 2 + 1e-9 THEN 0 ELSE 1 END AS ring, count(*) AS n FROM nr WHERE dist > 0 AND {INGRID} GROUP BY ALL""")
def _(spark, d):
    r = V.ring_runs(I.mask_rows(spark, d), K, [0.0, 2.0, 4.0], (3.9, 1.0, 1.2), GRID)
    return r.groupBy(*K, "ring").agg(F.sum(F.expr("b - a + 1")).alias("n"))


NODE = "(z << 42) + (y << 21) + x"

REACH = f"""
{offs_sql('o', [o for o in V.neighbours(26) if o[:3] != (0, 0, 0)])},
e AS (SELECT a.run_id, a.unit, a.z * 1000000 + a.y * 1000 + a.x AS src, b.z * 1000000 + b.y * 1000 + b.x AS dst FROM (SELECT *, z + dz AS z2, y + dy AS y2, x + dx AS x2 FROM masks, o) a
   JOIN masks b ON b.run_id = a.run_id AND b.unit = a.unit AND b.z = z2 AND b.y = y2 AND b.x = x2),
r AS (SELECT run_id, unit, z * 1000000 + y * 1000 + x AS root, z * 1000000 + y * 1000 + x AS node FROM masks
  UNION SELECT r.run_id, r.unit, r.root, e.dst FROM r JOIN e ON e.run_id = r.run_id AND e.unit = r.unit AND e.src = r.node),
cc AS (SELECT run_id, unit, root AS node, min(node) AS component FROM r GROUP BY ALL)
"""


@query("connected_components_26", f"""WITH RECURSIVE {I.MASKS}, {REACH}
SELECT run_id, unit, node // 1000000 AS z, node // 1000 % 1000 AS y, node % 1000 AS x, component FROM cc""")
def _(spark, d):
    c = V.connected_voxels(I.masks(spark, d), K, 26)
    first = F.shiftright("component", 42) * 1000000 + F.shiftright("component", 21).bitwiseAND(F.lit((1 << 21) - 1)) * 1000 + F.col(
        "component").bitwiseAND(F.lit((1 << 21) - 1))
    return c.select(*UV, first.alias("component"))


@query("components_keep_largest", f"""WITH RECURSIVE {I.MASKS}, {REACH},
s AS (SELECT run_id, unit, component, count(*) AS n FROM cc GROUP BY ALL)
SELECT run_id, unit, max(n) AS largest, count(*) AS n_components, CAST(sum(CASE WHEN n >= 4 THEN n ELSE 0 END) AS BIGINT) AS kept FROM s GROUP BY ALL""")
def _(spark, d):
    s = V.component_sizes(V.connected_voxels(I.masks(spark, d), K, 26), K)
    return s.groupBy(*K).agg(F.max("n_vox").alias("largest"), F.count(F.lit(1)).alias("n_components"),
                             F.sum(F.when(F.col("n_vox") >= 4, F.col("n_vox")).otherwise(0)).alias("kept"))


@query("components_by_seeds", f"""WITH RECURSIVE {I.MASKS}, {REACH},
sd AS (SELECT DISTINCT run_id, unit, component FROM cc WHERE node % 1000 = 25)
SELECT run_id, unit, count(*) AS n FROM cc JOIN sd USING (run_id, unit, component) GROUP BY ALL""")
def _(spark, d):
    m = I.masks(spark, d)
    c = V.touching_seeds(V.connected_voxels(m, K, 26), m.filter("x = 25"), K)
    return c.groupBy(*K).agg(F.count(F.lit(1)).alias("n"))


@query("fill_holes")
def _(spark, d):
    u = I.masks(spark, d).select(*VK).distinct()
    f = V.fill_holes(u, G)
    return f.groupBy(*G).agg(F.count(F.lit(1)).alias("n_filled"))


@query("slice_clean", f"""WITH RECURSIVE {I.MASKS},
{offs_sql('o', [o for o in V.neighbours(26) if o[:3] != (0, 0, 0) and o[0] == 0])},
e AS (SELECT a.run_id, a.unit, a.z, a.y * 1000 + a.x AS src, b.y * 1000 + b.x AS dst FROM (SELECT *, y + dy AS y2, x + dx AS x2 FROM masks, o) a
   JOIN masks b ON b.run_id = a.run_id AND b.unit = a.unit AND b.z = a.z AND b.y = y2 AND b.x = x2),
r AS (SELECT run_id, unit, z, y * 1000 + x AS root, y * 1000 + x AS node FROM masks
  UNION SELECT r.run_id, r.unit, r.z, r.root, e.dst FROM r JOIN e ON e.run_id = r.run_id AND e.unit = r.unit AND e.z = r.z AND e.src = r.node),
s AS (SELECT run_id, unit, z, root, count(*) AS n FROM r GROUP BY ALL)
SELECT run_id, unit, z, root // 1000 AS y, root % 1000 AS x FROM s WHERE n >= 3""")
def _(spark, d):
    return V.slice_clean(I.masks(spark, d), K, 3)


GY = gaussian_sql(0.5, 'vox', 'run_id, z, x, t', 'y', 'v', 5, 'gy')


@query("gaussian_smooth_3d", f"""{X}, {GY}, {gaussian_sql(0.5, '(SELECT run_id, z, x, t, y, smooth AS v FROM gy)', 'run_id, z, y, t', 'x', 'v', 5, 'gx')}
SELECT run_id, t, z, y, x, round(smooth, 6) + 0.0 AS v FROM gx""")
def _(spark, d):
    v = I.voxels_long(spark, d)
    return V.gaussian_smooth_3d(v, ["run_id", "t"], "v", (0.0, 0.5, 0.5), (2, 5, 5)).select("run_id", "t", "z", "y", "x", r6("v").alias("v"))


@query("spatial_highpass", f"""{X}, {GY},
h AS (SELECT v.run_id, v.t, v.z, v.y, v.x, greatest(0, v.v - smooth) AS h FROM vox v JOIN gy USING (run_id, z, x, t, y)),
q AS (SELECT run_id, quantile_cont(h, 0.999) AS q FROM h GROUP BY ALL)
SELECT run_id, t, z, y, x, round(h / q, 6) AS hp FROM h JOIN q USING (run_id)""")
def _(spark, d):
    h = V.spatial_highpass(I.voxels_long(spark, d), ["run_id", "t"], G, "v", (0.0, 0.5, 0.0), (2, 5, 5))
    return h.select("run_id", "t", "z", "y", "x", r6("hp").alias("hp"))


@query("activity_volume")
def _(spark, d):
    a = V.activity_volume(I.voxels_long(spark, d), G, "t", "v", 64, (2, 5, 5))
    return a.groupBy(*VK).agg(r6(F.max("z_act"), 3).alias("peak_z"), F.max_by("t", F.struct("z_act", -F.col("t"))).alias("t_peak"))


@query("adaptive_thresholds", f"""{X}, m AS (SELECT run_id, z, y, x, max(v) AS v FROM vox GROUP BY ALL),
q AS (SELECT run_id, quantile_cont(v, 0.5) AS f, quantile_cont(v, 0.9) AS a, quantile_cont(v, 0.99) AS b FROM m GROUP BY ALL),
t AS (SELECT run_id, f, least(greatest(f + 0.44 * (a - f), 0.2), 0.45) AS fg, least(greatest(f + 0.3 * (b - f), 0.25), 0.7) AS sd FROM q)
SELECT run_id, round(f, 6) AS floor, round(fg, 6) AS fg_thr, round(sd, 6) AS seed_thr, CASE WHEN fg < 0.26 THEN 0.4 ELSE 0.45 END::DOUBLE AS grow_r FROM t""")
def _(spark, d):
    """Levels scaled to the values of the given table."""
    m = I.voxels_long(spark, d).groupBy(*VK).agg(F.max("v").alias("v"))
    t = V.adaptive_thresholds(m, G, "v", (0.44, 0.2, 0.45), (0.3, 0.25, 0.7), dim=0.26)
    return t.select(*G, *[r6(c).alias(c) for c in ("floor", "fg_thr", "seed_thr")], "grow_r")


@query("hysteresis_segment", f"""WITH RECURSIVE {I.VOXELS}, m AS (SELECT run_id, z, y, x, max(v) AS v FROM vox GROUP BY ALL),
q AS (SELECT run_id, quantile_cont(v, 0.7) AS lo, quantile_cont(v, 0.95) AS hi FROM m GROUP BY ALL),
c AS (SELECT m.*, v >= hi AS seed FROM m JOIN q USING (run_id) WHERE v >= lo),
r AS (SELECT run_id, z, y, x FROM c WHERE seed UNION SELECT c.run_id, c.z, c.y, c.x FROM r JOIN c ON c.run_id = r.run_id AND abs(c.z - r.z) <= 1 AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1)
SELECT run_id, z, y, x FROM r""")
def _(spark, d):
    m = I.voxels_long(spark, d).groupBy(*VK).agg(F.max("v").alias("v"))
    return V.hysteresis_segment(m, G, "v", 0.7, 0.95).select(*VK)


@query("grow_regions")
def _(spark, d):
    v = I.voxel_traces(spark, d).withColumn("score", F.array_max("trace"))
    m = V.grow_regions(v, G, "trace", "score", 0.25, 0.1, refresh=2)
    return m.select(*VK, "region", "round")


@query("merge_units", f"""WITH RECURSIVE {I.MASKS}, {I.TRACES},
{offs_sql('o', V.neighbours(26))},
adj AS (SELECT DISTINCT a.run_id, a.unit AS a, b.unit AS b FROM (SELECT *, z + dz AS z2, y + dy AS y2, x + dx AS x2 FROM masks, o) a JOIN masks b ON a.run_id = b.run_id AND a.z2 = b.z AND a.y2 = b.y AND a.x2 = b.x AND a.unit < b.unit),
zn AS (SELECT t.run_id, t.unit, t.frame, (dff - m) / sd AS zz FROM traces t JOIN (SELECT run_id, unit, avg(dff) AS m, stddev_pop(dff) AS sd FROM traces GROUP BY ALL) USING (run_id, unit)),
e AS (SELECT a.run_id, a.unit AS a, b.unit AS b FROM zn a JOIN zn b ON a.run_id = b.run_id AND a.frame = b.frame AND a.unit < b.unit JOIN adj ON adj.run_id = a.run_id AND adj.a = a.unit AND adj.b = b.unit GROUP BY ALL HAVING avg(a.zz * b.zz) > 0.15),
s AS (SELECT run_id, a, b FROM e UNION SELECT run_id, b, a FROM e),
r AS (SELECT DISTINCT run_id, unit AS root, unit AS node FROM masks UNION SELECT r.run_id, r.root, s.b FROM r JOIN s ON s.run_id = r.run_id AND s.a = r.node)
SELECT run_id, root AS unit, min(node) AS component FROM r GROUP BY ALL""")
def _(spark, d):
    p = pair_corr(I.traces(spark, d), G, "unit", "frame", "dff")
    return V.merge_units(I.masks(spark, d), p, G, "unit", 0.15, 1).select(*K, "component")


@query("minip_dark_mask", f"""{X}, m AS (SELECT run_id, z, y, x, min(v) AS m FROM vox GROUP BY ALL), q AS (SELECT run_id, quantile_cont(m, 0.1) AS q FROM m GROUP BY ALL)
SELECT run_id, z, y, x FROM m JOIN q USING (run_id) WHERE m <= q""")
def _(spark, d):
    return V.minip_dark(I.voxels_long(spark, d), G, "v", 0.1)


@query("bestframe_seed", f"""{X}, g AS (SELECT run_id, t, avg(v) AS g FROM vox GROUP BY ALL),
b AS (SELECT run_id, t FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(g, 9) DESC, t) AS rn FROM g) WHERE rn <= 5),
m AS (SELECT run_id, z, y, x, max(v) AS m FROM vox SEMI JOIN b USING (run_id, t) GROUP BY ALL), q AS (SELECT run_id, quantile_cont(m, 0.8) AS q FROM m GROUP BY ALL)
SELECT run_id, z, y, x, round(m, 6) AS max_v FROM m JOIN q USING (run_id) WHERE m > q""")
def _(spark, d):
    from undulate.operators.topk import top_n

    v = I.voxels_long(spark, d)
    g = v.groupBy(*G, "t").agg(F.round(F.avg("v"), 9).alias("g"))
    b = top_n(g, G, "g", 5, ["t"])
    return V.bestframe_seed(v, b, G, "t", "v", 0.8).select(*VK, r6("max_v").alias("max_v"))


@query("split_by_seeds")
def _(spark, d):
    u = V.closing(I.masks(spark, d).select(*VK).distinct(), G, V.neighbours(6))
    return V.split_by_seeds(u, G, 3.0).groupBy(*G, "part").agg(F.count(F.lit(1)).alias("n"))


SIZE = (3.9, 1.0, 1.2)

# depth: least distance to a voxel that is not in the mask; seeds: deepest within 3; then a voxel joins what is flooded over its own
# lightest edge, or over the lightest of all edges of its run that lead on
FLOOD = f"""
{offs_sql('o6', V.neighbours(6))}, {offs_sql('b5', V.ball(5.0, SIZE))}, {offs_sql('b3', V.ball(3.0, SIZE))},
dm AS MATERIALIZED (SELECT DISTINCT run_id, z, y, x FROM masks),
dp AS MATERIALIZED (SELECT run_id, oz AS z, oy AS y, ox AS x, oz * 1000000 + oy * 1000 + ox AS node, round(min(dd), 9) AS d
  FROM (SELECT run_id, z AS oz, y AS oy, x AS ox, z + dz AS z, y + dy AS y, x + dx AS x, dd FROM dm, b5) ANTI JOIN dm USING (run_id, z, y, x) GROUP BY ALL),
sd AS (SELECT run_id, node FROM (SELECT a.run_id, a.node, a.d, b.node AS m, b.d AS e FROM (SELECT *, z + dz AS z2, y + dy AS y2, x + dx AS x2 FROM dp, b3) a
  JOIN dp b ON b.run_id = a.run_id AND b.z = z2 AND b.y = y2 AND b.x = x2) GROUP BY ALL HAVING bool_and(m = node OR e < d OR (e = d AND m > node))),
ed AS MATERIALIZED (SELECT a.run_id, a.node AS v, b.node AS u, -least(a.d, b.d) AS w, least(a.node, b.node) AS n1, greatest(a.node, b.node) AS n2,
    row_number() OVER (PARTITION BY a.run_id, a.node ORDER BY -least(a.d, b.d), least(a.node, b.node), greatest(a.node, b.node)) = 1 AS own
  FROM (SELECT *, z + dz AS z2, y + dy AS y2, x + dx AS x2 FROM dp, o6 WHERE dd = 0 AND abs(dz) + abs(dy) + abs(dx) = 1) a JOIN dp b ON b.run_id = a.run_id AND b.z = z2 AND b.y = y2 AND b.x = x2),
fl(run_id, node, part) USING KEY (run_id, node) AS (
  SELECT run_id, node, node FROM sd
  UNION
  SELECT run_id, v, part FROM (
    SELECT e.run_id, e.v, f.part, e.own, row_number() OVER (PARTITION BY e.run_id ORDER BY w, n1, n2) AS rn
    FROM ed e JOIN recurring.fl f ON f.run_id = e.run_id AND f.node = e.u ANTI JOIN recurring.fl g ON g.run_id = e.run_id AND g.node = e.v)
  WHERE own OR rn = 1)
"""


@query("split_by_flooding", f"""WITH RECURSIVE {I.MASKS}, {FLOOD}
SELECT run_id, node // 1000000 AS z, node // 1000 % 1000 AS y, node % 1000 AS x, part FROM fl""")
def _(spark, d):
    f = V.split_by_flooding(I.masks(spark, d).select(*VK).distinct(), G, 3.0, SIZE).filter("part IS NOT NULL")
    at = lambda s, k: F.shiftright("part", s).bitwiseAND(F.lit((1 << 21) - 1)) * k
    return f.select(*VK, (at(42, 1_000_000) + at(21, 1000) + at(0, 1)).alias("part"))


@query("pca_covariances", f"""{M}
SELECT run_id, unit, count(*) AS n_vox, round(covar_pop(y, y), 6) AS cyy, round(covar_pop(z * 3.9, y), 6) + 0.0 AS czy, round(covar_pop(y, x * 1.2), 6) + 0.0 AS cyx,
  round(15.21 * var_pop(z) + var_pop(y) + 1.44 * var_pop(x), 5) AS trace FROM masks GROUP BY ALL""")
def _(spark, d):
    m = I.masks(spark, d)
    s = V.pca_shape(m, K, (3.9, 1.0, 1.2))
    c = m.groupBy(*K).agg(F.var_pop("y").alias("cyy"), F.covar_pop(F.col("z") * 3.9, "y").alias("czy"), F.covar_pop("y", F.col("x") * 1.2).alias("cyx"))
    return s.join(c, K).select(*K, "n_vox", r6("cyy").alias("cyy"), r6("czy").alias("czy"), r6("cyx").alias("cyx"),
                               r6(F.col("w0") + F.col("w1") + F.col("w2"), 5).alias("trace"))


@query("pca_shape")
def _(spark, d):
    s = V.pca_shape(I.masks(spark, d), K, (3.9, 1.0, 1.2))
    return s.select(*K, "n_vox", r6("w0", 4).alias("w0"), r6("linearity", 4).alias("linearity"), r6("elongation", 4).alias("elongation"),
                    r6("verticality", 4).alias("verticality"), r6("length", 3).alias("length"), "kind")


@query("axis_bins")
def _(spark, d):
    m = I.masks(spark, d)
    b = V.axis_bins(m, V.pca_shape(m, K, (3.9, 1.0, 1.2)), K, 5, (3.9, 1.0, 1.2))
    return b.groupBy(*K, "bin").agg(F.count(F.lit(1)).alias("n"))


@query("depth_chunks", f"""{M}, q AS (SELECT run_id, unit, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.75) AS c FROM masks GROUP BY ALL)
SELECT run_id, unit, CASE WHEN y >= c THEN 3 WHEN y >= b THEN 2 WHEN y >= a THEN 1 ELSE 0 END AS bin, count(*) AS n FROM masks JOIN q USING (run_id, unit) GROUP BY ALL""")
def _(spark, d):
    return V.depth_chunks(I.masks(spark, d), K, 4).groupBy(*K, "bin").agg(F.count(F.lit(1)).alias("n"))


@query("spatial_features", f"""WITH RECURSIVE {I.MASKS}, {REACH},
nc AS (SELECT run_id, unit, count(DISTINCT component) AS n_components FROM cc GROUP BY ALL),
{offs_sql('o6', [o for o in V.neighbours(6) if o[:3] != (0, 0, 0)])},
i6 AS (SELECT run_id, unit, count(*) AS k FROM (SELECT s.* FROM (SELECT run_id, unit, z + dz AS z, y + dy AS y, x + dx AS x, count(*) AS n FROM masks, o6 GROUP BY ALL) s SEMI JOIN masks USING (run_id, unit, z, y, x) WHERE n = 6) GROUP BY ALL),
mp AS (SELECT run_id, unit, count(*) AS k FROM (SELECT DISTINCT run_id, unit, y, x FROM masks) GROUP BY ALL),
g AS (SELECT run_id, unit, count(*) AS n_vox, max(z) - min(z) + 1 AS zspan, max(y) - min(y) + 1 AS yspan, max(x) - min(x) + 1 AS xspan, count(DISTINCT z) AS nz FROM masks GROUP BY ALL)
SELECT run_id, unit, n_vox, zspan, yspan, xspan, round(yspan / xspan, 6) AS aspect_yx, round(yspan / zspan, 6) AS aspect_yz, round(1 - coalesce(i6.k, 0) / n_vox, 6) AS surface_ratio,
  round(mp.k / (yspan * xspan), 6) AS mip_fill, round(nz / zspan, 6) AS z_continuity, n_components FROM g JOIN nc USING (run_id, unit) JOIN mp USING (run_id, unit) LEFT JOIN i6 USING (run_id, unit)""")
def _(spark, d):
    f = V.spatial_features(I.masks(spark, d), K)
    return f.select(*K, "n_vox", "zspan", "yspan", "xspan", *[r6(c).alias(c) for c in ("aspect_yx", "aspect_yz", "surface_ratio", "mip_fill", "z_continuity")], "n_components")


@query("surface_plane_fit", f"""{X}, m AS (SELECT run_id, z, y, x, max(v) AS v FROM vox GROUP BY ALL),
h AS (SELECT run_id, z, x, (max(v) + min(v)) / 2 AS h FROM m GROUP BY ALL),
f AS (SELECT run_id, z::DOUBLE AS z, x::DOUBLE AS x, min(y)::DOUBLE AS y FROM m JOIN h USING (run_id, z, x) WHERE v > h GROUP BY ALL),
s AS (SELECT run_id, avg(y) AS my, avg(z) AS mz, avg(x) AS mx, var_pop(z) AS a, covar_pop(z, x) AS h, var_pop(x) AS c, covar_pop(y, z) AS p, covar_pop(y, x) AS q FROM f GROUP BY ALL),
k AS (SELECT *, (p * c - q * h) / (a * c - h * h) AS b1, (q * a - p * h) / (a * c - h * h) AS c1 FROM s)
SELECT run_id, round(my - b1 * mz - c1 * mx, 6) + 0.0 AS a, round(b1, 6) + 0.0 AS b, round(c1, 6) + 0.0 AS c, round(degrees(atan(sqrt(b1 * b1 + c1 * c1))), 5) AS tilt_deg FROM k""")
def _(spark, d):
    m = I.voxels_long(spark, d).groupBy(*VK).agg(F.max("v").alias("v"))
    return V.surface_plane(m, G, "v").select(*G, r6("a").alias("a"), r6("b").alias("b"), r6("c").alias("c"), r6("tilt_deg", 5).alias("tilt_deg"))


@query("corrected_depth", f"""{M}, s AS (SELECT run_id, avg(y) AS my, avg(z) AS mz, avg(x) AS mx, var_pop(z) AS a, covar_pop(z, x) AS h, var_pop(x) AS c, covar_pop(y, z) AS p, covar_pop(y, x) AS q FROM masks GROUP BY ALL),
k AS (SELECT *, (p * c - q * h) / (a * c - h * h) AS b1, (q * a - p * h) / (a * c - h * h) AS c1 FROM s),
u AS (SELECT run_id, unit, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM masks GROUP BY ALL)
SELECT run_id, unit, round(y - (my - b1 * mz - c1 * mx + b1 * z + c1 * x), 6) + 0.0 AS depth FROM u JOIN k USING (run_id)""")
def _(spark, d):
    m = I.masks(spark, d)
    p = ols_coefficients(m, G, "y", ["z", "x"]).select(*G, F.col("intercept").alias("a"), F.col("beta_z").alias("b"), F.col("beta_x").alias("c"), F.lit(0.0).alias("tilt_deg"))
    u = m.groupBy(*K).agg(F.avg("z").alias("z"), F.avg("y").alias("y"), F.avg("x").alias("x"))
    return V.corrected_depth(u, p, G).select(*K, r6("depth").alias("depth"))


@query("unit_adjacency", f"""{M}, {offs_sql('o', V.ball(4.0, (3.9, 1.0, 1.2)))}
SELECT a.run_id, a.unit AS a, b.unit AS b, min(dd) AS dist FROM (SELECT *, z + dz AS z2, y + dy AS y2, x + dx AS x2 FROM masks, o) a
JOIN masks b ON b.run_id = a.run_id AND b.z = z2 AND b.y = y2 AND b.x = x2 AND a.unit < b.unit GROUP BY ALL""")
def _(spark, d):
    return V.unit_distance(I.mask_rows(spark, d), G, "unit", 4.0, (3.9, 1.0, 1.2)).select(*G, "a", "b", "dist")


def small_rows(spark, d):
    """Orders as units: few voxels each, hence sparse adjacency; voxels may repeat."""
    l = I.table(spark, d, "lineitem")
    return l.select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("run_id"), F.pmod("l_orderkey", F.lit(100)).cast("long").alias("unit"),
                    F.col("l_linenumber").cast("long").alias("z"), F.pmod("l_partkey", F.lit(40)).cast("long").alias("y"), F.col("l_quantity").cast("long").alias("x"))


SMALL = """
su AS (SELECT DISTINCT l_orderkey // 100 AS run_id, l_orderkey % 100 AS unit, l_linenumber::BIGINT AS z, l_partkey % 40 AS y, l_quantity::BIGINT AS x FROM lineitem),
adj AS (SELECT DISTINCT a.run_id, a.unit AS a, b.unit AS b FROM su a JOIN su b ON a.run_id = b.run_id AND a.unit < b.unit AND (a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 2),
sy AS (SELECT run_id, a, b FROM adj UNION SELECT run_id, b, a FROM adj),
rc AS (SELECT DISTINCT run_id, unit AS root, unit AS node FROM su UNION SELECT rc.run_id, rc.root, sy.b FROM rc JOIN sy ON sy.run_id = rc.run_id AND sy.a = rc.node),
fam AS (SELECT run_id, root AS unit, min(node) AS component FROM rc GROUP BY ALL),
cen AS (SELECT run_id, unit, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx FROM su GROUP BY ALL),
rt AS (SELECT run_id, component, unit AS root, cz, cy, cx FROM (SELECT *, row_number() OVER (PARTITION BY run_id, component ORDER BY cy DESC, unit) AS rn FROM fam JOIN cen USING (run_id, unit)) WHERE rn = 1)
"""


@query("unit_families", f"""WITH RECURSIVE {SMALL},
lv AS (SELECT run_id, root AS node, 0 AS o FROM rt UNION SELECT lv.run_id, sy.b, lv.o + 1 FROM lv JOIN sy ON sy.run_id = lv.run_id AND sy.a = lv.node WHERE lv.o < 40),
ml AS (SELECT run_id, node AS unit, min(o) AS "order" FROM lv GROUP BY ALL)
SELECT f.run_id, f.unit, f.component, r.root, "order"::BIGINT AS "order", round(sqrt((c.cz - r.cz) * (c.cz - r.cz) + (c.cy - r.cy) * (c.cy - r.cy) + (c.cx - r.cx) * (c.cx - r.cx)), 6) AS root_dist
FROM fam f JOIN rt r USING (run_id, component) JOIN cen c ON c.run_id = f.run_id AND c.unit = f.unit JOIN ml ON ml.run_id = f.run_id AND ml.unit = f.unit""")
def _(spark, d):
    f = V.unit_families(small_rows(spark, d), G, "unit", 1.5)
    return f.select(*K, "component", "root", "order", r6("root_dist").alias("root_dist"))


SEED = "sg AS (SELECT run_id, t, avg(v) AS s FROM vox WHERE z = 0 AND y < 2 GROUP BY ALL)"


def seed(spark, d):
    return I.voxels_long(spark, d).filter("z = 0 AND y < 2").groupBy(*G, "t").agg(F.avg("v").alias("s"))


@query("corr_map_seed", f"""{X}, {SEED} SELECT run_id, z, y, x, round(covar_pop(v, s) / sqrt(var_pop(v) * var_pop(s)), 6) + 0.0 AS r FROM vox JOIN sg USING (run_id, t) GROUP BY ALL""")
def _(spark, d):
    return V.corr_map(I.voxels_long(spark, d), seed(spark, d), G, "t", "v", "s").select(*VK, r6("r").alias("r"))


@query("corr_candidates", f"""WITH RECURSIVE {I.VOXELS}, {SEED},
cm AS (SELECT run_id, z, y, x, covar_pop(v, s) / sqrt(var_pop(v) * var_pop(s)) AS r FROM vox JOIN sg USING (run_id, t) GROUP BY ALL),
c AS (SELECT run_id, z, y, x, z * 25 + y * 5 + x AS id FROM cm WHERE r >= 0 AND NOT (z = 0 AND y < 2)),
q AS (SELECT run_id, id AS root, id FROM c UNION SELECT q.run_id, q.root, b.id FROM q JOIN c a ON a.run_id = q.run_id AND a.id = q.id JOIN c b ON b.run_id = a.run_id AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
l AS (SELECT run_id, root AS id, min(id) AS comp FROM q GROUP BY ALL),
k AS (SELECT run_id, comp FROM l JOIN c USING (run_id, id) GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT z) >= 2)
SELECT run_id, z, y, x FROM l JOIN k USING (run_id, comp) JOIN c USING (run_id, id)""")
def _(spark, d):
    v = I.voxels_long(spark, d)
    cm = V.corr_map(v, seed(spark, d), G, "t", "v", "s")
    return V.corr_candidates(cm, I.voxel_traces(spark, d).filter("z = 0 AND y < 2"), G, 0.0, 5, 2).select(*VK)


@query("maxabs_map", f"{X} SELECT run_id, z, y, x, round(max(abs(v)), 6) AS m FROM vox GROUP BY ALL")
def _(spark, d):
    return I.voxels_long(spark, d).groupBy(*VK).agg(r6(F.max(F.abs("v"))).alias("m"))


@query("voxel_behavior_map", f"""{X}, {SEED},
g AS (SELECT run_id, z, y, x, covar_pop(v, s) / sqrt(var_pop(v) * var_pop(s)) AS r, covar_pop(v, t) / sqrt(var_pop(v) * var_pop(t)) AS vt, covar_pop(s, t) / sqrt(var_pop(s) * var_pop(t)) AS st, avg(v) AS b FROM vox JOIN sg USING (run_id, t) GROUP BY ALL)
SELECT run_id, z, y, x, round(r, 6) + 0.0 AS r, round((r - vt * st) / sqrt((1 - vt * vt) * (1 - st * st)), 6) + 0.0 AS r_partial, round(b, 6) + 0.0 AS brightness FROM g""")
def _(spark, d):
    b = V.behavior_map(I.voxels_long(spark, d), seed(spark, d), G, "t", "v", "s")
    return b.select(*VK, r6("r").alias("r"), r6("r_partial").alias("r_partial"), r6("brightness").alias("brightness"))


@query("dual_channel_lag_map", f"""{X}, {SEED},
c AS (SELECT v.run_id, z, y, x, l AS lag, covar_pop(v, s) / sqrt(var_pop(v) * var_pop(s)) AS r FROM vox v JOIN (SELECT unnest(range(-3, 4)) AS l) q ON true JOIN sg ON sg.run_id = v.run_id AND sg.t = v.t - l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, z, y, x ORDER BY round(abs(r), 9) DESC, abs(lag), lag) AS rn FROM c)
SELECT k.run_id, k.z, k.y, k.x, round(o.r, 6) + 0.0 AS r0, round(k.r, 6) + 0.0 AS r_best, k.lag FROM k JOIN c o USING (run_id, z, y, x) WHERE rn = 1 AND o.lag = 0""")
def _(spark, d):
    return V.lag_map(I.voxels_long(spark, d), seed(spark, d), G, "t", "v", "s", 3).select(*VK, r6("r0").alias("r0"), r6("r_best").alias("r_best"), "lag")


@query("voxel_regression_map", f"""{X}, rg AS (SELECT run_id, t, avg(v) FILTER (z = 0 AND y < 2) AS s1, avg(v) FILTER (z = 1 AND y > 2) AS s2 FROM vox GROUP BY ALL),
m AS (SELECT run_id, z, y, x, var_pop(s1) AS a, covar_pop(s1, s2) AS h, var_pop(s2) AS c, covar_pop(v, s1) AS p, covar_pop(v, s2) AS q, var_pop(v) AS s FROM vox JOIN rg USING (run_id, t) GROUP BY ALL),
b AS (SELECT *, (p * c - q * h) / (a * c - h * h) AS b1, (q * a - p * h) / (a * c - h * h) AS b2 FROM m)
SELECT run_id, z, y, x, round(b1, 6) + 0.0 AS beta1, round(b2, 6) + 0.0 AS beta2, round((b1 * p + b2 * q) / s, 6) + 0.0 AS r2, round((b1 * p + b2 * q) / s - q * q / (c * s), 6) + 0.0 AS unique_x1 FROM b""")
def _(spark, d):
    v = I.voxels_long(spark, d)
    rg = v.groupBy(*G, "t").agg(F.avg(F.when((F.col("z") == 0) & (F.col("y") < 2), F.col("v"))).alias("s1"), F.avg(F.when((F.col("z") == 1) & (F.col("y") > 2), F.col("v"))).alias("s2"))
    return V.regression_map(v, rg, G, "t", "v", "s1", "s2").select(*VK, *[r6(c).alias(c) for c in ("beta1", "beta2", "r2", "unique_x1")])


@query("inside_outside_summary", f"""{X}, m AS (SELECT run_id, z, y, x, max(abs(v)) AS v FROM vox GROUP BY ALL)
SELECT run_id, y < 2 AS inside, round(avg(v), 6) AS mean_v, count(*) AS n FROM m GROUP BY ALL""")
def _(spark, d):
    m = I.voxels_long(spark, d).groupBy(*VK).agg(F.max(F.abs("v")).alias("v"))
    return V.inside_outside(m, m.filter("y < 2"), G, "v").select(*G, "inside", r6("mean_v").alias("mean_v"), "n")


@query("remove_pc0")
def _(spark, d):
    c = V.remove_pc0(I.voxel_traces(spark, d), G, "trace", 64)
    c = c.select(*VK, "loading", F.explode("clean").alias("clean"))
    return c.groupBy(*VK).agg(r6(F.stddev_pop("clean"), 4).alias("sd_clean"), r6(F.abs(F.max("loading")), 3).alias("loading"))




@query("active_voxel_morphology", f"""{X}, g AS (SELECT run_id, t, avg(v) AS g FROM vox GROUP BY ALL),
e AS (SELECT run_id, t FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(g, 9) DESC, t) AS rn FROM g) WHERE rn = 1),
f AS (SELECT v.* FROM vox v JOIN e USING (run_id, t)), m AS (SELECT run_id, max(v) AS mx FROM f GROUP BY ALL)
SELECT run_id, count(*) AS n_vox, round(15.21 * var_pop(z) + var_pop(y) + 1.44 * var_pop(x), 5) AS extent FROM f JOIN m USING (run_id) WHERE v >= 0.3 * mx GROUP BY ALL""")
def _(spark, d):
    from undulate.operators.topk import top_n

    v = I.voxels_long(spark, d)
    g = v.groupBy(*G, "t").agg(F.round(F.avg("v"), 9).alias("g"))
    f = v.join(top_n(g, G, "g", 1, ["t"]).select(*G, "t"), [*G, "t"])
    s = V.pca_shape(V.active_voxels(f, G, "v", 0.3), G, (3.9, 1.0, 1.2))
    return s.select(*G, "n_vox", r6(F.col("w0") + F.col("w1") + F.col("w2"), 5).alias("extent"))
