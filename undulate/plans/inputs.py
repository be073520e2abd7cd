"""Canonical inputs derived from the given tables, in Spark and as SQL fragments.

Users are grouped by 15 into recordings (``run_id``), a user's place in the
group is its ``unit``; three recordings form a field of view (``fov``), so
units recur across the recordings of a field. Suppliers form mask units the
same way. More data means more recordings, not larger ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_FRAMES = 60          # half-day frames of the 30 days covered by the events
FRAME_S = 43200
UNITS_PER_RUN = 15
RUNS_PER_FOV = 3
NZ, NY, NX = 8, 40, 51  # extents of the mask grid: line number, part key mod 40, quantity


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_us(col: str = "ts"):
    """Microseconds since the first day of the events, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))")


def keyed_events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.floor(F.col("user_id") / UNITS_PER_RUN).cast("long").alias("run_id"),
        F.pmod("user_id", F.lit(UNITS_PER_RUN)).cast("long").alias("unit"),
        F.floor(event_us() / (FRAME_S * 1_000_000)).cast("long").alias("frame"),
        event_us().alias("us"), "event_type", "value", "event_id",
    )


def densify(df: DataFrame, keys, t: str, n_frames: int, fill: dict[str, object]) -> DataFrame:
    """All frames 0..n−1 of every key; absent ones get the fill value."""
    keys = list(keys)
    grid = df.select(*keys).distinct().withColumn(
        t, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_frames - 1).cast("long"))))
    out = grid.join(df.select(*keys, t, *fill), [*keys, t], "left")
    return out.select(*keys, t, *[F.coalesce(F.col(c), F.lit(x)).alias(c) for c, x in fill.items()])


def traces(spark, d) -> DataFrame:
    """run_id, unit, frame, dff (summed value), n_ev (count); dense."""
    a = keyed_events(spark, d).groupBy("run_id", "unit", "frame").agg(
        F.round(F.sum("value"), 2).alias("dff"), F.count(F.lit(1)).alias("n_ev"))
    return densify(a, ["run_id", "unit"], "frame", N_FRAMES, {"dff": 0.0, "n_ev": 0})


def total(c: str = "dff"):
    """Sum of values of two decimals as such a value: equal sums are equal whatever the order they were added in."""
    return F.round(F.sum(c), 2)


TRACES = f"""
ev AS (SELECT user_id // {UNITS_PER_RUN} AS run_id, user_id % {UNITS_PER_RUN} AS unit,
         CAST(floor((epoch_us(ts) - 1704067200000000) / {FRAME_S}000000.0) AS BIGINT) AS frame,
         epoch_us(ts) - 1704067200000000 AS us, event_type, value, event_id FROM events),
agg AS (SELECT run_id, unit, frame, round(sum(value), 2) AS dff, count(*) AS n_ev FROM ev GROUP BY ALL),
traces AS (SELECT g.run_id, g.unit, f.frame, coalesce(a.dff, 0.0) AS dff, coalesce(a.n_ev, 0) AS n_ev
  FROM (SELECT DISTINCT run_id, unit FROM ev) g
  JOIN (SELECT unnest(range({N_FRAMES})) AS frame) f ON true
  LEFT JOIN agg a ON a.run_id = g.run_id AND a.unit = g.unit AND a.frame = f.frame)
"""


def runs(spark, d) -> DataFrame:
    """run_id, fov, subject, genotype, frame_rate, skip_s."""
    u = table(spark, d, "events").select(
        F.floor(F.col("user_id") / UNITS_PER_RUN).cast("long").alias("run_id")).distinct()
    fov = F.floor(F.col("run_id") / RUNS_PER_FOV).cast("long")
    return u.select(
        "run_id", fov.alias("fov"), F.floor(fov / 2).cast("long").alias("subject"),
        F.when(F.pmod(fov, F.lit(2)) == 0, "wt").otherwise("mut").alias("genotype"),
        F.lit(2.0).alias("frame_rate"), (F.pmod("run_id", F.lit(4)) * 0.75).alias("skip_s"))


RUNS = f"""
runs AS (SELECT run_id, run_id // {RUNS_PER_FOV} AS fov, run_id // {RUNS_PER_FOV} // 2 AS subject,
   CASE WHEN (run_id // {RUNS_PER_FOV}) % 2 = 0 THEN 'wt' ELSE 'mut' END AS genotype,
   2.0 AS frame_rate, (run_id % 4) * 0.75 AS skip_s
  FROM (SELECT DISTINCT user_id // {UNITS_PER_RUN} AS run_id FROM events))
"""


def behavior(spark, d) -> DataFrame:
    """run_id, signal, frame, value: summed value per event type of a recording; dense."""
    a = keyed_events(spark, d).groupBy("run_id", F.col("event_type").alias("signal"), "frame").agg(
        F.round(F.sum("value"), 2).alias("value"))
    return densify(a, ["run_id", "signal"], "frame", N_FRAMES, {"value": 0.0})


BEHAVIOR = f"""
bagg AS (SELECT run_id, event_type AS signal, frame, round(sum(value), 2) AS value FROM ev GROUP BY ALL),
behavior AS (SELECT g.run_id, g.signal, f.frame, coalesce(a.value, 0.0) AS value
  FROM (SELECT DISTINCT run_id, event_type AS signal FROM ev) g
  JOIN (SELECT unnest(range({N_FRAMES})) AS frame) f ON true
  LEFT JOIN bagg a ON a.run_id = g.run_id AND a.signal = g.signal AND a.frame = f.frame)
"""

ROBUST_Z = """
rz_med AS (SELECT run_id, unit, quantile_cont(dff, 0.5) AS med FROM traces GROUP BY ALL),
rz_mad AS (SELECT t.run_id, t.unit, any_value(m.med) AS med, quantile_cont(abs(dff - med), 0.5) AS mad
   FROM traces t JOIN rz_med m USING (run_id, unit) GROUP BY ALL),
rz AS (SELECT t.run_id, t.unit, t.frame, t.dff, (t.dff - m.med) / nullif(m.mad * 1.4826, 0) AS z
   FROM traces t JOIN rz_mad m USING (run_id, unit))
"""


def mask_rows(spark, d) -> DataFrame:
    """run_id, unit, z, y, x: voxels of each supplier's line items, as often as they occur."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.floor(F.col("l_suppkey") / 10).cast("long").alias("run_id"),
        F.pmod("l_suppkey", F.lit(10)).cast("long").alias("unit"),
        F.col("l_linenumber").cast("long").alias("z"),
        F.pmod("l_partkey", F.lit(NY)).cast("long").alias("y"),
        F.col("l_quantity").cast("long").alias("x"),
    )


def masks(spark, d) -> DataFrame:
    """run_id, unit, z, y, x: distinct voxels of each supplier's line items."""
    return mask_rows(spark, d).distinct()


MASKS = f"""
masks AS (SELECT DISTINCT l_suppkey // 10 AS run_id, l_suppkey % 10 AS unit, CAST(l_linenumber AS BIGINT) AS z,
   l_partkey % {NY} AS y, CAST(l_quantity AS BIGINT) AS x FROM lineitem)
"""


def masks_other(spark, d) -> DataFrame:
    """A second set of masks on the same grid: returned items only, shifted one column (another source)."""
    li = table(spark, d, "lineitem").filter(F.col("l_discount") > 0.02)
    return li.select(
        F.floor(F.col("l_suppkey") / 10).cast("long").alias("run_id"),
        F.pmod("l_suppkey", F.lit(10)).cast("long").alias("unit"),
        F.col("l_linenumber").cast("long").alias("z"),
        F.pmod("l_partkey", F.lit(NY)).cast("long").alias("y"),
        F.col("l_quantity").cast("long").alias("x"),
    ).distinct()


MASKS_OTHER = f"""
masks2 AS (SELECT DISTINCT l_suppkey // 10 AS run_id, l_suppkey % 10 AS unit, CAST(l_linenumber AS BIGINT) AS z,
   l_partkey % {NY} AS y, CAST(l_quantity AS BIGINT) AS x FROM lineitem WHERE l_discount > 0.02)
"""


def voxel_traces(spark, d) -> DataFrame:
    """run_id, z, y, x, label, trace: embeddings as voxels of 2×5×5 grids with 64 frames."""
    e = table(spark, d, "embeddings")
    k = F.pmod("vec_id", F.lit(50)).cast("long")
    return e.select(
        F.floor(F.col("vec_id") / 50).cast("long").alias("run_id"),
        F.floor(k / 25).cast("long").alias("z"), F.pmod(F.floor(k / 5), F.lit(5)).cast("long").alias("y"),
        F.pmod(k, F.lit(5)).cast("long").alias("x"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("trace"))


def voxels_long(spark, d) -> DataFrame:
    v = voxel_traces(spark, d)
    return v.select("run_id", "z", "y", "x", "label", F.posexplode("trace").alias("t", "v")).withColumn(
        "t", F.col("t").cast("long"))


VOXELS = """
vox AS (SELECT vec_id // 50 AS run_id, (vec_id % 50) // 25 AS z, ((vec_id % 50) // 5) % 5 AS y, vec_id % 5 AS x,
   CAST(label AS BIGINT) AS label, CAST(i AS BIGINT) AS t, CAST(embedding[i + 1] AS DOUBLE) AS v
  FROM embeddings, unnest(range(64)) AS u(i))
"""


def cohort(spark, d) -> DataFrame:
    """One row per customer: fov (nation), subject (region), genotype, and metrics of its orders."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).alias("mean_price"), F.count(F.lit(1)).alias("n_orders"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    j = o.join(c, "c_custkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(
        F.col("c_custkey").alias("run_id"), F.col("c_nationkey").cast("long").alias("fov"),
        F.col("n_regionkey").cast("long").alias("subject"),
        F.when(F.pmod("n_regionkey", F.lit(2)) == 0, "wt").otherwise("mut").alias("genotype"),
        "mean_price", F.col("n_orders").cast("double").alias("n_orders"), F.col("c_acctbal").alias("acctbal"))


COHORT = """
cohort AS (SELECT c_custkey AS run_id, CAST(c_nationkey AS BIGINT) AS fov, CAST(n_regionkey AS BIGINT) AS subject,
   CASE WHEN n_regionkey % 2 = 0 THEN 'wt' ELSE 'mut' END AS genotype, mean_price,
   CAST(n_orders AS DOUBLE) AS n_orders, c_acctbal AS acctbal
  FROM (SELECT o_custkey, round(sum(o_totalprice), 2) / count(*) AS mean_price, count(*) AS n_orders FROM orders GROUP BY 1) o
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
"""


def cohort_long(spark, d) -> DataFrame:
    return cohort(spark, d).unpivot(
        ["run_id", "fov", "subject", "genotype"], ["mean_price", "n_orders", "acctbal"], "metric", "value")


COHORT_LONG = COHORT + """,
mlong AS (SELECT run_id, fov, subject, genotype, unnest(['mean_price', 'n_orders', 'acctbal']) AS metric,
   unnest([mean_price, n_orders, acctbal]) AS value FROM cohort)
"""
