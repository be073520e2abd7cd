"""Queries over readers and writers: a table is written to the shared folder and read back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from undulate.plans import inputs as I
from undulate.plans.registry import i8, query, r6
from undulate.session import ensure_checkpoint_dir
from undulate.sources import tables as R

SIGNALS = ["click", "view", "purchase", "signup", "error"]  # fixed values: columns of a behaviour file, in its order


def folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/sources-{uuid.uuid4().hex}"


@query("read_frames_range", f"""WITH {I.VOXELS}
SELECT run_id::VARCHAR AS run_id, t, z, y, x, round(v, 6) AS v FROM vox WHERE t BETWEEN 10 AND 19""")
def _(spark, d):
    """Movie rows are packed along x, written by recording, and a time range is read."""
    v = I.voxels_long(spark, d).groupBy("run_id", "t", "z", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("s"))
    rows = v.select(F.col("run_id").cast("string").alias("run_id"), F.lit("a").alias("channel"), *[F.col(c).cast("int").alias(c) for c in ("t", "z", "y")],
                    F.transform("s", lambda s: s["v"].cast("float")).alias("vals"))
    path = folder(spark)
    R.write_table(rows, path, "frames")
    f = R.read_frames(spark, path, 10, 20)
    return f.select("run_id", i8("t").alias("t"), i8("z").alias("z"), i8("y").alias("y"), F.posexplode("vals").alias("x", "v")).select(
        "run_id", "t", "z", "y", i8("x").alias("x"), r6(F.col("v").cast("double")).alias("v"))


@query("read_masks_table", f"""WITH {I.MASKS}
SELECT run_id::VARCHAR AS run_id, 'auto' AS source, unit::VARCHAR AS unit, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x FROM masks""")
def _(spark, d):
    m = I.masks(spark, d).select(F.col("run_id").cast("string").alias("run_id"), F.lit("auto").alias("source"), F.col("unit").cast("string").alias("unit"),
                                 *[F.col(c).cast("int").alias(c) for c in ("z", "y", "x")])
    path = folder(spark)
    R.write_table(m, path, "mask_voxels")
    return R.read_masks(spark, path).select("run_id", "source", "unit", *[i8(c).alias(c) for c in ("z", "y", "x")])


@query("read_behavior_file", f"""WITH {I.TRACES}, {I.BEHAVIOR}
SELECT (run_id * 1000 + frame)::DOUBLE AS time_s, signal, value FROM behavior WHERE signal IN ({', '.join(repr(s) for s in SIGNALS)})""")
def _(spark, d):
    """A wide file; the first signal is found under its fallback name."""
    b = I.behavior(spark, d).withColumn("time_s", (F.col("run_id") * 1000 + F.col("frame")).cast("double"))
    wide = b.groupBy("time_s").pivot("signal", SIGNALS).agg(F.first("value")).withColumnRenamed(SIGNALS[0], f"{SIGNALS[0]}_raw")
    path = folder(spark)
    wide.write.option("header", "true").csv(path)
    return R.read_behavior(spark, path, [(s, [s, f"{s}_raw"]) for s in SIGNALS])


@query("read_trigger_edges", f"""WITH {I.TRACES}, {I.BEHAVIOR},
l AS (SELECT run_id * 1000 + frame AS s, 'camera' AS line, CASE WHEN frame % 3 = 1 THEN 1 ELSE 0 END AS level FROM behavior UNION
  SELECT run_id * 1000 + frame, 'lick', CASE WHEN sum(value) > 100 THEN 1 ELSE 0 END FROM behavior GROUP BY ALL),
e AS (SELECT *, lag(level) OVER (PARTITION BY line ORDER BY s) AS p FROM l)
SELECT line, s * 1000000 AS us, s::DOUBLE AS time_s FROM e WHERE level = 1 AND p = 0""")
def _(spark, d):
    b = I.behavior(spark, d).groupBy("run_id", "frame").agg(F.sum("value").alias("v"))
    wide = b.select((F.col("run_id") * 1000 + F.col("frame")).cast("double").alias("time_s"),
                    F.when(F.col("frame") % 3 == 1, 5.0).otherwise(0.0).alias("AI0 Camera clock"), F.when(F.col("v") > 100, 1.0).otherwise(0.1).alias("AI1 lick port"))
    path = folder(spark)
    wide.write.option("header", "true").csv(path)
    return R.trigger_edges(R.read_triggers(spark, path, {"camera": "camera", "lick": "lick"}), []).select("line", "us", "time_s")


@query("write_table_replaces_runs", f"""WITH {I.TRACES}
SELECT run_id, unit, frame, CASE WHEN run_id % 2 = 0 THEN -dff ELSE dff END AS dff FROM traces""")
def _(spark, d):
    """Overwriting with some recordings leaves the others as they are."""
    t = I.traces(spark, d).select("run_id", "unit", "frame", "dff")
    path = folder(spark)
    R.write_table(t, path)
    R.write_table(t.filter("run_id % 2 = 0").withColumn("dff", -F.col("dff")), path)
    return spark.read.schema("unit long, frame long, dff double, run_id long").parquet(path).select("run_id", "unit", "frame", "dff")


@query("read_merge_log", """SELECT 'm' || s_nationkey AS new_name, min(s_name) AS rep, string_agg(s_name, ';' ORDER BY s_name) AS merged, count(*) AS group_size, sum(s_suppkey % 97)::BIGINT AS volume
FROM supplier GROUP BY s_nationkey""")
def _(spark, d):
    s = I.table(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.min("s_name").alias("rep"), F.array_join(F.array_sort(F.collect_list("s_name")), ";").alias("merged"),
        F.count(F.lit(1)).cast("int").alias("group_size"), F.sum(F.col("s_suppkey") % 97).cast("int").alias("volume"))
    rows = s.select(F.concat(F.lit("m"), "s_nationkey").alias("new_name"), "rep", "merged", "group_size", "volume", F.lit("2024-01-01").alias("timestamp"))
    path = folder(spark)
    R.validate(rows, "merge_log").write.option("header", "true").csv(path)
    return R.read_table(spark, path, "merge_log", "csv").select("new_name", "rep", "merged", i8("group_size").alias("group_size"), i8("volume").alias("volume"))


@query("read_mask_manifest", """SELECT p_partkey AS dend_id, p_name AS labelmap_path, p_size::BIGINT AS event_t_start, (p_size + 7)::BIGINT AS event_t_end, round(p_retailprice, 2) AS volume_um3 FROM part""")
def _(spark, d):
    p = I.table(spark, d, "part")
    rows = p.select(
        F.col("p_partkey").cast("int").alias("dend_id"), F.col("p_name").alias("labelmap_path"), F.lit("bg").alias("background_path"), F.lit("ev").alias("source_event_file"),
        F.col("p_size").cast("int").alias("event_t_start"), (F.col("p_size") + 7).cast("int").alias("event_t_end"), *[F.lit(v).alias(f"voxel_size_{a}") for a, v in (("z", 3.9), ("y", 1.0), ("x", 1.2))],
        F.round(F.col("p_retailprice").cast("double"), 2).alias("volume_um3"))
    path = folder(spark)
    R.validate(rows, "mask_manifest").write.option("header", "true").csv(path)
    m = R.read_table(spark, path, "mask_manifest", "csv")
    return m.select(i8("dend_id").alias("dend_id"), "labelmap_path", i8("event_t_start").alias("event_t_start"), i8("event_t_end").alias("event_t_end"), "volume_um3")
