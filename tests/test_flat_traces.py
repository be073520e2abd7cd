"""Traces without spread, sums that tie, grids with gaps: cases of larger tables on small ones."""

import datetime as dt
import math
import os

import pytest
from check import compare, connect
from pyspark.sql import Window
from pyspark.sql import functions as F

from undulate.operators import events as E
from undulate.operators import pairs as P
from undulate.operators import voxels as V
from undulate.plans import ORACLES, QUERIES, load_all

load_all()
SRC = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    """The small tables with some users who have one or twelve events only: their median deviation is 0."""
    d = str(tmp_path_factory.mktemp("flat"))
    for f in os.listdir(SRC):
        if f != "events.parquet":
            os.symlink(f"{SRC}/{f}", f"{d}/{f}")
    e = spark.read.parquet(f"{SRC}/events.parquet")
    u = F.col("user_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    most = F.when(u % 4 == 1, 1).when(u % 4 == 3, 12).otherwise(1 << 30)
    e.withColumn("n", n).filter(F.col("n") <= most).drop("n").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["dilate_flags", "binary_mi", "independence_controls", "temporal_features", "trace_qa_features", "coactivation_index"])
def test_flat_traces(spark, flat, name):
    con = connect_to(flat)
    status, _, _, _, msg = compare(spark, con, flat, name, QUERIES[name], ORACLES[name])
    assert status == "ok", msg


def connect_to(d):
    con = connect(SRC)
    for t in ("events", "embeddings"):
        if os.path.isdir(f"{d}/{t}.parquet"):
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("n", [6, 37, 56])
def test_smoothing_of_a_grid_with_gaps(spark, tmp_path, n):
    """The last recording has only part of its voxels: the smoothed grid has the same ones."""
    d = str(tmp_path)
    e = spark.read.parquet(f"{SRC}/embeddings.parquet").orderBy("vec_id").limit(n).coalesce(1)
    e.write.parquet(f"{d}/embeddings.parquet")
    status, _, _, _, msg = compare(spark, connect_to(d), d, "gaussian_smooth_3d", QUERIES["gaussian_smooth_3d"], ORACLES["gaussian_smooth_3d"])
    assert status == "ok", msg


def test_unknown_flags_count_as_off(spark):
    f = spark.createDataFrame([(1, u, t, None if u == 0 else int(t < 2)) for u in range(3) for t in range(4)], "run_id long, unit long, frame long, f int")
    got = {(r.a, r.b): (r.n_both, round(r.mi, 9)) for r in P.binary_mi(f, ["run_id"], "unit", "frame", "f").collect()}
    assert got == {(0, 1): (0, 0.0), (0, 2): (0, 0.0), (1, 2): (2, 1.0)}


def test_kinetics_of_a_level_peak(spark):
    """The sample after a peak at or below its base level is as high as the peak."""
    ev = spark.createDataFrame([(1, 3, 3), (2, 3, 3)], "run_id long, f_start long, f_peak long")
    fr = spark.createDataFrame([(1, t, 5.0) for t in range(8)] + [(2, t, 9.0 if t < 3 else 5.0) for t in range(8)], "run_id long, frame long, v double")
    got = {r.run_id: r for r in E.event_kinetics(ev, fr, ["run_id"], "frame", "v", 3).collect()}
    assert got[1].amp == 0 and math.isnan(got[1].decay_half) and math.isnan(got[1].decay_efold)
    assert got[2].amp == -4 and got[2].decay_half == -math.inf


def made_events(spark, d, sums):
    """A user with each list of values, a value an event, all in frames of their own."""
    day = dt.datetime(2024, 1, 1, 1)
    rows, n = [], 0
    for user, values in sums.items():
        for i, v in enumerate(values):
            rows.append((n, day + dt.timedelta(hours=12 * i), user, "click", float(v), "{}"))
            n += 1
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{d}/events.parquet")


def test_equal_sums_tie(spark, tmp_path):
    """0.1 + 0.2 + 0.3 and 0.6 are the same activity: the hub with the least number wins, and ranks are shared."""
    made_events(spark, str(tmp_path), {0: [0.6], 1: [0.1, 0.2, 0.3], 2: [0.3], 15: [1.0], 16: [1.0], 17: [0.5]})
    got = QUERIES["hub_units_top_share"](spark, str(tmp_path)).filter("run_id = 0").collect()
    assert [(r.unit, r.s) for r in got] == [(0, 0.6)]
    rho = QUERIES["identity_across_runs"](spark, str(tmp_path)).collect()
    assert [(r.run_1, r.run_2, r.n, r.rho) for r in rho] == [(0, 1, 3, 1.0)]


def test_peak_times_of_near_equal_values(spark, tmp_path):
    """A later value must be higher by 1e-7 a frame to be the peak, as the statement has it."""
    rows = []
    for k in range(5):
        e = [0.0] * 64
        e[3], e[9] = 0.5, 0.5 + 2.0 ** -24 if k != 4 else 0.75
        rows.append((5 * k, e, 0))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    status, _, _, _, msg = compare(spark, connect_to(str(tmp_path)), str(tmp_path), "axis_propagation", QUERIES["axis_propagation"], ORACLES["axis_propagation"])
    assert status == "ok", msg


def test_smoothing_keeps_values_of_a_dense_grid(spark):
    v = spark.createDataFrame([(1, 0, y, x, 1.0) for y in range(3) for x in range(4)], "run_id long, z long, y long, x long, v double")
    got = V.gaussian_smooth_3d(v, ["run_id"], "v", (0.0, 0.5, 0.5), (1, 3, 4)).collect()
    assert len(got) == 12 and all(abs(r.v - 1) < 1e-12 for r in got)
