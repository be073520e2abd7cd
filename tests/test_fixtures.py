"""Edge semantics with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from undulate.operators import aggregate as A
from undulate.operators import cohort as C
from undulate.operators import events as E
from undulate.operators import graph as G
from undulate.operators import matching as M
from undulate.operators import rolling as R
from undulate.operators import signal as S
from undulate.operators import voxels as V
from undulate.sources import tables as T

K = ["k"]


def series(spark, *rows):
    data = [(k, t, float(v)) for k, vs in enumerate(rows) for t, v in enumerate(vs)]
    return spark.createDataFrame(data, "k long, t long, v double")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_hysteresis(spark):
    # start at > 2, end at the first < 1 with that frame included; too short; open at the end
    d = series(spark, [0, 3, 2, 2, 0.5, 0], [0, 3, 1.5, 0, 0, 0], [0, 0, 0, 3, 2, 2], [2, 2, 2, 0, 0, 0])
    e = R.hysteresis_events(d, K, "t", "v", 2.0, 1.0, 3)
    assert rows(e, "k", "f_start", "f_end", "closed") == [(0, 1, 4, True), (2, 3, 5, False)]


@pytest.mark.parametrize("gap,expected", [(1, 4), (2, 3), (3, 2)])
def test_islands_gap(spark, gap, expected):
    d = spark.createDataFrame([(0, t) for t in (0, 1, 3, 6, 10)], "k long, t long")
    assert R.island_table(d, K, "t", gap).count() == expected


@pytest.mark.parametrize("chunk", [2, 3, 8192])
def test_chunking_changes_nothing(spark, chunk):
    d = series(spark, [5, 1, 4, 2, 3, 9, 7, 8, 0, 6])
    out = rows(R.rolling_quantile(d, K, "t", "v", 2, 2, 0.5, chunk=chunk), "t", "baseline")
    v = [5, 1, 4, 2, 3, 9, 7, 8, 0, 6]
    import numpy as np

    assert out == [(i, float(np.median(v[max(0, i - 2):i + 3]))) for i in range(10)]
    isl = R.islands(d.filter("v > 2"), K, "t", 1, "s", chunk=chunk)
    assert rows(isl, "t", "s") == [(0, 0), (2, 2), (4, 4), (5, 4), (6, 4), (7, 4), (9, 9)]
    from undulate.operators.segments import running_sum

    assert [r[1] for r in rows(running_sum(d, K, "t", "v", "c", chunk), "t", "c")] == list(np.cumsum(v))


def test_padding_maps(spark):
    d = series(spark, [1, 2, 3, 4, 5])
    refl = rows(R.rolling_quantile(d, K, "t", "v", 2, 0, 0.0, pad="reflect", n_frames=5), "t", "baseline")
    assert [v for _, v in refl] == [1, 1, 1, 2, 3]  # frames -2,-1 are 3,2
    sym = rows(R.rolling_quantile(d, K, "t", "v", 2, 0, 1.0, pad="symmetric", n_frames=5), "t", "baseline")
    assert [v for _, v in sym] == [2, 2, 3, 4, 5]  # frames -2,-1 are 2,1
    near = rows(R.rolling_quantile(d, K, "t", "v", 0, 2, 0.5, pad="nearest", n_frames=5), "t", "baseline")
    assert [v for _, v in near] == [2, 3, 4, 5, 5]


def test_gaussian_is_unbiased(spark):
    d = series(spark, [3] * 9, [0, 0, 0, 0, 1, 0, 0, 0, 0])
    g = rows(R.gaussian_smooth_1d(d, K, "t", "v", 1.0, 9), "k", "t", "smooth")
    assert all(abs(v - 3) < 1e-12 for k, _, v in g if k == 0)
    w = R.gaussian_weights(1.0)
    assert [round(v, 9) for k, t, v in g if k == 1 and t in (4, 5, 6)] == [round(x, 9) for x in w[4:7]]


def test_peaks(spark):
    d = series(spark, [0, 2, 2, 0, 1, 0, 3], [1, 1, 1, 1, 1, 1, 1])
    p = R.find_peaks(d, K, "t", "v")
    assert rows(p, "k", "peak", "height", "prominence") == [(0, 1, 2.0, 2.0), (0, 4, 1.0, 1.0)]
    assert rows(R.find_peaks(d, K, "t", "v", distance=4), "peak") == [(1,)]
    assert rows(R.find_peaks(d, K, "t", "v", prominence=1.5), "peak") == [(1,)]


def test_refractory_kept_against_seen(spark):
    d = spark.createDataFrame([(0, t) for t in (0, 3, 6, 9, 20)], "k long, t long")
    assert rows(R.refractory(d, K, "t", 5), "t") == [(0,), (6,), (20,)]
    assert rows(R.refractory_seen(d, K, "t", 5), "t") == [(0,), (20,)]


def test_local_mad(spark):
    d = series(spark, [1, 2, 10, 4, 5], [7, 7, 7, 7, 7])
    m = {(k, t): (a, b) for k, t, a, b in rows(R.rolling_mad(d, K, "t", "v", 1), "k", "t", "med", "mad")}
    assert m[(0, 0)] == (1.5, 0.5) and m[(0, 2)] == (4.0, 2.0) and m[(1, 3)] == (7.0, 0.0)


def test_interpolation(spark):
    d = series(spark, [9, 2, 9, 9, 8, 9], [1, 9, 9, 9, 9, 2])
    d = d.withColumn("bad", F.col("v") == 9)
    f = rows(R.interp_bad_runs(d, K, "t", "v", "bad"), "k", "t", "fixed")
    assert [v for k, _, v in f if k == 1] == [1, 9, 9, 9, 9, 2]  # two good frames: unchanged
    f2 = rows(R.interp_bad_runs(d, K, "t", "v", "bad", min_good=2), "k", "t", "fixed")
    assert [v for k, _, v in f2 if k == 0] == [2, 2, 4, 6, 8, 8]


def test_bh_with_ties_and_null(spark):
    d = spark.createDataFrame([(0, "a", 0.01), (0, "b", 0.04), (0, "c", 0.04), (0, "d", 0.9), (0, "e", None)], "k long, i string, p double")
    for bounded in (True, False):
        q = dict(rows(R.bh_qvalue(d, K, "p", bounded=bounded), "i", "q"))
        assert q["a"] == pytest.approx(0.04) and q["b"] == q["c"] == pytest.approx(0.04 * 4 / 3) and q["d"] == 0.9 and q["e"] is None


def test_wilcoxon_exact_and_zero(spark):
    d = spark.createDataFrame([(0, float(x)) for x in (1, 2, 3, 4)] + [(1, float(x)) for x in (0, -1, 2, 3)] + [(2, 0.0)], "k long, d double")
    w = {r["k"]: r for r in C.wilcoxon_signed_rank(d, K, "d").collect()}
    assert w[0]["p"] == pytest.approx(0.125) and w[0]["w_plus"] == 10
    assert w[1]["n"] == 3 and w[1]["p"] == pytest.approx(0.5)
    assert w[2]["n"] == 0 and w[2]["p"] is None
    g = {r["k"]: r["p"] for r in C.wilcoxon_signed_rank(d, K, "d", alternative="greater").collect()}
    assert g[0] == pytest.approx(1 / 16)


def test_mann_whitney_exact_and_ties(spark):
    d = spark.createDataFrame([(0, "a", 1.0), (0, "a", 2.0), (0, "b", 3.0), (0, "b", 4.0), (1, "a", 1.0), (1, "a", 1.0), (1, "b", 1.0), (1, "b", 2.0)], "k long, g string, v double")
    m = {r["k"]: r for r in C.mann_whitney(d, K, "g", "a", "b", "v").collect()}
    assert m[0]["u"] == 0 and m[0]["p"] == pytest.approx(2 / 6) and m[0]["cliffs_delta"] == -1
    assert m[1]["u"] == 1.0 and m[1]["cliffs_delta"] == -0.5


def test_sign_test_and_chi2(spark):
    d = spark.createDataFrame([(0, 9, 10, 10, 20, 30, 40)], "k long, p long, n long, a long, b long, c long, d long")
    assert d.select(C.sign_test(F.col("p"), F.col("n"))).first()[0] == pytest.approx(22 / 1024)
    x = C.chi2_2x2(d, K, "a", "b", "c", "d").first()
    assert x["chi2"] == pytest.approx(100 * (10 * 40 - 20 * 30) ** 2 / (30 * 70 * 40 * 60))


def test_kinetics_censored_and_interpolated(spark):
    d = series(spark, [0, 0, 0, 10, 6, 4, 0, 0], [0, 0, 0, 10, 9, 9, 9, 9])
    ev = spark.createDataFrame([(0, 3, 3), (1, 3, 3)], "k long, f_start long, f_peak long")
    k = {r["k"]: r for r in E.event_kinetics(ev, d, K, "t", "v", 4).collect()}
    assert k[0]["decay_half"] == pytest.approx(1.5) and k[1]["decay_half"] is None
    assert k[0]["decay_efold"] == pytest.approx(2 + (4 - 10 / math.e) / 4)


def test_skip_rounding(spark):
    d = spark.createDataFrame([(4.71, 7.0)], "rate double, skip double")
    r = d.select(S.skip_frames(F.col("skip"), F.col("rate")), S.skip_frames(F.col("skip"), F.col("rate"), "int")).first()
    assert tuple(r) == (33, 32)


def test_circular_shift_identity(spark):
    d = series(spark, [1, 2, 3])
    for s in (0, 3):
        assert rows(S.circular_shift(d, K, "t", 3, F.lit(s)), "t", "v") == rows(d, "t", "v")
    assert rows(S.circular_shift(d, K, "t", 3, F.lit(2)), "t", "v") == [(0, 2.0), (1, 3.0), (2, 1.0)]


def vox(spark, pts, unit="u"):
    return spark.createDataFrame([(0, unit, z, y, x) for z, y, x in pts], "run_id long, unit string, z long, y long, x long")


CUBE = [(z, y, x) for z in range(2, 5) for y in range(2, 5) for x in range(2, 5)]


def test_core_shell(spark):
    cube = V.core_shell_regions(vox(spark, CUBE), ["run_id"], "unit", (9, 9, 9))
    core = rows(cube.filter("region = 'core'"), "z", "y", "x")
    assert core == [(3, 3, 3)]
    line = vox(spark, [(3, y, 3) for y in range(2, 7)])
    r = V.core_shell_regions(line, ["run_id"], "unit", (9, 9, 9))
    assert r.filter("region = 'core'").count() == 5  # nothing survives erosion: the mask itself
    two = line.unionByName(vox(spark, [(3, y, 6) for y in range(2, 7)], "w"))
    s = V.core_shell_regions(two, ["run_id"], "unit", (9, 9, 9)).filter("region = 'shell'")
    assert s.join(two.select("z", "y", "x"), ["z", "y", "x"]).count() == 0


def test_components_connectivity(spark):
    m = vox(spark, [(0, 0, 0), (0, 0, 1), (1, 1, 2), (5, 5, 5)])
    assert V.connected_voxels(m, ["run_id", "unit"], 26).select("component").distinct().count() == 2
    assert V.connected_voxels(m, ["run_id", "unit"], 6).select("component").distinct().count() == 3


def test_fill_holes(spark):
    shell = [p for p in CUBE if p != (3, 3, 3)]
    f = V.fill_holes(vox(spark, shell), ["run_id", "unit"])
    assert f.count() == 27
    open_ = [p for p in shell if p != (2, 3, 3)]
    assert V.fill_holes(vox(spark, open_), ["run_id", "unit"]).count() == 25


def test_overlaps(spark):
    a = vox(spark, CUBE, "a").unionByName(vox(spark, [(9, 9, 9)], "z"))
    b = vox(spark, CUBE[:9], "p").unionByName(vox(spark, CUBE, "q"))
    o = {(r["a"], r["b"]): r for r in M.overlap_matrix(a, b, ["run_id"], "unit").collect()}
    assert o[("a", "q")]["iou"] == 1 and o[("a", "q")]["dice"] == 1
    assert o[("a", "p")]["overlap_coef"] == 1 and o[("a", "p")]["iou"] == pytest.approx(1 / 3)
    assert not [k for k in o if k[0] == "z"]


def test_dedup_chain(spark):
    # b duplicates a, c duplicates b only: a and c stay (b is not kept, so c is free)
    base = [(0, 0, x) for x in range(10)]
    m = vox(spark, base, "a").unionByName(vox(spark, [(0, 0, x + 2) for x in range(10)], "b")).unionByName(
        vox(spark, [(0, 0, x + 4) for x in range(10)], "c")).unionByName(vox(spark, base, "d"))
    assert dict(rows(M.dedup_dice(m, ["run_id"], "unit", 0.7), "unit", "kept")) == {"a": True, "b": False, "c": True, "d": False}


def test_fov_union_threshold(spark):
    first = [(0, 0, 0, 0, 0, x) for x in range(10)]
    second = [(0, 1, 1, 0, 0, x) for x in range(8, 18)] + [(0, 1, 2, 0, 0, x) for x in (9, 20, 21, 22, 23, 24)]
    m = spark.createDataFrame(first + second, "fov long, pos long, unit long, z long, y long, x long")
    u = M.fov_union(m, ["fov"], "pos", "unit", [0, 1], 0.2)
    assert rows(u.groupBy("unit").count(), "unit", "count") == [(0, 10), (2, 5)]  # exactly 20 % is rejected


def test_mutual_best(spark):
    d = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 1, 0.85), (0, 2, 2, 0.1)], "k long, a long, b long, s double")
    assert rows(G.mutual_best_matching(d, K, "a", "b", "s"), "a", "b") == [(1, 1), (2, 2)]


def test_event_classes(spark):
    d = spark.createDataFrame([(2,), (3,), (4,)], "n long")
    c = [r[0] for r in d.orderBy("n").select(E.classify_event(F.col("n"), F.lit(20.0), 0.2)).collect()]
    assert c == ["local", "multi", "global"]


def test_gini(spark):
    d = spark.createDataFrame([(0, 1.0)] * 4 + [(1, 0.0)] * 3 + [(1, 8.0)], "k long, v double")
    g = {r["k"]: r for r in A.gini_and_shares(d, K, "v", (0.25,)).collect()}
    assert g[0]["gini"] == pytest.approx(0) and g[1]["gini"] == pytest.approx(0.75) and g[1]["top25pct"] == 1


def test_trigger_edges_and_block(spark):
    us = [0, 1, 2, 3, 9_000_003, 9_000_004]
    d = spark.createDataFrame([(0, "cam", t / 1e6, t % 2) for t in us], "run_id long, line string, time_s double, level int")
    e = T.trigger_edges(d, ["run_id"], chunk_us=2)
    assert rows(e, "us") == [(1,), (3,)]
    b = R.longest_block(spark.createDataFrame([(0, t) for t in (0, 5, 30, 31, 32, 60)], "k long, t long"), K, "t", 9)
    assert rows(b, "start", "stop", "n") == [(0, 5, 2)]


def test_traces_csv_roundtrip(spark, tmp_path):
    p = str(tmp_path / "dff.csv")
    with open(p, "w") as f:
        f.write("Frame,time_s,dend_000,dend_001\n0,0.0,1.5,NaN\n1,0.2,2.5,3.5\n")
    t = T.read_traces_wide(spark, p)
    assert rows(t.filter("dff IS NOT NULL"), "unit", "dff") == [("dend_000", 1.5), ("dend_000", 2.5), ("dend_001", 3.5)]
    assert t.count() == 4


def test_behavior_fallback_and_triggers(spark, tmp_path):
    p = str(tmp_path / "b.csv")
    with open(p, "w") as f:
        f.write("time_s,pupil_raw,AndXTrigger\n0.0,1,0\n0.1,2,1\n")
    b = T.read_behavior(spark, p, [("pupil", ["pupil", "pupil_raw"]), ("whisker", ["whisk"])])
    assert rows(b, "signal", "value") == [("pupil", 1.0), ("pupil", 2.0)]
    assert rows(T.read_triggers(spark, p, {"cam": "ndx"}), "time_s", "level") == [(0.0, 0), (0.1, 1)]


def test_partition_overwrite(spark, tmp_path):
    p = str(tmp_path / "t")
    d = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, v int")
    T.write_table(d, p)
    T.write_table(spark.createDataFrame([("b", 3)], "run_id string, v int"), p)
    assert rows(spark.read.parquet(p), "run_id", "v") == [("a", 1), ("b", 3)]


def test_run_listing(spark, tmp_path):
    for root, f in (("r1", "2024-01-01/m1/run1/green.tif"), ("r2", "2024-01-01/m1/run1/other.tif"), ("r2", "2024-01-02/m1/run2/x.tif")):
        q = tmp_path / root / f
        q.parent.mkdir(parents=True)
        q.write_bytes(b"0")
    l = T.list_runs(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")], r"([0-9-]{10})/([^/]+)/(run[0-9]+)/")
    assert rows(l, "date", "root") == [("2024-01-01", 0), ("2024-01-02", 1)]


def test_streams_equal_batch(spark, tmp_path):
    from undulate.streaming import twins

    src = str(tmp_path / "ev")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.expr("CAST(ts AS TIMESTAMP)").alias("ts"), "event_type").write.parquet(src)
    for i, fn in enumerate((lambda d: twins.event_rates(d, ["event_type"], "ts", "1 day", "1 hour"),
                            lambda d: twins.islands(d, ["event_type"], "ts", "3 hours", "1 hour"))):
        batch = rows(fn(spark.read.parquet(src)), "*")
        stream = fn(spark.readStream.schema("ts timestamp, event_type string").parquet(src))
        mode = "complete" if i == 0 else "append"
        q = stream.writeStream.outputMode(mode).format("memory").queryName(f"tw{i}").option(
            "checkpointLocation", str(tmp_path / f"cp{i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = rows(spark.table(f"tw{i}"), "*")
        # append mode keeps the islands the watermark has not closed yet
        assert got == batch if i == 0 else set(got) <= set(batch) and len(got) >= len(batch) - 10


def test_frame_scan_pushes_range(spark, tmp_path):
    p = str(tmp_path / "frames")
    d = spark.createDataFrame([("r", "ca", t, 0, 0, [1.0]) for t in range(6)],
                              "run_id string, channel string, t int, z int, y int, vals array<float>")
    d.write.parquet(p)
    f = T.read_frames(spark, p, 2, 5).select("t")
    assert rows(f, "t") == [(2,), (3,), (4,)]
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,2)" in plan and "vals" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_schema_is_enforced(spark):
    from undulate.schemas import validate

    d = spark.createDataFrame([("r", 1.0)], "run_id string, time_s double")
    with pytest.raises(ValueError):
        validate(d, "global_trace")


def test_metrics_json_missing_section(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run": "a", "detect": {"n": 3}}')
    (tmp_path / "b.json").write_text('{"run": "b"}')
    j = T.read_metrics_json(spark, str(tmp_path), "run string, detect struct<n: int>, stats struct<r: double>")
    assert rows(j.select("run", F.col("detect.n").alias("n"), F.col("stats.r").alias("r")), "run", "n", "r") == [("a", 3, None), ("b", None, None)]
