"""Queries do the work of the parameters that the survey names."""

import datetime as dt

from undulate.plans import QUERIES, load_all

load_all()
SRC = "/root/testdata/sf0.001"


def test_radii_of_the_sweep(spark):
    got = {r.radius: r.largest for r in QUERIES["adjacency_threshold_sweep"](spark, SRC).collect()}
    assert {2.0, 3.0, 4.0, 6.0, 8.0} <= set(got)
    assert [got[r] for r in sorted(got)] == sorted(got.values())


def test_radius_of_adjacency(spark, tmp_path):
    """Units are adjacent up to 4 µm apart: along y and x by 1.0 and 1.2 a voxel, along z by 3.9."""
    rows = [(10, 1, 0, 5.0), (11, 1, 3, 5.0), (12, 2, 0, 5.0), (13, 1, 0, 9.0)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_partkey long, l_quantity double")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.a, r.b): round(r.dist, 6) for r in QUERIES["unit_adjacency"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1): 3.0, (0, 2): 3.9}


def test_subsets_of_independence_controls(spark):
    """Event frames are a subset of their own, half of the units count as high SNR, and each subset has its effective dimension."""
    rows = QUERIES["independence_controls"](spark, SRC).collect()
    assert {r.subset for r in rows} == {"all", "high_snr", "event_frames", "first_half", "second_half"}
    assert {r.n_pairs for r in rows if r.subset == "high_snr"} == {28}
    assert all(1 / 15 <= r.eff_dim <= 1 for r in rows if r.subset == "all")


def test_transients_among_temporal_features(spark, tmp_path):
    """One unit with peaks at frames 10, 12 (too near to 10) and 40; the other is level but for one low bump."""
    day = dt.datetime(2024, 1, 1, 1)
    values = {0: {10: 90.0, 12: 80.0, 40: 70.0}, 1: {f: 5.0 + (f == 30) for f in range(60)}}
    e = [(60 * u + f, day + dt.timedelta(hours=12 * f), u, "click", v, "{}") for u, x in values.items() for f, v in x.items()]
    df = spark.createDataFrame(e, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.unit: (r.n_transients, r.p5, r.snr) for r in QUERIES["temporal_features"](spark, str(tmp_path)).collect()}
    assert got == {0: (2, 0.0, round(3.5 / 1e-6, 5)), 1: (1, 5.0, round(5.0 / 1e-6, 5))}
