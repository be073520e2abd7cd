"""Surrogates and matching on the library's own schemas, whose ids are strings."""

from collections import Counter

from undulate.operators import cohort as C
from undulate.operators import graph as G
from undulate.operators import matching as M
from undulate.operators import nulls as U
from undulate.operators import voxels as V
from undulate.operators.topk import hash_sample

UNITS = [(f"2024-01-0{r}/M{r}/run{r}", f"dend_{u:03d}") for r in (1, 2) for u in range(30)]


def test_surrogates(spark):
    df = spark.createDataFrame([(r, u, i % 2, float(i)) for i, (r, u) in enumerate(UNITS)], "run_id string, unit string, label long, v double")
    part = hash_sample(df, ["run_id", "unit"], 0.5).count()
    assert 15 <= part <= 45
    got = U.label_permutation(df, ["run_id"], "unit", "label", 5).collect()
    by = {}
    for r in got:
        by.setdefault((r.run_id, r.rep), []).append((r.unit, r.label))
    assert len(by) == 10 and all(len({u for u, _ in x}) == 30 and Counter(v for _, v in x) == {0: 15, 1: 15} for x in by.values())
    assert len({tuple(sorted(x)) for x in by.values()}) == 10
    ev = df.select("run_id", "unit", (df.v % 50).cast("long").alias("frame")).union(df.select("run_id", "unit", (df.v + 3).cast("long"))).filter("frame < 60")
    moved = U.jitter_null(ev, "frame", 3, 60, ["run_id", "unit", "frame"], 4)
    assert moved.count() == 4 * ev.count() and moved.filter("frame < 0 OR frame > 59").count() == 0
    assert U.iei_shuffle_null(ev, ["run_id", "unit"], "frame", 3).count() == 3 * ev.count()
    n = df.selectExpr("run_id", "unit", "3 AS n")
    drawn = U.random_events(n, ["run_id", "unit"], "n", 60, 4, 2)
    assert drawn.count() == len(UNITS) * 6
    ci = C.bootstrap_ci(df, ["run_id"], ["run_id", "unit"], "v", 50).collect()
    assert len(ci) == 2 and all(r.ci_lo < r.mean < r.ci_hi for r in ci)


def test_matching(spark):
    s = spark.createDataFrame([("r/1", "a", "x", 0.9), ("r/1", "a", "y", 0.8), ("r/1", "b", "x", 0.9), ("r/1", "b", "y", 0.1), ("r/2", "a", "z", 0.3)], "run_id string, a string, b string, iou double")
    got = {(r.run_id, r.a, r.b) for r in G.mutual_best_matching(s, ["run_id"], "a", "b", "iou").collect()}
    assert got == {("r/1", "a", "x"), ("r/1", "b", "y"), ("r/2", "a", "z")}
    best = {(r.run_id, r.a): r.b for r in M.best_match(s, ["run_id"], 0.05).collect()}
    assert best == {("r/1", "a"): "x", ("r/1", "b"): "x", ("r/2", "a"): "z"}
    masks = spark.createDataFrame([("r", u, 0, y, x) for u, x in (("p", 0), ("q", 1), ("s", 9)) for y in range(3)], "run_id string, unit string, z long, y long, x long")
    fam = {r.unit: (r.root, r.order) for r in V.unit_families(masks, ["run_id"], "unit", 1.5).collect()}
    assert fam == {"p": ("p", 0), "q": ("p", 1), "s": ("s", 0)}
