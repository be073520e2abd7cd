"""Events whose onsets don't depend on position."""

import random

from undulate.operators import events as E


def test_a_slope_of_zero_is_not_positive(spark):
    """Each onset occurs at two mirrored positions, so that all slopes are 0; sums of doubles make some of them 1e-16."""
    rng, rows = random.Random(3), []
    for ev in range(200):
        for _ in range(4):
            t, y = rng.randrange(5) + 0.01 * rng.randrange(1, 50), float(rng.randrange(97))
            rows += [(1, ev, t, y), (1, ev, t, 96.0 - y)]
    p = spark.createDataFrame(rows, "run_id long, ev long, t double, y double")
    s = E.slope_per_event(p, ["run_id", "ev"], "t", "y", 4)
    assert s.filter("slope > 0").count() > 0
    assert [(r.n_events, r.n_pos) for r in E.slope_summary(s, ["run_id"]).collect()] == [(200, 0)]
