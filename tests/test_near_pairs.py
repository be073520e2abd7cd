"""Near pairs against brute force; the rows of all neighbouring cells don't pass through the driver."""

import random

from undulate.operators.pairs import grid_near_pairs


def test_near_pairs_are_shuffled_by_cell(spark):
    rnd = random.Random(5)
    rows = [(k % 2, k, rnd.randrange(-9, 9), rnd.uniform(-9, 9)) for k in range(150)] + [(0, k, 3, 3.0) for k in range(200, 220)]
    df = grid_near_pairs(spark.createDataFrame(rows, "run_id long, unit long, x long, y double"), ["run_id"], "unit", ["x", "y"], 3.0)
    want = {(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 < 9}
    got = [(r.run_id, r.a, r.b) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
