"""Spectra of shifted surrogates: recordings worked out in a task and those that go by Gram matrices."""

import random

import numpy as np

from undulate.operators import ml as L

T, LEAST, SHIFTS = 20, 3, 6


def test_spectra_in_a_task(spark, monkeypatch):
    rnd = random.Random(2)
    x = {(r, u): [rnd.gauss(0, 1) + (3 * np.sin(f) if r == 1 else 0) for f in range(T)] for r, n in enumerate((4, 9, 9, 30, 1)) for u in range(n)}
    x[2, 3] = [5.0] * T
    df = spark.createDataFrame([(r, u, f, float(v)) for (r, u), t in x.items() for f, v in enumerate(t)], "run_id long, unit long, frame long, v double")
    want = {}
    for r in range(5):
        z = np.array([t for (q, _), t in x.items() if q == r])
        z = z - z.mean(1, keepdims=True)
        sd = z.std(1, keepdims=True)
        z = z / np.where(sd < 1e-9, 1, sd)
        w = np.sort(np.linalg.eigvalsh(z.T @ z / T))[::-1]
        null = max(np.linalg.eigvalsh(q.T @ q / T)[-1] for i in range(SHIFTS)
                   for q in [np.array([np.roll(t, LEAST + (7 * i + 13 * u) % (T - 2 * LEAST)) for u, t in enumerate(z)])])
        want[r] = int((w[:3] > null + 1e-9).sum()), w[0] / w.sum(), null

    def got():
        out = L.pcs_above_null(df, ["run_id"], "unit", "frame", "v", T, 3, SHIFTS, LEAST)
        return {r.run_id: (r.n_pcs, r.pc1_frac, r.null_max) for r in out.collect()}, out._jdf.queryExecution().optimizedPlan().toString()

    for block in (512, 5):
        monkeypatch.setattr(L, "BLOCK", block)
        rows, plan = got()
        assert set(rows) == set(want) and all(np.allclose(rows[r], want[r], atol=1e-8) for r in want)
        assert ("Generate" in plan) == (block == 5)  # no surrogate is a row where a task holds the recording
