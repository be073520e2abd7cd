"""Small runs are compared whole in a task; runs beyond the bound give the same by prefixes and rounds."""

import random

import pytest

from undulate.operators import matching as M


def brute(rows, dice):
    sets = {}
    for r, u, *v in rows:
        sets.setdefault(r, {}).setdefault(u, set()).add(tuple(v))
    pairs, kept = {}, {}
    for r, own in sets.items():
        for b in sorted(own):
            hit = [a for a in sorted(own) if a < b and 2 * len(own[a] & own[b]) / (len(own[a]) + len(own[b])) > dice]
            pairs |= {(r, a, b): len(own[a] & own[b]) for a in hit}
            kept[r, b] = not any(kept[r, a] for a in hit)
    return pairs, kept


@pytest.mark.parametrize("units, rows, columns", [(512, 1 << 18, 4096), (8, 1 << 18, 5), (512, 60, 4096)])
def test_whole_or_by_prefix(spark, monkeypatch, units, rows, columns):
    rnd = random.Random(7)
    data = [(f"r{r}", f"u{u}", rnd.randrange(2), rnd.randrange(-1, 2), rnd.randrange(2)) for r in range(6) for u in range(4 + 3 * r) for _ in range(7)]
    data += [("r1", "v0", 0, 0, 0), ("r1", "v1", 0, 0, 0), ("r1", "v1", 0, 0, 0), ("r9", "u", 1, 1, 1)]
    for name, v in (("UNITS", units), ("ROWS", rows), ("COLUMNS", columns)):
        monkeypatch.setattr(M, name, v)
    df = spark.createDataFrame(data, "run_id string, unit string, z long, y long, x long").repartition(5)
    pairs, kept = brute(data, 0.7)
    got = M.similar_pairs(df, ["run_id"], "unit", 0.7)
    assert {(r.run_id, r.a, r.b): r.n_ab for r in got.collect()} == pairs and len(pairs) > 20
    assert {(r.run_id, r.unit): r.kept for r in M.dedup_dice(df, ["run_id"], "unit", 0.7).collect()} == kept
    if units == 512 and rows > 60:
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
