"""Optimal matching against every possible matching, with its duals as proof, in one task and in rounds of blocks."""

import itertools
import random

import pytest

from undulate.operators import assignment as A
from undulate.operators.graph import mutual_best_matching


def best_total(pairs):
    a = sorted({p[0] for p in pairs})
    b = sorted({p[1] for p in pairs})
    score = {p[:2]: p[2] for p in pairs}
    best = 0.0
    for order in itertools.permutations(b + [None] * len(a), len(a)):
        best = max(best, sum(score.get((x, y), 0.0) for x, y in zip(a, order)))
    return best


def table(spark, pairs):
    return spark.createDataFrame([(k, a, b, s) for k, own in pairs.items() for a, b, s in own], "k string, a string, b string, iou double")


def checked(got, pairs, gap=1e-6):
    """Each side at most once, duals that cover every pair and add up to the total; total by key."""
    total = {}
    for k, own in pairs.items():
        rows = [r for r in got if r.k == k]
        score = {}
        for a, b, s in own:
            score[a, b] = max(s, score.get((a, b), 0.0))
        hit = [(r.a, r.b) for r in rows if r.a is not None and r.b is not None]
        assert len({a for a, _ in hit}) == len({b for _, b in hit}) == len(hit)
        u = {r.a: r.dual_a for r in rows if r.a is not None}
        v = {r.b: r.dual_b for r in rows if r.b is not None}
        assert set(u) == {a for a, _, s in own if s > 0} and set(v) == {b for _, b, s in own if s > 0}
        assert min([*u.values(), *v.values()]) >= -1e-12
        assert all(u[a] + v[b] >= s - 1e-8 for (a, b), s in score.items() if s > 0)
        total[k] = sum(score[p] for p in hit)
        assert abs(sum(u.values()) + sum(v.values()) - total[k]) < gap
    return total


def test_equals_every_matching_tried(spark):
    rnd = random.Random(7)
    pairs = {}
    for k in range(5):
        n, m = rnd.choice([(3, 4), (4, 3), (4, 4), (1, 3)])
        pairs[f"run/{k}"] = [(f"a{i}", f"b{j}", round(rnd.random(), 3)) for i in range(n) for j in range(m) if rnd.random() < 0.8] or [("a0", "b0", 0.5)]
    pairs["run/greedy"] = [("a0", "b0", 0.9), ("a0", "b1", 0.8), ("a1", "b0", 0.85)]
    pairs["run/odd"] = [("a0", "b0", 0.5), ("a0", "b0", 0.7), ("a1", "b1", 0.0), ("a1", "b0", -1.0)]
    df = table(spark, pairs)
    total = checked(A.optimal_matching(df, ["k"], "a", "b", "iou").collect(), pairs)
    for k, own in pairs.items():
        assert abs(total[k] - best_total([(a, b, max(s, 0)) for a, b, s in sorted(own, key=lambda p: p[2])])) < 1e-6
    greedy = sum(r.iou for r in mutual_best_matching(df.filter("k = 'run/greedy'"), ["k"], "a", "b", "iou").collect())
    assert total["run/greedy"] > greedy + 0.5
    assert A.optimal_matching(df.limit(0), ["k"], "a", "b", "iou").count() == 0


def test_blocks_meet_in_rounds(spark):
    own = [("a0", "b0", 0.9), ("a0", "b1", 0.8), ("a1", "b0", 0.85), ("a2", "b1", 0.3)]
    total = checked(A.optimal_matching(table(spark, {"k": own}), ["k"], "a", "b", "iou", steps=100, most=3).collect(), {"k": own}, 0.01)
    assert abs(total["k"] - best_total(own)) < 1e-6


def test_a_chain_takes_no_rounds(spark, monkeypatch):
    """a_i meets b_i and b_i+1, each a little less than the one before: greedy frees one pair a round."""
    pairs = {"k": [(f"a{i:03d}", f"b{i + d:03d}", 1.0 - (2 * i + d) / 1000) for i in range(60) for d in (0, 1)]}
    monkeypatch.setattr(A, "_in_rounds", lambda *a: pytest.fail("settled in a task"))
    total = checked(A.optimal_matching(table(spark, pairs), ["k"], "a", "b", "iou").collect(), pairs)
    assert abs(total["k"] - sum(1.0 - 2 * i / 1000 for i in range(60))) < 1e-6
