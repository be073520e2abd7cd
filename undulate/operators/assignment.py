"""Optimal one-to-one matching by an auction with ε-scaling, spread over connected groups and blocks of them.

The matching with the greatest total score, members of either side free to stay alone, is an assignment on the doubled
graph: every member of one side has an object that stands for being alone, and a mirror of each pair joins these. Bidders
without an object bid for the one with the best value, up to where the second best would do; ε, the least step, falls by
phases until it can no longer hide a better matching. Scores are whole multiples of 1/``steps``, so the result is optimal
for the rounded scores; prices and profits give duals that bound every matching's total from above and meet it.

Pairs are first split into connected groups. A group of at most ``most`` pairs is settled inside a task. Larger ones are
dealt to blocks of bidders: a round settles every block against the prices of the round before, then each object takes its
highest bid, until nobody is without an object. Prices only rise within a phase and steps are at least ε, so rounds are
bounded by prices, not by chains of scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undulate.operators.blocks import group_starts, starts, whole_groups, with_columns
from undulate.operators.graph import components_with_singletons
from undulate.session import cut_lineage

#: ε falls by these factors from phase to phase, inside a task and between rounds of blocks, where a phase costs jobs.
FALL, FALL_OF_ROUNDS = 5, 50


def auction(first: np.ndarray, objects: np.ndarray, values: np.ndarray, price: list[int], eps: int, owner: list[int], queue: list[int]) -> None:
    """Bids of the queued bidders until each has an object; ``price`` and ``owner`` (of each object, -1: none) change.

    Bidder i values ``objects[first[i]:first[i+1]]``; one that loses its object is queued again.
    """
    while queue:
        i = queue.pop()
        best = second = None
        at = -1
        for e in range(first[i], first[i + 1]):
            gain = values[e] - price[objects[e]]
            if best is None or gain > best:
                best, second, at = gain, best, objects[e]
            elif second is None or gain > second:
                second = gain
        if second is None:  # nothing else to turn to: the price doesn't matter
            second = best
        price[at] += best - second + eps
        if owner[at] >= 0:
            queue.append(owner[at])
        owner[at] = i


def settled(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(matched pairs, duals of the a side, duals of the b side, scale) of one group of pairs with values >= 0 in whole numbers."""
    na, nb = int(a.max()) + 1, int(b.max()) + 1
    if len(a) == 1:
        return np.ones(1, bool), value.copy(), np.zeros(1, np.int64), 1
    n = na + nb
    # bidders: a, then the mirrors of b; objects: b, then the mirrors of a
    bidder = np.concatenate([a, na + b, np.arange(na), na + np.arange(nb)])
    obj = np.concatenate([b, nb + a, nb + np.arange(na), np.arange(nb)])
    scale = n + 1
    worth = np.concatenate([value * scale, np.zeros(len(a) + n, np.int64)])
    order = np.argsort(bidder, kind="stable")
    first = np.searchsorted(bidder[order], np.arange(n + 1)).tolist()
    objects, values = obj[order].tolist(), worth[order].tolist()
    price, eps = [0] * n, max(1, int(worth.max(initial=0)) // 2)
    while True:
        owner = [-1] * n
        auction(first, objects, values, price, eps, owner, list(range(n)))
        if eps == 1:
            break
        eps = max(1, eps // FALL)
    p = np.array(price, np.int64)
    profit = np.full(n, np.iinfo(np.int64).min)
    np.maximum.at(profit, bidder, worth - p[obj])
    own = np.array(owner, np.int64)
    return own[b] == a, profit[:na] + p[nb:], p[:nb] + profit[na:], scale


def optimal_matching(scores: DataFrame, keys: Sequence[str], a: str, b: str, score: str, steps: int = 10**9, most: int = 200_000) -> DataFrame:
    """``keys, a, b, score, dual_a, dual_b``: every member with its partner or none, and its dual.

    Pairs with a score of 0 or less, or none, are never matched. For every pair dual_a + dual_b >= score (rounded to
    1/``steps``), all duals are >= 0, and their sum is the total of the matching but for less than 1/``steps`` a group: no
    matching has a greater total. Repeated pairs count with their greatest score. Ids may have any type.
    """
    keys = list(keys)
    s = scores.filter(F.col(score) > 0).groupBy(*keys, a, b).agg(F.max(score).alias("_s")).withColumn("_w", F.round(F.col("_s") * steps).cast("long")).filter("_w > 0")
    s = cut_lineage(s.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"), "_s", "_w"))
    node = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    pairs = s.select(*keys, node("a", "_a").alias("u"), node("b", "_b").alias("v"))
    nodes = pairs.select(*keys, F.col("u").alias("node")).unionByName(pairs.select(*keys, F.col("v").alias("node")))
    groups = components_with_singletons(nodes, pairs, keys, "node", "u", "v")
    s = s.withColumn("node", node("a", "_a")).join(groups, [*keys, "node"]).drop("node")
    sizes = s.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n"))
    s = cut_lineage(s.join(sizes, [*keys, "component"]))
    done = _in_tasks(s.filter(F.col("_n") <= most), keys, steps)
    large = s.filter(F.col("_n") > most)
    if not large.isEmpty():
        done = done.unionByName(_in_rounds(large, keys, steps, most))
    return done.select(*keys, F.col("_a").alias(a), F.col("_b").alias(b), F.col("_s").alias(score), "dual_a", "dual_b")


def _schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in (*keys, "_a", "_b")), T.StructField("_s", df.schema["_s"].dataType),
                         T.StructField("dual_a", T.DoubleType()), T.StructField("dual_b", T.DoubleType())])


def _in_tasks(s: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Groups that fit a task, many of them to a table."""
    by = [*keys, "component"]
    rows = s.repartition(*by).sortWithinPartitions(*by, "_a", "_b")

    def work(batches: Iterator) -> Iterator:
        for t in whole_groups(batches, by, 1 << 16):
            cut = np.r_[np.flatnonzero(group_starts(t, by)), t.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:]):
                g = t.slice(int(lo), int(hi - lo))
                one = lambda c: g.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                ia, ib = _dense(one("_a")), _dense(one("_b"))
                hit, da, db, scale = settled(ia, ib, g.column("_w").to_numpy())
                yield from _matched(g, keys, ia, ib, hit, da / (scale * steps), db / (scale * steps))

    return rows.mapInArrow(work, _schema(s, keys))


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def _matched(g: pa.Table, keys: list[str], ia: np.ndarray, ib: np.ndarray, hit: np.ndarray, da: np.ndarray, db: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Matched pairs, then members that stay alone."""
    pairs = np.flatnonzero(hit)
    lone_a = np.unique(ia, return_index=True)[1][~np.isin(np.arange(len(da)), ia[pairs])]
    lone_b = np.unique(ib, return_index=True)[1][~np.isin(np.arange(len(db)), ib[pairs])]
    for rows, with_a, with_b in ((pairs, True, True), (lone_a, True, False), (lone_b, False, True)):
        if len(rows):
            take = lambda c, on: g.column(c).take(pa.array(rows)).combine_chunks() if on else pa.nulls(len(rows), g.schema.field(c).type)
            num = lambda x, on: pa.array(x) if on else pa.nulls(len(rows), pa.float64())
            yield from with_columns(g, keys, rows, _a=take("_a", with_a), _b=take("_b", with_b), _s=take("_s", with_a and with_b),
                                    dual_a=num(da[ia[rows]], with_a), dual_b=num(db[ib[rows]], with_b))


def _in_rounds(s: DataFrame, keys: list[str], steps: int, most: int) -> DataFrame:
    """Groups larger than a task: blocks of bidders against the prices of the round before."""
    by = [*keys, "component"]
    name = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    ends = s.select(*by, name("a", "_a").alias("x")).unionByName(s.select(*by, name("b", "_b").alias("x"))).distinct()
    n = ends.groupBy(*by).agg((F.count(F.lit(1)) + 1).alias("scale"))
    mirror = lambda c: F.concat(F.lit("~"), F.col(c))
    base = s.select(*by, name("a", "_a").alias("x"), name("b", "_b").alias("o"), "_w").join(n, by)
    zero = F.lit(0).cast("long")
    e = (base.select(*by, F.col("x").alias("bidder"), F.col("o").alias("object"), (F.col("_w") * F.col("scale")).alias("value"))
         .unionByName(base.select(*by, mirror("o").alias("bidder"), mirror("x").alias("object"), zero.alias("value")))
         .unionByName(ends.filter(F.col("x").startswith("a")).select(*by, F.col("x").alias("bidder"), mirror("x").alias("object"), zero.alias("value")))
         .unionByName(ends.filter(F.col("x").startswith("b")).select(*by, mirror("x").alias("bidder"), F.col("x").alias("object"), zero.alias("value"))))
    count = e.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).alias("_blocks"))
    e = cut_lineage(e.join(count, by).withColumn("_block", F.pmod(F.xxhash64("bidder"), F.col("_blocks"))).drop("_blocks"))
    eps = e.groupBy(*by).agg(F.greatest(F.floor(F.max("value") / 2), F.lit(1)).cast("long").alias("eps"))
    state = cut_lineage(e.select(*by, "object").distinct().withColumns({"price": zero, "owner": F.lit(None).cast("string")}).join(eps, by))
    while True:
        while True:
            bids = _bids(e, state, by)
            # the highest bid takes the object; what was offered below the price of this round is void
            top = bids.filter("bid IS NOT NULL").groupBy(*by, "object").agg(F.max(F.struct("bid", "bidder")).alias("_t"))
            state = cut_lineage(state.join(top, [*by, "object"], "left").select(
                *by, "object", F.coalesce("_t.bid", "price").alias("price"), F.coalesce("_t.bidder", "owner").alias("owner"), "eps"))
            if state.filter("owner IS NULL").isEmpty():  # as many objects as bidders: nobody is without one
                break
        if state.filter("eps > 1").isEmpty():
            break
        last = F.col("eps") == 1
        state = cut_lineage(state.withColumn("owner", F.when(last, F.col("owner"))).withColumn("eps", F.greatest(F.floor(F.col("eps") / FALL_OF_ROUNDS), F.lit(1)).cast("long")))
    profit = e.join(state.select(*by, "object", "price"), [*by, "object"]).groupBy(*by, "bidder").agg(F.max(F.col("value") - F.col("price")).alias("profit"))
    p = state.select(*by, "object", "price")
    both = profit.join(p.select(*by, F.when(F.col("object").startswith("~"), F.substring("object", 2, 1 << 30)).otherwise(mirror("object")).alias("bidder"), "price"), [*by, "bidder"]).join(n, by)
    dual = cut_lineage(both.select(*by, F.regexp_replace("bidder", "^~", "").alias("x"), ((F.col("profit") + F.col("price")) / (F.col("scale") * F.lit(float(steps)))).alias("dual")))
    side = lambda c, as_: dual.select(*by, F.col("x").alias(c), F.col("dual").alias(as_))
    named = s.select(*by, "_a", "_b", "_s", name("a", "_a").alias("xa"), name("b", "_b").alias("xb"))
    won = named.join(state.select(*by, F.col("object").alias("xb"), F.col("owner").alias("xa")), [*by, "xa", "xb"])
    won = won.join(side("xa", "dual_a"), [*by, "xa"]).join(side("xb", "dual_b"), [*by, "xb"])
    alone = lambda own, other, x, d, o: (named.select(*by, own, x).distinct().join(won.select(*by, x), [*by, x], "left_anti").join(side(x, d), [*by, x])
                                         .select(*keys, own, F.lit(None).cast(s.schema[other].dataType).alias(other), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), d, F.lit(None).cast("double").alias(o)))
    cols = [*keys, "_a", "_b", "_s", "dual_a", "dual_b"]
    return won.select(*cols).unionByName(alone("_a", "_b", "xa", "dual_a", "dual_b").select(*cols)).unionByName(alone("_b", "_a", "xb", "dual_b", "dual_a").select(*cols))


def _bids(e: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """``by, object, bidder, bid``: what each block's bidders without an object offer, as far as the block alone can tell."""
    held = state.filter("owner IS NOT NULL").select(*by, F.col("owner").alias("bidder"), F.col("object").alias("_has"))
    rows = e.join(state.select(*by, "object", "price", "eps"), [*by, "object"]).join(held, [*by, "bidder"], "left")
    group = [*by, "_block"]
    rows = rows.select(*group, "bidder", "object", "value", "price", "eps", F.col("_has").isNull().alias("_free")).repartition(*group).sortWithinPartitions(*group, "bidder", "object")

    def work(batches: Iterator) -> Iterator:
        for t in whole_groups(batches, group):
            cut = np.r_[np.flatnonzero(group_starts(t, group)), t.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:]):
                g = t.slice(int(lo), int(hi - lo))
                code = lambda c: g.column(c).combine_chunks().dictionary_encode()
                bidder, obj = code("bidder"), code("object")
                ib, io = bidder.indices.to_numpy(zero_copy_only=False).astype(np.int64), obj.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                head = np.flatnonzero(starts(ib))
                price = np.zeros(len(obj.dictionary), np.int64)
                price[io] = g.column("price").to_numpy()
                price = price.tolist()
                free = g.column("_free").to_numpy(zero_copy_only=False)[head]
                owner = [-1] * len(price)
                auction(np.r_[head, len(ib)].tolist(), io.tolist(), g.column("value").to_numpy().tolist(), price, int(g.column("eps")[0].as_py()), owner, np.flatnonzero(free).tolist())
                own = np.array(owner)
                new = np.flatnonzero(own >= 0)
                rows_ = head[own[new]]
                if len(new):
                    yield from with_columns(g, by, rows_, object=obj.dictionary.take(pa.array(new)), bidder=bidder.dictionary.take(pa.array(own[new])), bid=np.array(price, np.int64)[new])

    fields = T.StructType([*(e.schema[c] for c in by), T.StructField("object", T.StringType()), T.StructField("bidder", T.StringType()), T.StructField("bid", T.LongType())])
    return rows.mapInArrow(work, fields)
