"""Exact nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt into blocks by a hash of their id, and every block of queries meets every block of
candidates in one task. There, vectors are rounded to 8 bits with a scale of their own. Integer products of a tile give
the distance between the rounded vectors, and by the triangle inequality the true one differs by at most the two
rounding errors. Pairs whose least possible distance exceeds the k-th smallest greatest possible distance are out; the
others are computed in double precision and merged into a heap for each query. A window limited to k rows merges blocks.

Rows without an id, and vectors that are null, zero or hold null or non-finite components, take no part. Vectors of
different lengths never meet. Rows that repeat an id count as one vector at the least of their distances, and never as a
neighbour of themselves. Ties go to the smaller id. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undulate.llm.vectors import matrix, taking_part

FOUND = "query_id long, vec_id long, score double"
#: Components summed in one product of float32, exact for integers of 7 bits and a sign.
EXACT = 1024


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components as 8-bit integers, the scale of each row, and how far (Euclid) each row was moved."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: float32 holds each partial sum of EXACT terms."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT):
        out += a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T
    return out


def nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, tile: tuple[int, int] = (128, 2048)) -> list[tuple[int, int, float]]:
    """(query, candidate, distance) of the k nearest ids of each query id."""
    spare = len(cid) - len(np.unique(cid))  # rows that repeat an id may fill places of the bound
    qi, qs, qe = rounded(q)
    ci, cs, ce = rounded(c)
    qn = (qi.astype(np.float64) ** 2).sum(axis=1) * qs**2
    cn = (ci.astype(np.float64) ** 2).sum(axis=1) * cs**2
    heaps: dict[int, dict[int, float]] = {}
    for lo in range(0, len(q), tile[0]):
        rows = slice(lo, lo + tile[0])
        bound = np.full((len(qid[rows]), 0), np.inf)
        for at in range(0, len(c), tile[1]):
            cols = slice(at, at + tile[1])
            d2 = qn[rows, None] + cn[None, cols] - 2 * products(qi[rows], ci[cols]) * qs[rows, None] * cs[None, cols]
            near = np.sqrt(np.maximum(d2, 0))
            slack = qe[rows, None] + ce[None, cols] + 1e-9 * (1 + near + np.sqrt(qn[rows, None] + cn[None, cols]))
            own = qid[rows, None] == cid[None, cols]
            upper = np.where(own, np.inf, near + slack)
            bound = np.concatenate([bound, upper], axis=1)
            if bound.shape[1] > k + spare:
                bound = np.partition(bound, k + spare - 1, axis=1)[:, : k + spare]
            limit = bound.max(axis=1) if bound.shape[1] == k + spare else np.full(len(bound), np.inf)
            i, j = np.nonzero((near - slack <= limit[:, None]) & ~own)
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)] + lo, j[s : s + (1 << 16)] + at
                score = np.sqrt(((q[a] - c[b]) ** 2).sum(axis=1))
                order = np.lexsort((cid[b], score, a))
                a, b, score = a[order], b[order], score[order]
                first = np.r_[True, a[1:] != a[:-1]]
                nth = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
                few = nth < k + spare
                for query, cand, d in zip(qid[a[few]].tolist(), cid[b[few]].tolist(), score[few].tolist()):
                    own_best = heaps.setdefault(query, {})
                    own_best[cand] = min(d, own_best.get(cand, np.inf))
            for query in set(qid[rows].tolist()) & heaps.keys():
                if len(heaps[query]) > k:
                    heaps[query] = {x: d for d, x in heapq.nsmallest(k, ((d, x) for x, d in heaps[query].items()))}
    return [(query, x, d) for query, best in heaps.items() for x, d in best.items()]


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 2048, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row for which `is_query` (of the column `id`) holds."""
    import pyarrow as pa

    rows = taking_part(vectors, id_col, vector_col).withColumn("dim", F.size("v"))
    n = rows.agg(F.count("*").alias("all"), F.count(F.when(is_query, 1)).alias("asked")).first()
    qb, cb = max(1, -(-n.asked // query_block)), max(1, -(-n.all // block))
    deal = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = rows.where(is_query).withColumn("q", deal(qb, 1)).withColumn("c", each(cb))
    candidates = rows.withColumn("c", deal(cb, 2)).withColumn("q", each(qb))

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and there.num_rows:
            found = nearest(asked.column("id").to_numpy(), matrix(asked.column("v")), there.column("id").to_numpy(), matrix(there.column("v")), k)
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    by = ["dim", "q", "c"]
    found = queries.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(meet, FOUND)
    return (found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
