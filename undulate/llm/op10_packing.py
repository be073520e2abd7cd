"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document of more tokens than a window gives whole windows first; what is left is cut into pieces of at most
`piece` tokens. Pieces are dealt into groups of about `group_tokens` tokens, or `group_pieces` pieces where these are tiny, by a hash. In a group, each piece starts as a
partition into m windows, all but one empty; the two partitions with the largest imbalance are merged, the fullest
windows of one onto the emptiest of the other, until one is left. m is the least number of windows that could hold the
group and rises whenever one exceeds the capacity.

Null texts are documents of the end id alone. Repeated rows are documents of their own. Only doc_id and text are read; an
empty table gives no rows. A sequence shorter than the capacity is padded to it by the user, unless its length is a
power of two.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undulate.llm.common import encoder, in_batches, stored, text_batches, texts_of, vocabulary

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int, piece: int) -> list[int]:
    """Where the pieces of a document of n tokens begin, and n."""
    whole = n - n % capacity
    return [*range(0, whole, capacity), *range(whole, n, piece), n]


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """Window (0 to m-1) of each size, with near-equal sums.

    A partition is its m sums in ascending order, less the least of them. A merge remembers the two it came from and the
    order that sorted it; from the last one back, that tells which window each slot of a partition became.
    """
    n = len(sizes)
    if m == 1:
        return np.zeros(n, np.int64)
    heap, merges = [], []
    for i, s in enumerate(sizes.tolist()):
        sums = np.zeros(m, np.int64)
        sums[-1] = s
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heap[0]
        a = a + b[::-1]  # both ascend: the fullest of one meets the emptiest of the other
        order = a.argsort()
        a = a[order]
        a -= a[0]
        heapq.heapreplace(heap, (-int(a[-1]), n + len(merges), a))
        merges.append((i, j, order))
    slots = {heap[0][1]: np.arange(m)}
    for k in range(len(merges) - 1, -1, -1):
        i, j, order = merges[k]
        at = np.empty(m, np.int64)
        at[order] = slots.pop(n + k)
        slots[i], slots[j] = at, at[::-1]
    return np.fromiter((slots[i][-1] for i in range(n)), np.int64, n)


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size, none over the capacity; the number of windows rises until that holds."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        w = differencing(sizes, m)
        if np.bincount(w, sizes, m).max() <= capacity:
            return w
        m += 1


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, piece: int) -> DataFrame:
    """A row a piece; `row` is of the stored table alone and deals the pieces into groups."""
    import pyarrow as pa

    text_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, row = encoder(vocabulary(tokenizer), False), TaskContext.get().partitionId() << 40
        for b in in_batches(batches):
            ids, edges = enc.encode(texts_of(b.column("text")))
            ids = ids.astype("<u4")
            end = np.array([end_id], "<u4")
            which, out = [], []
            for i, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                own = np.concatenate([ids[lo:hi], end])
                at = cuts(len(own), capacity, piece)
                for s, e in zip(at, at[1:]):
                    which.append(i)
                    out.append((s, e - s, zlib.crc32(own[s:e].tobytes()), len(own), row))
                    row += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()).take(pa.array(which, pa.int32())), *(pa.array(c, pa.int64()) for c in zip(*out))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = 4096, piece: int = 1024, group_tokens: int = 1 << 19, group_pieces: int = 1 << 14) -> DataFrame:
    """Pieces with their sequence and their place in it."""
    import pyarrow as pa

    cut = stored(pieces(docs, tokenizer, end_id, capacity, piece), "pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("pieces")).first()
    groups = max(1, -(-total.tokens // group_tokens), -(-total.pieces // group_pieces))

    def place(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("row")  # the result depends on the pieces alone, not on how they arrived
        sizes = t.column("length").to_numpy()
        part = np.flatnonzero(sizes < capacity)
        window = np.empty(len(sizes), np.int64)
        window[part] = windows(sizes[part], capacity) if len(part) else 0
        used = int(window[part].max()) + 1 if len(part) else 0
        whole = np.flatnonzero(sizes >= capacity)
        window[whole] = used + np.arange(len(whole))
        order = np.argsort(window, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, np.diff(window[order]) > 0]
        base = np.maximum.accumulate(np.where(first, before, 0))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - base
        ids = (key[0].as_py() << 32) + window
        return pa.table([*(t.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(ids), pa.array(offset)],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return (cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
            .groupBy("group").applyInArrow(place, PACKED))
