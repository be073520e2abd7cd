"""Ordered operators over keyed frames, split into time chunks.

A series is never sorted as one unit of work. Sliding windows run per
(key, chunk) on rows plus a halo of the neighbouring frames; running values
(last seen, cumulative sum) run inside a chunk and then receive a carry
computed from one summary row per chunk. A key that holds a large share of
the table is therefore spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 8192


def _chunk_of(t: Column, chunk: int) -> Column:
    return F.floor(t / F.lit(chunk)).cast("long")


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    before: int,
    after: int,
    exprs: dict[str, Callable[[object], Column]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Add columns computed over the frames [t-before, t+after] of the same key.

    ``exprs`` maps an output name to a function of the window. The window is a
    range over the integer frame, so gaps in a sparse series count as gaps.
    """
    c = F.col(t)
    chunk = max(chunk, before + after)  # else a row would go to as many chunks as its window spans
    home = _chunk_of(c, chunk)
    # a row goes to its own chunk and to those whose windows reach it (either bound may be negative)
    out = df.withColumn("_chunk", F.explode(F.sequence(
        _chunk_of(c - max(after, 0), chunk), _chunk_of(c + max(before, 0), chunk))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(c.cast("long")).rangeBetween(-before, after)
    out = out.select("*", *[fn(w).alias(name) for name, fn in exprs.items()])
    return out.filter(F.col("_chunk") == home).drop("_chunk")


def previous(df: DataFrame, keys: Sequence[str], t: str, cols: dict[str, str], step: int = 1,
             chunk: int = CHUNK) -> DataFrame:
    """Value of the frame exactly ``step`` earlier (later when negative); NULL when absent."""
    before, after = (step, 0) if step > 0 else (0, -step)
    c = F.col(t)
    chunk = max(chunk, abs(step))
    home = _chunk_of(c, chunk)
    out = df.withColumn(
        "_chunk", F.explode(F.sequence(_chunk_of(c - after, chunk), _chunk_of(c + before, chunk)))
    )
    w = (Window.partitionBy(*keys, "_chunk").orderBy(c.cast("long"))
         .rangeBetween(-step, -step))
    out = out.select("*", *[F.first(v).over(w).alias(o) for o, v in cols.items()])
    return out.filter(F.col("_chunk") == home).drop("_chunk")


def running_last(df: DataFrame, keys: Sequence[str], t: str, v: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Latest non-NULL ``v`` at or before each row."""
    keys = list(keys)
    c = df.withColumn("_chunk", _chunk_of(F.col(t), chunk))
    w = Window.partitionBy(*keys, "_chunk").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    inner = c.withColumn("_in", F.last(v, ignorenulls=True).over(w))
    per = c.groupBy(*keys, "_chunk").agg(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(t))).alias("_tail"))
    wk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_chunk", F.last("_tail", ignorenulls=True).over(wk).alias("_tail"))
    return (
        inner.join(carry, [*keys, "_chunk"], "left")
        .withColumn(out, F.coalesce("_in", "_tail"))
        .drop("_in", "_tail", "_chunk")
    )


def running_sum(df: DataFrame, keys: Sequence[str], t: str, v: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Cumulative sum of ``v`` in frame order (inclusive)."""
    keys = list(keys)
    c = df.withColumn("_chunk", _chunk_of(F.col(t), chunk))
    w = Window.partitionBy(*keys, "_chunk").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    per = c.groupBy(*keys, "_chunk").agg(F.sum(v).alias("_s"))
    wk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_chunk", F.sum("_s").over(wk).alias("_carry"))
    return (
        c.withColumn("_in", F.sum(v).over(w))
        .join(carry, [*keys, "_chunk"], "left")
        .withColumn(out, F.col("_in") + F.coalesce("_carry", F.lit(0)))
        .drop("_in", "_carry", "_chunk")
    )


def reflect_pad(df: DataFrame, t: str, n_frames: int | Column, before: int, after: int,
                repeat_edge: bool) -> DataFrame:
    """Extend 0..n-1 by mirrored frames.

    ``repeat_edge`` mirrors about the border (…1 0 | 0 1…); otherwise about the
    edge sample itself (…2 1 | 0 1 2…). The two index maps differ by one.
    """
    n = n_frames if isinstance(n_frames, Column) else F.lit(n_frames)
    c = F.col(t).cast("long")
    shift = 1 if repeat_edge else 0
    left = -c - shift
    right = 2 * n - c - (1 if repeat_edge else 2)
    targets = F.array_compact(F.array(
        c,
        F.when((left < 0) & (left >= -before), left),
        F.when((right >= n) & (right < n + after), right),
    ))
    return df.withColumn(t, F.explode(targets))
