"""Exact ranks and quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer and a rank
window sorts a group in one task. Both are fine for one unit's frames, neither
is for a cohort column. Here rows collapse to (key, value, count) first, so a
value shared by a third of the rows is one row; the distinct values of a big
group are cut into bins at edges taken from a hash sample of those values (a
pure function of the data, so every recomputation cuts at the same place);
ranks are counted inside a bin and offset by the sizes of the bins below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_GROUP = 20_000
EDGES = 512


def ranked_values(df: DataFrame, keys: Sequence[str], v: str, weights: dict[str, Column] | None = None,
                  bounded: bool = False, small: int = SMALL_GROUP, edges: int = EDGES, rows: str | None = None) -> DataFrame:
    """One row per distinct value: ``keys, v, c`` (rows), ``below`` (rows with a smaller value), ``n``, ``bin``.

    ``weights`` adds further per-value sums (for instance rows of one sample).
    NULL values carry no rank and are left out. ``bounded`` states that the data
    model limits a group (frames of a recording, units of a recording, fields
    of a cohort); such groups are ranked by one window. ``rows`` tells how many rows a row stands for.
    """
    keys = list(keys)
    taken = {"c", "n", "below", "bin"} & {*keys, v}
    if taken:
        raise ValueError(f"rename {sorted(taken)}: used for results")
    vc = (
        df.filter(F.col(v).isNotNull())
        .groupBy(*keys, v)
        .agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("c"), *[F.sum(e).alias(n) for n, e in (weights or {}).items()])
    )
    if bounded:
        w = Window.partitionBy(*keys).orderBy(v)
        return vc.select(
            "*",
            F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
            F.sum("c").over(Window.partitionBy(*keys)).alias("n"), F.lit(0).alias("bin"))
    big = vc.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > small)
    cuts = (
        vc.select(*keys, v).join(big, keys)
        .filter(F.pmod(F.xxhash64(v), F.floor(F.col("_d") / edges)) == 0)
        .groupBy(*keys).agg(F.sort_array(F.collect_list(v)).alias("_cuts"))
    )
    vc = vc.join(cuts, keys, "left").withColumn(
        "bin",
        F.when(F.col("_cuts").isNull(), F.lit(0))
        .otherwise(F.size(F.filter("_cuts", lambda e: e <= F.col(v)))),
    ).drop("_cuts")
    inside = Window.partitionBy(*keys, "bin").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    bins = vc.groupBy(*keys, "bin").agg(F.sum("c").alias("_c"))
    over_bins = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offs = bins.select(*keys, "bin", F.coalesce(F.sum("_c").over(over_bins), F.lit(0)).alias("_off"),
                       F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    return (
        vc.withColumn("_b", F.coalesce(F.sum("c").over(inside), F.lit(0)))
        .join(offs, [*keys, "bin"])
        .withColumn("below", F.col("_b") + F.col("_off"))
        .drop("_b", "_off")
    )


def average_rank() -> Column:
    """Mid rank of a value of ``ranked_values`` (1-based, ties share their mean)."""
    return F.col("below") + (F.col("c") + 1) / 2


def with_average_rank(df: DataFrame, keys: Sequence[str], v: str, out: str, bounded: bool = False, rows: str | None = None) -> DataFrame:
    """Attach the mid rank of ``v`` within ``keys`` to each row; ``rows`` tells how many rows a row stands for."""
    keys = list(keys)
    if bounded and not rows:
        ties = F.count(v).over(Window.partitionBy(*keys, v))
        rk = F.rank().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(v)))
        return df.withColumn(out, F.when(F.col(v).isNotNull(), rk + (ties - 1) / 2))
    r = ranked_values(df, keys, v, rows=rows).select(*keys, v, average_rank().alias(out))
    return df.join(r, [*keys, v], "left")


def quantile_from_ranks(v: str, q: float) -> Column:
    """Aggregate over ``ranked_values`` rows: linear-interpolated quantile (NumPy default)."""
    h = (F.col("n") - 1) * F.lit(q)
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("c")), F.col(v)))
    lo, hi = at(F.floor(h)), at(F.ceil(h))
    frac = F.max(h - F.floor(h))
    return lo + frac * (hi - lo)


def exact_quantiles(df: DataFrame, keys: Sequence[str], v: str, qs: dict[str, float], bounded: bool = False,
                    **kw) -> DataFrame:
    """Quantiles of ``v`` per key, for groups without a size bound unless ``bounded``."""
    if bounded:
        return df.groupBy(*keys).agg(*[F.percentile(v, q).alias(name) for name, q in qs.items()])
    return ranked_values(df, keys, v, **kw).groupBy(*keys).agg(
        *[quantile_from_ranks(v, q).alias(name) for name, q in qs.items()]
    )


def exact_mad(df: DataFrame, keys: Sequence[str], v: str, med: str = "med", mad: str = "mad", **kw) -> DataFrame:
    """Median and median absolute deviation per key for groups without a size bound."""
    keys = list(keys)
    m = exact_quantiles(df, keys, v, {med: 0.5}, **kw)
    dev = df.join(m, keys).withColumn("_dev", F.abs(F.col(v) - F.col(med)))
    return m.join(exact_quantiles(dev, keys, "_dev", {mad: 0.5}, **kw), keys)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho", **kw) -> DataFrame:
    """Rank correlation per key with average ties; NULL when either side is constant."""
    keys = list(keys)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = with_average_rank(d, keys, x, "_rx", **kw)
    d = with_average_rank(d, keys, y, "_ry", **kw)
    return d.groupBy(*keys).agg(pearson("_rx", "_ry").alias(out), F.count(F.lit(1)).alias("n"))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation aggregate that gives NULL (not NaN) on a constant side."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    vx, vy = F.var_pop(F.when(both, x)), F.var_pop(F.when(both, y))
    # corr itself divides by zero on a constant side, before any condition around it is looked at
    return F.when((vx > 1e-18) & (vy > 1e-18), F.covar_pop(x, y) / F.sqrt(vx * vy))
