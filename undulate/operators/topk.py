"""Sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undulate.functions.scalar import mixed
from undulate.operators.ranks import ranked_values


def topk_mean(trace: str, k: int) -> Column:
    """Mean of the k largest values of an array."""
    top = F.slice(F.sort_array(F.col(trace), asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)


def top_n(df, keys, by: str, n: int, ties: list[str]) -> DataFrame:
    """The n largest per key. Spark keeps n rows per key map-side before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_share_rows(df, keys, by: str, share: float, ties: list[str]) -> DataFrame:
    """The ceil(share·N) largest rows per key.

    The cut-off value comes from exact ranks; only rows tied at the cut-off are
    ordered by ``ties``.
    """
    keys = list(keys)
    r = ranked_values(df, keys, by).withColumn("_m", F.ceil(F.col("n") * share - F.lit(1e-9)))
    above = F.col("n") - F.col("below") - F.col("c")
    cut = r.filter((above < F.col("_m")) & (F.col("_m") <= above + F.col("c"))).select(
        *keys, F.col(by).alias("_cut"), (F.col("_m") - above).alias("_k"))
    x = df.join(cut, keys)
    sure = x.filter(F.col(by) > F.col("_cut"))
    w = Window.partitionBy(*keys).orderBy(*ties)
    tied = x.filter(F.col(by) == F.col("_cut")).withColumn("_rn", F.row_number().over(w)).filter(
        F.col("_rn") <= F.col("_k")).drop("_rn")
    return sure.unionByName(tied).drop("_cut", "_k")


def first_label_wins(df, voxel_keys, unit: str) -> DataFrame:
    """Resolve overlapping labels: the lowest id keeps the voxel."""
    return df.groupBy(*voxel_keys).agg(F.min(unit).alias(unit))


def natural_order(df, name: str, out: str) -> DataFrame:
    """Position by the integer at the end of the name, then the name. For catalogs (one row per run)."""
    num = F.regexp_extract(name, r"([0-9]+)$", 1).cast("int")
    return df.withColumn(out, F.row_number().over(Window.orderBy(num, F.col(name))).cast("long"))


def cap(df, n: int, order: list[Column]) -> DataFrame:
    """First n rows of an order (a global top-n: every task keeps n)."""
    return df.orderBy(*order).limit(n)


def hash_sample(df, ident: list[str], share: float) -> DataFrame:
    """Deterministic sample by a mix of the identity columns."""
    return df.filter(F.pmod(mixed(df, *ident), F.lit(1_000_000)) < int(share * 1_000_000))
