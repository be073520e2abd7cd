"""Cohort statistics with the field of view as the unit of replication.

Rank tests work on the distinct-value table of :mod:`ranks`: rank sums and tie
terms are aggregates over values, so no group is sorted in one task and no
two samples are crossed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undulate.functions.scalar import MIX_P, log_factorial, mixed, norm_cdf
from undulate.operators.ranks import average_rank, exact_quantiles, ranked_values

#: Largest samples with an exact null distribution where the method is "auto".
EXACT_SIGNED, EXACT_RANK_SUM = 50, 8


@lru_cache(maxsize=256)
def _signed_rank_counts(n: int) -> np.ndarray:
    """Number of sign patterns per rank sum 0…n(n+1)/2."""
    c = np.zeros(n * (n + 1) // 2 + 1)
    c[0] = 1
    for k in range(1, n + 1):
        c[k:] = c[k:] + c[: len(c) - k]
    return c


@lru_cache(maxsize=1024)
def _rank_sum_counts(m: int, n: int) -> np.ndarray:
    """Number of arrangements per U of two samples; the same for either order of them, so the smaller one goes first."""
    if m > n:
        return _rank_sum_counts(n, m)
    c = np.zeros((m + 1, m * n + m + 1))
    c[0, 0] = 1
    # choose m of m+n ranks; track the rank sum above its least value
    for r in range(m + n):
        for k in range(min(m, r + 1), 0, -1):
            shift = r - (k - 1)
            c[k, shift:] = c[k, shift:] + c[k - 1, : c.shape[1] - shift]
    return c[m, : m * n + 1]


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def _exact_tails(kind: pd.Series, stat: pd.Series, m: pd.Series, n: pd.Series) -> pd.DataFrame:
    """P(S ≤ s) and P(S ≥ s); one row per test, not per observation."""
    lo, hi = [], []
    for k, s, a, b in zip(kind, stat, m, n):
        if s is None or math.isnan(s):
            lo.append(None)
            hi.append(None)
            continue
        c = _signed_rank_counts(int(a)) if k == "w" else _rank_sum_counts(int(a), int(b))
        tot, i = c.sum(), int(round(s))
        lo.append(c[: i + 1].sum() / tot)
        hi.append(c[i:].sum() / tot)
    return pd.DataFrame({"lo": lo, "hi": hi}, dtype="float64")


def _sided(lo: Column, hi: Column, alternative: str) -> Column:
    if alternative == "greater":
        return hi
    if alternative == "less":
        return lo
    return F.least(F.lit(1.0), 2 * F.least(lo, hi))


def _exact(method: str, small: Column) -> Column:
    if method not in ("auto", "exact", "normal"):
        raise ValueError(method)
    return small if method == "auto" else F.lit(method == "exact")


def wilcoxon_signed_rank(df, keys, d: str, mu: float = 0.0, alternative: str = "two-sided",
                         method: str = "auto", bounded: bool = False) -> DataFrame:
    """Signed-rank test of ``d`` − mu per key; zeros dropped.

    ``method``: "exact" (wherever there are no ties), "normal" with tie
    correction, or "auto": exact up to n = 50 without ties.
    ``keys, n, w_plus, p``; NULL p without any non-zero difference.
    """
    keys = list(keys)
    x = df.filter(F.col(d).isNotNull()).withColumn("_d", F.col(d) - mu)
    nz = x.filter(F.abs("_d") > 0).withColumn("_abs", F.abs("_d"))
    r = ranked_values(nz, keys, "_abs", {"_pos": (F.col("_d") > 0).cast("long")}, bounded)
    c = F.col("c").cast("double")
    g = r.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col("_pos") * average_rank()).alias("w_plus"),
                             F.sum(c * c * c - c).alias("_tie"))
    n, w = F.col("n").cast("double"), F.col("w_plus")
    exact = _exact(method, F.col("n") <= EXACT_SIGNED) & (F.col("_tie") == 0)
    tails = _exact_tails(F.lit("w"), F.when(exact, w), F.when(exact, F.col("n")).otherwise(1), F.lit(0))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie") / 48
    z = (w - n * (n + 1) / 4) / F.sqrt(F.nullif(var, F.lit(0.0)))
    g = g.withColumn("_t", tails)
    p = F.when(exact, _sided(F.col("_t.lo"), F.col("_t.hi"), alternative)).otherwise(
        _sided(norm_cdf(z), norm_cdf(-z), alternative))
    all_keys = x.select(*keys).distinct()
    return all_keys.join(g.select(*keys, "n", "w_plus", p.alias("p")), keys, "left").fillna(0, ["n"])


def mann_whitney(df, keys, group: str, a, b, v: str, method: str = "auto", bounded: bool = False) -> DataFrame:
    """Two-sample rank test of the rows with ``group`` = a against = b, with effect sizes.

    ``keys, n_a, n_b, u, p, cliffs_delta, hedges_g, median_a, median_b``. ``method``:
    "exact" (wherever there are no ties), "normal" with continuity and tie
    correction, or "auto": exact if either sample has at most 8 and no ties.
    """
    keys = list(keys)
    x = df.filter(F.col(v).isNotNull() & F.col(group).isin(a, b))
    is_a = (F.col(group) == F.lit(a)).cast("long")
    r = ranked_values(x, keys, v, {"_ca": is_a}, bounded)
    c = F.col("c").cast("double")
    g = r.groupBy(*keys).agg(
        F.max("n").alias("_n"), F.sum("_ca").alias("n_a"), F.sum(F.col("_ca") * average_rank()).alias("_ra"),
        F.sum(c * c * c - c).alias("_tie"))
    g = g.withColumn("n_b", F.col("_n") - F.col("n_a"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = F.col("_ra") - na * (na + 1) / 2
    g = g.withColumn("u", u)
    n = na + nb
    ok = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    exact = ok & _exact(method, F.least("n_a", "n_b") <= EXACT_RANK_SUM) & (F.col("_tie") == 0)
    var = na * nb / 12 * ((n + 1) - F.col("_tie") / (n * (n - 1)))
    z = (F.abs(F.col("u") - na * nb / 2) - 0.5) / F.sqrt(F.nullif(var, F.lit(0.0)))
    g = g.withColumn("_t", _exact_tails(F.lit("u"), F.when(exact, F.col("u")), F.when(exact, F.col("n_a")).otherwise(1),
                                        F.when(exact, F.col("n_b")).otherwise(1)))
    p = F.when(exact, _sided(F.col("_t.lo"), F.col("_t.hi"), "two-sided")).when(
        ok, F.least(F.lit(1.0), 2 * norm_cdf(-z)))
    g = g.select(*keys, "n_a", "n_b", "u", p.alias("p"), F.when(ok, 2 * F.col("u") / (na * nb) - 1).alias("cliffs_delta"))
    m = x.groupBy(*keys).agg(
        *[f(F.when(F.col(group) == F.lit(s), F.col(v))).alias(f"_{n}{t}") for t, s in (("a", a), ("b", b))
          for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "k"))])
    ka, kb = F.col("_ka"), F.col("_kb")
    sp = F.sqrt(((ka - 1) * F.col("_va") + (kb - 1) * F.col("_vb")) / (ka + kb - 2))
    hedges = (F.col("_ma") - F.col("_mb")) / F.nullif(sp, F.lit(0.0)) * (1 - 3 / (4 * (ka + kb) - 9))
    m = m.select(*keys, hedges.alias("hedges_g"))
    med = exact_quantiles(x, [*keys, group], v, {"_q": 0.5}, bounded)
    med = med.groupBy(*keys).agg(F.max(F.when(F.col(group) == F.lit(a), F.col("_q"))).alias("median_a"),
                                 F.max(F.when(F.col(group) == F.lit(b), F.col("_q"))).alias("median_b"))
    return _join(g, [m, med], keys)


def _join(first: DataFrame, rest: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    for r in rest:
        first = first.join(r, keys)
    return first


def random_intercept_slope(df, keys, group: str, y: str, x: str) -> DataFrame:
    """y = a + b·x + u_group + e by generalised least squares.

    Variance components by moments: σ² from the within-group regression, the
    group variance from the between mean square of the residuals. Everything is
    a function of six sums per group. (Likelihood-based components are not
    reproduced; the two agree for balanced groups.)
    """
    keys = list(keys)
    d = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).withColumn("_x", F.col(x).cast("double")).withColumn(
        "_y", F.col(y).cast("double"))
    s = d.groupBy(*keys, group).agg(
        F.count(F.lit(1)).cast("double").alias("_k"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"),
        F.regr_sxx("_y", "_x").alias("sxx"), F.regr_sxy("_y", "_x").alias("sxy"), F.regr_syy("_y", "_x").alias("syy"))
    w = s.groupBy(*keys).agg(
        F.sum("_k").alias("_N"), F.count(F.lit(1)).cast("double").alias("G"), F.sum("sxx").alias("wxx"), F.sum("sxy").alias("wxy"),
        F.sum("syy").alias("wyy"), F.sum(F.col("_k") * F.col("_k")).alias("n2"),
        (F.sum(F.col("_k") * F.col("mx")) / F.sum("_k")).alias("gx"), (F.sum(F.col("_k") * F.col("my")) / F.sum("_k")).alias("gy"))
    bw = F.col("wxy") / F.nullif(F.col("wxx"), F.lit(0.0))
    w = w.withColumn("_bw", bw).withColumn(
        "se2", (F.col("wyy") - F.col("_bw") * F.col("wxy")) / F.nullif(F.col("_N") - F.col("G") - 1, F.lit(0.0)))
    j = s.join(w, keys)
    res = (F.col("my") - F.col("gy")) - F.col("_bw") * (F.col("mx") - F.col("gx"))
    b = j.groupBy(*keys).agg((F.sum(F.col("_k") * res * res) / (F.max("G") - 1)).alias("_msb"))
    w = w.join(b, keys).withColumn("_n0", (F.col("_N") - F.col("n2") / F.col("_N")) / (F.col("G") - 1)).withColumn(
        "su2", F.greatest(F.lit(0.0), (F.col("_msb") - F.col("se2")) / F.col("_n0")))
    j = s.join(w.select(*keys, "_N", "G", "se2", "su2"), keys)
    k = F.col("se2") / (F.col("se2") + F.col("_k") * F.col("su2"))  # (1−θ)²
    nk = F.col("_k") * k
    g = j.groupBy(*keys, "_N", "G", "se2", "su2").agg(
        F.sum(nk).alias("_a"), F.sum(nk * F.col("mx")).alias("_b"), F.sum(F.col("sxx") + nk * F.col("mx") ** 2).alias("_c"),
        F.sum(nk * F.col("my")).alias("_p"), F.sum(F.col("sxy") + nk * F.col("mx") * F.col("my")).alias("_q"))
    det = F.col("_a") * F.col("_c") - F.col("_b") ** 2
    slope = (F.col("_a") * F.col("_q") - F.col("_b") * F.col("_p")) / det
    icpt = (F.col("_c") * F.col("_p") - F.col("_b") * F.col("_q")) / det
    se = F.sqrt(F.col("se2") * F.col("_a") / det)
    return g.select(*keys, F.col("_N").cast("long").alias("n"), F.col("G").cast("long").alias("n_groups"), icpt.alias("intercept"),
                    slope.alias("slope"), se.alias("se"), (2 * norm_cdf(-F.abs(slope / se))).alias("p"),
                    F.col("se2").alias("var_within"), F.col("su2").alias("var_group"))


def random_intercept_mean(df, keys, group: str, y: str) -> DataFrame:
    """Mean of y with a random group effect (moment estimates), its standard error and two-sided p."""
    keys = list(keys)
    s = df.filter(F.col(y).isNotNull()).groupBy(*keys, group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(y).alias("m"), (F.var_pop(y) * F.count(y)).alias("ss"))
    w = s.groupBy(*keys).agg(
        F.sum("n").alias("_N"), F.count(F.lit(1)).cast("double").alias("G"), F.sum("ss").alias("_ss"),
        F.sum(F.col("n") * F.col("n")).alias("_n2"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_gm"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_sm"))
    w = w.withColumn("se2", F.col("_ss") / (F.col("_N") - F.col("G")))
    msb = (F.col("_sm") - F.col("_N") * F.col("_gm") ** 2) / (F.col("G") - 1)
    n0 = (F.col("_N") - F.col("_n2") / F.col("_N")) / (F.col("G") - 1)
    w = w.withColumn("su2", F.greatest(F.lit(0.0), (msb - F.col("se2")) / n0))
    j = s.join(w.select(*keys, "se2", "su2"), keys).withColumn("_w", 1 / (F.col("su2") + F.col("se2") / F.col("n")))
    g = j.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("m")) / F.sum("_w")).alias("mean"), F.sqrt(1 / F.sum("_w")).alias("se"),
                             F.count(F.lit(1)).alias("n_groups"))
    return g.withColumn("p", 2 * norm_cdf(-F.abs(F.col("mean") / F.col("se"))))


def chi2_2x2(counts, keys, a: str, b: str, c: str, d: str) -> DataFrame:
    """Pearson χ² of a 2×2 table without continuity correction (1 degree of freedom)."""
    x = {k: F.col(v).cast("double") for k, v in zip("abcd", (a, b, c, d))}
    n = x["a"] + x["b"] + x["c"] + x["d"]
    den = (x["a"] + x["b"]) * (x["c"] + x["d"]) * (x["a"] + x["c"]) * (x["b"] + x["d"])
    chi = n * (x["a"] * x["d"] - x["b"] * x["c"]) ** 2 / F.nullif(den, F.lit(0.0))
    return counts.select(*keys, chi.alias("chi2"), (2 * norm_cdf(-F.sqrt(chi))).alias("p"))


def sign_test(n_pos: Column, n: Column) -> Column:
    """Two-sided exact binomial p with success probability ½."""
    k = F.least(n_pos, n - n_pos).cast("int")
    tail = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k, F.lit(0))), F.lit(0.0),
        lambda s, i: s + F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * F.log(F.lit(2.0))))
    return F.least(F.lit(1.0), 2 * tail)


def cohen_kappa(df, keys, a: str, b: str) -> DataFrame:
    """Agreement of two labels beyond chance, with the raw agreement and the majority base rate."""
    keys = list(keys)
    t = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_n"))
    tot = t.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("_n")).otherwise(0)).alias("_same"))
    ra = t.groupBy(*keys, F.col(a).alias("_l")).agg(F.sum("_n").alias("_ra"))
    rb = t.groupBy(*keys, F.col(b).alias("_l")).agg(F.sum("_n").alias("_rb"))
    e = ra.join(rb, [*keys, "_l"], "left").groupBy(*keys).agg(F.sum(F.col("_ra") * F.coalesce("_rb", F.lit(0))).alias("_e"), F.max("_ra").alias("_mx"))
    j = tot.join(e, keys)
    n = F.col("n").cast("double")
    po, pe = F.col("_same") / n, F.col("_e") / (n * n)
    return j.select(*keys, "n", po.alias("agreement"), (F.col("_mx") / n).alias("majority"),
                    ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def compare_groups(metrics, family: Sequence[str], group: str, a, b, v: str = "value", low_n: int = 5) -> DataFrame:
    """Two-group comparison of every metric with q over all metrics of a family.

    ``metrics`` has one row per (family…, metric, field of view), so groups are
    as large as the cohort has fields.
    """
    from undulate.operators.rolling import bh_qvalue

    keys = [*family, "metric"]
    t = mann_whitney(metrics, keys, group, a, b, v, bounded=True)
    t = t.withColumn("_f", F.lit(0))
    t = bh_qvalue(t, [*family, "_f"], "p", bounded=True).drop("_f")
    return t.withColumn("low_power", (F.least("n_a", "n_b") < low_n))


def minimum_p(n: Column) -> Column:
    """Least two-sided p a signed-rank test of n differences can reach: 2^(1−n)."""
    return F.pow(F.lit(2.0), 1 - n)


def subject_medians(df, keys, subject: str, v: str, bounded: bool = False) -> DataFrame:
    keys = [*keys, subject]
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fov"))
    return exact_quantiles(df, keys, v, {"median": 0.5}, bounded).join(n, keys)


def bootstrap_ci(df, keys, ident: Sequence[str], v: str, n_rep: int = 200, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean under Poisson(1) resampling weights from a mix of the row identity.

    Replicates are summed map-side, so the shuffle carries one row per
    (task, key, replicate).
    """
    keys = list(keys)
    # cumulative Poisson(1) probabilities e^-1/k!, up to where what is left is below the steps of u
    cdf, k = [math.exp(-1)], 1
    while 1 - cdf[-1] > 1 / MIX_P:
        cdf.append(cdf[-1] + math.exp(-1) / math.factorial(k))
        k += 1
    r = df.filter(F.col(v).isNotNull()).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))))
    u = mixed(r, "_rep", *ident) / float(MIX_P)
    w = sum((F.when(u > c, 1).otherwise(0) for c in cdf), F.lit(0))
    m = r.withColumn("_w", w).groupBy(*keys, "_rep").agg(
        (F.sum(F.col("_w") * F.col(v)) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    a = (1 - level) / 2
    ci = m.groupBy(*keys).agg(F.percentile("_m", a).alias("ci_lo"), F.percentile("_m", 1 - a).alias("ci_hi"))
    base = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))
    return base.join(ci, keys)
