"""Scalar column functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- strings -------------------------------------------------------------------------------

def run_key_part(key, i: int) -> Column:
    """Part of a DATE/SUBJECT/RUN key."""
    return F.split_part(_c(key), F.lit("/"), F.lit(i + 1))


def digits_padded(name, width: int = 3) -> Column:
    """Digits of a name, zero padded."""
    return F.lpad(F.regexp_replace(_c(name), r"[^0-9]", ""), width, "0")


def unit_name(i, fmt: str = "dend_%03d") -> Column:
    return F.format_string(fmt, _c(i))


def unit_id(name) -> Column:
    return F.regexp_extract(_c(name), r"([0-9]+)$", 1).cast("long")


def clean_stem(path) -> Column:
    """File name without folders and extensions, separators as underscores."""
    base = F.element_at(F.split(_c(path), "/"), -1)
    return F.regexp_replace(F.regexp_replace(base, r"\..*$", ""), r"[ \-]+", "_")


def event_group_id(name) -> Column:
    return F.regexp_extract(_c(name), r"event_group_?([0-9]+)", 1).cast("long")


def is_iso_date(s) -> Column:
    return F.rlike(_c(s), F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))


# ---- numbers -------------------------------------------------------------------------------

def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def fisher_z(r, limit: float = 0.999999) -> Column:
    return F.atanh(clip(r, -limit, limit))


def angle_deg(cosine) -> Column:
    return F.degrees(F.acos(clip(cosine, -1.0, 1.0)))


def cross_time(t0, v0, t1, v1, level) -> Column:
    """Time at which the segment (t0,v0)-(t1,v1) reaches ``level``."""
    d = _c(v1) - _c(v0)
    return _c(t0) + F.when(F.abs(d) > 1e-12, (level - _c(v0)) / d).otherwise(F.lit(0.0)) * (_c(t1) - _c(t0))


def null_if_nan(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def norm_cdf(z) -> Column:
    """Standard normal distribution function; rational approximation of erfc, error below 1.2e-7."""
    x = F.abs(_c(z)) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (1.0 + 0.5 * x)
    # fixed coefficients of the Chebyshev fit of erfc (Numerical Recipes, §6.2)
    coef = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = poly * t + c
    tail = 0.5 * t * F.exp(-x * x + poly)
    return F.when(_c(z) >= 0, 1.0 - tail).otherwise(tail)


def norm_cdf_sql(z: str) -> str:
    """The same expression as SQL text."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.5 * {x}))"
    coef = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = str(coef[-1]) + "::DOUBLE"
    for c in reversed(coef[:-1]):
        poly = f"({poly} * {t} + ({c}))"
    tail = f"(0.5 * {t} * exp(-{x} * {x} + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def log_factorial(n) -> Column:
    """ln n! exactly by summation (n is a small count)."""
    n = _c(n).cast("int")
    return F.when(n <= 1, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.lit(0.0), lambda s, k: s + F.log(k.cast("double"))))


# ---- arrays --------------------------------------------------------------------------------

def array_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def array_mean(a) -> Column:
    return array_sum(a) / F.nullif(F.size(_c(a)), F.lit(0))


def dot(a, b) -> Column:
    return array_sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def cosine(a, b) -> Column:
    d = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(d > 1e-12, d)


def cumsum(a) -> Column:
    """Running sums of an array."""
    z = F.array().cast("array<double>")
    return F.aggregate(_c(a), z, lambda acc, x: F.concat(
        acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))


def diff(a) -> Column:
    a = _c(a)
    n = F.size(a)
    return F.zip_with(F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))),
                      lambda x, y: x - y)


def argmax(a) -> Column:
    """0-based position of the first maximum."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def roll(a, s: int) -> Column:
    """Circular shift to the right by s."""
    a = _c(a)
    n = F.size(a)
    k = F.pmod(F.lit(s), n)
    return F.concat(F.slice(a, n - k + 1, k), F.slice(a, F.lit(1), n - k))


def top_k(a, k: int) -> Column:
    return F.slice(F.sort_array(_c(a), asc=False), 1, k)


def map_values(a, f: Callable[[Column], Column]) -> Column:
    return F.transform(_c(a), f)


# ---- JSON ----------------------------------------------------------------------------------

def to_json_nan_safe(fields: dict[str, Column]) -> Column:
    """JSON document with NaN written as null."""
    return F.to_json(F.struct(*[null_if_nan(c.cast("double")).alias(n) for n, c in fields.items()]),
                     {"ignoreNullFields": "false"})


def json_number(doc, *path: str) -> Column:
    return F.get_json_object(_c(doc), "$." + ".".join(path)).cast("double")


# ---- ranges --------------------------------------------------------------------------------

def contrast_stretch(x, lo, hi) -> Column:
    d = _c(hi) - _c(lo)
    return clip((_c(x) - _c(lo)) / F.when(d > 1e-12, d), 0.0, 1.0)


def acc_magnitude(ax, ay, az, mx, my, mz) -> Column:
    """Distance of a 3-axis acceleration from its medians."""
    return F.sqrt((_c(ax) - _c(mx)) ** 2 + (_c(ay) - _c(my)) ** 2 + (_c(az) - _c(mz)) ** 2)


#: Modulus and step of `mixed`; a product of two intermediate values fits 64 bits.
MIX_P, MIX_A = 2_147_483_647, 48_271


def id_number(df: DataFrame, c: str | Column) -> Column:
    """An integer for an id of any type: integers are themselves, others the first 60 bits of the MD5 of their text; null is 0."""
    kind = df.schema[c].dataType if isinstance(c, str) and c in df.columns else T.LongType()
    if isinstance(kind, T.IntegralType):
        return F.coalesce(_c(c).cast("long"), F.lit(0))
    digest = F.md5(_c(c).cast("string").cast("binary"))
    return F.coalesce(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(0))


def mixing(df: DataFrame, *cols: str | Column) -> Column:
    """What :func:`mixed` keeps of id columns before it takes in a further one: see :func:`mixed_values`."""
    h = F.lit(17).cast("long")
    for c in cols:
        h = F.pmod(h * MIX_A + F.pmod(id_number(df, c), F.lit(MIX_P)), F.lit(MIX_P))
    return h


def mixed(df: DataFrame, *cols: str | Column) -> Column:
    """A pseudo-random integer in 0…2^31-2 from id columns of ``df``, by an explicit rule that SQL can repeat."""
    h = mixing(df, *cols)
    return F.pmod(h * (F.pmod(h, F.lit(65_537)) + 1), F.lit(MIX_P))


def permuted(i: Column, n: Column, seed: Column, rounds: int = 32) -> Column:
    """Image of index i under a permutation of 0…n-1 that the seed (0…2^31-2) keys.

    Each round pairs x with k - x modulo n and swaps the pair if a bit of the mix of its greater member says so: a bijection for
    every n, of which one image is worked out without the others - no sort, no window.
    """
    p = F.lit(MIX_P)

    def mix(v: Column) -> Column:
        v = F.pmod(F.pmod(v, p) * MIX_A, p)
        return F.pmod(v * (F.pmod(v, F.lit(65_537)) + 1), p)

    def swap(x: Column, r: Column) -> Column:
        u = mix(seed + r * 1_000_003)
        y = F.pmod(F.pmod(u, n) + n - x, n)
        return F.when(mix(u + (F.greatest(x, y) + 1) * 7919) >= MIX_P // 2, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(rounds).cast("long")), i.cast("long"), swap)


def mixed_values(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """:func:`mixed` of the columns that made h and of a last one, inside a task."""
    h = (h * MIX_A + last % MIX_P) % MIX_P
    return h * (h % 65_537 + 1) % MIX_P


def permuted_values(n: int, seeds: np.ndarray, rounds: int = 32) -> np.ndarray:
    """Images of 0…n-1 by :func:`permuted` for each of the seeds, one row each, inside a task."""

    def mix(v: np.ndarray) -> np.ndarray:
        v = v % MIX_P * MIX_A % MIX_P
        return v * (v % 65_537 + 1) % MIX_P

    x = np.tile(np.arange(n, dtype=np.int64), (len(seeds), 1))
    for r in range(1, rounds + 1):
        u = mix(seeds.astype(np.int64) + r * 1_000_003)[:, None]
        y = u % n - x
        y += n * (y < 0)
        x = np.where(mix(u + (np.maximum(x, y) + 1) * 7919) >= MIX_P // 2, y, x)
    return x


def permuted_sql(i: str, n: str, seed: str, rounds: int = 32) -> str:
    """The same as a DuckDB expression."""
    mix = lambda v: f"(((({v}) % {MIX_P}) * {MIX_A} % {MIX_P}) * (((({v}) % {MIX_P}) * {MIX_A} % {MIX_P}) % 65537 + 1) % {MIX_P})"
    u = mix(f"({seed}) + r * 1000003")
    y = f"({u} % ({n}) + ({n}) - x) % ({n})"
    return (f"list_reduce(list_prepend(CAST({i} AS BIGINT), CAST(range(1, {rounds + 1}) AS BIGINT[])), lambda x, r: "
            f"CASE WHEN {mix(f'{u} + (greatest(x, {y}) + 1) * 7919')} >= {MIX_P // 2} THEN {y} ELSE x END)")


def mixed_sql(*exprs: str) -> str:
    """The same as a DuckDB expression."""
    h = "17::BIGINT"
    for e in exprs:
        h = f"(({h}) * {MIX_A} + ((({e})::BIGINT % {MIX_P} + {MIX_P}) % {MIX_P})) % {MIX_P}"
    return f"((({h}) * (({h}) % 65537 + 1)) % {MIX_P})"
