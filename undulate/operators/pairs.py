"""Pairwise statistics between units, by blocks of packed traces.

A self-join on the frame would emit units² rows per frame. Instead each unit is
one packed array, units of a run are hashed into blocks of about ``block``
units, and each pair of blocks is one task-sized matrix product. A run with
many units becomes many block pairs; no group holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undulate.operators.blocks import ragged

BLOCK = 256


def pack(df: DataFrame, keys: Sequence[str], t: str, v: str, out: str = "trace") -> DataFrame:
    """One row per key: the values in frame order (a recording's frames bound the length)."""
    return df.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(v).alias("v")))),
                    lambda s: s["v"]).alias(out)
    )


def unpack(df: DataFrame, trace: str, t: str, v: str) -> DataFrame:
    """Inverse of :func:`pack` with frames numbered from 0."""
    others = [c for c in df.columns if c != trace]
    return df.select(*others, F.posexplode(trace).alias(t, v))


def unit_pairs(df: DataFrame, keys: Sequence[str], unit: str, cols: Sequence[str] = ()) -> DataFrame:
    """Pairs a < b of the units of one key with the named columns of both sides.

    For dimension-sized tables (one row per unit); traces go through
    :func:`block_pairs`.
    """
    keys = list(keys)
    a = df.select(*keys, F.col(unit).alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = df.select(*keys, F.col(unit).alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, keys).filter(F.col("a") < F.col("b"))


def block_pairs(packed: DataFrame, keys: Sequence[str], unit: str, trace: str,
                kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]],
                outputs: dict[str, str], keep: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None,
                block: int = BLOCK) -> DataFrame:
    """Apply ``kernel(X, Y)`` to all unit pairs a < b of each key.

    ``X`` (n, T) and ``Y`` (m, T) hold the traces of the a and b sides; the
    kernel returns one (n, m) matrix per name of ``outputs`` (name → SQL type).
    ``keep`` may drop pairs inside the task by a condition on those matrices.
    """
    keys = list(keys)
    src = packed.select(*keys, F.col(unit).alias("_u"), F.col(trace).alias("_v"))
    count = src.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    src = src.join(count, keys).withColumn("_blk", F.pmod(F.xxhash64("_u"), F.col("_nb")).cast("int"))
    src = src.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    src = src.withColumn("_bi", F.least("_blk", "_o")).withColumn("_bj", F.greatest("_blk", "_o"))
    fields = [src.schema[k] for k in keys]
    unit_type = src.schema["_u"].dataType
    schema = T.StructType(
        fields + [T.StructField("a", unit_type), T.StructField("b", unit_type)]
        + [T.StructField(n, T._parse_datatype_string(ty)) for n, ty in outputs.items()]
    )
    names = list(outputs)

    def one_side(pa: pd.DataFrame, pb: pd.DataFrame, head: dict) -> pd.DataFrame:
        res = kernel(np.stack(pa["_v"].to_numpy()), np.stack(pb["_v"].to_numpy()))
        ua, ub = pa["_u"].to_numpy(), pb["_u"].to_numpy()
        mask = ua[:, None] < ub[None, :]
        if keep is not None:
            mask &= keep(res)
        i, j = np.nonzero(mask)
        out = {k: [head[k]] * len(i) for k in keys}
        out.update(a=ua[i], b=ub[j])
        for n in names:
            col = pd.Series(res[n][i, j])
            out[n] = col.where(col.notna(), None) if col.dtype.kind == "f" else col
        return pd.DataFrame(out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in keys}
        bi, bj = pdf["_bi"].iloc[0], pdf["_bj"].iloc[0]
        left = pdf[pdf["_blk"] == bi]
        if bi == bj:
            return one_side(left, left, head)
        right = pdf[pdf["_blk"] == bj]
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        return pd.concat([one_side(left, right, head), one_side(right, left, head)])

    return src.select(*keys, "_u", "_v", "_blk", "_bi", "_bj").groupBy(*keys, "_bi", "_bj").applyInPandas(run, schema)


# ---- kernels -------------------------------------------------------------------------------


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 1e-9)


def corr_kernel(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    return {"r": _unit_rows(x.astype(float)) @ _unit_rows(y.astype(float)).T}


def lag_kernel(max_lag: int, min_overlap: int = 3):
    """Correlation of the strongest lag, each lag on its overlap only; lag > 0: a follows b."""

    def kernel(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        x, y = x.astype(float), y.astype(float)
        t = x.shape[1]
        best = np.full((len(x), len(y)), np.nan)
        lag = np.full((len(x), len(y)), -1, dtype=np.int64)
        zero = best
        # nearest lags first, so that of equal strengths the smallest shift wins
        for s in sorted(range(-max_lag, max_lag + 1), key=lambda s: (abs(s), s)):
            if t - abs(s) < min_overlap:
                continue
            a, b = (x[:, s:], y[:, : t - s]) if s >= 0 else (x[:, : t + s], y[:, -s:])
            r = _unit_rows(a) @ _unit_rows(b).T
            if s == 0:
                zero = r
            better = np.where(np.isnan(best), ~np.isnan(r), np.abs(r) > np.abs(best) + 1e-9)
            best = np.where(better, r, best)
            lag = np.where(better, s, lag)
        return {"r0": zero, "r_best": best, "lag": lag}

    return kernel


def binary_mi_kernel(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Mutual information in bits of 0/1 flags (unknown: 0), with the joint and single counts."""
    x, y = np.nan_to_num(x.astype(float)), np.nan_to_num(y.astype(float))
    t = x.shape[1]
    n11 = x @ y.T
    na = np.repeat(x.sum(1)[:, None], len(y), 1)
    nb = np.repeat(y.sum(1)[None, :], len(x), 0)
    mi = np.zeros_like(n11)
    for n, pa, pb in (
        (n11, na, nb), (na - n11, na, t - nb), (nb - n11, t - na, nb), (t - na - nb + n11, t - na, t - nb)
    ):
        ok = n > 0.5
        p = np.where(ok, n / t, 1.0)
        base = np.where(ok, (pa / t) * (pb / t), 1.0)
        mi += np.where(ok, p * np.log2(p / base), 0.0)
    return {"mi": mi, "n_both": n11.astype(np.int64)}


def coactive_corr_kernel(thr: float, min_frames: int):
    """Correlation over the frames where both exceed ``thr``; 0 with fewer than ``min_frames`` of them."""

    def kernel(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        x, y = x.astype(float), y.astype(float)
        mx, my = (x > thr).astype(float), (y > thr).astype(float)
        xa, ya = x * mx, y * my
        n = mx @ my.T
        sx, sy = xa @ my.T, mx @ ya.T
        sxx, syy, sxy = (xa * xa) @ my.T, mx @ (ya * ya).T, xa @ ya.T
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = sxy / n - (sx / n) * (sy / n)
            vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
            r = cov / np.sqrt(vx * vy)
        r = np.where((n >= min_frames) & (vx > 1e-12) & (vy > 1e-12), r, 0.0)
        return {"r": r, "n_both": n.astype(np.int64)}

    return kernel


# ---- operators -----------------------------------------------------------------------------


def pair_corr(traces: DataFrame, keys, unit, t, v, block: int = BLOCK) -> DataFrame:
    """``keys, a, b, r``: Pearson r of every unit pair; NULL for a constant trace."""
    keys = list(keys)
    return block_pairs(pack(traces, [*keys, unit], t, v), keys, unit, "trace", corr_kernel,
                       {"r": "double"}, block=block)


def duplicate_traces(traces: DataFrame, keys, unit, t, v, thr: float = 0.92, block: int = BLOCK) -> DataFrame:
    """Pairs whose correlation exceeds ``thr``; the others are dropped inside the task."""
    keys = list(keys)
    return block_pairs(pack(traces, [*keys, unit], t, v), keys, unit, "trace", corr_kernel, {"r": "double"},
                       keep=lambda m: np.nan_to_num(m["r"], nan=-2.0) > thr, block=block)


def best_lag_corr(traces: DataFrame, keys, unit, t, v, max_lag: int, block: int = BLOCK) -> DataFrame:
    """``keys, a, b, r0, r_best, lag`` over lags −L…L."""
    keys = list(keys)
    return block_pairs(pack(traces, [*keys, unit], t, v), keys, unit, "trace", lag_kernel(max_lag),
                       {"r0": "double", "r_best": "double", "lag": "bigint"}, block=block)


def binary_mi(flags: DataFrame, keys, unit, t, flag, block: int = BLOCK) -> DataFrame:
    keys = list(keys)
    return block_pairs(pack(flags, [*keys, unit], t, flag), keys, unit, "trace", binary_mi_kernel,
                       {"mi": "double", "n_both": "bigint"}, block=block)


def coactive_corr(traces: DataFrame, keys, unit, t, v, thr: float, min_frames: int = 10,
                  block: int = BLOCK) -> DataFrame:
    keys = list(keys)
    return block_pairs(pack(traces, [*keys, unit], t, v), keys, unit, "trace",
                       coactive_corr_kernel(thr, min_frames), {"r": "double", "n_both": "bigint"}, block=block)


def coactivation_index(flags: DataFrame, keys, unit, t, flag, block: int = BLOCK) -> DataFrame:
    """both / √(n_a·n_b), unknown flags as 0; NULL when one of the units is never active."""

    def kernel(x, y):
        x, y = np.nan_to_num(x.astype(float)), np.nan_to_num(y.astype(float))
        d = np.sqrt(x.sum(1)[:, None] * y.sum(1)[None, :])
        return {"index": np.divide(x @ y.T, d, out=np.full(d.shape, np.nan), where=d > 0)}

    keys = list(keys)
    return block_pairs(pack(flags, [*keys, unit], t, flag), keys, unit, "trace", kernel, {"index": "double"},
                       block=block)


def mean_pair_corr(traces: DataFrame, keys, unit, t, v) -> DataFrame:
    """Mean r over all pairs without forming a pair: Σ_{i≠j} r = Σ_t (Σ_i z)²/T − N."""
    keys = list(keys)
    m = traces.groupBy(*keys, unit).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s")).filter("_s > 1e-9")
    z = traces.join(m, [*keys, unit]).withColumn("_z", (F.col(v) - F.col("_m")) / F.col("_s"))
    per_t = z.groupBy(*keys, t).agg(F.sum("_z").alias("_zs"), F.count(F.lit(1)).alias("_n"))
    s = per_t.groupBy(*keys).agg(
        F.sum(F.col("_zs") * F.col("_zs")).alias("_ss"), F.max("_n").alias("n_units"),
        F.count(F.lit(1)).alias("_t"))
    n = F.col("n_units")
    return s.select(*keys, n, F.when(n > 1, (F.col("_ss") / F.col("_t") - n) / (n * (n - 1))).alias("mean_r"))


def participation_ratio(traces: DataFrame, keys, unit, t, v, block: int = BLOCK) -> DataFrame:
    """(Σλ)²/Σλ² of the unit correlation matrix from its entries: N²/(N + 2Σ_{a<b} r²)."""
    keys = list(keys)
    r = pair_corr(traces, keys, unit, t, v, block).filter(F.col("r").isNotNull())
    s = r.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("_s2"), F.count(F.lit(1)).alias("n_pairs"))
    n = (1 + F.sqrt(1 + 8 * F.col("n_pairs"))) / 2
    return s.select(*keys, F.round(n).cast("long").alias("n_units"),
                    (n * n / (n + 2 * F.col("_s2"))).alias("pr"),
                    (n / (n + 2 * F.col("_s2"))).alias("pr_per_unit"))


def corr_degree(pairs: DataFrame, keys, thr: float = 0.5) -> DataFrame:
    """Number of partners with abs(r) > thr per unit."""
    hit = F.abs(F.col("r")) > thr
    ends = pairs.select(*keys, F.explode(F.array("a", "b")).alias("unit"), F.coalesce(hit, F.lit(False)).alias("_h"))
    return ends.groupBy(*keys, "unit").agg(F.sum(F.col("_h").cast("long")).alias("degree"))


def cross_correlogram(x: DataFrame, y: DataFrame, keys, t, vx, vy, max_lag: int) -> DataFrame:
    """r per lag on the overlap: ``x`` at t against ``y`` at t − lag. Both series travel packed; lags leave a task as rows."""
    keys = list(keys)
    on = [k for k in keys if k in y.columns]
    extra = [c for c in y.columns if c not in keys and c not in (t, vy)]

    def series(df: DataFrame, by: list[str], v: str, side: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col(t).cast("long").alias("t"), F.col(v).cast("double").alias("v"))))
        return df.groupBy(*by).agg(rows.alias("_s")).select(*by, F.col("_s.t").alias(f"_t{side}"), F.col("_s.v").alias(f"_v{side}"))

    a, b = series(x, keys, vx, "x"), series(y, [*on, *extra], vy, "y")
    j = a.join(b, on)
    names = [*keys, *extra]
    schema = T.StructType([*(j.schema[c] for c in names), *T.StructType.fromDDL("lag int, r double, n bigint").fields])

    def correlated(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        ok = ~(np.isnan(p) | np.isnan(q))
        n = np.maximum(ok.sum(1), 1)

        def centred(v: np.ndarray) -> np.ndarray:
            v = np.where(ok, v, 0.0)
            return np.where(ok, v - (v.sum(1) / n)[:, None], 0.0)

        p, q = centred(p), centred(q)
        sp, sq = (p * p).sum(1) / n, (q * q).sum(1) / n
        return np.divide((p * q).sum(1) / n, np.sqrt(sp * sq), out=np.full(len(p), np.nan), where=(sp > 1e-18) & (sq > 1e-18))

    def run(batches):
        for pdf in (b.iloc[lo : lo + BLOCK] for b in batches for lo in range(0, len(b), BLOCK)):
            # rows on the same frames are worked on together
            frames = [(u.tobytes(), w.tobytes()) for u, w in zip(pdf["_tx"], pdf["_ty"])]
            for _, g in pdf.groupby(pd.factorize(pd.Series(frames, index=pdf.index))[0]):
                tx, ty = g["_tx"].iloc[0], g["_ty"].iloc[0]
                p, q = (np.stack(g[c].to_numpy()).astype(float) for c in ("_vx", "_vy"))
                for lag in range(-max_lag, max_lag + 1):
                    first, last = np.searchsorted(ty, tx - lag, side="left"), np.searchsorted(ty, tx - lag, side="right")
                    i, k = ragged(first, last - first)
                    if not len(i):
                        continue
                    out = g[names].copy()
                    r = pd.Series(correlated(p[:, i], q[:, k]), index=g.index)
                    out["lag"], out["r"], out["n"] = lag, r.astype(object).where(r.notna(), None), len(i)
                    yield out

    return j.mapInPandas(run, schema)


def peak_lag(ccg: DataFrame, keys) -> DataFrame:
    """Strongest lag of a correlogram; of equal strengths the smaller shift, then the earlier."""
    keys = list(keys)
    order = F.struct(F.round(F.abs("r"), 9), -F.abs(F.col("lag")), -F.col("lag"))
    return ccg.filter(F.col("r").isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct("lag", "r"), order).alias("_b")).select(*keys, "_b.lag", "_b.r")


def pair_geometry(units: DataFrame, keys, unit, depth, lat, z, um=(1.0, 1.0, 1.0)) -> DataFrame:
    """Distances of unit pairs from centroids: 3-D, depth gap, lateral; column and row classes."""
    p = unit_pairs(units, keys, unit, [depth, lat, z])
    dd = (F.col(f"{depth}_a") - F.col(f"{depth}_b")) * um[1]
    dl = (F.col(f"{lat}_a") - F.col(f"{lat}_b")) * um[2]
    dz = (F.col(f"{z}_a") - F.col(f"{z}_b")) * um[0]
    return p.select(
        *keys, "a", "b",
        F.sqrt(dd * dd + dl * dl + dz * dz).alias("dist_um"),
        F.abs(dd).alias("ddepth_um"),
        F.sqrt(dl * dl + dz * dz).alias("dlat_um"),
    )


def grid_near_pairs(points: DataFrame, keys, unit, xyz: Sequence[str], radius: float) -> DataFrame:
    """Pairs closer than ``radius`` by grid cells of that size and their neighbours.

    Only the cell is a join key, so the candidates are those of 27 cells. Both sides are shuffled by it: the size of a table
    says nothing of its rows once each stands in every neighbouring cell, and as a broadcast they all pass through the driver.
    """
    keys = list(keys)
    cells = [F.floor(F.col(c) / radius).cast("long").alias(f"_g{i}") for i, c in enumerate(xyz)]
    base = points.select(*keys, F.col(unit).alias("_u"), *[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(xyz)],
                         *cells)
    a = base.withColumnRenamed("_u", "a")
    steps = F.sequence(F.lit(-1), F.lit(1))
    for i in range(len(xyz)):
        a = a.withColumn("_d", F.explode(steps)).withColumn(f"_g{i}", F.col(f"_g{i}") + F.col("_d")).drop("_d")
    a = a.select(*keys, "a", *[F.col(f"_p{i}").alias(f"_q{i}") for i in range(len(xyz))],
                 *[f"_g{i}" for i in range(len(xyz))])
    j = a.hint("merge").join(base.withColumnRenamed("_u", "b"), [*keys, *[f"_g{i}" for i in range(len(xyz))]])
    d2 = sum(((F.col(f"_p{i}") - F.col(f"_q{i}")) ** 2 for i in range(len(xyz))), F.lit(0.0))
    return j.filter((F.col("a") < F.col("b")) & (d2 < radius * radius)).select(
        *keys, "a", "b", F.sqrt(d2).alias("dist"))
