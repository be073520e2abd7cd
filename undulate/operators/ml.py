"""Factor, encoding and clustering models.

A recording has many units but few frames, so its linear models are solved in
frame space: the T×T Gram matrix Σ_units x xᵀ is a sum that tasks compute on
whatever units they hold, and it determines principal components, held-out
residuals, ridge predictions from all other units and ridge precision entries.
Units are then processed in hashed blocks against that small matrix. Pooled
models use MLlib.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undulate.operators.blocks import group_starts, whole_groups, with_columns
from undulate.operators.pairs import block_pairs, pack

BLOCK = 512
ROWS = 64
SPECTRA = 1 << 13  # units of whole recordings of which a task works out spectra together
HELD = 16 << 20  # bytes of partial Gram matrices that a task holds


def _ddl(df: DataFrame, cols) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def fold_edges(n_frames: int, k: int, longer_first: bool = False) -> list[int]:
    """Where blocks of frames begin: at floors of even shares, or with the longer blocks first."""
    if longer_first:
        return [i * (n_frames // k) + min(i, n_frames % k) for i in range(k + 1)]
    return [i * n_frames // k for i in range(k + 1)]


def _standardise(x: np.ndarray, train: np.ndarray, scale: bool) -> np.ndarray:
    mu = x[:, train].mean(1, keepdims=True)
    if not scale:
        return x - mu
    sd = x[:, train].std(1, keepdims=True)
    return (x - mu) / np.where(sd < 1e-9, 1.0, sd)


def _masks(n_frames: int, folds: int, longer_first: bool = False) -> list[tuple[int, np.ndarray]]:
    """(fold, train mask); fold −1 = all frames when no folds are asked for."""
    if not folds:
        return [(-1, np.ones(n_frames, bool))]
    e = fold_edges(n_frames, folds, longer_first)
    out = []
    for f in range(folds):
        m = np.ones(n_frames, bool)
        m[e[f]:e[f + 1]] = False
        out.append((f, m))
    return out


def frame_gram(packed: DataFrame, run_keys: Sequence[str], trace: str, n_frames: int, folds: int = 0,
               scale: bool = True, longer_first: bool = False) -> DataFrame:
    """Rows of Σ_units x xᵀ per run and fold: ``run_keys, fold, i, row, total, n_units`` (total = Σ_units x_i).

    x is standardised with the fold's training frames. A task adds up the units
    of its batches, for few runs at a time however many a batch has; partial rows are then summed per (run, fold, i).
    """
    run_keys = list(run_keys)
    schema = _ddl(packed, run_keys) + ", fold int, i int, row array<double>, total double, n_units bigint"
    most = max(1, HELD // (8 * n_frames * (n_frames + 1)))

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(run_keys, sort=False):
                x = np.stack(g[trace].to_numpy()).astype(float)
                for f, m in _masks(n_frames, folds, longer_first):
                    z = _standardise(x, m, scale)
                    s = acc.setdefault((key, f), [np.zeros((n_frames, n_frames)), np.zeros(n_frames), 0])
                    s[0] += z.T @ z
                    s[1] += z.sum(0)
                    s[2] += len(z)
                if len(acc) >= most:
                    yield from flush(acc)
                    acc = {}
        yield from flush(acc)

    def flush(acc):
        for (key, f), (g, tot, n) in acc.items():
            d = {c: v for c, v in zip(run_keys, key if isinstance(key, tuple) else (key,))}
            yield pd.DataFrame({**{c: [v] * n_frames for c, v in d.items()}, "fold": f, "i": range(n_frames), "row": list(g), "total": tot, "n_units": n})

    def total(pdf):
        # partial rows of up to ROWS frames; one addition per task that held the run
        i = pdf["i"].to_numpy()
        ids, at = np.unique(i, return_inverse=True)
        rows, tot, n = np.zeros((len(ids), n_frames)), np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
        np.add.at(rows, at, np.stack(pdf["row"].to_numpy()))
        np.add.at(tot, at, pdf["total"].to_numpy())
        np.add.at(n, at, pdf["n_units"].to_numpy())
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(ids) for c in run_keys}, "fold": pdf["fold"].iloc[0], "i": ids,
                             "row": list(rows), "total": tot, "n_units": n})

    parts = packed.mapInPandas(partial, schema).withColumn("_ib", F.floor(F.col("i") / ROWS))
    return parts.groupBy(*run_keys, "fold", "_ib").applyInPandas(total, schema)


def run_pca(packed: DataFrame, run_keys, trace: str, n_frames: int, k: int, scale: bool = True) -> DataFrame:
    """Leading k temporal components per run: ``pc, eigenvalue, frac, n_units, vec`` (unit norm, sign by its largest entry)."""
    run_keys = list(run_keys)
    g = frame_gram(packed, run_keys, trace, n_frames, 0, scale)
    schema = _ddl(packed, run_keys) + ", pc int, eigenvalue double, frac double, n_units bigint, vec array<double>"

    def solve(pdf):
        m = np.stack(pdf.sort_values("i")["row"].to_numpy())
        w, u = np.linalg.eigh(m)
        w, u = w[::-1], u[:, ::-1]
        rows = []
        for p in range(min(k, len(w))):
            v = u[:, p]
            v = v * np.sign(v[np.argmax(np.abs(np.round(v, 9)))])
            rows.append({**{c: pdf[c].iloc[0] for c in run_keys}, "pc": p + 1, "eigenvalue": w[p] / n_frames,
                         "frac": w[p] / w.sum(), "n_units": pdf["n_units"].iloc[0], "vec": v})
        return pd.DataFrame(rows)

    return g.groupBy(*run_keys).applyInPandas(solve, schema)


def loadings(packed: DataFrame, pcs: DataFrame, run_keys, unit: str, trace: str) -> DataFrame:
    """Correlation of each unit's trace with each temporal component: ``unit, pc, loading``."""
    from undulate.functions.scalar import array_mean, dot

    j = packed.join(pcs.select(*run_keys, "pc", "vec"), list(run_keys)).withColumn("_m", array_mean(trace))
    x = F.transform(trace, lambda v: v - F.col("_m"))
    j = j.withColumn("_x", x)
    n = F.sqrt(dot("_x", "_x"))
    return j.select(*run_keys, unit, "pc", (dot("_x", "vec") / F.when(n > 1e-9, n)).alias("loading"))


def pcs_above_null(traces: DataFrame, run_keys, unit: str, t: str, v: str, n_frames: int, k: int, n_shift: int,
                   min_shift: int) -> DataFrame:
    """Number of leading components whose eigenvalue exceeds the largest one of every unit-wise shifted surrogate.

    The units of a recording of one block meet in a task, which shifts them and gives on the result only. Gram matrices
    travel for recordings of several blocks alone.
    """
    from undulate.operators.nulls import shift_amount

    run_keys = list(run_keys)
    packed = pack(traces, [*run_keys, unit], t, v, "x").withColumn("_s", shift_amount(F.lit(0), F.col(unit), n_frames, min_shift).cast("int"))
    n = traces.select(*run_keys, unit).distinct().groupBy(*run_keys).agg(F.count(F.lit(1)).alias("_n"))
    big = n.filter(F.col("_n") > BLOCK).select(*run_keys)
    if big.isEmpty():
        return _spectra(packed, run_keys, n_frames, k, n_shift, min_shift)
    few = _spectra(packed.join(big, run_keys, "left_anti"), run_keys, n_frames, k, n_shift, min_shift)
    many = packed.join(big, run_keys, "left_semi")
    obs = run_pca(many, run_keys, "x", n_frames, k)
    s = many.withColumn("shift_id", F.explode(F.sequence(F.lit(0), F.lit(n_shift - 1))))
    amt = shift_amount(F.col("shift_id"), F.col(unit), n_frames, min_shift).cast("int")
    s = s.withColumn("x", F.concat(F.slice("x", n_frames - amt + 1, amt), F.slice("x", F.lit(1), n_frames - amt)))
    null = run_pca(s, [*run_keys, "shift_id"], "x", n_frames, 1)
    top = null.groupBy(*run_keys).agg(F.max("eigenvalue").alias("null_max"))
    out = obs.join(top, run_keys).groupBy(*run_keys, "null_max").agg(
        F.sum((F.col("eigenvalue") > F.col("null_max") + 1e-9).cast("long")).alias("n_pcs"), F.max("frac").alias("pc1_frac"))
    return few.unionByName(out)


def _spectra(units: DataFrame, run_keys, n_frames: int, k: int, n_shift: int, min_shift: int) -> DataFrame:
    """``n_pcs, pc1_frac, null_max`` of recordings that fit into a task; ``_s`` is a unit's shift in the first surrogate."""
    import pyarrow as pa

    schema = _ddl(units, run_keys) + ", null_max double, n_pcs long, pc1_frac double"
    span, every = n_frames - 2 * min_shift, np.arange(n_frames)

    def eigenvalues(z: np.ndarray) -> np.ndarray:
        """Of many recordings of as many units, ascending; on the side with fewer rows, which has the same ones but zeros."""
        g = z @ z.transpose(0, 2, 1) if z.shape[1] < n_frames else z.transpose(0, 2, 1) @ z
        return np.linalg.eigvalsh(g) / n_frames

    def run(batches):
        for t in whole_groups(batches, run_keys, SPECTRA):
            first = np.flatnonzero(group_starts(t, run_keys))
            size = np.diff(np.r_[first, t.num_rows])
            x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_frames)
            z, shift = _standardise(x, np.ones(n_frames, bool), True), t.column("_s").to_numpy()
            for n in np.unique(size):
                own = first[size == n]
                at = own[:, None] + np.arange(n)
                w = eigenvalues(z[at])
                null = np.zeros(len(own))
                for i in range(n_shift):
                    s = min_shift + (shift - min_shift + 7 * i) % span
                    null = np.maximum(null, eigenvalues(np.take_along_axis(z, (every - s[:, None]) % n_frames, 1)[at])[:, -1])
                total = w.sum(1)
                keys = t.select(run_keys).take(pa.array(own)).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [*(c.chunk(0) for c in keys.columns), pa.array(null), pa.array((w[:, -k:] > null[:, None] + 1e-9).sum(1).astype(np.int64)),
                     pa.array(w[:, -1] / np.where(total > 0, total, np.nan))], names=[*run_keys, "null_max", "n_pcs", "pc1_frac"])

    return units.repartition(*run_keys).sortWithinPartitions(*run_keys).select(*run_keys, "x", "_s").mapInArrow(run, schema)


def _blocks(packed: DataFrame, run_keys, unit: str) -> tuple[DataFrame, DataFrame]:
    n = packed.groupBy(*run_keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_nb"))
    units = packed.join(n, list(run_keys)).withColumn("_blk", F.pmod(F.xxhash64(unit), F.col("_nb")).cast("int"))
    return units, n.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))


def _blocks_and_gram(packed: DataFrame, run_keys, unit: str, trace: str, n_frames: int, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units in blocks, the blocks, and the Gram rows beside each block of the recordings that have several.

    The units of any other recording meet in one task, which adds them up itself: see :func:`_gram_of`.
    """
    units, blocks = _blocks(packed, run_keys, unit)
    gram = frame_gram(units.filter("_nb > 1").drop("_nb", "_blk"), run_keys, trace, n_frames, **how)
    return units.drop("_nb"), blocks.drop("_nb"), blocks.filter("_nb > 1").drop("_nb").join(gram, run_keys)


def _gram_of(x: np.ndarray, m: pd.DataFrame, fold: int, train: np.ndarray, scale: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(Gram matrix, sum of units, number of units) of a fold: from the rows of the recording, or, if there are none, its units x."""
    g = m[m["fold"] == fold].sort_values("i")
    if len(g):
        return np.stack(g["row"].to_numpy()), g["total"].to_numpy(), int(g["n_units"].iloc[0])
    z = _standardise(x, train, scale)
    return z.T @ z, z.sum(0), len(z)


def _right(df: DataFrame, run_keys) -> DataFrame:
    """The run-level side of a cogroup, its keys under new names (both sides stem from one table)."""
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*run_keys, "_blk"])],
                     *[F.col(c).alias(c) for c in df.columns if c not in run_keys and c != "_blk"])


def _cogroup(units: DataFrame, side: DataFrame, run_keys, fn, schema: str) -> DataFrame:
    r = _right(side, run_keys)
    ks = [f"_k{i}" for i in range(len(run_keys) + 1)]
    return units.groupBy(*run_keys, "_blk").cogroup(r.groupBy(*ks)).applyInPandas(lambda a, b: fn(a, b), schema)


def _held_out(x: np.ndarray, gram, ks: list[int], n_frames: int, folds: int) -> dict[int, np.ndarray]:
    """Residuals of the units x for each k; ``gram(fold, train)`` gives the recording's Gram matrix, its sum of units and their number."""
    e, res = fold_edges(n_frames, folds, longer_first=True), {}
    for f, train in _masks(n_frames, folds, longer_first=True):
        kk, _, n = gram(f, train)
        z = _standardise(x, train, False)
        te = slice(e[f], e[f + 1])
        w, q = np.linalg.eigh(kk[np.ix_(train, train)])
        w, q = w[::-1], q[:, ::-1]
        for k in ks:
            if k >= max(n, 1):
                continue
            r = z[:, te]
            good = w[:k] > 1e-9 * max(w[0], 1e-300)
            if k and good.any():
                uk = q[:, :k][:, good]
                r = r - (z[:, train] @ (uk / w[:k][good])) @ uk.T @ kk[te][:, train].T
            res.setdefault(k, np.zeros_like(x))[:, te] = r
    return res


def cv_residuals(packed: DataFrame, run_keys, unit: str, trace: str, n_frames: int, ks: Sequence[int], folds: int = 5) -> DataFrame:
    """Blocked cross-validated residuals: every frame is held out once and centred with the training mean.

    ``run_keys, unit, k, resid`` (array over frames). k components of the
    training frames give, in frame space, the n_test × n_train matrix
    K_te,tr U S⁻² Uᵀ applied to the unit's training trace. k goes up to the number of units less one.
    """
    run_keys = list(run_keys)
    ks = list(ks)
    units, _, g = _blocks_and_gram(packed, run_keys, unit, trace, n_frames, folds=folds, scale=False, longer_first=True)
    schema = _ddl(packed, [*run_keys, unit]) + ", k int, resid array<double>"

    def run(u: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if u.empty:
            return pd.DataFrame({c: [] for c in [*run_keys, unit, "k", "resid"]})
        x = np.stack(u[trace].to_numpy()).astype(float)
        res = _held_out(x, lambda f, train: _gram_of(x, m, f, train, False), ks, n_frames, folds)
        out = []
        for k in res:
            o = u[[*run_keys, unit]].copy()
            o["k"], o["resid"] = k, list(res[k])
            out.append(o)
        return pd.concat(out)

    return _cogroup(units, g, run_keys, run, schema)


def kstar(residuals: DataFrame, run_keys, unit: str, n_frames: int, n_shift: int, min_shift: int, tol: float = 0.01,
          q: float = 0.995) -> DataFrame:
    """Per k: explained variance, mean abs(r) of residual pairs, share beyond the shifted null's quantile; and k*, the
    least k whose share is within ``tol`` of the null's own rate 1 − q.
    """
    from undulate.operators.nulls import shift_amount
    from undulate.operators.pairs import corr_kernel
    from undulate.operators.ranks import exact_quantiles

    run_keys = list(run_keys)
    keys = [*run_keys, "k"]
    obs = block_pairs(residuals, keys, unit, "resid", corr_kernel, {"r": "double"}).withColumn("ar", F.abs("r"))
    s = residuals.withColumn("shift_id", F.explode(F.sequence(F.lit(0), F.lit(n_shift - 1))))
    amt = shift_amount(F.col("shift_id"), F.col(unit), n_frames, min_shift).cast("int")
    s = s.withColumn("resid", F.concat(F.slice("resid", n_frames - amt + 1, amt), F.slice("resid", F.lit(1), n_frames - amt)))
    null = block_pairs(s, [*keys, "shift_id"], unit, "resid", corr_kernel, {"r": "double"}).withColumn("ar", F.abs("r"))
    thr = exact_quantiles(null, keys, "ar", {"thr": q})
    g = obs.join(thr, keys).groupBy(*keys).agg(
        F.avg("ar").alias("mean_abs_r"), F.avg((F.col("ar") > F.col("thr")).cast("double")).alias("frac_sig"))
    ss = residuals.select(*keys, F.aggregate("resid", F.lit(0.0), lambda a, x: a + x * x).alias("_ss")).groupBy(*keys).agg(F.sum("_ss").alias("_ss"))
    tot = ss.filter("k = 0").select(*run_keys, F.col("_ss").alias("_tot"))
    g = g.join(ss, keys).join(tot, run_keys).withColumn("var_explained", 1 - F.col("_ss") / F.col("_tot"))
    best = g.groupBy(*run_keys).agg(F.min(F.when(F.col("frac_sig") <= (1 - q) + tol, F.col("k"))).alias("k_star"))
    return g.join(best, run_keys).select(*keys, "var_explained", "mean_abs_r", "frac_sig", "k_star")


def kstar_factors(packed: DataFrame, units: DataFrame, run_keys, unit: str, trace: str, n_frames: int, ks: Sequence[int], folds: int,
                  n_shift: int, min_shift: int, tol: float = 0.01, q: float = 0.995) -> DataFrame:
    """:func:`kstar` of :func:`cv_residuals`. Recordings of one block are worked out in a task, which gives on a row a k only.

    ``units`` lists at least the units of ``packed``; it tells which recordings have several blocks.
    """
    import pyarrow as pa

    from undulate.operators.nulls import shift_amount

    run_keys, ks = list(run_keys), sorted({0, *ks})
    big = units.select(*run_keys, unit).distinct().groupBy(*run_keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK).select(*run_keys)
    none = big.isEmpty()
    few = packed if none else packed.join(big, run_keys, "left_anti")
    few = few.select(*run_keys, F.col(trace).alias("_x"), shift_amount(F.lit(0), F.col(unit), n_frames, min_shift).cast("int").alias("_s"))
    schema = _ddl(packed, run_keys) + ", k int, var_explained double, mean_abs_r double, frac_sig double, k_star int"
    span, every = n_frames - 2 * min_shift, np.arange(n_frames)

    def pairs(x: np.ndarray) -> np.ndarray:
        """abs(r) of all pairs of units, a row a k."""
        z = x - x.mean(2, keepdims=True)
        norm = np.sqrt((z * z).sum(2, keepdims=True))
        z = np.divide(z, norm, out=np.full_like(z, np.nan), where=norm > 1e-9)
        return np.abs(z @ z.transpose(0, 2, 1))[(slice(None), *np.triu_indices(x.shape[1], 1))]

    def solved(x: np.ndarray, shift: np.ndarray) -> list[tuple]:
        def gram(f: int, train: np.ndarray) -> tuple:
            z = _standardise(x, train, False)
            return z.T @ z, z.sum(0), len(z)

        res = _held_out(x, gram, ks, n_frames, folds)
        rows, best, total = [], None, (res[0] ** 2).sum()
        for part in np.array_split(list(res), max(1, len(res) * n_shift * len(x) ** 2 >> 23)):
            r = np.stack([res[k] for k in part])
            at = [(every - (min_shift + (shift - min_shift + 7 * i) % span)[:, None]) % n_frames for i in range(n_shift)]
            null = np.concatenate([pairs(np.take_along_axis(r, np.broadcast_to(a, r.shape), 2)) for a in at], axis=1)
            for k, ar, nl in zip(part, pairs(r), null):
                ar, nl = ar[~np.isnan(ar)], nl[~np.isnan(nl)]
                if not len(ar) or not len(nl):  # no pair of units that vary
                    continue
                sig = float((ar > np.quantile(nl, q)).mean())
                if best is None and sig <= (1 - q) + tol:
                    best = int(k)
                rows.append((int(k), 1 - (res[k] ** 2).sum() / total if total else None, float(ar.mean()), sig))
        return [(*r, best) for r in rows]

    def run(batches):
        for t in whole_groups(batches, run_keys, SPECTRA):
            first = np.flatnonzero(group_starts(t, run_keys))
            x = t.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_frames)
            shift = t.column("_s").to_numpy()
            found = [(lo, *r) for lo, hi in zip(first, np.r_[first[1:], t.num_rows]) for r in solved(x[lo:hi], shift[lo:hi])]
            if found:
                own, k, *values, best = zip(*found)
                yield from with_columns(t, run_keys, np.array(own), **{
                    "k": np.array(k, np.int32), **{n: pa.array(v, pa.float64()) for n, v in zip(("var_explained", "mean_abs_r", "frac_sig"), values)},
                    "k_star": pa.array(best, pa.int32())})

    out = few.repartition(*run_keys).sortWithinPartitions(*run_keys).mapInArrow(run, schema)
    if none:
        return out
    res = cv_residuals(packed.join(big, run_keys, "left_semi"), run_keys, unit, trace, n_frames, ks, folds)
    return out.unionByName(kstar(res, run_keys, unit, n_frames, n_shift, min_shift, tol, q))


def encoding_r2(packed: DataFrame, design: DataFrame, run_keys, unit: str, trace: str, n_frames: int, folds: int = 5,
                alpha: float = 0.1) -> DataFrame:
    """Blocked-CV R² per unit from behaviour, from the mean of the others, from all others, and from both.

    ``design`` is packed per run: ``run_keys, name, series``. Predictions from
    all other units use the kernel form of ridge: with A = K + αI over the
    training frames, a = A⁻¹z and s = zᵀa, leaving the unit itself out gives
    (K_te,tr a − s z_te)/(1 − s). ``unique_behavior`` = both − population.
    """
    run_keys = list(run_keys)
    units, blocks, g = _blocks_and_gram(packed, run_keys, unit, trace, n_frames, folds=folds)
    dsg = blocks.join(design.select(*run_keys, F.lit(-1).alias("fold"), F.dense_rank().over(_by(run_keys, "name")).alias("i"),
                                    F.col("series").cast("array<double>").alias("row"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n_units")), run_keys)
    side = g.unionByName(dsg)
    schema = _ddl(packed, [*run_keys, unit]) + ", r2_behavior double, r2_global double, r2_population double, r2_both double, unique_behavior double"
    e = fold_edges(n_frames, folds)

    def run(u: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if u.empty:
            return pd.DataFrame({c: [] for c in [*run_keys, unit, "r2_behavior", "r2_global", "r2_population", "r2_both", "unique_behavior"]})
        x = np.stack(u[trace].to_numpy()).astype(float)
        d = np.stack(m[m["fold"] == -1].sort_values("i")["row"].to_numpy()).astype(float)
        names = ("behavior", "global", "population", "both")
        res = {n: np.zeros(len(x)) for n in names}
        tot = np.zeros(len(x))
        for f, train in _masks(n_frames, folds):
            k, total, n_units = _gram_of(x, m, f, train, True)
            te = np.zeros(n_frames, bool)
            te[e[f]:e[f + 1]] = True
            z = _standardise(x, train, True)
            ee = _standardise(d, train, True)
            a = alpha * train.sum()
            ke = ee.T @ ee
            y, yt = z[:, train], z[:, te]
            tot += (yt ** 2).sum(1)

            def kernel(kk):
                return np.linalg.solve(kk[np.ix_(train, train)] + a * np.eye(train.sum()), y.T)

            res["behavior"] += ((yt - (ke[np.ix_(te, train)] @ kernel(ke)).T) ** 2).sum(1)
            for name, kk in (("population", k), ("both", k + ke)):
                c = kernel(kk)
                s = np.einsum("nt,tn->n", y, c)[:, None]
                p = ((kk[np.ix_(te, train)] @ c).T - s * yt) / (1 - s)
                res[name] += ((yt - p) ** 2).sum(1)
            g_ = (total[None, :] - z) / max(n_units - 1, 1)
            b = (g_[:, train] * y).sum(1) / ((g_[:, train] ** 2).sum(1) + a)
            res["global"] += ((yt - b[:, None] * g_[:, te]) ** 2).sum(1)
        r2 = {n: 1 - res[n] / np.where(tot < 1e-12, np.nan, tot) for n in names}
        out = u[[*run_keys, unit]].copy()
        for n in names:
            out[f"r2_{n}"] = r2[n]
        out["unique_behavior"] = r2["both"] - r2["population"]
        return out

    return _cogroup(units, side, run_keys, run, schema)


def _by(keys, order):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order)


def restricted_r2(traces_packed: DataFrame, neighbours: DataFrame, run_keys, unit: str, trace: str, n_frames: int, folds: int = 5,
                  alpha: float = 0.1) -> DataFrame:
    """Blocked-CV R² of each unit from its listed predictors (a = target, b = predictor; a bounded number per target)."""
    run_keys = list(run_keys)
    p = neighbours.select(*run_keys, F.col("a").alias(unit), "b").join(
        traces_packed.select(*run_keys, F.col(unit).alias("b"), F.col(trace).alias("_p")), [*run_keys, "b"])
    p = p.groupBy(*run_keys, unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "_p"))), lambda s: s["_p"]).alias("_ps"))
    j = traces_packed.select(*run_keys, unit, F.col(trace).alias("_y")).join(p, [*run_keys, unit])
    schema = _ddl(j, [*run_keys, unit]) + ", n_predictors bigint, r2 double"

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            n, r2 = [], []
            for yv, ps in zip(pdf["_y"], pdf["_ps"]):
                y = np.asarray(yv, float)[None, :]
                x = np.stack([np.asarray(q, float) for q in ps])
                res = tot = 0.0
                e = fold_edges(n_frames, folds)
                for f, train in _masks(n_frames, folds):
                    te = slice(e[f], e[f + 1])
                    ys, xs = _standardise(y, train, True)[0], _standardise(x, train, True)
                    a = xs[:, train] @ xs[:, train].T + alpha * train.sum() * np.eye(len(xs))
                    b = np.linalg.solve(a, xs[:, train] @ ys[train])
                    res += ((ys[te] - b @ xs[:, te]) ** 2).sum()
                    tot += (ys[te] ** 2).sum()
                n.append(len(x))
                r2.append(1 - res / tot if tot > 1e-12 else None)
            out = pdf[[*run_keys, unit]].copy()
            out["n_predictors"], out["r2"] = n, r2
            yield out

    return j.mapInPandas(run, schema)


def partial_corr_network(packed: DataFrame, run_keys, unit: str, trace: str, n_frames: int, alpha: float = 0.1,
                         thr: float | None = None) -> DataFrame:
    """Partial correlations of all unit pairs from the ridge precision matrix (ZᵀZ + αT·I)⁻¹.

    By the Woodbury identity an entry is (δ_ij − w_i·w_j)/α with w = B^½ z and
    B = (αI + ZZᵀ)⁻¹ in frame space, so the pairs are inner products of
    transformed traces. (A sparse penalised path is not built.)
    """
    run_keys = list(run_keys)
    units, _, g = _blocks_and_gram(packed, run_keys, unit, trace, n_frames)
    schema = _ddl(packed, [*run_keys, unit]) + ", w array<double>"

    def run(u, m):
        if u.empty:
            return pd.DataFrame({c: [] for c in [*run_keys, unit, "w"]})
        x = np.stack(u[trace].to_numpy()).astype(float)
        k, _, _ = _gram_of(x, m, -1, np.ones(n_frames, bool), True)
        lam, q = np.linalg.eigh(k)
        b = (q / np.sqrt(np.maximum(lam, 0) + alpha * n_frames)) @ q.T
        z = _standardise(x, np.ones(n_frames, bool), True)
        o = u[[*run_keys, unit]].copy()
        o["w"] = list(z @ b)
        return o

    w = _cogroup(units, g, run_keys, run, schema)

    def kernel(x, y):
        dx, dy = 1 - (x * x).sum(1), 1 - (y * y).sum(1)
        d = np.sqrt(np.maximum(dx[:, None] * dy[None, :], 1e-24))
        return {"partial_r": (x @ y.T) / d}

    keep = None if thr is None else (lambda mats: np.abs(mats["partial_r"]) > thr)
    return block_pairs(w, run_keys, unit, "w", kernel, {"partial_r": "double"}, keep=keep)


def morans_i(points: DataFrame, values: DataFrame, run_keys, unit: str, xyz: Sequence[str], v: str, n_perm: int = 50) -> DataFrame:
    """Spatial autocorrelation with Gaussian weights (σ = median nearest-neighbour distance) and a permutation p.

    Each unit carries its value and the permuted values of its place; block
    pairs return only the quadratic forms.
    """
    from undulate.operators.joins import nearest_k
    from undulate.operators.nulls import label_permutation

    run_keys = list(run_keys)
    x = values.filter(F.col(v).isNotNull()).select(*run_keys, unit, F.col(v).cast("double").alias(v))
    mean = x.groupBy(*run_keys).agg(F.avg(v).alias("_m"), (F.var_pop(v) * F.count(v)).alias("_ss"), F.count(v).alias("_n"))
    perm = label_permutation(x, run_keys, unit, v, n_perm).join(mean, run_keys)
    perm = perm.groupBy(*run_keys, unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", (F.col(v) - F.col("_m")).alias("x")))), lambda s: s["x"]).alias("_p"))
    nn = nearest_k(points, run_keys, unit, xyz, 1)
    sigma = nn.groupBy(*run_keys).agg(F.percentile("dist", 0.5).alias("_sigma"))
    j = points.select(*run_keys, unit, *[F.col(c).cast("double").alias(c) for c in xyz]).join(x, [*run_keys, unit]).join(
        mean, run_keys).join(perm, [*run_keys, unit]).join(sigma, run_keys)
    packed = j.select(*run_keys, unit, F.concat(F.array("_sigma", *xyz, F.col(v) - F.col("_m")), "_p").alias("row"))
    # block pairs of rows; only sums leave a task
    n = packed.groupBy(*run_keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_nb"))
    b = packed.join(n, run_keys).withColumn("_blk", F.pmod(F.xxhash64(unit), F.col("_nb")).cast("int"))
    b = b.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).withColumn("_bi", F.least("_blk", "_o")).withColumn("_bj", F.greatest("_blk", "_o"))
    schema = _ddl(packed, run_keys) + ", rep int, q double, w double"
    dim = len(xyz)

    def run(pdf):
        bi, bj = pdf["_bi"].iloc[0], pdf["_bj"].iloc[0]
        m = np.stack(pdf["row"].to_numpy())
        l, r = m[pdf["_blk"] == bi], m[pdf["_blk"] == bj]
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame({c: [] for c in [*run_keys, "rep", "q", "w"]})
        d2 = ((l[:, None, 1:1 + dim] - r[None, :, 1:1 + dim]) ** 2).sum(2)
        w = np.exp(-d2 / (2 * m[0, 0] ** 2))
        if bi == bj:
            np.fill_diagonal(w, 0.0)
        q = np.einsum("ik,ij,jk->k", l[:, 1 + dim:], w, r[:, 1 + dim:])
        f = 1.0 if bi == bj else 2.0
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(q) for c in run_keys}, "rep": np.arange(len(q)) - 1, "q": f * q, "w": f * w.sum()})

    s = b.groupBy(*run_keys, "_bi", "_bj").applyInPandas(run, schema).groupBy(*run_keys, "rep").agg(F.sum("q").alias("q"), F.sum("w").alias("w"))
    s = s.join(mean, run_keys).withColumn("_i", F.col("_n") / F.col("w") * F.col("q") / F.nullif(F.col("_ss"), F.lit(0.0)))
    o = s.filter("rep = -1").select(*run_keys, F.col("_i").alias("morans_i"))
    return s.filter("rep >= 0").join(o, run_keys).groupBy(*run_keys, "morans_i").agg(
        ((1 + F.sum((F.col("_i") >= F.col("morans_i")).cast("long"))) / (n_perm + 1)).alias("p"), F.avg("_i").alias("null_mean"))


def channel_pca_cross(a: DataFrame, b: DataFrame, run_keys, trace: str, n_frames: int, k: int) -> DataFrame:
    """Correlation of the temporal components of two channels of a run."""
    from undulate.functions.scalar import array_mean

    run_keys = list(run_keys)
    pa = run_pca(a, run_keys, trace, n_frames, k).select(*run_keys, F.col("pc").alias("pc_a"), F.col("vec").alias("_a"))
    pb = run_pca(b, run_keys, trace, n_frames, k).select(*run_keys, F.col("pc").alias("pc_b"), F.col("vec").alias("_b"))
    j = pa.join(pb, run_keys).withColumn("_ma", array_mean("_a")).withColumn("_mb", array_mean("_b"))
    num = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) - n_frames * F.col("_ma") * F.col("_mb")
    va = 1 - n_frames * F.col("_ma") ** 2
    vb = 1 - n_frames * F.col("_mb") ** 2
    return j.select(*run_keys, "pc_a", "pc_b", (num / F.sqrt(va * vb)).alias("r"))


def modularity(pairs: DataFrame, labels: DataFrame, run_keys, w: str = "r") -> DataFrame:
    """Newman modularity of a partition on non-negative pair weights: Σ_c (in_c/m − (deg_c/2m)²)."""
    run_keys = list(run_keys)
    p = pairs.select(*run_keys, "a", "b", F.greatest(F.lit(0.0), F.coalesce(w, F.lit(0.0))).alias("_w"))
    la = labels.select(*run_keys, F.col("unit").alias("a"), F.col("label").alias("_la"))
    lb = labels.select(*run_keys, F.col("unit").alias("b"), F.col("label").alias("_lb"))
    j = p.join(la, [*run_keys, "a"]).join(lb, [*run_keys, "b"])
    m = j.groupBy(*run_keys).agg(F.sum("_w").alias("_mm"), F.sum(F.when(F.col("_la") == F.col("_lb"), F.col("_w")).otherwise(0.0)).alias("_in"))
    ends = j.select(*run_keys, F.explode(F.array("_la", "_lb")).alias("_l"), "_w").groupBy(*run_keys, "_l").agg(F.sum("_w").alias("_d"))
    d2 = ends.groupBy(*run_keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("_d2"), F.count(F.lit(1)).alias("n_clusters"))
    mm = F.nullif(F.col("_mm"), F.lit(0.0))
    return m.join(d2, run_keys).select(*run_keys, "n_clusters", (F.col("_in") / mm - F.col("_d2") / (4 * mm * mm)).alias("modularity"))


def functional_clusters(pairs: DataFrame, units: DataFrame, run_keys, levels: Sequence[float]) -> DataFrame:
    """Single-linkage clusters at several r levels; the level of greatest modularity wins per run.

    (Average linkage is not reproduced; the modularity of each partition is exact.)
    """
    from undulate.operators.graph import components_with_singletons

    run_keys = list(run_keys)
    lv = F.explode(F.array(*[F.lit(x) for x in levels]))
    p = pairs.withColumn("level", lv)
    u = units.withColumn("level", lv)
    c = components_with_singletons(u, p.filter(F.col("r") > F.col("level")), [*run_keys, "level"], "unit", "a", "b").withColumnRenamed("component", "label")
    q = modularity(p, c, [*run_keys, "level"])
    best = q.groupBy(*run_keys).agg(F.max_by("level", F.struct(F.round("modularity", 9), -F.col("level"))).alias("level"))
    return c.join(best, [*run_keys, "level"]).join(q, [*run_keys, "level"])


# ---- pooled models (MLlib) -----------------------------------------------------------------


def nmf_motifs(long: DataFrame, item: str, frame: str, v: str, ranks: Sequence[int], iterations: int = 8, seed: int = 1) -> DataFrame:
    """Non-negative factorisation by alternating least squares; reconstruction error per rank (elbow table)."""
    from pyspark.ml.recommendation import ALS

    out = None
    for k in ranks:
        m = ALS(rank=k, maxIter=iterations, regParam=0.01, nonnegative=True, userCol=item, itemCol=frame, ratingCol=v, seed=seed).fit(long)
        e = m.transform(long).agg(F.avg((F.col(v) - F.col("prediction")) ** 2).alias("mse")).select(F.lit(k).alias("rank"), "mse")
        out = e if out is None else out.unionByName(e)
    return out


def nmf_factors(long: DataFrame, item: str, frame: str, v: str, k: int, iterations: int = 8, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    from pyspark.ml.recommendation import ALS

    m = ALS(rank=k, maxIter=iterations, regParam=0.01, nonnegative=True, userCol=item, itemCol=frame, ratingCol=v, seed=seed).fit(long)
    return m.userFactors, m.itemFactors


def kmeans_best(df: DataFrame, features: Sequence[str], ks: Sequence[int], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Standardised k-means, k by silhouette: (rows with ``cluster``, table of silhouettes)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    prep = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_z", withMean=True)])
    z = prep.fit(df).transform(df)
    ev = ClusteringEvaluator(featuresCol="_z", predictionCol="cluster")
    scores, best = [], None
    for k in ks:
        c = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster").fit(z).transform(z)
        s = ev.evaluate(c)
        scores.append((k, float(s)))
        if best is None or s > best[0]:
            best = (s, c)
    return best[1].drop("_raw", "_z"), df.sparkSession.createDataFrame(scores, "k int, silhouette double")


def mutual_information(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    """Mutual information of two labels and its share of the smaller entropy, from contingency counts."""
    keys = list(keys)
    t = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_n"))
    ra = t.groupBy(*keys, a).agg(F.sum("_n").alias("_ra"))
    rb = t.groupBy(*keys, b).agg(F.sum("_n").alias("_rb"))
    n = t.groupBy(*keys).agg(F.sum("_n").alias("_tot"))
    N = F.col("_tot")
    j = t.join(ra, [*keys, a]).join(rb, [*keys, b]).join(n, keys)
    mi = j.groupBy(*keys).agg(F.sum(F.col("_n") / N * F.log(F.col("_n") * N / (F.col("_ra") * F.col("_rb")))).alias("mi"))
    ha = ra.join(n, keys).groupBy(*keys).agg((-F.sum(F.col("_ra") / N * F.log(F.col("_ra") / N))).alias("_ha"))
    hb = rb.join(n, keys).groupBy(*keys).agg((-F.sum(F.col("_rb") / N * F.log(F.col("_rb") / N))).alias("_hb"))
    return mi.join(ha, keys).join(hb, keys).select(*keys, "mi", (F.col("mi") / F.nullif(F.least("_ha", "_hb"), F.lit(0.0))).alias("nmi"))


def gmm_bic(df: DataFrame, v: str, ks: Sequence[int], seed: int = 1) -> DataFrame:
    """Gaussian mixtures of one feature by BIC, with the cut-off at the density minimum between two components."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=[v], outputCol="_f").transform(df.select(v).dropna())
    n = x.count()
    rows = []
    if 1 in ks:
        s = df.agg(F.avg(v).alias("m"), F.var_pop(v).alias("s")).first()
        ll = float(-0.5 * n * (np.log(2 * np.pi * s["s"]) + 1))
        rows.append((1, ll, float(2 * np.log(n) - 2 * ll), None))
    for k in [k for k in ks if k > 1]:
        m = GaussianMixture(k=k, seed=seed, featuresCol="_f", maxIter=50).fit(x)
        cut = None
        if k == 2:
            comp = sorted((float(g.mean[0]), float(g.cov.toArray()[0, 0]), float(w)) for g, w in zip(m.gaussians, m.weights))
            grid = np.linspace(comp[0][0], comp[1][0], 201)
            dens = sum(w * np.exp(-0.5 * (grid - mu) ** 2 / s) / np.sqrt(2 * np.pi * s) for mu, s, w in comp)
            cut = float(grid[int(np.argmin(dens))])
        ll = float(m.summary.logLikelihood)
        rows.append((k, ll, float((3 * k - 1) * np.log(n) - 2 * ll), cut))
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double, cutoff double")


def classifier_scores(df: DataFrame, features: Sequence[str], label: str, fold: str, n_folds: int, seed: int = 1):
    """Cross-validated AUC of three classifiers on given folds and the best one refitted on all rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    prep = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    models = {
        "logistic": LogisticRegression(labelCol=label, maxIter=50, regParam=0.01),
        "forest": RandomForestClassifier(labelCol=label, numTrees=30, maxDepth=5, seed=seed),
        "boosted": GBTClassifier(labelCol=label, maxIter=10, maxDepth=3, seed=seed),
    }
    ev = BinaryClassificationEvaluator(labelCol=label)
    df = df.cache()
    rows = []
    for name, m in models.items():
        for f in range(n_folds):
            fit = Pipeline(stages=[*prep, m]).fit(df.filter(F.col(fold) != f))
            rows.append((name, f, float(ev.evaluate(fit.transform(df.filter(F.col(fold) == f))))))
    best = max(models, key=lambda n: np.mean([r[2] for r in rows if r[0] == n]))
    table = df.sparkSession.createDataFrame(rows, "model string, fold int, auc double")
    return table, Pipeline(stages=[*prep, models[best]]).fit(df)


def score_units(model, df: DataFrame, ident: Sequence[str], keep: float = 0.5) -> DataFrame:
    """Probability of the positive class and the keep decision."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array(F.col("probability"))[1]
    return model.transform(df).select(*ident, p.alias("score"), (p > keep).alias("keep"))
