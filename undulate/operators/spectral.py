"""Spectra and coherence as sums over Welch segments.

Every segment of a packed trace is detrended, windowed and projected on the
few frequencies of interest inside one task; cross-spectra of two series are
products of those coefficients. Averages over segments and bands are ordinary
aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undulate.operators.pairs import pack


def segment_starts(n_frames: int, seg: int, overlap: float = 0.5) -> list[int]:
    step = max(1, int(seg * (1 - overlap)))
    return list(range(0, n_frames - seg + 1, step))


def segment_coefficients(x: np.ndarray, seg: int, bins: list[int], overlap: float = 0.5) -> np.ndarray:
    """(n, T) → (n, segments, bins) complex: linear detrend, Hann, DFT at the listed bins."""
    n_t = x.shape[1]
    k = np.arange(seg)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * k / seg)
    kc = k - k.mean()
    basis = np.exp(-2j * np.pi * np.outer(k, bins) / seg) * hann[:, None]
    out = []
    for s in segment_starts(n_t, seg, overlap):
        w = x[:, s:s + seg]
        w = w - w.mean(1, keepdims=True)
        w = w - ((w * kc).sum(1) / (kc * kc).sum())[:, None] * kc
        out.append(w @ basis)
    return np.stack(out, axis=1)


def welch_coherence(a: DataFrame, b: DataFrame, run_keys, a_key: str, b_key: str, t: str, va: str, vb: str,
                    seg: int, bins: list[int], overlap: float = 0.5) -> DataFrame:
    """Coherence, phase and cross-spectrum of each a with each b of its recording, per frequency bin.

    ``keys, a_key, b_key, bin, coh, re, im`` — ``re``/``im`` of the mean cross-spectrum.
    """
    run_keys = list(run_keys)
    x = pack(a, [*run_keys, a_key], t, va, "_x")
    y = pack(b, [*run_keys, b_key], t, vb, "_y")
    j = x.join(y, run_keys)
    cols = [c for c in j.columns if c not in ("_x", "_y")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in j.schema.fields if f.name in cols)
    schema += ", bin bigint, coh double, re double, im double"

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            fx = segment_coefficients(np.stack(pdf["_x"].to_numpy()).astype(float), seg, bins, overlap)
            fy = segment_coefficients(np.stack(pdf["_y"].to_numpy()).astype(float), seg, bins, overlap)
            sxy = (np.conj(fx) * fy).mean(1)
            sxx, syy = (abs(fx) ** 2).mean(1), (abs(fy) ** 2).mean(1)
            d = sxx * syy
            coh = np.divide(abs(sxy) ** 2, d, out=np.full(d.shape, np.nan), where=d > 1e-18)
            for i, k in enumerate(bins):
                o = pdf[cols].copy()
                o["bin"], o["coh"], o["re"], o["im"] = k, coh[:, i], sxy[:, i].real, sxy[:, i].imag
                yield o

    return j.mapInPandas(run, schema).withColumn("coh", F.when(~F.isnan("coh"), F.col("coh")))


def coherence_null(a, b, run_keys, a_key, b_key, t, va, vb, seg: int, bins: list[int], shifts: list[int],
                   overlap: float = 0.5, q: float = 0.95) -> DataFrame:
    """Band-mean coherence against rolled b: ``coh, p, excess, null_mean, null_q``."""
    run_keys = list(run_keys)
    x = pack(a, [*run_keys, a_key], t, va, "_x")
    y = pack(b, [*run_keys, b_key], t, vb, "_y")
    j = x.join(y, run_keys)
    cols = [c for c in j.columns if c not in ("_x", "_y")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in j.schema.fields if f.name in cols)
    schema += ", coh double, p double, excess double, null_mean double, null_q double"

    def band(fx, fy):
        d = (abs(fx) ** 2).mean(1) * (abs(fy) ** 2).mean(1)
        c = abs((np.conj(fx) * fy).mean(1)) ** 2
        return np.divide(c, d, out=np.zeros(d.shape), where=d > 1e-18).mean(1)

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            xs, ys = np.stack(pdf["_x"].to_numpy()).astype(float), np.stack(pdf["_y"].to_numpy()).astype(float)
            fx = segment_coefficients(xs, seg, bins, overlap)
            obs = band(fx, segment_coefficients(ys, seg, bins, overlap))
            null = np.stack([band(fx, segment_coefficients(np.roll(ys, s, axis=1), seg, bins, overlap)) for s in shifts], 1)
            o = pdf[cols].copy()
            o["coh"] = obs
            o["p"] = (1 + (null >= obs[:, None] - 1e-12).sum(1)) / (len(shifts) + 1)
            o["excess"], o["null_mean"], o["null_q"] = obs - null.mean(1), null.mean(1), np.quantile(null, q, axis=1)
            yield o

    return j.mapInPandas(run, schema)


def unit_pair_coherence(traces, run_keys, unit, t, v, seg: int, bins: list[int], overlap: float = 0.5, block: int = 128) -> DataFrame:
    """Band-mean coherence of every unit pair, by blocks of units."""
    from undulate.operators.pairs import block_pairs

    def kernel(x, y):
        fx = segment_coefficients(x.astype(float), seg, bins, overlap)
        fy = segment_coefficients(y.astype(float), seg, bins, overlap)
        sxy = np.einsum("iwb,jwb->ijb", np.conj(fx), fy) / fx.shape[1]
        d = (abs(fx) ** 2).mean(1)[:, None, :] * (abs(fy) ** 2).mean(1)[None, :, :]
        c = np.divide(abs(sxy) ** 2, d, out=np.zeros(d.shape), where=d > 1e-18)
        return {"coh": c.mean(2)}

    return block_pairs(pack(traces, [*run_keys, unit], t, v), run_keys, unit, "trace", kernel, {"coh": "double"}, block=block)


def band_mean(coh: DataFrame, keys, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean coherence per named band of bins (inclusive)."""
    name = None
    for n, (lo, hi) in bands.items():
        hit = F.col("bin").between(lo, hi)
        name = F.when(hit, n) if name is None else name.when(hit, n)
    return coh.withColumn("band", name).filter(F.col("band").isNotNull()).groupBy(*keys, "band").agg(F.avg("coh").alias("coh"))


def band_phase(coh: DataFrame, keys, lo: int, hi: int) -> DataFrame:
    """Phase of the summed cross-spectrum of a band and its class: in, anti or other."""
    g = coh.filter(F.col("bin").between(lo, hi)).groupBy(*keys).agg(F.sum("re").alias("_re"), F.sum("im").alias("_im"), F.avg("coh").alias("coh"))
    ph = F.atan2("_im", "_re")
    kind = F.when(F.abs(ph) < F.lit(np.pi / 3), "in").when(F.abs(ph) > F.lit(2 * np.pi / 3), "anti").otherwise("other")
    return g.select(*keys, "coh", ph.alias("phase"), kind.alias("kind"))


def band_lag(coh: DataFrame, keys, lo: int, hi: int, seg: int) -> DataFrame:
    """Lag in frames: coherence-weighted mean of −phase/(2πf) over the band."""
    f = F.col("bin") / F.lit(float(seg))
    lag = -F.atan2("im", "re") / (2 * np.pi * f)
    return coh.filter(F.col("bin").between(lo, hi)).groupBy(*keys).agg(
        (F.sum(lag * F.col("coh")) / F.nullif(F.sum("coh"), F.lit(0.0))).alias("lag"))


def phase_groups(phase: DataFrame, sig: Column) -> DataFrame:
    """in / anti for significant units with a clear phase, none otherwise."""
    return phase.withColumn("group", F.when(sig & F.col("kind").isin("in", "anti"), F.col("kind")).otherwise("none"))


def periodogram(traces: DataFrame, keys, t: str, v: str, bins: list[int]) -> DataFrame:
    """Power at the listed DFT bins of the mean-removed series: plain sums over frames."""
    keys = list(keys)
    m = traces.groupBy(*keys).agg(F.avg(v).alias("_m"), F.count(F.lit(1)).alias("_n"))
    x = traces.join(m, keys)
    ang = lambda k: 2 * np.pi * k * F.col(t) / F.col("_n")
    aggs = []
    for k in bins:
        aggs += [F.sum((F.col(v) - F.col("_m")) * F.cos(ang(k))).alias(f"_c{k}"), F.sum((F.col(v) - F.col("_m")) * F.sin(ang(k))).alias(f"_s{k}")]
    g = x.groupBy(*keys, "_n").agg(*aggs)
    power = F.array(*[F.struct(F.lit(k).cast("long").alias("bin"), ((F.col(f"_c{k}") ** 2 + F.col(f"_s{k}") ** 2) / F.col("_n")).alias("power")) for k in bins])
    return g.select(*keys, F.explode(power).alias("_p")).select(*keys, "_p.bin", "_p.power")


def bandpower_ratio(psd: DataFrame, keys, a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    lo = F.sum(F.when(F.col("bin").between(*a), F.col("power")))
    hi = F.sum(F.when(F.col("bin").between(*b), F.col("power")))
    return psd.groupBy(*keys).agg((lo / F.nullif(hi, F.lit(0.0))).alias("ratio"))


def welch_psd(traces: DataFrame, keys, t: str, v: str, seg: int, overlap: float = 0.5) -> DataFrame:
    """Mean segment power per bin 0…seg/2."""
    keys = list(keys)
    j = pack(traces, keys, t, v, "_x")
    schema = ", ".join(f"{k} {j.schema[k].dataType.simpleString()}" for k in keys) + ", bin bigint, power double"
    bins = list(range(seg // 2 + 1))

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            p = (abs(segment_coefficients(np.stack(pdf["_x"].to_numpy()).astype(float), seg, bins, overlap)) ** 2).mean(1)
            for i, k in enumerate(bins):
                yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame({"bin": k, "power": p[:, i]})], axis=1)

    return j.mapInPandas(run, schema)


def psd_peaks(psd: DataFrame, keys) -> DataFrame:
    """Bins above both neighbours."""
    from undulate.operators.rolling import local_maxima

    return local_maxima(psd.select(*keys, "bin", "power"), keys, "bin", "power").select(
        *keys, F.col("peak").alias("bin"), F.col("height").alias("power"))
