"""Row selection: cropping, gating, sampling, live voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undulate.operators.ranks import exact_quantiles


def skip_and_crop(df, t: str, y: str | None, skip: Column, last: Column | None = None, n_frames: Column | None = None,
                  deep_rows: int = 0, ny: int | None = None, renumber: bool = True) -> DataFrame:
    """Drop the first ``skip`` frames, the last ``last`` frames and the deepest Y rows."""
    out = df.filter(F.col(t) >= skip)
    if last is not None:
        out = out.filter(F.col(t) < n_frames - last)
    if deep_rows and y:
        out = out.filter(F.col(y) < ny - deep_rows)
    return out.withColumn(t, F.col(t) - skip) if renumber else out


def select_units(df, unit: str, mode: str, chosen: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """'all', 'only' the listed units, or all 'except' them."""
    if mode == "all":
        return df
    return df.join(chosen, on or [unit], {"only": "left_semi", "except": "left_anti"}[mode])


def sample_frames(df, t: str, every: int | None = None, n: int | None = None, n_frames: int | None = None) -> DataFrame:
    """Each ``every``-th frame, or ``n`` evenly spaced ones (integer part of a linear grid from 0 to T−1)."""
    if every is not None:
        return df.filter(F.pmod(F.col(t), F.lit(every)) == 0)
    picks = sorted({int(i * (n_frames - 1) / (n - 1)) if n > 1 else 0 for i in range(n)})
    return df.filter(F.col(t).isin(picks))


def decimate(df, t: str, n: int, time: str | None = None, first: int = 0) -> DataFrame:
    """Keep every n-th frame of a dense series and renumber; time stays that of the kept frame."""
    k = F.col(t) - first
    return df.filter((k >= 0) & (F.pmod(k, F.lit(n)) == 0)).withColumn(t, F.floor(k / n).cast("long"))


def valid_region(df, keys, v, min_std: float, min_range: float = 0.0) -> DataFrame:
    """Voxels that vary (population sd and range) and are finite throughout."""
    bad = F.max((F.isnan(v) | F.col(v).isNull()).cast("int"))
    s = df.groupBy(*keys).agg(F.stddev_pop(v).alias("_s"), (F.max(v) - F.min(v)).alias("_r"), bad.alias("_b"))
    return s.filter((F.col("_b") == 0) & (F.col("_s") > min_std) & (F.col("_r") > min_range)).select(*keys)


def live_voxels(df, run_keys, voxel_keys, v, q: float, skip_zero: bool = False) -> DataFrame:
    """Voxels whose mean exceeds the q-quantile of the recording's voxel means."""
    run_keys, voxel_keys = list(run_keys), list(voxel_keys)
    m = df.groupBy(*run_keys, *voxel_keys).agg(F.avg(v).alias("mean_v"))
    base = m.filter(F.col("mean_v") != 0) if skip_zero else m
    cut = exact_quantiles(base, run_keys, "mean_v", {"_cut": q})
    return m.join(cut, run_keys).filter(F.col("mean_v") > F.col("_cut")).select(*run_keys, *voxel_keys, "mean_v")


def tissue_mean_sd(df, run_keys, voxel_keys, v, k: float) -> DataFrame:
    """Voxels whose mean exceeds mean + k·sd (population) over the recording's voxel means."""
    run_keys, voxel_keys = list(run_keys), list(voxel_keys)
    m = df.groupBy(*run_keys, *voxel_keys).agg(F.avg(v).alias("mean_v"))
    s = m.groupBy(*run_keys).agg((F.avg("mean_v") + k * F.stddev_pop("mean_v")).alias("_cut"))
    return m.join(s, run_keys).filter(F.col("mean_v") > F.col("_cut")).select(*run_keys, *voxel_keys, "mean_v")


def activity_mask(df, run_keys, voxel_keys, v, mode: str, level: float) -> DataFrame:
    """Voxels by 'mad' (max above median + level·1.4826·MAD), 'std' (sd above a quantile of sds) or 'peak_z'."""
    run_keys, voxel_keys = list(run_keys), list(voxel_keys)
    keys = run_keys + voxel_keys
    if mode == "mad":
        from undulate.operators.signal import robust_stats

        s = robust_stats(df, keys, v).join(df.groupBy(*keys).agg(F.max(v).alias("_mx")), keys)
        return s.filter(F.col("_mx") > F.col("med") + level * 1.4826 * F.col("mad")).select(*keys)
    if mode == "std":
        s = df.groupBy(*keys).agg(F.stddev_pop(v).alias("_s"))
        return s.join(exact_quantiles(s, run_keys, "_s", {"_c": level}), run_keys).filter("_s > _c").select(*keys)
    if mode == "peak_z":
        s = df.groupBy(*keys).agg(((F.max(v) - F.avg(v)) / F.nullif(F.stddev_pop(v), F.lit(0.0))).alias("_z"))
        return s.filter(F.col("_z") > level).select(*keys)
    raise ValueError(mode)


def volume_gate(morph: DataFrame, vmin: float, vmax: float, col: str = "volume_um3") -> DataFrame:
    return morph.filter(F.col(col).between(vmin, vmax))


def geometry_gate(morph: DataFrame, min_yfrac: float, ny: int, min_yx: float, min_yz: float) -> DataFrame:
    """Y span as a share of the grid and the Y/X, Y/Z span ratios."""
    return morph.filter(
        (F.col("yspan") / F.lit(ny) >= min_yfrac)
        & (F.col("yspan") / F.col("xspan") >= min_yx) & (F.col("yspan") / F.col("zspan") >= min_yz))


def shape_reject_sheet(morph: DataFrame, max_x_um: float = 60.0, ratio: float = 1.5) -> DataFrame:
    """Drop sheets: wide in X and much wider than deep."""
    return morph.filter(~((F.col("xspan_um") > max_x_um) & (F.col("xspan_um") > ratio * F.col("yspan_um"))))


def clamp_artifact(v: str, zero_below: float | None = None, floor: float | None = None, cap: float | None = None) -> Column:
    x = F.col(v)
    if zero_below is not None:
        x = F.when(x < zero_below, F.lit(0.0)).otherwise(x)
    if floor is not None:
        x = F.greatest(x, F.lit(floor))
    if cap is not None:
        x = F.least(x, F.lit(cap))
    return x


def sampled_valid_voxels(df, keys, t, v, frames: list[int]) -> DataFrame:
    """Voxels that are finite and not constant over a few probe frames."""
    p = df.filter(F.col(t).isin(frames))
    return p.groupBy(*keys).agg(
        F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_n"),
        F.max(F.isnan(v).cast("int")).alias("_nan")
    ).filter((F.col("_n") == len(frames)) & (F.col("_nan") == 0) & (F.col("_hi") > F.col("_lo"))).select(*keys)


def supra_threshold(v: str, thr: float, null: bool = False) -> Column:
    return F.when(F.col(v) >= thr, F.col(v)).otherwise(F.lit(None) if null else F.lit(0.0))
