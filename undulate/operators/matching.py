"""Matching of masks and validation against a second source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undulate.operators.blocks import codes, group_starts, starts, whole_groups
from undulate.operators.graph import components_with_singletons, first_wins
from undulate.operators.ranks import pearson
from undulate.session import cut_lineage

ZYX = ["z", "y", "x"]
#: A run of at most so many units and voxel rows is compared whole in a task; columns of its matrix at a time.
UNITS, ROWS, COLUMNS = 512, 1 << 18, 4096


def overlap_matrix(a, b, run_keys, unit: str, self_pairs: bool = False) -> DataFrame:
    """Shared voxels and the overlap measures of every overlapping unit pair.

    The join key is one voxel, so the pairs formed are the overlaps themselves;
    they are summed map-side.
    """
    run_keys = list(run_keys)
    x = a.select(*run_keys, F.col(unit).alias("a"), *ZYX)
    y = b.select(*run_keys, F.col(unit).alias("b"), *ZYX)
    j = x.join(y, [*run_keys, *ZYX])
    if self_pairs:
        j = j.filter("a < b")
    n = j.groupBy(*run_keys, "a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    na = x.groupBy(*run_keys, "a").agg(F.count(F.lit(1)).alias("n_a"))
    nb = y.groupBy(*run_keys, "b").agg(F.count(F.lit(1)).alias("n_b"))
    o = n.join(na, [*run_keys, "a"]).join(nb, [*run_keys, "b"])
    return measures(o, run_keys)


def measures(o: DataFrame, run_keys) -> DataFrame:
    ab, a, b = F.col("n_ab"), F.col("n_a"), F.col("n_b")
    return o.select(*run_keys, "a", "b", "n_ab", "n_a", "n_b", (ab / (a + b - ab)).alias("iou"), (2 * ab / (a + b)).alias("dice"),
                    (ab / F.least(a, b)).alias("overlap_coef"), (ab / a).alias("frac_a"), (ab / b).alias("frac_b"))


def _by_size(masks, run_keys, unit: str) -> tuple[DataFrame, DataFrame | None]:
    """Masks of the runs that a task compares whole, and of the other ones (None if there are none)."""
    run_keys = list(run_keys)
    n = masks.groupBy(*run_keys, unit).agg(F.count(F.lit(1)).alias("_r")).groupBy(*run_keys).agg(F.count(F.lit(1)).alias("_u"), F.sum("_r").alias("_r"))
    large = cut_lineage(n.filter((F.col("_u") > UNITS) | (F.col("_r") > ROWS)).select(*run_keys))
    if large.isEmpty():
        return masks, None
    return masks.join(large, run_keys, "left_anti"), masks.join(large, run_keys, "left_semi")


def _compared(masks, run_keys, unit: str, schema: str, found: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], names: list[str], of_unit: int) -> DataFrame:
    """Rows that ``found`` makes of each run's matrix of shared voxels and its sizes, both in order of units.

    The first ``of_unit`` arrays of ``found`` are places of units, which become their ids. Runs are shuffled once, whole.
    """
    import pyarrow as pa

    run_keys = list(run_keys)
    m = masks.select(*run_keys, unit, *ZYX).repartition(*run_keys).sortWithinPartitions(*run_keys, unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, run_keys):
            new = group_starts(t, run_keys)
            first_of_unit = new | starts(codes(t.column(unit)))
            units = np.cumsum(first_of_unit) - 1
            rows = np.flatnonzero(first_of_unit)  # a row of each unit
            voxel = voxel_codes(t)
            edges = np.append(np.flatnonzero(new), t.num_rows)
            out = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                u0 = units[lo]
                u = units[lo:hi] - u0
                _, v = np.unique(voxel[lo:hi], return_inverse=True)
                both, n = shared(u, v, int(u[-1]) + 1)
                got = found(both, n)
                if len(got[0]):
                    out.append((*(x + u0 for x in got[:of_unit]), *got[of_unit:]))
            if out:
                got = [np.concatenate(x) for x in zip(*out)]
                at = [pa.array(rows[x]) for x in got[:of_unit]]
                own = t.select(run_keys).take(at[0]).combine_chunks()
                cols = [own.column(c) for c in run_keys] + [t.column(unit).take(x) for x in at] + [pa.chunked_array([pa.array(x)]) for x in got[of_unit:]]
                yield from pa.table(dict(zip([*run_keys, *names], cols))).combine_chunks().to_batches()

    return m.mapInArrow(run, schema)


def voxel_codes(t) -> np.ndarray:
    """Numbers that are equal where all coordinates of two rows are."""
    out = np.zeros(t.num_rows, np.int64)
    for c in ZYX:
        _, x = np.unique(codes(t.column(c)), return_inverse=True)
        out = np.unique(out * (int(x.max(initial=0)) + 1) + x, return_inverse=True)[1]
    return out


def shared(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Voxels that each two of n units share, and the units' sizes; repeated rows count once."""
    both, width = np.zeros((n, n), np.float32), int(v.max()) + 1
    for lo in range(0, width, COLUMNS):
        part = (v >= lo) & (v < lo + COLUMNS) if width > COLUMNS else slice(None)
        x = np.zeros((n, min(COLUMNS, width - lo)), np.float32)
        x[u[part], v[part] - lo] = 1
        both += x @ x.T
    both = both.astype(np.int64)  # whole numbers up to ROWS
    return both, both.diagonal()


def dices(both: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Dice of each pair a before b; 0 elsewhere."""
    return np.triu(2 * both / (n[:, None] + n[None, :]), 1)


def similar_pairs(masks, run_keys, unit: str, dice: float) -> DataFrame:
    """Unit pairs with Dice > ``dice``.

    A run of at most UNITS units is one product of matrices in a task, which gives on its similar pairs only; the
    pairs of larger runs are found by prefix filtering.
    """
    run_keys = list(run_keys)
    small, large = _by_size(masks, run_keys, unit)

    def found(both: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = np.nonzero(dices(both, n) > dice)
        return a, b, both[a, b], n[a], n[b]

    kind = masks.schema[unit].dataType.simpleString()
    schema = "".join(f"{c} {masks.schema[c].dataType.simpleString()}, " for c in run_keys) + f"a {kind}, b {kind}, n_ab bigint, n_a bigint, n_b bigint"
    o = measures(_compared(small.dropna(subset=[*run_keys, unit, *ZYX]), run_keys, unit, schema, found, ["a", "b", "n_ab", "n_a", "n_b"], 2), run_keys)
    return o if large is None else o.unionByName(similar_pairs_by_prefix(large, run_keys, unit, dice))


def similar_pairs_by_prefix(masks, run_keys, unit: str, dice: float) -> DataFrame:
    """Unit pairs with Dice > ``dice`` by exact prefix filtering.

    Voxels are ordered from rare to common. Two sets with Dice above d share at
    least one voxel among the first n − ⌈n·d/(2−d)⌉ + 1 of each, so candidates
    come from rare voxels only; a voxel claimed by very many units is almost
    never in a prefix. Candidates are verified on all voxels. Collapse exact
    copies with :func:`collapse_identical` first where only one of them matters.
    """
    from pyspark.sql import Window

    run_keys = list(run_keys)
    m = masks.select(*run_keys, unit, *ZYX).distinct()
    df = m.groupBy(*run_keys, *ZYX).agg(F.count(F.lit(1)).alias("_f"))
    n = m.groupBy(*run_keys, unit).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*run_keys, unit).orderBy("_f", *ZYX)
    p = m.join(df, [*run_keys, *ZYX]).join(n, [*run_keys, unit]).withColumn("_k", F.row_number().over(w))
    keep = F.col("_n") - F.ceil(F.col("_n") * (dice / (2 - dice)) - 1e-9) + 1
    p = p.filter(F.col("_k") <= keep).select(*run_keys, unit, *ZYX, "_n")
    l = p.select(*run_keys, F.col(unit).alias("a"), *ZYX, F.col("_n").alias("_na"))
    r = p.select(*run_keys, F.col(unit).alias("b"), *ZYX, F.col("_n").alias("_nb"))
    lim = dice / (2 - dice)
    cand = l.join(r, [*run_keys, *ZYX]).filter(
        (F.col("a") < F.col("b")) & (F.least("_na", "_nb") >= lim * F.greatest("_na", "_nb") - 1e-9)).select(*run_keys, "a", "b").distinct()
    x = m.withColumnRenamed(unit, "a").join(cand, [*run_keys, "a"])
    hit = x.join(m.withColumnRenamed(unit, "b"), [*run_keys, "b", *ZYX]).groupBy(*run_keys, "a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    o = hit.join(n.select(*run_keys, F.col(unit).alias("a"), F.col("_n").alias("n_a")), [*run_keys, "a"]).join(
        n.select(*run_keys, F.col(unit).alias("b"), F.col("_n").alias("n_b")), [*run_keys, "b"])
    return measures(o, run_keys).filter(F.col("dice") > dice)


def collapse_identical(masks, run_keys, unit: str) -> DataFrame:
    """``unit, rep``: the first unit with exactly the same voxels (two independent 64-bit sums of voxel hashes and the size)."""
    run_keys = list(run_keys)
    h = masks.select(*run_keys, unit, *ZYX).distinct().groupBy(*run_keys, unit).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64(*ZYX).cast("decimal(38,0)")).alias("_h1"),
        F.sum(F.xxhash64(F.lit(7), *ZYX).cast("decimal(38,0)")).alias("_h2"))
    rep = h.groupBy(*run_keys, "_n", "_h1", "_h2").agg(F.min(unit).alias("rep"))
    return h.join(rep, [*run_keys, "_n", "_h1", "_h2"]).select(*run_keys, unit, "rep")


def dedup_dice(masks, run_keys, unit: str, dice: float = 0.70) -> DataFrame:
    """First-wins duplicate removal: ``unit, kept``.

    Exact copies go first (only the first of a group of copies can stay). Runs that a task compares whole are
    settled there; in larger ones the rest is decided on the graph of similar pairs.
    """
    run_keys = list(run_keys)
    small, large = _by_size(masks, run_keys, unit)

    def found(both: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        d = dices(both, n)
        conflict, kept = (d > dice) | (d == 1), np.ones(len(n), bool)
        for b in np.flatnonzero(conflict.any(axis=0)).tolist():
            kept[b] = not (conflict[:b, b] & kept[:b]).any()
        return np.arange(len(n)), kept

    schema = ", ".join(f"{c} {masks.schema[c].dataType.simpleString()}" for c in [*run_keys, unit]) + ", kept boolean"
    out = _compared(small, run_keys, unit, schema, found, [unit, "kept"], 1)
    return out if large is None else out.unionByName(dedup_dice_by_graph(large, run_keys, unit, dice))


def dedup_dice_by_graph(masks, run_keys, unit: str, dice: float = 0.70) -> DataFrame:
    """The same for runs of any size: copies collapse to their first unit, the others are decided in rounds."""
    run_keys = list(run_keys)
    rep = cut_lineage(collapse_identical(masks, run_keys, unit))
    first = masks.join(rep.filter(F.col(unit) == F.col("rep")).select(*run_keys, unit), [*run_keys, unit], "left_semi")
    dec = first_wins(first, similar_pairs_by_prefix(first, run_keys, unit, dice), run_keys, unit)
    copies = rep.filter(F.col(unit) != F.col("rep")).select(*run_keys, unit, F.lit(False).alias("kept"))
    return dec.select(*run_keys, unit, "kept").unionByName(copies)


def best_match(ov, run_keys, thr: float, by: str = "iou") -> DataFrame:
    """Best b of every a at or above the threshold (lowest b of equals)."""
    o = F.struct(-F.col(by), F.col("b"))
    return ov.filter(F.col(by) >= thr).groupBy(*run_keys, "a").agg(F.min_by(F.struct("b", by), o).alias("_x")).select(*run_keys, "a", "_x.*")


def novel_and_lost(ov, a_units, b_units, run_keys, thr: float, by: str = "iou") -> DataFrame:
    """matched (a with its best b), novel (a without), lost (b that is nobody's match)."""
    run_keys = list(run_keys)
    m = best_match(ov, run_keys, thr, by)
    matched = m.select(*run_keys, "a", "b", F.lit("matched").alias("status"))
    novel = a_units.join(m.select(*run_keys, "a"), [*run_keys, "a"], "left_anti").select(
        *run_keys, "a", F.lit(None).cast(b_units.schema["b"].dataType).alias("b"), F.lit("novel").alias("status"))
    lost = b_units.join(m.select(*run_keys, "b").distinct(), [*run_keys, "b"], "left_anti").select(
        *run_keys, F.lit(None).cast(a_units.schema["a"].dataType).alias("a"), "b", F.lit("lost").alias("status"))
    return matched.unionByName(novel).unionByName(lost)


def precision_recall(matches, n_a, n_b, run_keys, thresholds: list[float], by: str = "iou") -> DataFrame:
    """P, R and F1 of one-to-one matches at several overlap thresholds (n_a: proposed, n_b: reference)."""
    run_keys = list(run_keys)
    t = matches.withColumn("thr", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    g = t.groupBy(*run_keys, "thr").agg(F.sum((F.col(by) >= F.col("thr")).cast("long")).alias("tp"))
    g = g.join(n_a, run_keys).join(n_b, run_keys)
    p, r = F.col("tp") / F.col("n_a"), F.col("tp") / F.col("n_b")
    return g.select(*run_keys, "thr", "tp", p.alias("precision"), r.alias("recall"), (2 * F.col("tp") / (F.col("n_a") + F.col("n_b"))).alias("f1"))


def cross_corr_of_matches(matches, ta, tb, run_keys, unit, t, v) -> DataFrame:
    """Trace correlation of matched pairs on common frames."""
    run_keys = list(run_keys)
    x = ta.select(*run_keys, F.col(unit).alias("a"), t, F.col(v).alias("_va"))
    y = tb.select(*run_keys, F.col(unit).alias("b"), t, F.col(v).alias("_vb"))
    j = matches.select(*run_keys, "a", "b").join(x, [*run_keys, "a"]).join(y, [*run_keys, "b", t])
    return j.groupBy(*run_keys, "a", "b").agg(pearson("_va", "_vb").alias("r"))


def functional_recall(ov, ta, tb, run_keys, unit, t, v, min_overlap: float = 0.2, levels=(0.5, 0.7, 0.8), by: str = "frac_b") -> DataFrame:
    """Share of reference units b with an overlapping proposal whose trace correlates above each level; median best r."""
    run_keys = list(run_keys)
    c = cross_corr_of_matches(ov.filter(F.col(by) >= min_overlap), ta, tb, run_keys, unit, t, v)
    best = c.groupBy(*run_keys, "b").agg(F.max("r").alias("best_r"))
    allb = tb.select(*run_keys, F.col(unit).alias("b")).distinct().join(best, [*run_keys, "b"], "left")
    return allb.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("n_ref"), F.percentile("best_r", 0.5).alias("median_best_r"),
        *[F.avg((F.coalesce("best_r", F.lit(-1.0)) >= l).cast("double")).alias(f"recall_{int(l * 10)}") for l in levels])


def signal_recall(ov, ta, tb, run_keys, unit, t, v, k: int = 8, min_overlap: float = 0.0, by: str = "n_ab") -> DataFrame:
    """Multiple R of the ≤ k most overlapping proposals reproducing each reference trace.

    Candidates are limited to k per reference by the definition of the measure,
    so a task holds k + 1 traces.
    """
    import numpy as np
    import pandas as pd

    from undulate.operators.pairs import pack
    from undulate.operators.topk import top_n

    run_keys = list(run_keys)
    top = top_n(ov.filter(F.col(by) > min_overlap), [*run_keys, "b"], by, k, ["a"]).select(*run_keys, "a", "b")
    x = pack(ta, [*run_keys, unit], t, v, "_x").withColumnRenamed(unit, "a")
    y = pack(tb, [*run_keys, unit], t, v, "_y").withColumnRenamed(unit, "b")
    j = top.join(x, [*run_keys, "a"]).groupBy(*run_keys, "b").agg(F.array_sort(F.collect_list(F.struct("a", "_x"))).alias("_xs"))
    j = j.select(*run_keys, "b", F.transform("_xs", lambda s: s["_x"]).alias("_xs")).join(y, [*run_keys, "b"])
    schema = ", ".join(f"{c} {j.schema[c].dataType.simpleString()}" for c in [*run_keys, "b"]) + ", n_units bigint, multiple_r double"

    def run(batches):
        for pdf in batches:
            res = []
            for xs, yv in zip(pdf["_xs"], pdf["_y"]):
                a = np.stack([np.asarray(q, dtype=float) for q in xs]).T
                a = np.column_stack([np.ones(len(a)), a])
                yy = np.asarray(yv, dtype=float)
                fit = a @ np.linalg.lstsq(a, yy, rcond=None)[0]
                tot = ((yy - yy.mean()) ** 2).sum()
                r2 = 1 - ((yy - fit) ** 2).sum() / tot if tot > 1e-12 else 0.0
                res.append((len(xs), float(np.sqrt(max(0.0, r2)))))
            out = pdf[[*run_keys, "b"]].copy()
            out["n_units"], out["multiple_r"] = [r[0] for r in res], [r[1] for r in res]
            yield out if len(res) else pd.DataFrame(columns=out.columns)

    return j.mapInPandas(run, schema)


def voxel_coverage(a, b, run_keys) -> DataFrame:
    """Share of the reference voxels (b) covered by any proposal."""
    run_keys = list(run_keys)
    u = a.select(*run_keys, *ZYX).distinct().withColumn("_in", F.lit(1))
    r = b.select(*run_keys, *ZYX).distinct().join(u, [*run_keys, *ZYX], "left")
    return r.groupBy(*run_keys).agg(F.count(F.lit(1)).alias("n_ref"), F.avg(F.coalesce("_in", F.lit(0)).cast("double")).alias("coverage"))


def confusion(df, keys, a: str, b: str) -> DataFrame:
    return df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))


def branch_groups(ov, coact, units, run_keys, unit: str, jaccard: float = 0.05, r: float = 0.3) -> DataFrame:
    """Units that overlap and are co-active, grouped; groups of at least two: ``unit, component``."""
    run_keys = list(run_keys)
    e = ov.filter(F.col("iou") > jaccard).select(*run_keys, "a", "b").join(
        coact.filter(F.col("r") > r).select(*run_keys, "a", "b"), [*run_keys, "a", "b"])
    c = components_with_singletons(units, e, run_keys, unit, "a", "b")
    big = c.groupBy(*run_keys, "component").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    return c.join(big.select(*run_keys, "component"), [*run_keys, "component"], "left_semi")


def fov_union(masks, group, run: str, unit: str, runs: list, overlap_max: float = 0.2) -> DataFrame:
    """Units of the runs of a field in order; a unit joins when < overlap_max of its voxels are claimed, with its free voxels.

    ``masks`` carries the position of its run in the field (``run``, values
    ``runs``); all fields advance together, one step per position.
    """
    group = list(group)
    vox = [*group, *ZYX]
    claimed = None
    for r in runs:
        m = masks.filter(F.col(run) == r).select(*group, run, unit, *ZYX)
        if claimed is None:
            # inside one run the lowest id keeps a shared voxel
            add = m.groupBy(*vox).agg(F.min(unit).alias(unit)).withColumn(run, F.lit(r).cast(masks.schema[run].dataType))
        else:
            c = claimed.select(*vox).withColumn("_c", F.lit(1))
            j = m.join(c, vox, "left")
            ok = j.groupBy(*group, unit).agg(F.avg(F.coalesce("_c", F.lit(0)).cast("double")).alias("_s")).filter(F.col("_s") < overlap_max)
            free = j.filter(F.col("_c").isNull()).join(ok.select(*group, unit), [*group, unit], "left_semi")
            add = free.groupBy(*vox).agg(F.min(unit).alias(unit)).withColumn(run, F.lit(r).cast(masks.schema[run].dataType))
        add = add.select(*group, run, unit, *ZYX)
        claimed = cut_lineage(add if claimed is None else claimed.unionByName(add))
    return claimed


def frame_offset_audit(windows, indices, keys, start: str, index: str) -> DataFrame:
    """Most frequent difference between an event's start and its recorded best frames."""
    j = windows.join(indices, list(keys)).withColumn("_d", F.col(index) - F.col(start))
    n = j.groupBy("_d").agg(F.count(F.lit(1)).alias("n"))
    return n


def trace_agreement(ta, tb, run_keys, unit, t, v) -> DataFrame:
    """r per common unit on common frames; median, mean and least per run."""
    keys = [*run_keys, unit]
    j = ta.select(*keys, t, F.col(v).alias("_a")).join(tb.select(*keys, t, F.col(v).alias("_b")), [*keys, t])
    r = j.groupBy(*keys).agg(pearson("_a", "_b").alias("r")).filter(F.col("r").isNotNull())
    return r.groupBy(*run_keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("r", 0.5).alias("median_r"), F.avg("r").alias("mean_r"), F.min("r").alias("min_r"))
