"""Readers, writers and catalog queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undulate.schemas import schema, validate


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """Scan a canonical table with its declared schema (columns and partitions prune at the source)."""
    r = spark.read.schema(schema(name)).options(**options)
    if fmt == "csv":
        r = r.option("header", "true").option("enforceSchema", "false")
    return r.format(fmt).load(path)


def read_frames(spark, path: str, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
    """Frames of a movie; the time range reaches the Parquet scan as a pushed filter."""
    f = read_table(spark, path, "frames")
    if t_from is not None:
        f = f.filter(F.col("t") >= t_from)
    if t_to is not None:
        f = f.filter(F.col("t") < t_to)
    return f


def read_masks(spark, path: str) -> DataFrame:
    """Sparse masks; a unit without voxels has no rows."""
    return read_table(spark, path, "mask_voxels")


def read_traces_wide(spark, path: str, prefix: str = "dend", ids=("time_s",)) -> DataFrame:
    """One CSV column per unit → long rows; the frame counter column is optional.

    The header is read from the file, all columns as strings, and only the
    value columns are cast: no inference pass over the data.
    """
    w = spark.read.option("header", "true").csv(path)
    keep = [c for c in ids if c in w.columns]
    if "Frame" in w.columns:
        w = w.withColumnRenamed("Frame", "frame")
        keep = ["frame", *keep]
    return wide_to_long(w, keep, prefix).withColumn("dff", null_nan(F.col("dff").cast("double")))


def wide_to_long(wide: DataFrame, ids, prefix: str, unit: str = "unit", value: str = "dff") -> DataFrame:
    cols = [c for c in wide.columns if c.startswith(prefix)]
    if not cols:
        raise ValueError(f"no column starts with {prefix!r}")
    return wide.unpivot(list(ids), cols, unit, value)


def export_wide(long: DataFrame, ids, unit: str, value: str, units: list, name: str = "{}") -> DataFrame:
    """One column per listed unit (the list fixes the schema, so no discovery job runs)."""
    p = long.groupBy(*ids).pivot(unit, units).agg(F.first(value))
    return p.select(*ids, *[F.col(str(u)).alias(name.format(u)) for u in units])


def read_behavior(spark, path: str, columns: list[tuple[str, list[str]]], time: str = "time_s") -> DataFrame:
    """Behaviour CSV: for each signal the first present of its fallback columns."""
    raw = spark.read.option("header", "true").csv(path)
    sel = [F.col(time).cast("double").alias("time_s")]
    for signal, names in columns:
        have = [n for n in names if n in raw.columns]
        if have:
            sel.append(F.coalesce(*[null_nan(F.col(n).cast("double")) for n in have]).alias(signal))
    wide = raw.select(*sel)
    return wide.unpivot(["time_s"], wide.columns[1:], "signal", "value").filter(F.col("value").isNotNull())


def read_triggers(spark, path: str, lines: dict[str, str], time: str = "time_s") -> DataFrame:
    """Trigger log: columns found by a fragment of their name (line → fragment); levels above 0.5 are 1."""
    raw = spark.read.option("header", "true").csv(path)
    found = {l: next(c for c in raw.columns if frag.lower() in c.lower()) for l, frag in lines.items()}
    w = raw.select(F.col(time).cast("double").alias("time_s"),
                   *[(F.col(c).cast("double") > 0.5).cast("int").alias(l) for l, c in found.items()])
    return w.unpivot(["time_s"], list(found), "line", "level")


def trigger_edges(triggers: DataFrame, keys, chunk_us: int = 60_000_000) -> DataFrame:
    """Rising edges of each line; samples are ordered by integer microseconds inside time chunks."""
    keys = [*keys, "line"]
    t = triggers.withColumn("us", F.round(F.col("time_s") * 1_000_000).cast("long"))
    c = F.floor(F.col("us") / chunk_us)
    w = Window.partitionBy(*keys, "_c").orderBy("us")
    inner = t.withColumn("_c", c).withColumn("_p", F.lag("level").over(w))
    tail = inner.groupBy(*keys, "_c").agg(F.max_by("level", "us").alias("_last"))
    wk = Window.partitionBy(*keys).orderBy("_c")
    carry = tail.select(*keys, "_c", F.lag("_last").over(wk).alias("_carry"))
    j = inner.join(carry, [*keys, "_c"])
    return j.filter((F.col("level") == 1) & (F.coalesce("_p", "_carry") == 0)).select(*keys, "us", "time_s")


def read_metrics_json(spark, path: str, ddl: str) -> DataFrame:
    """Nested metric documents; sections absent from a file are NULL."""
    return spark.read.schema(ddl).option("multiLine", "true").json(path)


def null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def write_table(df: DataFrame, path: str, name: str | None = None, partition_by: str = "run_id",
                mode: str = "overwrite") -> None:
    """Parquet, one directory per recording; overwriting replaces only the recordings in ``df``.

    A recording is one file, unless it is so large that rebalancing splits it.
    """
    out = validate(df, name) if name else df
    (out.hint("rebalance", partition_by)
        .write.mode(mode).partitionBy(partition_by).option("partitionOverwriteMode", "dynamic").parquet(path))


def latest_metrics(df: DataFrame, keys, stamp: str) -> DataFrame:
    """Later values of a section replace earlier ones."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), stamp).alias("_r")).select(*keys, "_r.*")


def list_runs(spark, roots: list[str], pattern: str, exclude: list[str] = ()) -> DataFrame:
    """Recording folders under several roots: paths only, the first root with data wins.

    ``pattern`` extracts date, subject and run from the path.
    """
    parts = None
    for i, root in enumerate(roots):
        f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "modificationTime", "length", F.lit(i).alias("root")))
        parts = f if parts is None else parts.unionByName(f)
    k = parts.select(
        *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(("date", "subject", "run"))],
        "path", "modificationTime", "root").filter(F.col("run") != "")
    for e in exclude:
        k = k.filter(~F.col("path").contains(e))
    first = k.groupBy("date", "subject", "run").agg(F.min("root").alias("root"))
    return k.join(first, ["date", "subject", "run", "root"])


def prefer(files: DataFrame, keys, name: str, fragments: list[str], ties=()) -> DataFrame:
    """One file per key: the earliest listed name fragment wins, then the name."""
    rank = F.lit(len(fragments))
    for i, f in reversed(list(enumerate(fragments))):
        rank = F.when(F.col(name).contains(f), F.lit(i)).otherwise(rank)
    order = F.struct(rank.alias("r"), F.col(name).alias("n"), *[F.col(t).alias(f"t_{t}") for t in ties])
    rest = [c for c in files.columns if c not in keys]
    return files.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def get_run(runs: DataFrame, **key) -> DataFrame:
    for c, v in key.items():
        runs = runs.filter(F.col(c) == v)
    return runs


def params_hash(params: Column) -> Column:
    return F.sha2(F.to_json(params), 256)


def stale_runs(inputs: DataFrame, outputs: DataFrame, key: str, stamp: str = "mtime", digest: str | None = None) -> DataFrame:
    """Runs without output, with newer inputs, or whose parameter digest changed."""
    i = inputs.groupBy(key).agg(F.max(stamp).alias("_in"), *([F.max(digest).alias("_di")] if digest else []))
    o = outputs.groupBy(key).agg(F.min(stamp).alias("_out"), *([F.max(digest).alias("_do")] if digest else []))
    j = i.join(o, key, "left")
    stale = F.col("_out").isNull() | (F.col("_in") > F.col("_out"))
    if digest:
        stale = stale | (F.col("_di") != F.col("_do"))
    return j.filter(stale).withColumn("never", F.col("_out").isNull())
