"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source is an endless stream: its documents in a hashed order, again and again, cut into blocks of as many words.
Slot j of the mix gets the j-th point of a golden-ratio sequence; the point falls into one source's share of the unit
interval, and the r-th slot of a source takes its r-th block. Any stretch of the mix so holds each source close to its
share. A source's last block is trimmed, so the words taken equal the rounded target. DataFrame functions only.

Sources are ordered by code point with null last. Documents without words take nothing. Rows with the same id are
documents of their own. An empty table gives no rows. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undulate.llm.common import WORD, stored

#: Golden-ratio step of an additive sequence over 2^31 points.
STEP, POINTS = 1_327_217_885, 1 << 31
#: Cells of the unit interval by which slots find their source.
CELLS = 1024
#: Tables of sources up to this many rows are broadcast.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Target words of each source (one row each): shares by weight, none above `cap` times its size.

    Resharing what lies above a cap until nothing does ends at one level of words per unit of weight. The sources in
    order of cap per weight are at their cap up to the first whose level, if all before it are capped, is below its own.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    unit = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    s = sources.withColumn("nth", F.row_number().over(order)).withColumn("weight", unit)
    s = s.withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = W.orderBy("ratio", "nth")
    s = (s.withColumn("capped", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("total", F.sum("source_size").over(W.partitionBy(F.lit(0)))))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(W.partitionBy(F.lit(0))), F.lit(0.0))
    s = s.withColumn("target", F.least("most", F.col("weight") * level))
    s = s.withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * cap))
    upto = W.orderBy("nth")
    total = F.greatest(F.sum("target").over(W.partitionBy(F.lit(0))), F.lit(1e-9))
    return (s.withColumn("hi", F.sum("target").over(upto.rowsBetween(W.unboundedPreceding, 0)) / total)
            .withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
            .select("skey", "source", "nth", "source_size", "target", "words", "lo", "hi"))


def ranked(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Running sum of `value` before each row of a key, in order of (chunk, order); no task holds a whole key."""
    df = df.withColumn("_chunk", chunk).withColumn("_value", value)
    sums = df.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(
        W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = W.partitionBy(*keys, "_chunk").orderBy(*order)
    inside = F.coalesce(F.sum("_value").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (df.withColumn("_inside", inside).withColumn("_nth", F.row_number().over(own)).join(sums, [*keys, "_chunk"])
            .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_value", "_before", "_inside"))


def slots(spark, sources: DataFrame, block: int, n_slots: int, small) -> DataFrame:
    """skey, rank, slot: which slot of the mix takes the rank-th block of a source.

    Slots of a source beyond its number of blocks stay unused; blocks that the points didn't reach follow at the end.
    """
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1)).cast("long")
    need = sources.where(F.col("words") > 0).withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))
    cells = need.select("skey", "blocks", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (((F.col("id") % POINTS) * STEP + STEP) % POINTS / POINTS).alias("u"))
    hit = (points.withColumn("cell", cell(F.col("u"))).join(small(cells), "cell")
           .where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("skey", "blocks", "slot"))
    hit = ranked(hit, ["skey"], F.floor(F.col("slot") / 1024), ["slot"], F.lit(1), "rank")
    counts = hit.groupBy("skey").agg(F.count("*").alias("n"))
    late = (need.join(counts, "skey", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < F.col("blocks"))
            .withColumn("base", F.coalesce(F.sum(F.col("blocks") - F.col("n")).over(
                W.orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .select("skey", "n", "base", F.explode(F.sequence("n", F.col("blocks") - 1)).alias("rank"))
            .select("skey", "rank", (F.lit(n_slots) + F.col("base") + F.col("rank") - F.col("n")).alias("slot")))
    return hit.where(F.col("rank") < F.col("blocks")).select("skey", "rank", "slot").unionByName(late)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 1024, seed: int = 7, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with what the mix takes of each, and the schedule.

    documents: row (as given), doc_id, skey, source, size, source_size, target, taken. schedule: slot, doc_id, skey, first, words - the
    words from `first` of a document that a slot takes, in order of `slot`, then of `at`.
    """
    spark = docs.sparkSession
    row = F.lit(None).cast("long") if row is None else row
    base = stored(docs.select(row.alias("row"), "doc_id", F.xxhash64("text").alias("of_text"), "source", source_key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size")), "sizes")
    sources = stored(targets(base.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), weights, cap), "sources")
    n = base.agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    n_sources = sources.count()
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    buckets = max(1, -(-n.docs // 512))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("of_text"))  # rows of one id, or of none, are dealt by their texts
    placed = ranked(base.withColumn("_key", key), ["skey"], F.pmod(F.col("_key"), F.lit(buckets)), ["_key", "doc_id", "size", "row"], F.col("size"), "start")
    placed = stored(placed.join(small(sources.drop("source")), "skey").select(
        "row", "doc_id", "source", "skey", F.col("_chunk").alias("chunk"), F.col("_nth").alias("nth"), "size", "start", "source_size", "target", F.col("words").alias("quota")), "placed")
    copies = (placed.where(F.col("size") > 0).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
              .withColumn("at", F.col("start") + F.col("turn") * F.col("source_size"))
              .withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota"))).where(F.col("at") < F.col("end")))
    parts = (copies.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
             .withColumn("from", F.greatest(F.col("at"), F.col("rank") * block))
             .withColumn("words", F.least(F.col("end"), (F.col("rank") + 1) * block) - F.col("from")))
    plan = slots(spark, sources, block, -(-n.words // block) + n_sources, small)
    schedule = parts.join(plan, ["skey", "rank"]).select(
        "slot", F.col("from").alias("at"), "doc_id", "skey", "chunk", "nth", (F.col("from") - F.col("at")).alias("first"), "words")
    taken = schedule.groupBy("skey", "chunk", "nth").agg(F.sum("words").alias("taken"))
    result = placed.join(taken, ["skey", "chunk", "nth"], "left").select(
        "row", "doc_id", "skey", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return result, schedule


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents repeated and cut as the mix says, with the columns of `docs`; a stage of the pipeline.

    A document is written once for every whole time that the mix takes it, and once more with its first words where the
    mix ends inside it. Every row has a number of its own and gets its own words, be its id null or repeated. Rows without
    words take nothing and go; an empty table gives none.
    """
    columns = docs.columns
    docs = stored(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "numbered")
    taken, _ = mix(docs, row=F.col("__mix_row"), **params)
    each = taken.where(F.col("taken") > 0).select(F.col("row").alias("__mix_row"), F.col("size").alias("__mix_size"), F.col("taken").alias("__mix_taken"))
    rows = docs.join(each, "__mix_row")
    rows = rows.withColumn("__mix_left", F.explode(F.sequence(F.lit(0), F.floor((F.col("__mix_taken") - 1) / F.col("__mix_size")))))
    some = F.col("__mix_taken") - F.col("__mix_left") * F.col("__mix_size")
    first = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.lit(1), some.cast("int")))
    rows = rows.withColumn("text", F.when(some >= F.col("__mix_size"), F.col("text")).otherwise(first))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*columns)
