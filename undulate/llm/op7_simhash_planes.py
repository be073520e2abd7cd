"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has a bit for each bit of the 64-bit hashes of a text's shingles, set where over half of them have it. To
find all pairs at a radius of r bits or fewer, the 64 bits are cut into s segments; two such fingerprints agree on s-r of
them, so a fingerprint is filed under each choice of s-r segments. s grows with the number of distinct fingerprints, so
that chance collisions stay rare; the pairs found are the same for every s.

Files of fingerprints are compared vertically: bit plane b is one long integer with bit b of every fingerprint, sorted
by key. A shift by o lines lane i up with lane i+o, and one exclusive-or per plane updates all those distances at once in
carry-save counters that begin at -(r+1), so that their carry out marks the lanes beyond the radius. Once all are, the
block is abandoned. Keys with many fingerprints are split into pairs of chunks. Only a spanning forest of each block's links
leaves a task, which keeps the components. Equal fingerprints collapse before all that.

Null and wordless texts have fingerprint 0 and link as any other. component_id is the smallest non-null doc_id. Repeated
rows stay; an empty table gives none; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undulate.llm.common import bytes_of, in_batches, stored, text_batches, words
from undulate.llm.components import connected_components

SEED = 42
#: Words are split in steps of about so many bytes.
STEP = 4 << 20
#: Rows of one key that meet in a block; larger keys are split.
CHUNK = 2048
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(data: bytes, n: int = 3) -> np.ndarray:
    """XXH64 of all word n-grams in turn (of the whole sequence if it is shorter; none without words)."""
    import xxhash

    h = partial(xxhash.xxh64_intdigest, seed=SEED)
    parts, last, at = [], [], 0
    while at < len(data):
        cut = _GAP.search(data, at + STEP)
        end = cut.start() if cut else len(data)
        w = last + words(data[at:end])
        if len(w) >= n:
            parts.append(np.fromiter(map(h, map(b" ".join, zip(*(w[i:] for i in range(n))))), np.uint64, len(w) - n + 1))
        last, at = w[1 - n :] if n > 1 else [], end + 1
    if not parts and last:
        parts.append(np.array([h(b" ".join(last))], np.uint64))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprint of each list of hashes. Byte lanes of 64-bit words add up to 255 hashes at once."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    begin = np.cumsum(sizes[full]) - sizes[full]
    per = -(-sizes[full] // 255)
    first = np.cumsum(per) - per
    steps = np.repeat(begin, per) + 255 * (np.arange(int(per.sum())) - np.repeat(first, per))
    lane = np.uint64(0x0101010101010101)
    for j in range(8):
        sums = np.add.reduceat((flat >> np.uint64(j)) & lane, steps)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for k in range(8):
            out[full] |= (counts[:, k] * 2 > sizes[full]).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    import pyarrow as pa

    text_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_batches(batches, 2 << 20):
            fp = majorities([shingle_hashes(x, n) for x in bytes_of(b.column("text"))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def plane_links(fps: np.ndarray, runs: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset o, lanes i): all pairs i, i+o of one run whose fingerprints differ in `radius` bits or fewer."""
    n = len(fps)
    as_int = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = [as_int(bits[:, b]) for b in range(64)]
    lanes = (1 << n) - 1
    width = (radius + 1).bit_length()
    bias = (1 << width) - (radius + 1)
    begin = [lanes if bias >> k & 1 else 0 for k in range(width)]
    ends = np.flatnonzero(np.r_[np.diff(runs) != 0, True]) + 1
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n) - 1  # lanes of the run after each
    for o in range(1, int(left.max(initial=0)) + 1):
        live = as_int(left >= o)
        counters = list(begin)
        for p in planes:
            carry = p ^ (p >> o)
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            live &= ~carry
            if not live:
                break
        if live:
            yield o, np.flatnonzero(np.unpackbits(np.frombuffer(live.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))


def forest(fps: np.ndarray, runs: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a block that join what no link before joined."""
    up = list(range(len(fps)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for o, at in plane_links(fps, runs, radius):
        for i in at.tolist():
            a, b = top(i), top(i + o)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((i, i + o))
    return out


def masks(distinct: int, radius: int) -> list[int]:
    """Masks of s-r of s segments, s as small as leaves 4 keys a fingerprint; at most 4r segments."""
    for s in range(radius + 1, 4 * radius + 1):
        if 64 * (s - radius) / s >= np.log2(max(distinct, 1)) + 2:
            break
    edges = [round(64 * i / s) for i in range(s + 1)]
    seg = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(s)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(seg, s - radius)]


def links(distinct: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b): a spanning forest, or more, of all pairs of distinct fingerprints within the radius."""
    import pyarrow as pa

    keys = masks(distinct.count(), radius)
    filed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(keys)))).alias("f")).select("fp", "f.*")
    sizes = filed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    rows = (filed.join(sizes, ["k", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .select("k", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"))
    by = ["k", "key", "lo", "hi"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have, run = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            fps, runs = np.concatenate([x for x, _ in held]), np.concatenate([r for _, r in held])
            out = forest(fps.view(np.uint64), runs, radius)
            if out:
                i, j = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[j])], names=["a", "b"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = [b.column(c).to_numpy() for c in by]
            new = np.r_[last is None or tuple(x[0] for x in k) != last, np.logical_or.reduce([x[1:] != x[:-1] for x in k])]
            fps, runs = b.column("fp").to_numpy(), run + np.cumsum(new)
            cuts, at = np.flatnonzero(new), 0
            if have >= 2 * chunk and len(cuts):  # the block ends with a whole run
                if cuts[0]:
                    held.append((fps[: cuts[0]], runs[: cuts[0]]))
                at = int(cuts[0])
                yield from flush()
                held, have = [], 0
            held.append((fps[at:], runs[at:]))
            have += len(fps) - at
            run, last = int(runs[-1]), tuple(x[-1] for x in k)
        if held:
            yield from flush()

    rows = rows.repartition(*by).sortWithinPartitions(*by, "fp")
    return rows.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, n: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    fps = stored(fingerprints(docs, n), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    parts = connected_components(links(distinct, radius))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "roots")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(ids, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id (rows without an id last); a stage of the pipeline.

    Rows have numbers of their own, so repeated ids, rows without an id and repeated rows are judged by their texts alone.
    Null, empty and blank texts are one group. Columns stay as they are; an empty table gives none.
    """
    columns = docs.columns
    docs = stored(docs.withColumn("__simhash_row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(docs.select(F.col("__simhash_row").alias("doc_id"), "text"), **params)
    ids = found.select(F.col("doc_id").alias("__simhash_row"), F.col("component_id").alias("__simhash_group")).join(
        docs.select("__simhash_row", F.col("doc_id").alias("__simhash_id")), "__simhash_row")
    first = ids.groupBy("__simhash_group").agg(F.min(F.struct(F.col("__simhash_id").isNull(), "__simhash_id", "__simhash_row"))["__simhash_row"].alias("__simhash_row"))
    return docs.join(first.select("__simhash_row").hint("shuffle_hash"), "__simhash_row").select(*columns)
