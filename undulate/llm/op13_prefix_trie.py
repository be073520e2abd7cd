"""The prefix trie of conversations, with count-min screening of prefix digests.

A node of depth d is a distinct sequence of d turns (role, text); its members are the conversations that begin so. A turn is
known by the MD5 of role and text. A prefix is known by two 64-bit digests: the exclusive or of hashes of (depth, turn), so
that prefixes of a conversation that spreads over many tasks are running values with a carry.

Screening: prefixes of the depths 1 to 8 and of every power of two are counted in a count-min sketch, whose cells are summed
by the shuffle and come back as bits, "counted once". An estimate is never too small, so one proves that no other
conversation has the prefix, nor any longer one: from there on the nodes of a conversation are a chain of its own,
given out where its rows lie. The other prefixes - up to and with the first proven one - are shuffled and grouped
exactly. The sketch has `rows` times at most `most_width` bits (fewer on small input); where more prefixes are counted
than it tells apart, more of them are grouped and the result is the same.

Sums over subtrees need no descent. Each node is owned by its smallest member, which then owns all its own longer prefixes
too. A leaf counts once, on the path of its owner. Tokens that sharing saves in a subtree are, member by member, the code
points of the turns below that it doesn't own.

Hot keys: turns are dealt by ranges of (conversation, turn), with running values carried between tasks (at most two
conversations a task cross a border). A prefix or conversation that holds more than a thousandth of all rows meets the
other side of its joins by a broadcast of at most a thousand rows. The sorted ids of conversations that end in a
node are joined to texts of `run` ids where the sort put them and then hashed in turn; no list of them is held.

Rows without a conv_id belong to no conversation and are left out. Null role or text is empty. Turns are ordered null first,
equal ones by their digest; repeated rows are turns of their own. Other columns are ignored; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undulate.llm.common import discard, stored

NODE = ["depth", "d1", "d2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
CHUNK = 1 << 19  # bits of the sketch that one group makes


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size): turns without their texts."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size"))


def hashed(depth: Column, digest: Column, which: int) -> Column:
    return F.xxhash64(F.lit(which), depth.cast("long"), digest)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], often: Column, how: str = "inner") -> DataFrame:
    """Join with the rows of `right` (one a key) whose key `left` holds often - a bounded number - broadcast, so that a hot
    key of `left` stays where its rows lie."""
    hot = F.broadcast(right.where(often))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(~often), keys, how)
    return left.join(hot, keys).unionByName(rest)


def dealt(turns: DataFrame) -> DataFrame:
    """Turns with the range (`part`) they were dealt to by conversation and order."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    return stored(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")


def parts_of(turns: DataFrame) -> DataFrame:
    """(conv_id, part) with the turns that lie in earlier parts, of the conversation's `own` turns."""
    n = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    by = W.partitionBy("conv_id")
    return n.select("conv_id", "part", F.sum("n").over(by).alias("own"), F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))


def heads(turns: DataFrame, parts: DataFrame, block: int, most: int) -> DataFrame:
    """The first turns, in order, of the conversations whose beginning others take over."""
    first = turns.where(F.col("conv_id") % block == 0).join(parts.where(F.col("earlier") < most).select("conv_id", "part"), ["conv_id", "part"])
    first = first.withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))).where(F.col("at") <= most)
    return first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", "size"))).alias("head"))


def spliced(turns: DataFrame, take: Callable[[Column], Column], block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, (conv_id, part, depth, d1, d2, p1, p2, size, before, length), and their lengths.

    d is the prefix with the turn and p the one without, `before` the code points of the turns before. The first `take(conv_id)`
    turns are those of the block's first conversation, then come the own ones after as many.
    """
    parts = parts_of(turns)
    i = lambda c, n: F.slice(c, 1, n)
    xor = lambda c, which: F.aggregate(c, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(hashed(t["at"], t["digest"], which)))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, t: a + t["size"])
    info = (parts.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("skip", take(F.col("conv_id")).cast("long"))
            .join(heads(turns, parts, block, most), "base", "left").withColumn("head", F.coalesce("head", F.array().cast("array<struct<at:int,digest:binary,size:bigint>>")))
            .withColumn("head", i(F.col("head"), F.col("skip").cast("int"))).withColumn("n_head", F.size("head"))
            .select("conv_id", "part", "skip", "earlier", "head", "n_head", (F.col("n_head") + F.greatest(F.col("own") - F.col("skip"), F.lit(0))).alias("length"),
                    xor(F.col("head"), 1).alias("h1"), xor(F.col("head"), 2).alias("h2"), total(F.col("head")).alias("h_size")))
    info = stored(info, "parts")
    lengths = info.where(F.col("earlier") == 0).select("conv_id", "part", "length")

    by = W.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    upto, above = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(W.unboundedPreceding, -1)
    own = turns.join(info.drop("head"), ["conv_id", "part"]).withColumn("at", F.col("earlier") + F.row_number().over(by)).where(F.col("at") > F.col("skip"))
    own = own.withColumn("depth", F.col("n_head") + F.col("at") - F.col("skip"))
    own = own.withColumn("s1", hashed(F.col("depth"), F.col("digest"), 1)).withColumn("s2", hashed(F.col("depth"), F.col("digest"), 2))
    own = stored(own.select("conv_id", "part", "depth", "s1", "s2", F.col("h1").bitwiseXOR(F.bit_xor("s1").over(upto)).alias("d1"), F.col("h2").bitwiseXOR(F.bit_xor("s2").over(upto)).alias("d2"),
                            "size", (F.col("h_size") + F.coalesce(F.sum("size").over(above), F.lit(0))).alias("before"), "length"), "own")

    across = F.broadcast(info.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id"))  # at most two a part
    sums = own.join(across, "conv_id").groupBy("conv_id", "part").agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"), F.sum("size").alias("size"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = F.broadcast(sums.select("conv_id", "part", F.bit_xor("s1").over(earlier).alias("c1"), F.bit_xor("s2").over(earlier).alias("c2"), F.sum("size").over(earlier).alias("c_size")))
    own = own.join(carry, ["conv_id", "part"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("c1", "c2", "c_size")}).select(
        "conv_id", "part", "depth", "s1", "s2", F.col("d1").bitwiseXOR(F.col("c1")).alias("d1"), F.col("d2").bitwiseXOR(F.col("c2")).alias("d2"),
        "size", (F.col("before") + F.col("c_size")).alias("before"), "length")

    head = info.where((F.col("earlier") == 0) & (F.col("n_head") > 0)).select("conv_id", "part", "length", "head", F.explode(F.sequence(F.lit(1), F.greatest("n_head", F.lit(1)))).alias("depth"))
    turn, above_ = F.element_at("head", F.col("depth")), i(F.col("head"), F.col("depth"))
    head = head.select("conv_id", "part", F.col("depth").cast("long").alias("depth"), hashed(F.col("depth"), turn["digest"], 1).alias("s1"), hashed(F.col("depth"), turn["digest"], 2).alias("s2"),
                       xor(above_, 1).alias("d1"), xor(above_, 2).alias("d2"), turn["size"].alias("size"), (total(above_) - turn["size"]).alias("before"), "length")
    every = own.unionByName(head)
    return every.select("conv_id", "part", "depth", "d1", "d2", F.col("d1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("s2")).alias("p2"), "size", "before", "length"), lengths


def counted_once(prefixes: DataFrame, width: int, rows: int) -> np.ndarray:
    """Bits of a count-min sketch: which of its cells count one prefix."""
    import pyarrow as pa

    cells = prefixes.select(F.explode(F.array(*cells_of(width, rows))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n = 1")

    def chunk(key: tuple, t: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK, np.uint8)
        bits[t.column("cell").to_numpy() % CHUNK] = 1
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    made = cells.select("cell", F.shiftright("cell", 19).alias("chunk")).groupBy("chunk").applyInArrow(chunk, "chunk long, bits binary").collect()
    out = np.zeros(max(width * rows, CHUNK) // 8, np.uint8)
    for r in made:
        out[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def cells_of(width: int, rows: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(100 + r), "d1", "d2"), F.lit(width)) + F.lit(r * width).cast("long") for r in range(rows)]


def alone_from(every: DataFrame, count: int, rows: int = 3, most_width: int = 1 << 25) -> DataFrame:
    """(conv_id, alone): the least screened depth at which a conversation's prefix is proven to be its own."""
    import pyarrow as pa

    depth = F.col("depth")
    screened = every.where((depth <= 8) | (depth.bitwiseAND(depth - 1) == 0)).select("conv_id", "depth", "d1", "d2")
    width = CHUNK
    while width < 4 * count and width < most_width:
        width *= 2
    shared = every.sparkSession.sparkContext.broadcast(counted_once(screened, width, rows))

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            one = np.zeros(b.num_rows, bool)
            for r in range(rows):
                cell = b.column(f"c{r}").to_numpy()
                one |= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth")], names=["conv_id", "depth"]).filter(pa.array(one))

    asked = screened.select("conv_id", "depth", *(c.alias(f"c{r}") for r, c in enumerate(cells_of(width, rows))))
    return asked.mapInArrow(proven, "conv_id long, depth long").groupBy("conv_id").agg(F.min("depth").alias("alone"))


def ends(rows: DataFrame, run: int = 1000) -> DataFrame:
    """Per node the SHA-256 of the ids, ascending and comma-joined, of the conversations that end in it."""
    import pyarrow as pa

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ids of one node as one text."""
        key, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*key, ids[0])), pa.array([",".join(map(str, ids))])], names=[*NODE, "first", "ids"])

        for b in batches:
            for *node, conv in zip(*(b.column(c).to_pylist() for c in (*NODE, "conv_id"))):
                if ids and (node != key or len(ids) == run):
                    yield out()
                    ids = []
                key = node
                ids.append(conv)
        if ids:
            yield out()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([state.hexdigest()])], names=[*NODE, "ends_sha256"])

        for b in batches:
            for *node, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if node != key:
                    if key is not None:
                        yield out()
                    key, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield out()

    order = [*NODE, "conv_id"]
    texts = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "depth long, d1 long, d2 long, first long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashes, "depth long, d1 long, d2 long, ends_sha256 string")


def crc_take(conv_id: Column) -> Column:
    """How many turns a conversation takes over: crc32 of its id in decimal, modulo 6."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def prefix_trie(conversations: DataFrame, take: Callable[[Column], Column] = crc_take, block: int = 100, most: int = 5, rows: int = 3, most_width: int = 1 << 25) -> DataFrame:
    """A row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. `take` says how many turns (at most `most`) a conversation takes over from the first of its `block`."""
    turns = dealt(turns_of(conversations))
    every, lengths = spliced(turns, take, block, most)
    every = stored(every, "prefixes")
    discard(turns)
    count = every.count()
    alone = alone_from(every, count, rows, most_width)
    alone = every.select("conv_id", "part").distinct().join(alone, "conv_id", "left")
    every = stored(every.join(alone, ["conv_id", "part"]), "screened")

    own = F.col("depth") > F.col("alone")  # null: never proven
    last = F.col("depth") == F.col("length")
    tails = every.where(own).select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY_SHA).alias("ends_sha256"))

    zero = F.lit(0).cast("long")
    asked = every.where(~F.coalesce(own, F.lit(False))).select("conv_id", "depth", "d1", "d2", "p1", "p2", "size", "before", "length", F.coalesce((F.col("depth") == F.col("alone")) & ~last, F.lit(False)).alias("tail"))
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), zero.alias("p1"), zero.alias("p2"), zero.alias("size"), zero.alias("before"), "length", F.lit(False).alias("tail"))
    asked = stored(asked.unionByName(roots), "asked")

    nodes = asked.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("tail").alias("tail"))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("kids"))
    nodes = nodes.join(kids, NODE, "left").withColumn("kids", F.coalesce("kids", zero)).withColumn("n_children", F.col("kids") + F.col("tail").cast("long")).drop("tail")
    nodes = stored(nodes, "nodes")

    often = max(1000, nodes.agg(F.coalesce(F.sum("n_convs"), zero).alias("n")).first().n // 1000)
    owned = spread_join(asked.where("depth > 0"), nodes.select(*NODE, "owner", "n_children", "n_convs"), NODE, F.col("n_convs") > often)
    mine = F.col("owner") == F.col("conv_id")
    paths = owned.groupBy("conv_id").agg(
        F.coalesce(F.min(F.when(mine, F.col("before"))), F.max(F.col("before") + F.col("size"))).alias("shared"),
        F.max((mine & (F.col("depth") == F.col("length")) & (F.col("n_children") == 0)) | F.col("tail")).cast("long").alias("leaf"), F.count("*").alias("n"))
    paths = stored(paths, "paths")
    sums = (spread_join(asked.select("conv_id", *NODE, "before"), paths, ["conv_id"], F.col("n") > often)
            .groupBy(*NODE).agg(F.sum(F.greatest(F.col("shared") - F.col("before"), zero)).alias("saved"), F.sum("leaf").alias("leaves")))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("owner").alias("parent_conv_id"), F.col("kids").alias("kids_"))
    grouped = spread_join(nodes, parents, ["depth", "p1", "p2"], F.col("kids_") > often, "left")
    grouped = grouped.join(sums, NODE, "left").join(ends(asked.where(last)), NODE, "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("leaves", zero)).cast("long").alias("n_leaves"), F.coalesce("saved", zero).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    return grouped.unionByName(tails)
