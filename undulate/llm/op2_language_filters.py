"""Language ID by bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of the letter n-grams that are typical of it, all of one size and with the same hash
functions. They are stored sliced: slot i holds a bitmask with bit l set if the filter of language l has bit i set, so
that k reads and two ANDs return all languages that contain an n-gram. A document's popcount per language, less the
hits that chance alone brings (known from how full the filter is), decides.

n-grams: four characters of the lower-cased text, of which the inner two are letters and an outer one may stand for a word's
edge; besides, words of one letter with their edges. They are counted over all texts to learn from. A language contains
an n-gram if its share of the language's n-grams is `least` or more and no other language's share is `ratio` times as large;
so a language has at most 1/least n-grams, which bounds the filters whatever the corpus.

A null text, or one without a letter, is `und` with score 0, as is every text if nothing was learned. Where no n-gram decides,
the language with most documents wins (then by code point). Repeated rows stay; an empty table gives none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undulate.llm.common import crc_mod, in_batches, stored, text_batches, texts_of

#: Code points looked at in one step.
STEP = 1 << 20
#: Odd multipliers of the hash functions.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Code points without letters, where the letters above 16 bits are filed.
FILED, FILED_SIZE = 0xE000, 0x1900


@functools.cache
def letters() -> np.ndarray:
    """16-bit code of the lower-case letter of each code point; 0 for all that is no letter. Letters above 16 bits share the
    codes of the private area, 6400 of them."""
    out = np.zeros(0x110000, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low if low < 1 << 16 else FILED + low % FILED_SIZE
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, n-gram) arrays in steps: which text an n-gram is of, and its four 16-bit codes as one number."""
    joined = "\n".join(["", *texts, "", ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes = letters()[points]
    for at in range(0, len(codes) - 3, STEP):
        c = codes[at : at + STEP + 3]
        a, b, d, e = c[:-3], c[1:-2], c[2:-1], c[3:]
        own = (b > 0) & ((d > 0) | (a == 0))  # two inner letters, or one with edges on both sides
        i = np.flatnonzero(own)
        wide = lambda x: x[i].astype(np.uint64)
        last = np.where(d[i] > 0, e[i], 0).astype(np.uint64)
        key = wide(a) << np.uint64(48) | wide(b) << np.uint64(32) | wide(d) << np.uint64(16) | last
        yield np.searchsorted(ends, i + at, side="right"), key


def counted(docs: DataFrame) -> DataFrame:
    """lang, gram, n: n-grams of all texts by language, summed in each task before the shuffle."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held[lang]])
            counts = np.concatenate([c for _, c in held[lang]])
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, counts).astype(np.int64)

        for b in in_batches(batches, 2 << 20):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), texts_of(b.column("text"))):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for _, keys in grams(texts):
                    held.setdefault(lang, []).append(np.unique(keys, return_counts=True))
                if len(held.get(lang, ())) > 16:
                    held[lang] = [merged(lang)]
        for lang in held:
            keys, counts = merged(lang)
            for lo in range(0, len(keys), 50_000):
                k, c = keys[lo : lo + 50_000], counts[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Filters:
    """langs: by most documents. tables: for each 64 languages, one bitmask a slot. chance: false positives by language."""

    langs: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    bits: int
    chance: np.ndarray

    def hits(self, keys: np.ndarray) -> list[np.ndarray]:
        """Bitmasks of the languages that contain each n-gram."""
        shift = np.uint64(64 - self.bits)
        at = [(keys * np.uint64(m)) >> shift for m in MULTIPLIERS]
        return [t[at[0]] & t[at[1]] & t[at[2]] for t in self.tables]


def build(langs: list[str], lang_of: np.ndarray, keys: np.ndarray, per_gram: int = 12) -> Filters:
    """Filters of (language number, n-gram) pairs with about `per_gram` bits for each n-gram of the largest language."""
    most = max(1, int(np.bincount(lang_of, minlength=1).max()))
    bits = max(10, int(np.ceil(np.log2(most * per_gram))))
    tables, chance = [], []
    for lo in range(0, len(langs), 64):
        n = min(64, len(langs) - lo)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= n)
        t = np.zeros(1 << bits, kind)
        for i in range(n):
            own = keys[lang_of == lo + i]
            for m in MULTIPLIERS:
                t[(own * np.uint64(m)) >> np.uint64(64 - bits)] |= kind(1 << i)
            chance.append(float(np.mean(t >> kind(i) & kind(1))) ** len(MULTIPLIERS))
        tables.append(t)
    return Filters(tuple(langs), tuple(tables), bits, np.array(chance))


def learn(docs: DataFrame, least: float = 3e-6, ratio: float = 3.0) -> Filters:
    """Filters from the texts whose language is known. To the driver come only the n-grams that filters hold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    text_batches(docs.sparkSession)
    order = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    langs = [r.lang for r in order]
    counts = stored(counted(known), "ngrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals) if len(langs) < 10_000 else totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    top = shares.groupBy("gram").agg(F.max("share").alias("top")).where(F.col("top") >= least)
    typical = shares.where(F.col("share") >= least).join(top, "gram").where(F.col("share") * ratio >= F.col("top")).select("lang", "gram").toArrow()
    number = {x: i for i, x in enumerate(langs)}
    lang_of = np.array([number[x] for x in typical.column("lang").to_pylist()], np.int64)
    return build(langs, lang_of, typical.column("gram").to_numpy().view(np.uint64))


def decide(filters: Filters, texts: list[str]) -> tuple[list[str], np.ndarray]:
    n = np.zeros(len(texts))
    hits = np.zeros((len(filters.langs), len(texts)))
    for text, keys in grams(texts):
        n += np.bincount(text, minlength=len(texts))
        for t, mask in enumerate(filters.hits(keys)):
            for i in range(64 * t, min(64 * t + 64, len(filters.langs))):
                own = (mask >> mask.dtype.type(i - 64 * t)) & mask.dtype.type(1)
                hits[i] += np.bincount(text, own, minlength=len(texts))
    if not filters.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    chance = filters.chance[:, None]
    real = np.maximum(0, (hits - n * chance) / np.maximum(1 - chance, 1e-9))
    best = real.argmax(axis=0)
    score = np.minimum(1, real[best, np.arange(len(texts))] / np.maximum(n, 1))
    none = [not has_letter(t) for t in texts]
    return ["und" if x else filters.langs[i] for x, i in zip(none, best)], np.where(none, 0.0, score)


def predict(docs: DataFrame, filters: Filters, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row with lang_pred and score."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_batches(batches, 2 << 20):
            lang, score = decide(shared.value, texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang), pa.array(score)], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = StructType([*(rows.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(work, schema)


def identify(docs: DataFrame, held_out: Column | None = None, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score; texts that are held out teach nothing."""
    out = crc_mod(F.col("doc_id"), 4) == 2 if held_out is None else held_out
    filters = learn(docs.where(~out), **params)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), filters, ["doc_id", "held_out"])


def floors(docs: DataFrame, filters: Filters, share: float, part: float) -> dict[str, float]:
    """Per language, `part` of the score that all but `share` of its labelled texts reach when they are taken for it."""
    told = predict(docs.where(F.col("lang").isNotNull()).select(F.col("lang").alias("told"), "text"), filters, ["told"])
    own = told.where(F.col("told") == F.col("lang_pred")).groupBy("lang_pred").agg(F.percentile_approx("score", share, 10_000).alias("s"))
    return {r.lang_pred: part * r.s for r in own.collect()}


def in_known_language(docs: DataFrame, share: float = 0.01, part: float = 0.5, **params) -> DataFrame:
    """The documents that are in a learned language; a stage of the pipeline.

    All labelled rows teach. A text goes if it is `und` (null, without a letter, or nothing was learned) or if its score is
    below the floor of the language that it is taken for: `part` of the lowest score but for `share` of the texts labelled so, so
    that scripts and corpora with lower scores have lower floors. Languages that no labelled text was taken for have none.
    Rows without an id, repeated rows and extra columns stay as they are; an empty table gives none.
    """
    columns = docs.columns
    filters = learn(docs.select("lang", "text"), **params)
    floor = floors(docs, filters, share, part)
    named = docs.select(*(F.col(c).alias(f"__{i}") if c != "text" else F.col(c) for i, c in enumerate(columns)))
    found = predict(named, filters, named.columns)
    least = F.create_map(*(F.lit(x) for item in floor.items() for x in item))[F.col("lang_pred")] if floor else F.lit(0.0)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= F.coalesce(least, F.lit(0.0))))
    return kept.select(*(F.col("text" if c == "text" else f"__{i}").alias(c) for i, c in enumerate(columns)))
