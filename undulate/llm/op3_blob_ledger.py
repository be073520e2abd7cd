"""Secret scans with an incremental ledger of blobs.

A text is stored under the SHA-256 of its bytes, its blob. The ledger holds a row for every pair of a blob and a version
of a rule set that was ever scanned, with the spans found. A run scans only pairs that the ledger lacks, each blob once
however many documents or revisions hold it, adds them, and joins the findings of the wanted rule sets back to all
documents. A second run over the same texts reads no text at all for its scan.

Null texts count as empty. Spans are code points, end exclusive. Repeated rows stay rows of their own; an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undulate.llm.common import bytes_of, in_batches, stored, text_batches

LEDGER = "blob binary, rule_version string, spans array<struct<start:int, ord:int, kind:string, end:int>>"


@dataclass(frozen=True)
class Rule:
    """A span is a match whose `group` has `least` characters or more. needs: bytes without which nothing can match."""

    kind: str
    pattern: re.Pattern
    group: int
    least: int
    needs: tuple[bytes, ...] = ()
    folded: bool = False


# fixed values: the rules of the contract, kinds in their order
ASSIGN = Rule("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6,
              (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), True)
ACCESS = Rule("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20, (b"AKIA",))
HEX = Rule("hex", re.compile(r"[0-9a-f]+"), 0, 24)
# fixed values: well-known forms of keys
MORE = (
    Rule("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), 0, 1, (b"PRIVATE KEY-----",)),
    Rule("forge_token", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40, (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    Rule("chat_token", re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 0, 15, (b"xox",)),
    Rule("web_token", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0, 30, (b"eyJ",)),
)
#: Rule sets by version. A change of a rule takes a new version, and only that is scanned again.
RULE_SETS = {"base-1": (ASSIGN, ACCESS, HEX), "forms-1": MORE}
BASE = ("assign", "access", "hex")
ORDER = {r.kind: i for i, r in enumerate([*RULE_SETS["base-1"], *MORE])}

_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 46 for i in range(256))


def spans_of(data: bytes, rules: tuple[Rule, ...]) -> list[dict]:
    """Leftmost matches of each rule that don't overlap; matches that are too short are dropped and not tried again."""
    low = data.lower() if any(r.folded for r in rules) else b""
    text, found = None, []
    for r in rules:
        if r.needs and not any(x in (low if r.folded else data) for x in r.needs):
            continue
        if r is HEX and b"x" * r.least not in data.translate(_HEX):
            continue
        if text is None:
            text = data.decode()
        found += [{"start": m.start(), "ord": ORDER.get(r.kind, len(ORDER)), "kind": r.kind, "end": m.end()}
                  for m in r.pattern.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
    return found


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rule_sets: dict[str, tuple[Rule, ...]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, blob, spans) of every row, the rows that the ledger gained, and the whole ledger.

    The text of a blob is fetched from one of the documents that hold it; only ids and hashes are grouped.
    """
    import pyarrow as pa

    rule_sets = RULE_SETS if rule_sets is None else rule_sets
    spark = versions.sparkSession
    text_batches(spark)
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    paths = stored(versions.select("doc_id", blob(F.col("text")).alias("blob")), "paths")
    holders = paths.groupBy("blob").agg(F.min("doc_id").alias("_holder"))
    pairs = holders.withColumn("rule_version", F.explode(F.array(*map(F.lit, rule_sets))))
    unseen = (pairs.join(ledger.select("blob", "rule_version"), ["blob", "rule_version"], "left_anti")
              .groupBy("blob").agg(F.min("_holder").alias("_holder"), F.sort_array(F.collect_list("rule_version")).alias("_todo"))
              .withColumnRenamed("blob", "_blob"))
    texts = versions.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("_own", blob(F.col("text")))
    texts = texts.join(unseen.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_holder")) & (F.col("_own") == F.col("_blob")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_batches(batches):
            out = [(key, v, spans_of(data, rule_sets[v])) for key, data, todo in zip(b.column("_own").to_pylist(), bytes_of(b.column("text")), b.column("_todo").to_pylist()) for v in todo]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("ord", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string(), kind))], names=["blob", "rule_version", "spans"])

    gained = stored(texts.select("_own", "text", "_todo").mapInArrow(work, LEDGER), "ledger")
    gained = gained.dropDuplicates(["blob", "rule_version"])  # rows that repeat a document with its text were scanned again
    whole = ledger.unionByName(gained)
    found = (whole.where(F.col("rule_version").isin(*rule_sets) & (F.size("spans") > 0))
             .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    none = F.expr("cast(array() as array<struct<start:int, ord:int, kind:string, end:int>>)")
    report = paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))
    return report, gained, whole


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(report: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return report.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced by `mark`, and n_chars as it is then; all rows and columns are kept."""
    columns = docs.columns
    report, _, _ = scan(docs)
    report = report.where(F.size("spans") > 0).select(F.col("blob").alias("__ledger_blob"), F.col("spans").alias("__ledger_spans")).dropDuplicates(["__ledger_blob"])
    rows = docs.withColumn("__ledger_own", blob(F.col("text"))).join(report, F.col("__ledger_own") == F.col("__ledger_blob"), "left")
    # spans of several kinds may overlap: a cut goes on from where the last one ended
    cut = F.aggregate("__ledger_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at")), lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    rows = rows.withColumn("text", F.when(F.col("__ledger_spans").isNotNull(), cut).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*columns)
