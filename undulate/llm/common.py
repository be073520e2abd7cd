"""What the operators of this subpackage share: tables in the shared folder, word rules, subword encoding."""

from __future__ import annotations

import gc
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undulate.session import ensure_checkpoint_dir

#: A word is a run of bytes other than space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        ensure_checkpoint_dir(spark)
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/undulate-llm/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step once to the shared folder and read it from there: a cut of the lineage that outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `stored` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts cross to Python in batches of few rows, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes with A-Z lower-cased; bytes.lower and bytes.split know ASCII only, as wanted."""
    return data.lower().split()


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(c.cast("string")) % n, F.lit(0))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of many slices of one array, in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


_PIECE = re.compile(r" (?=\S)")
_WIDE = re.compile(r" (?:\s|$)")
_LINE = re.compile(r"(?<=[^\s])\n(?=\S)")
#: After a Latin letter that neither case folding nor composition takes apart, or a digit.
_SIGNS = re.compile(r"(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f])[!-/:-@\[-`{-~]+$")
_SIGN = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ASCII_SPACE = "\t\n\x0b\x0c\r"
_BLANK = bytes.maketrans(_ASCII_SPACE.encode(), b" " * 5)
_PLAIN = bytes.maketrans((_ASCII_SPACE + UPPER).encode(), (" " * 5 + LOWER).encode())
_MARK = re.compile("[\u0300-\u036f]")
#: Marks a piece at the start of a text; no piece after a space begins with a space.
_FIRST = " "


def id_count(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])])


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file, which the library finds in a raw text before anything else."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    odd = [a["content"] for a in added if a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"]]
    if odd:
        raise ValueError(f"{path}: added tokens with rules of their own: {odd}")
    return {a["content"]: a["id"] for a in added}


class PieceEncoder:
    """Exact ids of whole texts, with each distinct piece encoded once.

    Where a text holds an added token literally, that becomes its id and what lies before and after are texts of their own.

    A text is cut at a space that a visible character follows; the space stays with what follows, where the vocabulary
    has spaces. The pre-tokenizers of the public files never cross such a cut, so the ids of a text are those of its
    pieces in turn. Pieces are cut once more at line breaks and before closing signs, where pre-tokens end as well. A
    worker keeps what it has encoded until that is more than `keep` pieces, and then begins anew.
    """

    def __init__(self, path: str, spaced: bool, keep: int = 1_500_000, ids_of: Callable[[list[str]], list[list[int]]] | None = None):
        self.path, self.added = path, added_tokens(path)
        names = sorted(self.added, key=len, reverse=True)
        self.found_added = re.compile("|".join(map(re.escape, names)) or "(?!)")
        self.ids_of = ids_of or library_ids(path)
        self.spaced, self.keep = spaced, keep
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _pieces(self, text: str) -> list[str]:
        """The first piece has a mark before it, as no space stood there."""
        if not self.spaced:  # white space is dropped and case folded: A-Z may be lower-cased at once where no mark composes
            return text.encode().translate(_BLANK if _MARK.search(text) else _PLAIN).decode().split(" ")
        parts = _PIECE.split(text) if _WIDE.search(text) else text.split(" ")
        parts[0] = _FIRST + parts[0]
        return parts

    def _parts(self, piece: str) -> list[str]:
        """A piece as pieces between which a pre-token ends: lines, and signs after the last letter or digit."""
        first = _FIRST if self.spaced else ""
        if self.spaced and "\n" in piece:
            lines = _LINE.split(piece)
            if len(lines) > 1:
                return [lines[0], *(first + x for line in lines[1:] for x in ("\n", line))]
        if piece[-1:] in _SIGN:
            signs = _SIGNS.search(piece)
            if signs and signs.start():
                return [piece[: signs.start()], first + piece[signs.start() :]]
        return []

    def _keep(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.index)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(names) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(names)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.index.update(zip(names, range(n, n + len(names))))

    def _learn(self, new: list[str]) -> None:
        """Encode what can't be cut any further, then join the rest from it, pieces of pieces first."""
        whole, made, level = {}, [], new
        while level:
            cut, below = {}, {}
            for p in level:
                parts = self._parts(p)
                if parts:
                    cut[p] = parts
                    for x in parts:
                        if x not in self.index:
                            below[x] = None
                else:
                    whole[p] = None
            made.append(cut)
            level = [x for x in below if x not in whole]
        names = list(whole)
        full = names if not self.spaced else [p[len(_FIRST) :] if p.startswith(_FIRST) else " " + p for p in names]
        found = self.ids_of(full)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._keep(names, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes)
        for group in reversed(made):
            group = {p: parts for p, parts in group.items() if p not in self.index}
            if group:
                flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(group.values())), np.int64)
                starts = self.starts[flat]
                lengths = self.starts[flat + 1] - starts
                counts = np.fromiter(map(len, group.values()), np.int64, len(group))
                self._keep(list(group), self.ids[ragged(starts, lengths)], np.add.reduceat(lengths, np.cumsum(counts) - counts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text begins (one more entry at the end)."""
        held = {i: self.found_added.findall(t) for i, t in enumerate(texts) if any(x in t for x in self.added)}
        if not held:
            return self._encode(texts)
        parts = [self.found_added.split(t) if i in held else [t] for i, t in enumerate(texts)]
        ids, edges = self._encode(list(chain.from_iterable(parts)))
        last = np.cumsum([len(p) for p in parts])
        after = np.setdiff1d(np.arange(1, len(edges)), last)  # edges inside a text: there an added token stood
        added = [self.added[x] for i in sorted(held) for x in held[i]]
        ids = np.insert(ids, edges[after], added)
        edges = edges + np.searchsorted(after, np.arange(len(edges)))
        return ids, edges[np.r_[0, last]]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.keep:
            self._reset()
        parts = [self._pieces(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        total = int(counts.sum())
        known = np.fromiter(map(self.index.get, chain.from_iterable(parts), repeat(-1)), np.int64, total)
        lack = np.flatnonzero(known < 0)
        if len(lack):
            flat = list(chain.from_iterable(parts))
            names = [flat[i] for i in lack.tolist()]
            collects = gc.isenabled()
            gc.disable()  # the many short lists of learning hold no cycles
            try:
                self._learn(list(dict.fromkeys(names)))
            finally:
                if collects:
                    gc.enable()
            known[lack] = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        starts = self.starts[known]
        lengths = self.starts[known + 1] - starts
        before = np.concatenate([[0], np.cumsum(lengths)])
        edges = before[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[ragged(starts, lengths)], edges


def library_ids(path: str) -> Callable[[list[str]], list[list[int]]]:
    """The tokenizers library on pieces that hold no added token."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    tok.no_padding()
    tok.no_truncation()
    return lambda names: [e.ids for e in tok.encode_batch_fast(names, add_special_tokens=False)]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """One encoder a worker process, kept from task to task."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = PieceEncoder(path, spaced)
    return _ENCODERS[path, spaced]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def texts_of(column) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column) -> list[bytes]:
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_batches(batches: Iterable, n_bytes: int = 8 << 20, column: str = "text") -> Iterator:
    """Arrow batches cut so that the texts of one stay near n_bytes (a longer text stands alone)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column).cast(pa.binary())), 0), dtype=np.int64)
        at = np.cumsum(sizes) // n_bytes
        cuts = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            yield b.slice(lo, hi - lo)
