"""Byte-pair encoding by a trie of words, and decoding.

The ids of a word end in the one token that is a suffix of the word, is next to the last token of what stands before it and
would stay apart from that token in a merge of the two; so a prefix is known by its last token and by where that begins. Distinct
words are inserted into a trie, whose nodes are the prefixes at which they part. Going through it depth first, the last
token of each prefix follows from those of shorter prefixes on the same path; a prefix that many words share is worked out
once. A word's ids are read back from its end. Whether two tokens stay apart is found by taking their merges back, latest
first, until neither can be split or a merge across the border would have come before.

Every task keeps the pieces that it has met (up to `keep`), so nothing is shuffled; a trie holds at most `trie_words` new words, in
sorted order, and an edge of it may have any length, so that a very long word costs one node. Texts are whole: null is the
empty text, of no ids. Added tokens that stand in a text literally become their id, as the library's own setting has it.
Only doc_id and text are read; repeated rows and rows without an id stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from undulate.llm.common import PieceEncoder, added_tokens, in_batches, texts_of, vocabulary

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids array<int>"
#: Last bytes of a prefix that tell which lengths its last token may have.
TAIL = 4
#: The words of a byte-level vocabulary of this kind, where a text is cut before anything is merged.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The visible sign of each byte: itself if it is visible in Latin-1, else the next free one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def shared_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


class Trie:
    """Sorted distinct words; node 0 is the empty prefix. A node's prefix are the first `depth` bytes of its `word`."""

    def __init__(self, words: list[bytes]):
        self.words, self.depth, self.word, self.children, self.ends = words, [0], [0], [[]], [False]
        path = [0]
        for i, w in enumerate(words):
            shared = shared_length(words[i - 1], w) if i else 0
            below = path[-1]
            while self.depth[path[-1]] > shared:
                below = path.pop()
            if self.depth[path[-1]] < shared:  # the two part inside the edge to `below`
                parting = self._node(shared, i, False)
                self.children[path[-1]][-1] = parting
                self.children[parting].append(below)
                path.append(parting)
            leaf = self._node(len(w), i, True)
            self.children[path[-1]].append(leaf)
            path.append(leaf)

    def _node(self, depth: int, word: int, ends: bool) -> int:
        self.depth.append(depth)
        self.word.append(word)
        self.children.append([])
        self.ends.append(ends)
        return len(self.depth) - 1

    def depth_first(self) -> Iterator[tuple[int, int]]:
        """(node, depth of its parent), a parent before its children."""
        stack = [(0, 0)]
        while stack:
            node, above = stack.pop()
            yield node, above
            stack.extend((c, self.depth[node]) for c in reversed(self.children[node]))


class TrieBPE:
    """The merges of a byte-level vocabulary file. Tokens are numbered by rank: the bytes, then the merges in their order."""

    def __init__(self, path: str, trie_words: int = 20_000, most_pairs: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kind = (spec["normalizer"], spec["pre_tokenizer"]["type"], spec["pre_tokenizer"].get("use_regex"), spec["pre_tokenizer"].get("add_prefix_space"))
        if kind != (None, "ByteLevel", True, False) or model["type"] != "BPE" or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        import regex
        from tokenizers import Tokenizer

        self.cut, self.cut_any = regex.compile(SPLIT), Tokenizer.from_file(path).pre_tokenizer
        self.trie_words, self.most_pairs = trie_words, most_pairs
        signs = byte_signs()
        ids, self.of = np.zeros(256 + len(model["merges"]), np.int64), {}
        self.left, self.right, self.merged = list(range(256)), list(range(256)), {}
        self.bytes = [bytes([b]) for b in range(256)]
        number = {s: b for s, b in signs.items()}
        for s, b in signs.items():
            ids[b] = model["vocab"][s]
            self.of[bytes([b])] = b
        self.apart: dict[tuple[int, int], bool] = {}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            t, x, y = len(self.bytes), number[a], number[b]
            if a + b in number:
                raise ValueError(f"{path}: two merges give {a + b}")
            number[a + b] = t
            ids[t] = model["vocab"][a + b]
            self.left.append(x)
            self.right.append(y)
            self.merged[x, y] = t
            self.bytes.append(self.bytes[x] + self.bytes[y])
        for t in range(256, len(self.bytes)):  # a token whose own bytes are merged otherwise never comes out
            x, y = self.left[t], self.right[t]
            if self.bytes[x] in self.of and self.bytes[y] in self.of and self._stay_apart(x, y, t):
                self.of[self.bytes[t]] = t
        self.ids, self.size = ids.tolist(), [len(b) for b in self.bytes]
        ending: dict[bytes, set[int]] = {}
        for b in self.of:
            ending.setdefault(b[-TAIL:], set()).add(len(b))
        self.ending, self.lengths = ending, {}  # lengths: of the tokens that may end where these bytes do, longest first
        self.text = dict(zip(self.ids, self.bytes)) | {i: s.encode() for s, i in added_tokens(path).items()}

    def _stay_apart(self, a: int, b: int, before: int | None = None) -> bool:
        """Do tokens a and b stay as they are, side by side? `before`: looking only at merges of smaller rank."""
        limit = len(self.bytes) if before is None else before
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if max(a, b) < 256:
                return True
            if a > b:  # the later one is taken back; of two merges of one rank the left one came first
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def _lengths(self, tail: bytes) -> tuple[int, ...]:
        """Lengths of the tokens that can be a suffix of a prefix with these last bytes."""
        if len(self.lengths) > self.most_pairs:
            self.lengths.clear()
        found = {n for i in range(len(tail)) for n in self.ending.get(tail[i:], ()) if i == 0 or n == len(tail) - i}
        out = self.lengths[tail] = tuple(sorted(found, reverse=True))
        return out

    def _last_tokens(self, trie: Trie) -> Iterator[tuple[int, array]]:
        """(word, last tokens of all its prefixes by their length), for each word of a trie."""
        of, lengths, apart = self.of, self.lengths, self.apart
        last = array("i", bytes(4 * (1 + max(map(len, trie.words)))))
        for node, above in trie.depth_first():
            w = trie.words[trie.word[node]]
            for d in range(above + 1, trie.depth[node] + 1):
                tail = w[max(0, d - TAIL) : d]
                for n in lengths.get(tail) or self._lengths(tail):
                    if n > d:
                        continue
                    t = of.get(w[d - n : d])
                    if t is None:
                        continue
                    if n < d:
                        pair = last[d - n], t
                        fits = apart.get(pair)
                        if fits is None:
                            fits = apart[pair] = self._stay_apart(*pair)
                        if not fits:
                            continue
                    last[d] = t
                    break
            if trie.ends[node]:
                yield trie.word[node], last

    def word_ids(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words, none of them empty."""
        words, out = sorted(words), {}
        for lo in range(0, len(words), self.trie_words):
            trie = Trie(words[lo : lo + self.trie_words])
            for i, last in self._last_tokens(trie):
                w, own = trie.words[i], []
                d = len(w)
                while d:
                    own.append(self.ids[last[d]])
                    d -= self.size[last[d]]
                out[w] = own[::-1]
            if len(self.apart) > self.most_pairs:
                self.apart.clear()
        return out

    def words_of(self, text: str) -> list[bytes]:
        """Classes of letters beyond ASCII differ between releases of Unicode, so the vocabulary's own library cuts there."""
        if text.isascii():
            return [w.encode() for w in self.cut.findall(text)]
        return [text[a:b].encode() for _, (a, b) in self.cut_any.pre_tokenize_str(text)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        cut = [self.words_of(t) for t in texts]
        known = self.word_ids(list({w for c in cut for w in c}))
        return [[i for w in c for i in known[w]] for c in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that are no UTF-8 become replacement signs, ids that aren't known nothing."""
        return b"".join(map(self.text.get, ids, repeat(b""))).decode("utf-8", "replace")


_CODERS: dict[str, tuple[PieceEncoder, TrieBPE]] = {}


def coder(path: str, keep: int) -> tuple[PieceEncoder, TrieBPE]:
    """One a worker process, kept from task to task."""
    if path not in _CODERS:
        bpe = TrieBPE(path)
        _CODERS[path] = PieceEncoder(path, True, keep, bpe), bpe
    return _CODERS[path]


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", keep: int = 1_500_000) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = coder(vocabulary(tokenizer), keep)
        for b in in_batches(batches, 4 << 20):
            ids, edges = pieces.encode(texts_of(b.column("text")))
            lists = pa.ListArray.from_arrays(edges.astype(np.int32), ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, IDS)


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json", keep: int = 1_500_000) -> DataFrame:
    """(doc_id, text) of ids; null ids give no text."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, bpe = coder(vocabulary(tokenizer), keep)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [None if x is None else bpe.decode(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", keep: int = 1_500_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, ids and texts staying in the task."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, bpe = coder(vocabulary(tokenizer), keep)
        for b in in_batches(batches, 4 << 20):
            ids, edges = pieces.encode(texts_of(b.column("text")))
            ids = ids.astype("<u4")
            sizes, of_ids, of_text = [], [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = ids[lo:hi]
                sizes.append(hi - lo)
                of_ids.append(hashlib.sha256(own.tobytes()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(own.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(work, ENCODED)
