"""Trie encoding, VA-file clusters and the conversation trie against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from undulate.llm import op12_va_file_clusters as va
from undulate.llm.common import encoder, vocabulary
from undulate.llm.op11_trie_bpe import TrieBPE, Trie, coder, decode, encode, round_trip
from undulate.llm.op13_prefix_trie import prefix_trie

FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(FILE))


@pytest.fixture(scope="module")
def trie_coder():
    return coder(vocabulary(FILE), 1000)


def test_trie_inserts_each_prefix_once():
    words = sorted([b"a", b"abc", b"abd", b"b", b"abcde", b"x" * 5000])
    t = Trie(words)
    assert sorted(words[t.word[n]][: t.depth[n]] for n in range(1, len(t.depth)) if t.ends[n]) == words
    prefixes = [words[t.word[n]][: t.depth[n]] for n in range(len(t.depth))]
    assert len(prefixes) == len(set(prefixes))
    for node, above in t.depth_first():
        assert above <= t.depth[node]
        for c in t.children[node]:
            assert prefixes[c].startswith(prefixes[node]) and t.depth[c] > t.depth[node]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabcehst 'é字́ \n\t-_1½🙂<|>"), max_size=60), max_size=5))
def test_trie_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(FILE))
    pieces, bpe = coder(vocabulary(FILE), 1000)
    ids, edges = pieces.encode(texts)
    for t, lo, hi in zip(texts, edges, edges[1:]):
        assert ids[lo:hi].tolist() == tok.encode(t, add_special_tokens=False).ids
        assert bpe.decode(ids[lo:hi].tolist()) == t


@pytest.mark.parametrize("name", [FILE, "word_bpe_49k.json"])
def test_added_tokens_in_texts(name):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|startoftext|>x<|endoftext|><|endoftext|> \n y", "<|ENDOFTEXT|>", "<|endoftext", "", "x" * 3000 + "<|endoftext|>", "plain"]
    tok = Tokenizer.from_file(vocabulary(name))
    ids, edges = encoder(vocabulary(name), name == FILE).encode(texts)
    assert [ids[lo:hi].tolist() for lo, hi in zip(edges, edges[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoding_any_ids(trie_coder, library):
    rnd = random.Random(4)
    for _ in range(300):
        ids = [rnd.randrange(0, 50300) for _ in range(rnd.randrange(0, 40))]
        known = [i for i in ids if i < 50257]
        assert trie_coder[1].decode(known) == library.decode(known, skip_special_tokens=False) == trie_coder[1].decode(ids)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        TrieBPE(vocabulary("word_bpe_49k.json"))


def test_round_trip_of_odd_documents(spark, library):
    data = [*rows(), (200, "a <|endoftext|> b", None, None, 1, 1, "", 1), (201, "w" * 200_000, None, None, 1, 1, "", 1)]
    docs = documents(spark, data)
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(docs).collect())
    want = []
    for d in data:
        ids = library.encode(d[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d[0] is None, d[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    back = decode(encode(docs))
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in back.collect()) == sorted((d[0] is None, d[0], d[1] or "") for d in data)
    assert round_trip(docs.limit(0)).collect() == []


# --- clusters


def brute_clusters(data, k, n_rounds, dims, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in data
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < va.REACH / scale for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in first[:k]]
    if not c:
        return [], c
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(n_rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c[j] for j in range(len(c))]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def vectors(n, dims, seed, spread=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("bits,block,sample", [(6, 4096, 4096), (2, 7, 20), (1, 3, 16)])
def test_clusters_equal_brute_force(spark, bits, block, sample):
    data = vectors(300, 8, bits)
    data += [(300, None), (301, [1.0] * 7), (302, [math.nan] * 8), (303, [None] * 8), (304, [math.inf] * 8), (305, [0.0] * 8), (306, [1e30] * 8), (307, [-2e6, 2e6] * 4)]
    data += [data[3], data[3], (4, data[5][1]), (None, data[9][1]), (None, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, cluster int, id string").repartition(3)
    found, c = va.clusters(df, k=16, dims=8, bits=bits, block=block, sample=sample)
    want, want_c = brute_clusters(data, 16, 3, 8, 64)
    assert c.tolist() == want_c
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    out = va.digest(found, c).collect()
    total = sum(d for _, _, d in want)
    for r in out:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_c[r.cluster])).encode()).hexdigest()


def test_ties_equal_vectors_and_few_rows(spark):
    data = [(i, [float(i % 2)] * 4) for i in range(9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for k in (2, 16):
        found, c = va.clusters(df, k=k, dims=4)
        want, want_c = brute_clusters(data, k, 3, 4, 64)
        assert c.tolist() == want_c and sorted(map(tuple, found.collect())) == sorted(want)
    for empty in (df.limit(0), df.where("vec_id < 0"), spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")):
        assert va.digest(*va.clusters(empty, dims=4)).collect() == []


def test_cells_hold_their_values_and_intervals_their_distances():
    rng = np.random.default_rng(5)
    v = rng.integers(-300, 300, (500, 6))
    cells = va.Cells(v[:50].min(axis=0), v[:50].max(axis=0), 3)
    cells.reach(v.min(axis=0), v.max(axis=0))
    own = cells.of(v)
    assert (va.unpacked(va.packed(own, 3), 500, 6, 3) == own).all()
    for d in range(6):
        assert (cells.low[d][own[:, d]] <= v[:, d]).all() and (v[:, d] <= cells.high[d][own[:, d]]).all()
    c = rng.integers(-300, 300, (9, 6))
    left = va.in_reach(va.packed(own, 3), 500, 6, cells, cells.tables(c))
    at, _ = va.nearest(v, np.ones_like(left), c)
    assert left[np.arange(500), at].all() and not left.all()


# --- conversations


def brute_trie(data):
    own = defaultdict(list)
    for conv, turn, role, text in data:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in kids[p]) or 1
        saved[p] = sum(saved[x] for x in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        done = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=260, most=12):
    rnd = random.Random(seed)
    texts = ["hi", "héllo 🙂", "", None, "long " * 50]
    out = []
    for c in rnd.sample(range(-150, 500), n):
        same = rnd.random() < 0.5
        for t in range(rnd.randrange(1, most)):
            out.append((c, t, "user" if t % 2 else None, texts[t % 5] if same else rnd.choice(texts)))
    return out


@pytest.mark.parametrize("seed,width", [(1, 1 << 25), (2, 1)])
def test_trie_equals_brute_force(spark, seed, width):
    data = conversations(seed)
    data += [(700, t, "a", f"own {t}") for t in range(400)] + [(701, None, "a", "first"), (701, 0, "a", "x"), (None, 1, "a", "x"), (701, 0, "a", "x"), (702, -5, None, None)]
    data += [(c, t, "u", f"twin {t}") for c in (800, 900) for t in range(90)]  # 800 and 900 are equal to their ends
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "conv_id long, turn long, role string, text string, part string, depth int").repartition(5)
    got = sorted(map(tuple, prefix_trie(df, most_width=width).collect()), key=str)
    assert got == brute_trie(data)


def test_one_conversation_over_many_tasks(spark):
    data = [(5, t // 3, "u", f"{t % 7}") for t in range(3000)] + [(c, 0, "u", "x") for c in range(100, 140)]
    data = list({(c, t, r, x) for c, t, r, x in data})
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    # equal turns are ordered by digest, so only what doesn't depend on their order is held against brute force
    key = lambda rows: sorted((r[0], r[1], r[2] or 0, *r[3:6], r[7]) for r in rows)
    assert key(map(tuple, got)) == key(brute_trie(data))


def test_only_shared_prefixes_are_grouped(spark):
    from undulate.llm.op13_prefix_trie import alone_from, crc_take, dealt, spliced, turns_of

    df = spark.createDataFrame([(c, t, "u", f"{c} {t}" if t else "hello") for c in range(100, 160) for t in range(20)], "conv_id long, turn long, role string, text string")
    every, _ = spliced(dealt(turns_of(df)), lambda c: crc_take(c) * 0, 100, 5)
    alone = {r.conv_id: r.alone for r in alone_from(every, every.count()).collect()}
    assert len(alone) == 60 and set(alone.values()) == {2}


def test_empty_conversations(spark):
    df = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie(df).collect() == [] and prefix_trie(df.limit(0)).collect() == []
    turnless = spark.createDataFrame([(c, 0, "u", "x") for c in (101, 102, 103, 104)], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie(turnless).collect()), key=str) == brute_trie([(c, 0, "u", "x") for c in (101, 102, 103, 104)])
