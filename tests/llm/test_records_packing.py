"""Token records, packing, source mix and URL rules against plain restatements."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import SCHEMA, documents, rows

from undulate.llm.common import vocabulary
from undulate.llm.op6_source_mix import mix, mixed_documents
from undulate.llm.op8_url_rules import RULES, judge, listed_rule, pattern_rule
from undulate.llm.op9_token_records import framed, read_records, token_positions, unframed, write_records
from undulate.llm.op10_packing import cuts, differencing, pack, windows

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def odd_rows():
    """Rows with added tokens in their texts besides."""
    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext"]
    return rows() + [(150 + i, t, "en", "b", 1, 1, "x", 1) for i, t in enumerate(texts)]


def ids_of(t, text, end):
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_records_round_trip(spark):
    t = tokenizer("byte_bpe_50k.json")
    data = odd_rows()
    index = write_records(documents(spark, data))
    got = sorted(token_positions(read_records(index)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in data), key=lambda i: (i is not None, i or 0))
    want = defaultdict(list)
    for r in data:
        want[r[0]].append(ids_of(t, r[1], 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(x.tobytes())) for x in want[r.doc_id]]
    some = read_records(index.where("doc_id % 7 = 3"), with_ids=True).collect()
    assert {r.doc_id for r in some} == {i for i in range(60) if i % 7 == 3} | {101, 150}
    for r in some:
        assert r.ids == want[r.doc_id][0].tolist()


def test_broken_record():
    r = framed(b"\x01\x02\x03\x04")
    assert unframed(r) == b"\x01\x02\x03\x04"
    for i in range(len(r)):
        with pytest.raises(ValueError):
            unframed(r[:i] + bytes([r[i] ^ 1]) + r[i + 1 :])


def test_packing(spark):
    t = tokenizer("word_bpe_49k.json")
    data = odd_rows()
    got = pack(documents(spark, data), group_tokens=20_000).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    want, ids = Counter(r[0] for r in data), {r[0]: ids_of(t, r[1], 2) for r in data}
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        at = cuts(len(ids[i]), 4096, 1024)
        expect = Counter({(s, e - s, zlib.crc32(ids[i][s:e].tobytes()), len(ids[i])): want[i] for s, e in zip(at, at[1:])})
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in parts) == expect
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert pack(documents(spark, [])).count() == 0 and write_records(documents(spark, [])).count() == 0


def test_many_tiny_pieces_make_more_groups(spark):
    docs = documents(spark, [(i, None, None, None, 0, 0, "", 0) for i in range(200)])
    got = pack(docs, group_pieces=50).collect()
    assert len(got) == 200 and {r.doc_tokens for r in got} == {1}
    assert len({r.sequence_id >> 32 for r in got}) == 4


def test_differencing():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 3), (5, 2), (40, 7), (500, 60)):
        sizes = rng.integers(1, 1024, n)
        w = differencing(sizes, m)
        sums = np.bincount(w, sizes, m)
        assert len(w) == n and w.min() >= 0 and w.max() < m and sums.sum() == sizes.sum()
        if n >= 40:
            assert sums.max() - sums.min() < 0.05 * sums.mean()
    w = windows(np.array([4000, 4000, 100, 90, 4096, 3000, 1100]), 4096)
    assert np.bincount(w, [4000, 4000, 100, 90, 4096, 3000, 1100]).max() <= 4096


def filled(sizes, weights, cap):
    """Reshare what lies above a cap, by weight, until none is."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        for i in open_:
            target[i] = left * weights[i] / sum(weights[j] for j in open_)
        above = {i for i in open_ if target[i] > cap * sizes[i]}
        for i in above:
            target[i] = cap * sizes[i]
        if not above:
            return target
        full |= above


def test_mix(spark):
    for data, block in ((rows(), 1024), (rows(200, 5), 16), ([r for r in rows(300, 6) if r[3] != "é" or r[0] < 9], 64)):
        taken, schedule = mix(documents(spark, data), block=block)
        got = taken.collect()
        sizes = defaultdict(int)
        for r in data:
            sizes[r[3]] += len(WORDS.findall((r[1] or "").encode()))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        target = dict(zip(order, filled([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))], 3)))
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in data)
        sums = defaultdict(int)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
            assert 0 <= r.taken <= 3 * r.size
            sums[r.source] += r.taken
        assert all(abs(sums[s] - target[s]) <= 1 for s in order)
        slots = Counter(r.slot for r in schedule.select("slot", "skey").distinct().collect())
        assert max(slots.values()) == 1  # a slot belongs to one source
        assert sorted(taken.collect(), key=repr) == sorted(mix(documents(spark, data), block=block)[0].collect(), key=repr)
        out = mixed_documents(documents(spark, data), block=block)
        assert out.columns == documents(spark).columns
        by = defaultdict(int)
        for r in out.collect():
            by[r.source] += len(WORDS.findall(r.text.encode()))
        assert all(abs(by[s] - target[s]) <= 1 for s in order)
        own = Counter()
        for r in got:  # whole texts as often as they are taken, and one part of the rest
            own[r.doc_id, r.source, r.size] += r.taken
        assert own == Counter({k: n for k, n in own.items()}) and sum(own.values()) == sum(by.values())
    assert mix(documents(spark, []))[0].count() == 0


def test_rows_without_ids_get_their_own_words(spark):
    data = [(None, "a b c d e", "en", "s", 1, 1, "", 1)] * 7 + [(1, " ".join("xyz"[i % 3] for i in range(40)), "en", "t", 1, 1, "", 1)] * 3
    docs = documents(spark, data)
    taken, _ = mix(docs)
    words = Counter()
    for r in mixed_documents(docs).collect():
        words[r.source] += len(r.text.split())
    for s in "st":
        assert words[s] == sum(r.taken for r in taken.collect() if r.source == s)


def test_mix_is_even_along_the_way(spark):
    data = [(i, "w " * 40, "en", "abc"[i % 3], 1, 1, "", 1) for i in range(600)]
    _, schedule = mix(documents(spark, data), block=40)
    seen = [r.skey for r in schedule.orderBy("slot", "at").collect()]
    for upto in range(60, len(seen), 60):
        c = Counter(seen[:upto])
        assert all(abs(c[f"={s}"] / upto - w / 6) < 0.05 for s, w in zip("abc", (1, 2, 3)))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://a.net/x", "https://example.net/en/1?x#y", "http://EXAMPLE.net/de/", "http://badexample.net/en/",
            "http://x.example.com/de/a", "http://x.example.com/dev/a", "http://foo.org/fr/", "http://foo.org/fr", "http://u@h.org#/fr/", "x://a.net?/", "http://spam-farm.org/en/",
            "http://a://b.net/", "http://a.b/c/track/9", "http://a.b/click/9", "http://a.b/clicks/9", "http://straße.net/é\n/z"] + ["http://hot.net/a"] * 50
    pages = spark.createDataFrame([(i, u, "h", "x", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, token int")
    lists = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in lists if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=None)
        spam = re.match(r"([^/]*[.-])?spam-", host) or "/track/" in path or "/click/" in path
        return host, path, rule and rule[1], rule[2] if rule else "block" if spam else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages).collect()}
    assert got == {i: want(u) for i, u in enumerate(urls)}
    assert judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        judge(pages, (pattern_rule("any", "block", "."),))
    assert listed_rule("a.b", "/en", "allow").tokens == ("h:a", "h:b")
    assert SCHEMA


def test_statement_of_the_rules(spark):
    import duckdb

    from undulate.llm.sql import OP8

    urls = ["http://a.com/click/x", "http://a.com/x/track/", "http://a.com/clicks/x", "http://spam-a.com/", "http://a.net/click/", "http://a.com/a?/click/", None]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    got = judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(con.execute(OP8).fetchall()) == sorted(map(tuple, got.collect()))


def test_a_rule_is_fetched_by_every_url_that_fits(spark):
    urls = ["http://a.com/click/x", "http://a.com/track/x", "http://a.com/x/click/track/y", "http://a.com/click", "http://a.com/my-click/x", "http://a.com/clicks/x", "http://spam-a.com/", "http://a.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.pattern, r.verdict) for r in judge(pages).collect()}
    for i, u in enumerate(urls):  # the expressions alone, over every URL
        fits = [(len(r.regex), r.name, r.verdict) for r in RULES if not r.listed and re.search(r.regex, u.split("://")[1])]
        assert got[i] == (max(fits)[1:] if fits else (None, "allow"))
        held = {f"p:{x}" for x in re.split("[^A-Za-z0-9]+", u.split("://")[1].partition("/")[2])} | {f"h:{x}" for x in re.split("[^a-z0-9]+", u.split("/")[2])}
        for r in RULES:
            if re.search(r.regex, u.split("://")[1]):
                assert all(held & set(need.split("|")) for need in r.tokens), (u, r.name)
