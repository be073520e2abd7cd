"""Every stage of the pipeline against what it should keep of its input."""

import random
import re
from collections import Counter

import corpus_pipeline
from fixtures import documents, rows, write_documents
from test_language_secrets_simhash import SECRETS, firsts, spans
from test_records_packing import filled, ids_of, tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rnd = random.Random(8)
    voc = {"en": "the and tion ough ing with", "de": "der und keit lich sch ung"}
    data = [(600 + i, " ".join(rnd.choice(voc[lang].split()) + rnd.choice(voc[lang].split()) for _ in range(50)), lang, "abc"[i % 3], 1, 1, "", 1) for i, lang in enumerate(["en", "de"] * 40)]
    data += [(800 + i, data[i][1], "en", "a", 1, 1, "", 1) for i in range(5)]
    data += [(900, data[7][1] + " " + SECRETS[0], "de", "b", 1, 1, "", 1), (901, "123 456", "en", "a", 7, 1, "", 1), (902, None, None, None, None, None, None, None)]
    return [*data, data[3]]


def check_stages(spark, data, kept_by_language=None):
    """Every stage against a restatement of what it does to its input; the rows of the last one."""
    docs = documents(spark, data)
    steps = dict(corpus_pipeline.STAGES)
    first = steps["language_id"](spark, docs, "")
    assert first.columns == docs.columns
    kept = [tuple(r) for r in first.collect()]
    assert not Counter(kept) - Counter(map(tuple, docs.collect()))
    gone = Counter(map(tuple, docs.collect())) - Counter(kept)
    assert all(not any(map(str.isalpha, r[1] or "")) or kept_by_language is None for r in gone)
    if kept_by_language is not None:
        assert Counter(r[0] for r in kept) == kept_by_language
    second = steps["simhash_near_dedup"](spark, first, "")
    once = [tuple(r) for r in second.collect()]
    assert Counter(r[0] for r in once) == firsts(kept) and not Counter(once) - Counter(kept)
    third = steps["secret_scans"](spark, second, "")
    clean = [tuple(r) for r in third.collect()]
    assert Counter(r[0] for r in clean) == Counter(r[0] for r in once)
    for r in clean:
        assert not any(spans(part) for part in (r[1] or "").split("[secret]"))
    assert {r for r in once if not spans(r[1] or "") and "PRIVATE KEY" not in (r[1] or "")} <= {r for r in clean} | {r for r in once if r[1] is None or r[4] != len(r[1])}
    fourth = steps["source_mix"](spark, third, "")
    assert fourth.columns == docs.columns
    sizes, taken = Counter(), Counter()
    texts = {r[1] for r in clean}
    for r in clean:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    for r in fourth.collect():
        w = WORDS.findall(r.text)
        taken[r.source] += len(w)
        assert w and (r.text in texts or any(WORDS.findall(x or "")[: len(w)] == w for x in texts))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert all(abs(taken[s] - t) <= 1 for s, t in zip(order, filled([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))], 3)))
    fifth = steps["packing"](spark, fourth, "")
    t = tokenizer("word_bpe_49k.json")
    want = Counter((r.doc_id, len(ids_of(t, r.text, 2))) for r in fourth.collect())
    rows_ = fifth.collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in rows_ if r.start == 0) == want
    assert sum(r.length for r in rows_) == sum(n * k for (_, n), k in want.items())
    return sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in rows_)


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "secret_scans", "source_mix", "packing"]
    rows_ = check_stages(spark, corpus(), Counter(r[0] for r in corpus() if r[0] not in (901, 902)))
    folder = write_documents(spark, str(tmp_path), corpus())
    assert sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == rows_


def test_on_odd_and_empty_tables(spark, tmp_path):
    for data in (rows(), []):
        want = check_stages(spark, data)
        folder = write_documents(spark, f"{tmp_path}/{len(data)}", data)
        assert sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == want
        assert bool(want) == bool(data)
