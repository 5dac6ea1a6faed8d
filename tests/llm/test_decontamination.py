import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salesloom.llm import decontamination as dec

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, items, window=10):
    """Per text: number of words, hit words, items."""
    fold = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    strings = [(i, tuple(w[k:k + window])) for i, t in items if i is not None and (w := fold(t))
               for k in range(max(1, len(w) - window + 1))]
    out = []
    for text in texts:
        words, hit, found = fold(text), set(), set()
        for item, string in strings:
            for k in range(len(words) - len(string) + 1):
                if tuple(words[k:k + len(string)]) == string:
                    hit.update(range(k, k + len(string)))
                    found.add(item)
        out.append((len(words), len(hit), sorted(found)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4), st.lists(st.sampled_from("abc"), max_size=40),
       st.integers(1, 5))
def test_search_equals_brute_force(items, words, window):
    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    tables = dec.matchers([(w, i) for i, t in items for w in dec.windows_of(dec.words_of(t.encode()), window)])
    found: set = set()
    spans = dec.search([w.encode() for w in words], tables, [], found)
    assert [(len(words), sum(s[1] for s in spans), sorted(found))] == brute([" ".join(words)], items, window)
    assert all(a + n < b for (a, n), (b, _) in zip(spans, spans[1:]))


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "Of", "straße", "x1", "a-b", "É", "é", "q."])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(1, text(14)), (2, text(30)), (3, "zz top"), (4, None), (5, ""), (6, "!!"), (None, text(12)), (2, text(11)),
             (10, text(14).upper())]
    texts = [text(60) + "\n" + items[k % 4][1] + "," + text(9) if items[k % 4][1] else text(40) for k in range(30)]
    return items, texts + [None, "", "   ", "ZZ-TOP", "zz", items[1][1] * 40, text(20_000), texts[0], "x\x7fzz\x00top"]


@pytest.mark.parametrize("strings_per_pass", [1000, 9])
def test_annotate_and_decontaminate(spark, strings_per_pass):
    items, texts = corpus()
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)],
                                 "doc_id long, text string, items string, _contamination int").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    rows = dec.annotate(docs, bench, "found", strings_per_pass=strings_per_pass).orderBy("doc_id").collect()
    assert [(r.found.n_words, r.found.n_hit, r.found["items"]) for r in rows] == brute(texts, items)
    clean = dec.decontaminate(docs, bench, strings_per_pass=strings_per_pass)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, b in enumerate(brute(texts, items)) if not b[1]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.found.n_hit for r in dec.annotate(docs, bench, "found").collect()] == [0, 0]
    assert dec.annotate(docs.limit(0), bench, "found").count() == 0


def test_query(spark):
    from salesloom.llm.queries import op6_benchmark_decontamination
    got = op6_benchmark_decontamination(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    tables = dec.matchers([(w, r.item_id) for r in items for w in set(dec.windows_of(dec.words_of(r.text.encode())))])
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)
    joined = [" " + " ".join(x.decode() for x in dec.words_of(r.text.encode())) + " " for r in items]
    for doc, row in zip(docs, got):
        text = " " + " ".join(x.decode() for x in dec.words_of((doc.text or "").encode())) + " "
        ids = set()
        for r, item in zip(items, joined):
            w = item.split()
            if any(" " + " ".join(w[k:k + 10]) + " " in text for k in range(max(1, len(w) - 9))):
                ids.add(str(r.item_id))
        assert row.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert (row.n_items, row.contaminated) == (len(ids), bool(ids))
    assert tables
