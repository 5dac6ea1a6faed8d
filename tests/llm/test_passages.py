import hashlib
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from salesloom.llm import passages
from salesloom.llm.common import kept
from salesloom.llm.passages import SIZE


def brute(docs):
    """Per row: removed runs, straight from the definition."""
    first = {}
    for doc_id, text in docs:
        text = (text or "").encode()
        doc_id = passages.NO_ID if doc_id is None else doc_id
        for a in range(len(text) - SIZE + 1):
            w = text[a:a + SIZE]
            first[w] = min(doc_id, first.get(w, doc_id))
    out = []
    for doc_id, text in docs:
        text = (text or "").encode()
        doc_id = passages.NO_ID if doc_id is None else doc_id
        gone = bytearray(len(text))
        for a in range(len(text) - SIZE + 1):
            if first[text[a:a + SIZE]] < doc_id:
                gone[a:a + SIZE] = b"\1" * SIZE
        kept = bytes(c for c, g in zip(text, gone) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    words = [f"w{i}" for i in range(60)] + ["Straße", "é"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [prose(n) for n in (9, 12, 20, 40)] + ["a" * 70, "ab" * 60, " " * 55, "0" * 49, "=" * 50]
    docs = []
    for i in range(120):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            cut = rng.randint(0, len(c) // 2) if rng.random() < 0.5 else 0
            parts += [c[cut:], prose(rng.randint(0, 12))]
        docs.append(rng.choice(["", " "]).join(parts))
    docs += [docs[5]] * 6 + [docs[9] + " " + docs[11], None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 400, common[3][:-1], common[3] * 3]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,block_bytes", [(1, 1500), (2, 10 ** 6)])
def test_find_equals_brute_force(spark, seed, block_bytes, monkeypatch):
    rng = random.Random(seed)
    texts = corpus(rng)
    rows = [(i * 7 - 300, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, texts[4]), (-300, texts[0]), (-300, texts[1])]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, block string, id int").repartition(4)
    got = passages.find_passages(docs, "found", block_bytes=block_bytes)
    assert got.columns == ["doc_id", "block", "id", "found"]
    got = [(r.doc_id, (r.found.n_bytes, r.found.n_removed, len(r.found.spans), hashlib.sha256(r.found.kept).hexdigest()))
           for r in got.collect()]
    assert sorted(got, key=str) == sorted(((r[0], b) for r, b in zip(rows, brute(rows))), key=str)


def in_this_process(blocks):
    """What ``find_passages`` finds, its steps one after the other; ``blocks`` are lists of (id, text)."""
    tables = [pa.table({"block": pa.array([n] * len(rows), pa.int32()), "id": pa.array([r[0] for r in rows], pa.int64()),
                        "text": pa.array([r[1].encode() for r in rows], pa.binary()), "rest": pa.array([{"k": r[0]} for r in rows])})
              for n, rows in enumerate(blocks)]
    of = lambda verdicts, n: verdicts.filter(pc.equal(verdicts.column("block"), n))
    verdicts = passages._match_names(pa.concat_tables([passages._name_entries(1)(t) for t in tables]))
    windows = pa.concat_tables([passages._window_entries(1)(t, of(verdicts, n)) for n, t in enumerate(tables)])
    verdicts = passages._match_windows(windows)
    found = [r for n, t in enumerate(tables) for r in passages._finish(t, of(verdicts, n)).to_pylist()]
    return {r["rest"]["k"]: (r["found"]["n_bytes"], r["found"]["n_removed"], len(r["found"]["spans"]),
                             hashlib.sha256(r["found"]["kept"]).hexdigest()) for r in found}


def test_all_bits_of_a_name_count(monkeypatch):
    """Stretches at the edges of a passage share an anchor; their hashes may differ in any of the bits."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(120)
    rows = [(i, noise(90) + passage + noise(90)) for i in range(40)]
    digest = passages.xxhash.xxh3_64_intdigest
    for kept in (0xFFFFFFFF, 0xFFFFFFFF << 32):
        monkeypatch.setattr(passages.xxhash, "xxh3_64_intdigest", lambda b: digest(b) & kept)
        for blocks in ([rows], [rows[::2], rows[1::2]], [[r] for r in rows]):
            assert in_this_process(blocks) == {r[0]: b for r, b in zip(rows, brute(rows))}


@pytest.mark.parametrize("block_bytes", [600, 10 ** 6])
def test_rows_that_share_an_id_or_have_none_lose_parts(spark, block_bytes):
    """They share only a part of their text with a smaller document."""
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(130)
    twice, without, other = (noise(70) + passage + noise(80) for _ in range(3))
    rows = [(3, noise(60) + passage + noise(60)), (5, twice), (5, twice), (5, noise(9) + twice), (7, other), (5, other),
            (None, without), (None, without), (None, without + noise(30)), (None, noise(20) + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, (r.found.n_bytes, r.found.n_removed, len(r.found.spans), hashlib.sha256(r.found.kept).hexdigest()))
           for r in passages.find_passages(docs, "found", block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == sorted(((r[0], b) for r, b in zip(rows, brute(rows))), key=str)


def test_crowded_anchors(spark):
    """One passage at another place of every document: its anchors have many different stretches."""
    rng = random.Random(3)
    passage = "the same words stand in very many of these documents, each time elsewhere"
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) + passage[:rng.randint(52, 73)]
             + "".join(rng.choice("ijklm ") for _ in range(rng.randint(0, 80)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes in (8000, 10 ** 6):
        got = {r.doc_id: (r.found.n_bytes, r.found.n_removed, len(r.found.spans), hashlib.sha256(r.found.kept).hexdigest())
               for r in passages.find_passages(docs, "found", block_bytes=block_bytes).collect()}
        assert got == {r[0]: b for r, b in zip(rows, brute(rows))}


def test_remove(spark):
    p = "a passage of more than fifty bytes that is in each of these é"
    rows = [(1, "x " + p, "s", 63), (2, p + " y", "t", 63), (3, p, "u", 61), (4, "", None, 0), (5, None, None, None), (3, "other", "u", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = passages.remove_passages(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect())) == [(1, rows[0][1], "s", 63), (2, " y", "t", 2), (3, "other", "u", 5), (4, "", None, 0), (5, "", None, None)]
    assert passages.remove_passages(docs.limit(0)).count() == 0


def test_query(spark):
    from salesloom.llm.queries import op7_passage_dedup
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_passage_dedup(spark, sf).collect()}
    assert got == {d[0]: b for d, b in zip(docs, brute(docs))}
    assert any(g[1] for g in got.values())


def test_what_packing_keeps_is_let_go():
    """Python workers pass from one operator to the next, in a session that runs the pipeline again."""
    made = kept("encoder", lambda: object())
    assert kept("encoder", lambda: object()) is made
    table = pa.table({"id": pa.array([1], pa.int64()), "text": pa.array([b"text"], pa.binary())})
    passages.Block(table)
    assert kept("encoder", lambda: object()) is not made
    passages._gathered(passages._sent([]), passages._ENTRY)
    assert kept("encoder", lambda: None) is None


def test_one_python_step_at_a_time(spark):
    """Steps of one task run in processes of their own, which the executor then keeps."""
    docs = spark.createDataFrame([(1, "x" * 60 + "é", 61), (2, "é" + "x" * 60 + "ê", 62)], "doc_id long, text string, n_chars long")
    done = passages.remove_passages(docs)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "CoGroupsInArrow" in plan and "EvalPython" not in plan
    assert sorted(map(tuple, done.collect())) == [(1, "x" * 60 + "é", 61), (2, "é", 1)], "of the last character one byte is left"
