import math
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from salesloom.llm import language as G

WORD = re.compile("[^\x20\x09-\x0D]+")


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def brute(rows):
    """Columns of the base score, from plain counts."""
    counts = {}
    for doc_id, text in rows:
        if not held(doc_id):
            for t in tokens(text):
                counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return [(doc_id, held(doc_id), len(tokens(text)), sum(t in counts for t in tokens(text)), n,
             sum(math.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in tokens(text))) for doc_id, text in rows]


def same(got, expected):
    key = lambda r: (str(r[:5]), round(r[5], 6))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    expected = sorted(expected, key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5] for g in got], [e[5] for e in expected], rtol=1e-12)


@pytest.mark.parametrize("block_tokens", [40, 10 ** 6])
def test_base_score_equals_plain_counts(spark, block_tokens):
    rng = np.random.default_rng(1)
    words = ["The", "the", "of", "É", "é", "x\x1cy", "a\xa0b", "<s>", *(f"w{i}" for i in range(50))]
    rows = [(i, " \n".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(80)]
    rows += [(7, rows[7][1]), (7, "another text"), (None, "the of"), (200, None), (201, ""), (202, " \t"), (203, "long " * 70_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, token string, block int").repartition(3)
    got = G.score(docs, rounds=2, block_tokens=block_tokens).collect()
    same(got, brute(rows))
    assert G.score(docs, rounds=1).count() == len(rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = G.score(docs).collect()
    same(got, brute([(None, "a b"), (None, None)]))
    assert G.score(docs.limit(0)).count() == 0


def test_probabilities_sum_to_one():
    """Over all known words and the unknown share of every slot, whatever the weights."""
    rng = np.random.default_rng(2)
    table = G.Marks()
    numbers = table.numbers([f"w{i}".encode() for i in range(500)] + [G.END])
    counts = rng.integers(1, 9, len(numbers))
    cells = table.cells[:len(numbers)]
    masses = np.ones(G.CLASSES * G.SLOTS)
    np.add.at(masses, cells, counts + 1)
    model = G.Model(rng.normal(size=(G.ROWS, G.CLASSES + G.SLOTS)).astype("float32"),
                    rng.normal(size=G.CLASSES).astype("float32"), rng.normal(size=(G.CLASSES, G.SLOTS)).astype("float32"))
    history = G.history_rows(table.values[numbers[:5]], np.zeros(1, "int64"))[:, 4:5]
    every = np.arange(G.CLASSES * G.SLOTS)
    slots = 10 ** model.log10(np.repeat(history, len(every), axis=1), every)
    words = (slots[cells] * (counts + 1) / masses[cells]).sum()
    assert np.isclose(words + (slots / masses).sum(), 1, atol=1e-4)


def test_steps_learn_what_follows_what():
    table = G.Marks()
    numbers = table.numbers([b"ax", b"by", b"cz"] * 2000)
    values, cells = table.values[numbers], table.cells[numbers]
    model = G.Model(np.zeros((G.ROWS, G.CLASSES + G.SLOTS), "float32"), np.zeros(G.CLASSES, "float32"), np.zeros((G.CLASSES, G.SLOTS), "float32"))
    rows, seen = G.history_rows(values, np.zeros(1, "int64")), np.ones((G.ROWS, G.CLASSES + G.SLOTS), "float32")
    before = model.log10(rows, cells).mean()
    for _ in range(30):
        model.step(rows[:, :500], cells[:500], seen)
    assert model.log10(rows[:, 1000:], cells[1000:]).mean() > before / 10


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    table = G.Marks()
    numbers = table.numbers([f"w{i}".encode() for i in rng.integers(0, 9, 40)])
    rows, cells = G.history_rows(table.values[numbers], np.zeros(1, "int64")), table.cells[numbers]
    weights = rng.normal(0, 0.1, (G.ROWS, G.CLASSES + G.SLOTS))
    model = G.Model(weights.copy(), np.zeros(G.CLASSES), np.zeros((G.CLASSES, G.SLOTS)))
    seen = np.full(weights.shape, 1e12)  # steps so small that all are taken at the start
    model.step(rows, cells, seen)
    slope = (weights - model.weights) * 1e6 / G.RATE
    for row in (rows[0][5], rows[2][7], G.slot_rows(rows, cells // G.SLOTS)[1][9]):
        for column in (cells[5] // G.SLOTS, G.CLASSES + cells[9] % G.SLOTS):
            loss = []
            for d in (1e-4, -1e-4):
                moved = weights.copy()
                moved[row, column] += d
                loss.append(-G.Model(moved, model.class_bias, model.slot_bias).log10(rows, cells).sum() * np.log(10))
            assert np.isclose((loss[0] - loss[1]) / 2e-4, slope[row, column], rtol=1e-3, atol=1e-4)


def test_numbers_survive_packing():
    numbers = np.random.default_rng(4).integers(0, 1 << 23, 1000)
    assert (G._unpack_numbers(G._pack_numbers(numbers)) == numbers).all()


def test_query_beats_the_base_on_held_out_documents(spark):
    from salesloom.llm.queries import op3_language_model
    sf = "/root/testdata/sf0.01"
    got = op3_language_model(spark, sf).collect()
    same(got, brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.995 * sum(r.base_score for r in out)


def test_documents_go_through_the_model_together(monkeypatch):
    """Tokens of many short documents are one step; each document has its own sums and its own history."""
    from types import SimpleNamespace

    import pyarrow as pa

    texts = [b"a b c a", b"", b"b b", b"c a b d e f"] * 30
    table = G.Marks()
    numbers = [table.numbers(G.tokens_of(t)) for t in texts]
    rng = np.random.default_rng(5)
    model = G.Model(rng.normal(0, 0.3, (G.ROWS, G.CLASSES + G.SLOTS)).astype("float32"), np.zeros(G.CLASSES, "float32"),
                    np.zeros((G.CLASSES, G.SLOTS), "float32"))
    masses = np.full(G.CLASSES * G.SLOTS, 2.0)
    docs = pa.table({"block": [0] * len(texts), "doc_id": range(len(texts)), "held": [False] * len(texts),
                     "payload": pa.array([G._pack_numbers(n) for n in numbers], pa.binary())})
    sent = [len(k) for _, k in G._by_bucket(table.values[:len(table)], 1)]
    told = pa.table({"block": [0, 0], "bucket": pa.array([None, 0], pa.int32()), "payload": pa.array(
        [b"\n".join(table), np.ones(sent[0], "<u8").tobytes()], pa.binary())})
    calls, plain = [], G.Model.log10
    monkeypatch.setattr(G.Model, "log10", lambda self, r, c: calls.append(len(c)) or plain(self, r, c))
    got = G._scorer(SimpleNamespace(value=(model, masses, 50)), 1)(docs, told).to_pylist()
    assert len(calls) == 1 and [r["doc_id"] for r in got] == list(range(len(texts)))
    for r, n in zip(got, numbers):
        rows, cells = G.history_rows(table.values[n], np.zeros(1, "int64")), table.cells[n]
        want = len(n) * math.log10(2) + float(plain(model, rows, cells).sum()) - len(n) * math.log10(2)
        assert r["n_tokens"] == r["n_known"] == len(n)
        assert r["base_score"] == pytest.approx(len(n) * math.log10(2 / 50)) and r["score"] == pytest.approx(want, rel=1e-6)


def test_a_step_goes_through_the_model_in_pieces(monkeypatch):
    """No more than PIECE tokens at once, with the weights that plain sums over the whole step give."""
    rng = np.random.default_rng(6)
    n = 2 * G.PIECE + 77
    rows = np.stack([rng.integers(0, G.BEFORE, n), G.BEFORE + rng.integers(0, G.SKIP, n), G.BEFORE + G.SKIP + rng.integers(0, 9, n)])
    cells = rng.integers(0, G.CLASSES * G.SLOTS, n)
    weights = rng.normal(0, 0.3, (G.ROWS, G.CLASSES + G.SLOTS))
    bias, slot_bias = rng.normal(size=G.CLASSES), rng.normal(size=(G.CLASSES, G.SLOTS))
    sizes, plain = [], G.Model.forward
    monkeypatch.setattr(G.Model, "forward", lambda self, r, *more, **named: sizes.append(r.shape[1]) or plain(self, r, *more, **named))
    model, seen = G.Model(weights.copy(), bias, slot_bias), np.ones(weights.shape)
    model.step(rows, cells, seen)
    assert max(sizes) <= G.PIECE and sum(sizes) == n

    slope = np.zeros(weights.shape)
    deep = G.slot_rows(rows, cells // G.SLOTS)
    for where, columns, own, at in ((rows, slice(0, G.CLASSES), bias, cells // G.SLOTS),
                                    (deep, slice(G.CLASSES, None), slot_bias[cells // G.SLOTS], cells % G.SLOTS)):
        z = np.exp(weights[where, columns].sum(axis=0) + own)
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), at] -= 1
        for k in where:
            np.add.at(slope[:, columns], k, z)
    assert np.allclose(seen, 1 + slope ** 2) and np.allclose(model.weights, weights - G.RATE * slope / np.sqrt(1 + slope ** 2))
    assert (model.weights[G.BEFORE + G.SKIP + 9:, :G.CLASSES] == weights[G.BEFORE + G.SKIP + 9:, :G.CLASSES]).all()


def test_words_are_marked_at_once_as_one_by_one():
    words = ["a", "to", "über", "x" * 300, "1", "日本"]
    words = [w.encode() for w in words] + [G.END, b"\xff", b"\x00\x00", b"a", b""]
    hashes, cells = G.marked(words)
    for word, value, cell in zip(words, hashes.tolist(), cells.tolist()):
        assert value == xxhash.xxh3_64_intdigest(word)
        assert cell == zlib.crc32(word[-2:]) % G.CLASSES * G.SLOTS + (value >> 20) % G.SLOTS
    assert [len(x) for x in G.marked([])] == [0, 0]


def test_counting_a_document_does_not_pass_over_the_words_of_its_block(monkeypatch):
    texts = [" ".join(f"w{20 * k + j}" for j in range(20)).encode() for k in range(600)] + [b"w0"] * 600
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array([k == 1 for k in range(1200)]),
                                        pa.array(texts, pa.binary())], names=["doc_id", "held", "text"])
    passed, bincount = [], np.bincount
    monkeypatch.setattr(G.np, "bincount", lambda x, minlength=0: passed.append(max(len(x), minlength)) or bincount(x, minlength=minlength))
    monkeypatch.setattr(G.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rows = [r for part in G._encode([batch], 10 ** 9, 1) for r in part.to_pylist()]
    assert sum(passed) < 20 * 12_000, "some passes over 12,000 words, not one per document"
    words = next(r["payload"] for r in rows if r["kind"] == G.WORDS).split(b"\n")
    packed = next(r["payload"] for r in rows if r["kind"] == G.COUNTS)
    counts = dict(zip(words, np.frombuffer(packed, "<u4", len(words), 8 * len(words)).tolist()))
    assert (counts[b"w0"], counts[b"w1"], counts[b"w20"], counts[b"w40"], counts[G.END]) == (601, 1, 0, 1, 1199)
