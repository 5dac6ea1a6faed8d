import hashlib
import random

import numpy as np
import pytest

from salesloom.llm import substrings
from salesloom.llm.fm_index import FmIndex, WaveletMatrix
from salesloom.llm.substrings import WINDOW


def brute(docs):
    """Per row (words, removed, digest), straight from the definition."""
    rows = [(substrings.NO_ID if i is None else i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in rows:
        for a in range(len(w) - WINDOW + 1):
            key = tuple(w[a:a + WINDOW])
            first[key] = min((i, a), first.get(key, (i, a)))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for a in range(len(w) - WINDOW + 1):
            if first[tuple(w[a:a + WINDOW])] < (i, a):
                gone[a:a + WINDOW] = [True] * WINDOW
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def found(spark, rows, **sizes):
    docs = spark.createDataFrame([(*r, "k", 1, "x") for r in rows], "doc_id long, text string, block string, id int, shard string").repartition(4)
    got = substrings.find_repeats(docs, "found", **sizes)
    assert got.columns == ["doc_id", "block", "id", "shard", "found"]
    rows = got.collect()
    for r in rows:
        assert sum(s.size for s in r.found.spans) == r.found.n_removed
    return sorted(((r.doc_id, (r.found.n_words, r.found.n_removed, hashlib.sha256(r.found.kept).hexdigest())) for r in rows), key=str)


def expected(rows):
    return sorted(((r[0], b) for r, b in zip(rows, brute(rows))), key=str)


def corpus(rng, count=120):
    words = [f"w{i}" for i in range(50)] + ["Straße", "é é", "\x1c"]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    common = [prose(n) for n in (19, 20, 21, 30, 60)] + [["a"] * 45, ["a", "b"] * 25]
    texts = []
    for _ in range(count):
        parts = prose(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            cut = rng.randint(0, len(c) // 2) if rng.random() < 0.5 else 0
            parts += c[cut:] + prose(rng.randint(0, 12))
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += [texts[5]] * 6 + [texts[9] + " " + texts[11], None, "", " ", " ".join(["x"] * 400), texts[7] + " " + texts[7]]
    rng.shuffle(texts)
    return texts


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 3, 7, 64, 100):
        values = rng.integers(0, kinds, 500)
        matrix = WaveletMatrix(values, kinds)
        which, places = rng.integers(0, kinds, 300), rng.integers(0, 501, 300)
        want = [int((values[:p] == v).sum()) for v, p in zip(which, places)]
        assert matrix.rank(which, places).tolist() == want


def test_index_finds_all_windows_and_nothing_else():
    for seed in range(80):
        rng = random.Random(seed)
        kinds, window = rng.randint(1, 5), rng.choice([2, 3, 5, 20])
        texts = [[rng.randrange(kinds) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(0, 6))]
        asked = [[rng.randrange(-1, kinds) for _ in range(rng.randint(0, 60))] for _ in range(4)] + texts
        flat = lambda t: (np.array(sum(t, []), "int64"), np.array([len(x) for x in t], "int64"))
        got = FmIndex(*flat(texts), kinds, window).search(*flat(asked)).tolist()
        known = {tuple(t[a:a + window]) for t in texts for a in range(len(t) - window + 1)}
        windows = [tuple(t[a:a + window]) for t in asked for a in range(len(t))]
        assert [g >= 0 for g in got] == [w in known for w in windows]
        groups = {w: g for w, g in zip(windows, got) if g >= 0}
        assert len(set(groups.values())) == len(groups) and all(groups[w] == g for w, g in zip(windows, got) if g >= 0)


@pytest.mark.parametrize("seed,block_bytes,shard_bytes,crowded", [(1, 1500, 4000, 4096), (2, 10 ** 6, 10 ** 6, 4096), (3, 2500, 3000, 3)])
def test_find_equals_brute_force(spark, monkeypatch, seed, block_bytes, shard_bytes, crowded):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "LONGEST", 30)
    texts = corpus(random.Random(seed))
    rows = [(i * 7 - 300, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, texts[4]), (None, texts[4]), (-300, texts[0]), (-300, texts[1])]
    assert found(spark, rows, block_bytes=block_bytes, shard_bytes=shard_bytes) == expected(rows)


def test_hashes_of_words_do_not_depend_on_their_place():
    piece = substrings.Piece()
    piece.add([b"a", b"bb", b"a", b"ab", b"ba", b"bb", "é".encode()])
    piece.windows()
    got = piece.hashes().tolist()
    assert got[0] == got[2] and got[1] == got[5] and len(set(got)) == 5
    assert piece.text(1, 3) == b"bb a ab"


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(400)}" for _ in range(3000))
    rows = [(1, long), (2, long[5000:9000]), (3, "one " + long), (4, long[:700] + " " + long), (5, "x" * 5000), (6, "x" * 5000)]
    want = expected(rows)
    assert want[3][1][1] > 3000
    monkeypatch.setattr(substrings, "PIECE_BYTES", 700)
    monkeypatch.setattr(substrings, "PIECE_WORDS", 100)
    at = [(d, s) for p in substrings.pieces([r[1].encode() for r in rows]) if p.docs
          for d, s in zip(*(x.tolist() for x in p.where(p.windows()[0])))]
    assert sorted(at) == [(k, a) for k, r in enumerate(rows) for a in range(len(r[1].split()) - WINDOW + 1)]
    text, spans = rows[0][1].encode(), np.array([[3, 50], [90, 1200], [2990, 3000]])
    words = text.split()
    assert substrings._without(text, spans) == (3000, b" ".join(words[:3] + words[50:90] + words[1200:2990]))
    assert found(spark, rows) == want


def test_empty_and_null_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, None), (1, "")], "doc_id long, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(None, None), (1, None), (1, "")]) == [(1, (0, 0, nothing)), (1, (0, 0, nothing)), (None, (0, 0, nothing))]
    assert substrings.find_repeats(docs.limit(0)).count() == 0


def test_query(spark):
    from salesloom.llm.queries import op13_substring_dedup
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op13_substring_dedup(spark, sf).collect()}
    assert got == {d[0]: b for d, b in zip(docs, brute(docs))}
    assert any(g[1] for g in got.values())
