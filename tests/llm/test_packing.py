import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from salesloom.llm import packing

PATH = tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, sequence_id string, cell int"


def expand(places):
    rows = []
    for length, rank, size, sequence, offset in places:
        rows += [(sequence + i, offset, length, rank + i) for i in range(size)]
    return sorted(rows)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40)))
def test_plan_places_every_piece_once_without_gaps(counts):
    places, total = packing.plan_sequences(counts, 30)
    rows = expand(places)
    assert sorted((r[2], r[3]) for r in rows) == sorted((n, i) for n, c in counts.items() for i in range(c))
    end = {}
    for sequence, offset, length, _ in rows:
        assert offset == end.get(sequence, 0)
        end[sequence] = offset + length
    assert all(v <= 30 for v in end.values())
    assert sorted(end) == list(range(total))
    large = sum(c for n, c in counts.items() if 2 * n > 30)
    assert total <= max(large, 1 + 2 * sum(n * c for n, c in counts.items()) // 30)


def test_plan_uses_few_sequences():
    counts = {2048: 50, 1500: 100, 548: 100, 1000: 60, 900: 30, 148: 30, 48: 30, 5: 400}
    _, total = packing.plan_sequences(counts)
    assert total <= -(-sum(n * c for n, c in counts.items()) // 2048) + 2


@pytest.mark.parametrize("text", [
    "", "Hello  world", "it's we'll", "<|endoftext|> a<|startoftext|>b", "é́ ̈x \x1c y\x85z q", "ΟΔΟΣ Σ 12345 ###!!!",
    "don 't", "a b\tc\r\nd\x0be"])
def test_ids_equal_those_of_the_whole_text(text):
    whole = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(PATH)([text.encode()])[0], "<u4").tolist() == whole


def test_pack_whole_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["the", "of", "Straße", "x1", "<s>"], int(n))), "x", 1)
            for i, n in enumerate(rng.integers(0, 900, 60))]
    rows += [(100, None, None, None), (101, "", "y", 0), (102, "word " * 9000, "z", 0), (7, rows[7][1], "x", 1),
             (103, "  \n", None, 2), (None, "the end", None, None)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], "<u4")
            expected.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert packing.pack(spark.createDataFrame(rows, SCHEMA), PATH).select("doc_id").count() == len(out)
    key = str
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(expected, key=key)
    end = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 2048
    assert len(end) <= -(-sum(r.length for r in out) // 2048) + 2


def test_pack_empty_table(spark):
    out = packing.pack(spark.createDataFrame([], SCHEMA), PATH)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() == 0


def test_ids_of_given_documents(spark):
    whole, encode = Tokenizer.from_file(PATH), packing.encoder(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text, ids in zip(texts, encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
