import zlib

import numpy as np
import pytest

from salesloom.llm import quality
from salesloom.llm.common import WordTable

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def machine(spark):
    return quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_pairs_by_sums_equal_pairs_one_by_one():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.SLOTS), rng.normal(0, 0.3, (quality.SLOTS, quality.RANK)))
    found = [(rng.choice(quality.SLOTS, n, replace=False), rng.random(n)) for n in (1, 5, 12)]
    for (slots, values), got in zip(found, m.scores(found)):
        odds = m.bias + sum(m.weights[s] * v for s, v in zip(slots, values))
        odds += sum(m.vectors[slots[i]] @ m.vectors[slots[j]] * values[i] * values[j]
                    for i in range(len(slots)) for j in range(i))
        assert np.isclose(got, 1 / (1 + np.exp(-odds)))


def test_products_of_features_are_learned():
    """The label is whether both or neither of two words occur, which no linear model can tell."""
    rng, table = np.random.default_rng(2), WordTable()
    found, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        text = " ".join(["x"] * 3 + ["alpha"] * 3 * int(a) + ["beta"] * 3 * int(b)).encode()
        found.append(quality.features(text, table))
        labels.append(float(a == b))
    m = quality.fit(found[:1000], np.array(labels[:1000]))
    assert ((m.scores(found[1000:]) > 0.5) == labels[1000:]).mean() > 0.95


def test_held_out_accuracy(spark, machine):
    from salesloom.llm.queries import op9_quality_classifier
    got = {r.doc_id: r for r in op9_quality_classifier(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_odd_rows(spark, machine):
    rows = [(1, None, 3), (2, "", 4), (3, "a " * 50_000, 5), (3, "a " * 50_000, 5), (None, "The words of it.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _quality int")
    scored = quality.score(docs, machine, "s").collect()
    assert len(scored) == 5 and all(0 <= r.s <= 1 for r in scored)
    assert quality.keep_good(docs, machine).columns == docs.columns
    assert quality.keep_good(docs.limit(0), machine).count() == 0


def test_labels_of_held_out_documents_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and more") for i in range(40)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(40)]
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in rows] + [(5, None), (None, 1), (9, 1)]
    a = quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    b = quality.train(docs, spark.createDataFrame(other, "doc_id long, quality int"))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_without_labels_scores_are_even(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    m = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(docs, m).collect()] == [0.5, 0.5]
