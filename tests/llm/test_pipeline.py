import pytest
import test_minhash
from pyspark.sql import functions as F

import corpus_pipeline
from salesloom.llm import decontamination, quality

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def cut(docs):
    """What is left of each text, from the definition of passages."""
    first = {}
    for doc_id, text in docs:
        b = text.encode()
        for a in range(len(b) - 49):
            first[b[a:a + 50]] = min(doc_id, first.get(b[a:a + 50], doc_id))
    out = []
    for doc_id, text in docs:
        b = text.encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if first[b[a:a + 50]] < doc_id:
                gone[a:a + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if left or not any(gone):
            out.append((doc_id, left))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "minhash_near_dedup", "passage_dedup", "benchmark_decontamination", "best_fit_packing"]

    def run(name, docs):
        out = steps[name](spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    good = run("quality_classifier", docs)
    machine = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert texts(good) == texts(quality.score(docs, machine).filter("score >= 0.3"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert docs.join(labels.filter("quality = 1"), "doc_id").join(good.select("doc_id"), "doc_id", "left_anti").count() <= 2

    single = run("minhash_near_dedup", good)
    expected = test_minhash.brute(texts(good), 5, 80)
    assert texts(single) == [(d, t) for d, t in texts(good) if expected[d][1] == d]

    fresh = run("passage_dedup", single)
    assert texts(fresh) == sorted(cut(texts(single)), key=str)
    assert fresh.filter(F.length("text") != F.col("n_chars")).count() == 0

    clean = run("benchmark_decontamination", fresh)
    line = lambda text: " " + " ".join(w.decode() for w in decontamination.words_of((text or "").encode())) + " "
    windows = {" " + " ".join(x.decode() for x in w) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()
               for w in decontamination.windows_of(decontamination.words_of((r.text or "").encode()))}
    assert texts(clean) == [d for d in texts(fresh) if not any(w in line(d[1]) for w in windows)]

    packed = run("best_fit_packing", clean)
    assert packed.select("doc_id").distinct().count() == clean.count()
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_all_stages(spark, empty):
    good = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (900001, None, "en", None, None), (900002, "", None, "s", 0), (900003, "ж" * 300_000, "ru", "s", 1),
         (900003, "ж" * 300_000, "ru", "s", 1)], good.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = good.union(odd).withColumns({"score": F.lit(1), "bucket": F.lit("x"), "spans": F.lit(None).cast("string")})
    docs = docs.limit(0) if empty else docs.union(docs.limit(3))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert empty == (docs.count() == 0)
