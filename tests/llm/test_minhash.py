import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.llm import minhash
from salesloom.llm.common import Scratch
from salesloom.llm.components import components

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, size, percent):
    """doc_id -> (size of set, component), by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = {}
    for d in sorted(sets):
        common = {}
        for s in sets[d]:
            for other in holders.get(s, ()):
                common[other] = common.get(other, 0) + 1
            holders.setdefault(s, []).append(d)
        for other, both in common.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[other]) - both):
                a, b = sorted((root(d), root(other)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def family(rng, words, members, edits):
    base = [rng.choice(words) for _ in range(rng.randint(20, 160))]
    out = [" ".join(base)]
    for _ in range(members):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_link_equals_brute_force(spark, size, percent):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(300)] + ["Straße", "É", "é"]
    texts = []
    for k in range(25):
        texts += family(rng, words, rng.randint(1, 14), 4)
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [" ".join(rng.choice(words) for _ in range(40)) + " " + passage for _ in range(60)]
    texts += ["", None, "  \n", "one", "ONE", "one two", "one  two", "É", "é"] + [texts[3]] * 40 + [texts[3].upper()] * 5
    texts += ["word " * 30_000, "word " * 20_000]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i * 3, t, "k", 1, True) for i, t in enumerate(texts)],
                                 "doc_id long, text string, key string, n int, _kept_id boolean").repartition(5)
    expected = brute([(i * 3, t) for i, t in enumerate(texts)], size, percent)
    rows = minhash.link(docs, size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert len(rows) == len(texts)
    kept = minhash.deduplicate(docs, size, percent)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in expected.items() if d == c)


def test_repeated_rows_missing_ids_and_empty_table(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (9, "x"), (9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in minhash.link(docs, 3, 85).collect()), key=str)
    assert got == sorted([(5, 2), (5, 2), (2, 2), (None, 2), (None, None), (9, 9), (9, 9)], key=str)
    assert sorted((r.doc_id for r in minhash.deduplicate(docs).collect()), key=str) == [2, 9, None, None]
    assert minhash.link(docs.limit(0), 3, 85).count() == 0


def test_buckets_that_their_pivot_leaves_apart_are_split(spark):
    """A chain whose ends differ: the smallest id is not similar to all members."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts, now = [], list(base)
    for k in range(24):
        texts.append(" ".join(now))
        now = list(now)
        for _ in range(2):
            now[rng.randrange(len(now))] = f"x{k}{rng.random()}"
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute(list(enumerate(texts)), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link(docs, 3, 85).collect()} == expected


def test_pairs_within_a_family_just_below_the_threshold(spark):
    """No pivot links anything (0.79 similar); 100 planted pairs are 0.82 similar."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    tails = [[f"x{k}a{i}" for i in range(13)] for k in range(900)]
    tails += [tails[k][:2] + [f"y{k}a{i}" for i in range(11)] for k in range(100)]
    texts = {k: " ".join(base + tail) for k, tail in enumerate(tails)}
    rows = list(texts.items())
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == {k: k - 900 if k >= 900 else k for k in texts}


def test_only_members_that_share_rare_shingles_are_compared(spark, monkeypatch):
    """Of a family below the threshold, few but the planted pairs are compared with others."""
    left = []
    families = minhash._families

    def watched(*args):
        found = families(*args)
        left.append((args[0].select("rid").distinct().count(), found.filter("short").count()))
        return found

    monkeypatch.setattr(minhash, "_families", watched)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    texts = {k: " ".join(base + [f"x{k}a{i}" for i in range(13)]) for k in range(600)}
    texts |= {1000 + k: " ".join(base + [f"x{k}a{i}" for i in range(2)] + [f"y{k}a{i}" for i in range(11)]) for k in range(20)}
    rows = list(texts.items())
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == {k: k - 1000 if k >= 1000 else k for k in texts}
    assert len(left) == 1 and left[0][0] > 300 and left[0][1] <= 60


def test_variants_of_one_template(spark):
    """Rare shingles that many share: every member takes one of four forms at each of some places."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{i}" if i % 10 else f"w{i}{rng.choice('abcd')}" for i in range(120))) for k in range(200)]
    want = {k: c for k, (_, c) in brute(rows, 3, 80).items()}
    got = {r.doc_id: r.component_id for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == want and 1 < len(set(want.values())) < 200


def test_counts_of_shingles_are_upper_bounds_for_all_members(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 500, 60, "uint64")) for _ in range(30)]
    table = spark.createDataFrame([(k % 2, bytearray(s.tobytes())) for k, s in enumerate(sets)], "family long, set binary").repartition(4)
    counts = minhash._counts(table)
    assert counts.sum() == sum(map(len, sets))
    for family in (0, 1):
        own = np.concatenate(sets[family::2])
        values, often = np.unique(own, return_counts=True)
        assert (counts[minhash._slots(values, family) >> np.uint64(64 - minhash.SKETCH_BITS)] >= often).all()


def test_rows_with_one_id_are_judged_by_their_texts(spark):
    long = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(1, long("a"), "p"), (1, long("b"), "q"), (1, long("a"), "r"), (2, long("b") + " more", "s"), (3, long("c"), "t"), (3, None, "u"),
            (None, long("c"), "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = minhash.deduplicate(docs)
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(found, key=str) == sorted([(1, long("a")), (1, long("b")), (3, long("c")), (3, None), (None, long("c"))], key=str)


@pytest.mark.parametrize("width", [7, 4096])
def test_cells_connect_what_similar_pairs_connect(width):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60), "uint64")) for _ in range(40)]
    sides = rng.integers(0, 2, 40)
    rows, columns = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    both = minhash.common_shingles(sets, rows, columns, width)
    assert (both == [[len(np.intersect1d(sets[a], sets[b])) for b in columns] for a in rows]).all()
    label = rng.integers(0, 30, 40)
    for side in (sides, sides * 0):
        alike = {(a, b) for a in range(40) for b in range(40) if (not side.any() or side[a] < side[b]) and label[a] != label[b]
                 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))}
        found = minhash.connecting(sets, side, label, 50)
        assert alike and set(found) <= alike

        def joined(pairs):
            part = {int(x): {int(x)} for x in label}
            for a, b in pairs:
                one = part[int(label[a])] | part[int(label[b])]
                part.update(dict.fromkeys(one, one))
            return part

        assert joined(found) == joined(alike)


def test_estimate_is_close(spark):
    rng = np.random.default_rng(1)
    functions = minhash._functions()
    rows, truth = [], []
    for share in (0, 200, 600, 900):
        a = rng.integers(0, 2 ** 64, 1000, "uint64")
        b = np.concatenate([a[:share], rng.integers(0, 2 ** 64, 1000 - share, "uint64")])
        truth.append(share / (2000 - share))
        least = np.stack([minhash.minima(np.unique(x), *functions) for x in (a, b)])
        rows.append((len(rows), *[[int(v) for v in s] for s in minhash.packed(least)]))
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    got = [r[0] for r in df.orderBy("k").select(minhash.estimated(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, truth, atol=0.11)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 3), (200, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 103), 100), 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    from salesloom.llm.queries import op10_minhash_near_dedup
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    expected = brute([(r.doc_id, r.text) for r in docs], 3, 85)
    got = op10_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in expected.values()}) < len(expected)


def test_a_large_group_has_about_one_edge_per_member(spark, monkeypatch):
    """Near copies share many buckets, each with a smallest member of its own; edges do not grow with their number."""
    given, plain = [], minhash.components

    def watched(edges):
        given.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(minhash, "components", watched)
    rng = random.Random(11)
    base, rows = [f"w{i}" for i in range(150)], []
    for k in range(400):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == {k: c for k, (_, c) in brute(rows, 3, 80).items()}
    assert max(given) < 3 * len(rows)


def test_spokes_connect_what_links_connect(spark):
    rng = random.Random(12)
    links = [(a, a, b) for a in range(100, 160) for b in rng.sample(range(40), rng.randrange(1, 5))]
    links += [(200, 30, 7), (201, 30, 8), (202, 50, 51)]
    plain = spark.createDataFrame([x[1:] for x in links], "a long, b long")
    spokes = minhash._spokes(spark.createDataFrame(links, "a long, label long, pivot_label long"))
    assert sorted(components(spokes).collect()) == sorted(components(plain).collect())


def test_small_tables_of_components_have_few_files(spark, monkeypatch):
    files, drop = [], Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, *tables: files.extend(len(t.inputFiles()) for t in tables) or drop(self, *tables))
    edges = spark.range(300).selectExpr("id as a", "id - id % 10 as b")
    monkeypatch.setattr("salesloom.llm.common.FILE_ROWS", 200)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(before, ("40", "false")):
            spark.conf.set(c, v)
        got = {r.node: r.component for r in components(edges).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == {k: k - k % 10 for k in range(300)}
    assert files and max(files) <= 3, files
