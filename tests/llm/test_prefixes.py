import hashlib
import random
import zlib

import duckdb
import pytest

from salesloom.llm import prefixes
from salesloom.llm.queries import ORACLE_SQL, op12_conversation_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(talks):
    """All nodes from ``{conversation: [(role, text), ...]}``, straight from the definition."""
    members = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, held in members.items():
        below = [v for v in members if v[:len(node)] == node]
        children = [v for v in below if len(v) == len(node) + 1]
        leaves = [v for v in below if not any(len(w) == len(v) + 1 and w[:len(v)] == v for w in below)]
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        ends = ",".join(map(str, sorted(c for c in held if len(talks[c]) == len(node))))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_talks(rng, count, longest):
    kinds = [("user", "hi"), ("user", "hi there é"), ("assistant", ""), ("", "hi"), ("u", "serhi")]
    talks = {c * 3 - 9: [rng.choice(kinds) for _ in range(rng.randint(0, longest))] for c in range(count)}
    common = [("system", "be kind")] * 6
    for c in range(200, 200 + count):
        talks[c] = common[:rng.choice([1, 4, 6])] + [rng.choice(kinds) for _ in range(rng.randint(0, longest))]
    for c in range(500, 500 + count // 2):
        talks[c] = common + kinds
    return talks


@pytest.mark.parametrize("seed,classes,shard_turns", [(1, 256, 1024), (2, 1, 5), (3, 3, 20)])
def test_nodes_equal_brute_force(spark, seed, classes, shard_turns):
    """With few classes to a shard most nodes are above the shards."""
    talks = random_talks(random.Random(seed), 40, 4)
    rows = [(c, t, *turn, 1, "x") for c, turns in talks.items() for t, turn in enumerate(turns)] + [(None, 0, "user", "hi", 1, "x")]
    random.Random(seed).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, at int, role string, text string, depth int, node string").repartition(4)
    ids = spark.createDataFrame([(c,) for c in talks], "conv_id long")
    got = prefixes.prefix_nodes(turns, ids, classes, shard_turns)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(talks)


def test_weights_are_counted_by_bit_slices():
    way = lambda *turns: [(d, bytes([d, *turns[:d]]), None, bytes([t]), 2) for d, t in enumerate(turns, 1)]
    shard = prefixes.Shard({7: way(1, 2), 3: way(1, 2, 3), 5: way(1, 4)}, {7: 5, 3: 1, 5: 1000})
    assert {(r[1], r[2]): (r[5], r[6], r[7], r[8]) for r in shard.nodes()} == {
        (3, 1): (1006, 2, 2, 2 * 1005 + 2 * 5 + 2 * 999), (3, 2): (6, 1, 1, 10), (3, 3): (1, 0, 1, 0), (5, 2): (1000, 0, 1, 1998)}


def test_nulls_empty_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, 0, "a", "x"), (2, None, "", ""), (2, 0, "a", "x"), (3, 0, "a", "x"), (3, 0, "a", "x"), (4, 0, "", "")]
    turns = spark.createDataFrame(rows, "conv_id long, at int, role string, text string")
    got = sorted(map(tuple, prefixes.prefix_nodes(turns, turns.select("conv_id")).collect()), key=str)
    e, a = ("", ""), ("a", "x")
    assert got == brute({1: [e, a], 2: [e, a], 3: [a, a], 4: [e]})
    assert prefixes.prefix_nodes(turns.limit(0), turns.limit(0).select("conv_id")).count() == 0
    alone = prefixes.prefix_nodes(turns.limit(0), spark.createDataFrame([(6,), (4,), (6,)], "conv_id long"))
    assert list(map(tuple, alone.collect())) == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,6").hexdigest())]


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None]))
            for c in range(90) if c % 10 for t in range(rng.choice([1, 2, 3, 7, 11]))]
    rows += [(c, t, "user", f"{t}") for c in (50, 52) for t in range(9)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    held = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        held.setdefault(c, []).append((role or "", text or ""))
    talks = {}
    for c, turns in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        talks[c] = held.get(c - c % 5, [])[:h] + turns[h:]
    got = op12_conversation_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(talks)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op12_conversation_trie"]).fetchall(), key=str) == brute(talks)
