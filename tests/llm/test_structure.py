import hashlib
import itertools
import random
import re
import zlib

import pytest

from salesloom.llm import structure
from salesloom.llm.grammar import Rope, re_pair

SHAPE = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def faulty(rows):
    """(role, text, fault) of ordered rows, straight from the definition."""
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(SPACE)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_edit(rows):
    """All edits of at most two insertions at a place, as (cost, audit, repaired rows)."""
    gaps = [()] + [g for n in (1, 2) for g in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for role, text, fault in rows:
        own = [(3, "D", ())]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            own += [(more, "K", ((role, text),))] + [(2 + more, "R", ((r, text),)) for r in ("user", "assistant")]
        choices += [gaps, own]
    for picked in itertools.product(*choices, gaps):
        cost, audit, out = 0, "", []
        for k, p in enumerate(picked):
            if k % 2:
                cost, audit, out = cost + p[0], audit + p[1], out + list(p[2])
            else:
                cost, audit, out = cost + 2 * len(p), audit + "I" * len(p), out + [(r, "") for r in p]
        if SHAPE.fullmatch("".join(r[:1] for r, _ in out)):
            yield cost, audit, out


def in_order(rows):
    """Cheapest edits by going over the rows one by one."""
    best = {0: (0, "", [])}

    def least(table, state, found):
        if state not in table or found[:2] < table[state][:2]:
            table[state] = found

    def insertions(best):
        table = {}
        for state, (cost, audit, out) in best.items():
            for n in range(3):
                least(table, state, (cost + 2 * n, audit + "I" * n, out))
                role = "a" if state == 2 else "u"
                state, out = {"u": 2, "a": 3}[role], out + [(structure.ROLES[role], "")]
        return table

    for role, text, fault in rows:
        table = {}
        # insertions and the edit that follows are compared together
        for state, (cost, audit, out) in best.items():
            for n in range(3):
                c, a = cost + 2 * n, audit + "I" * n
                least(table, state, (c + 3, a + "D", out))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    for initial, to in structure.STEPS[state].items():
                        if role[:1] == initial:
                            least(table, to, (c + more, a + "K", out + [(role, text)]))
                        if initial in "ua":
                            least(table, to, (c + 2 + more, a + "R", out + [(structure.ROLES[initial], text)]))
                new = "a" if state == 2 else "u"
                state, out = {"u": 2, "a": 3}[new], out + [(structure.ROLES[new], "")]
        best = table
    return min((v for s, v in insertions(best).items() if s in (0, 3)), key=lambda v: v[:2])


def expected(turns):
    """From rows (turn, role, text) of one conversation."""
    if not turns:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    key = lambda r: (r[0] is not None, r[0] or 0, r[1][:1], hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest())
    turns = sorted(turns, key=key)
    rows = faulty([t[1:] for t in turns])
    numbers = {t[0] for t in turns if t[0] is not None}
    count = lambda f: sum(r[2] == f for r in rows)
    cost, audit, out = in_order(rows)
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damage(turns):
    """From rows (conv_id, turn, role, text)."""
    for conv, turn, role, text in turns:
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)


def test_grammar_gives_the_sequences_back():
    for seed in range(60):
        rng = random.Random(seed)
        kinds = rng.randint(1, 4)
        given = [[rng.randrange(kinds) for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(0, 8))]
        rules, written = re_pair(given, kinds)

        def expand(x):
            return [x] if x < kinds else [y for part in rules[x - kinds] for y in expand(part)]

        assert [[y for x in w for y in expand(x)] for w in written] == given
    rules, written = re_pair([[0, 1] * 512], 2)
    assert len(rules) <= 11 and len(written[0]) <= 2


def test_ropes_compare_as_their_texts():
    rng = random.Random(4)

    def rope(text):
        cut = rng.randint(0, len(text))
        return Rope(text) if len(text) < 2 or rng.random() < 0.2 else rope(text[:cut]) + rope(text[cut:])

    for _ in range(800):
        a = "".join(rng.choice("DI") for _ in range(rng.randint(0, 9)))
        b = rng.choice([a, a + "K", a[:-1] + "R", a[1:]])
        assert (rope(a) < rope(b)) == (a < b) and str(rope(a)) == a


def test_least_edits_of_all():
    rng = random.Random(2)
    for n in range(4):
        for _ in range(40 if n < 3 else 25):
            rows = [(rng.choice(["system", "user", "assistant", "tool", "uncle"]), rng.choice(["a.", "b", "", "c!"])) for _ in range(n)]
            rows = faulty(rows)
            want = min(every_edit(rows), key=lambda e: e[:2])
            assert in_order(rows) == want
            if n:
                symbols = tuple(structure.GONE if f in ("blank", "duplicate") else
                                2 * (structure.KINDS + "o").index(r[0] if r[0] in "sua" else "o") + (f == "truncated") for r, _, f in rows)
                cost, audit = structure.ended(structure.matrices([symbols])[0][structure.START])
                assert (cost, audit.replace("L", "K")) == want[:2]


def random_turns(rng, convs):
    out = []
    for c in range(convs):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "über"])
            text = rng.choice(["Yes.", "Yes.", "no", "Why?", "", " \n", None, "x. \t", "é!", "very " * 50])
            out.append((c if c else None, rng.choice([t, t, t, t + 1, None]), role, text))
    return out


@pytest.mark.parametrize("stretch", [2, 16384])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, stretch):
    from salesloom.llm.queries import op11_conversation_repair
    monkeypatch.setattr(structure, "STRETCH", stretch)
    turns = random_turns(random.Random(stretch), 60)
    turns += [(100, t, "user" if t % 2 == 0 else "assistant", f"t{t % 7}.") for t in range(90)] + [(101, 0, "user", "Hi.")] * 3
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn int, role string, text string, at string").repartition(3)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    by_conv = {}
    for row in damage(turns):
        by_conv.setdefault(row[0], []).append(row[1:])
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {c: expected(by_conv.get(c, [])) for c in {t[0] for t in turns}}


def test_query_on_the_given_table(spark):
    from salesloom.llm.queries import op11_conversation_repair
    sf = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by_conv = {t[0]: [] for t in turns}
    for row in damage(turns):
        by_conv[row[0]].append(row[1:])
    got = {r[0]: tuple(r[1:]) for r in op11_conversation_repair(spark, sf).collect()}
    assert got == {c: expected(t) for c, t in by_conv.items()}
    assert len({g[6] for g in got.values()}) > 5


def test_turns_of_the_repair_and_empty_tables(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (1, 2, "tool", "None."), (2, 0, "user", " ")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    stretches = structure.stretched(turns)
    plans = structure.plan_repairs(stretches)
    got = [tuple(r) for r in structure.repaired_turns(stretches, plans).orderBy("conv_id", "at", "n", "k").select("conv_id", "role", "text", "edit").collect()]
    assert got == [(1, "user", "", "I"), (1, "assistant", "Hello.", "K"), (1, "user", "Why?", "K"), (1, "assistant", "None.", "R")]
    assert {(r.conv_id, r.cost, r.audit) for r in structure.conversations(plans).collect()} == {(1, 4, "IKKR"), (2, 3, "D")}
    none = structure.stretched(turns.limit(0))
    assert structure.plan_repairs(none).count() == 0 and structure.repaired_turns(none, structure.plan_repairs(none)).count() == 0
