"""Repair of the structure of conversations by grammar-compressed dynamic programming.

Every row has a role and at most one fault; a conversation is a sequence over nine symbols (four
kinds of role, sound or truncated, and rows that must go).  For each symbol a min-plus matrix tells,
from every state of the wanted shape ``(s?(ua)+)?`` to every other, the least cost and the least
audit string of getting over that row, insertions before it included.  The matrices multiply, so
Re-Pair rules get one matrix each, bottom-up, shared by all conversations of a task; audits are
ropes whose halves are shared as well.  A conversation may be cut anywhere: the matrices of its
stretches are multiplied in order, so one that holds most rows is worked on by many tasks.

Faults, the first that holds: blank (nothing but white space), duplicate (role and text stand earlier in
the conversation), truncated (the last character is not one of ``.!?``).

Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one for blank and duplicate
rows), Insert an empty text of user or assistant 2; a truncated row that stays costs 1 more.  Of the
cheapest edits those with the least string of initials are taken.

Defined results: a null role or text is one space; an empty role has no initial, so it cannot be kept;
null turns come first; rows with one turn follow each other by initial, then by the MD5 of role and text, equal
rows are one row that occurs several times; rows without a conversation id are one conversation; an
empty table gives no rows.  Very long texts stay outside Python; the turns of very long conversations are
dealt over tasks in stretches of at most ``STRETCH`` rows.  Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from salesloom.llm.grammar import Rope, re_pair
from salesloom.llm.ordered import batches_of, rows_of
from salesloom.session import staged

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of one stretch, and rows whose grammar is made together.
STRETCH, TOGETHER = 16_384, 65_536
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES, START = 4, 0
#: What a state takes next, and where it leads.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Insertions that end the conversation well.
ENDINGS = ("", "II", "I", "")
ROLES = {"u": "user", "a": "assistant"}
#: Symbols: twice the place of the initial in KINDS (3: any other), plus one where truncated; the last must go.
KINDS, GONE = "sua", 8
# keeping the system turn is written L inside; no two edits that differ in this alone can compete
_KEPT_SYSTEM = "L"

Matrix = list[list[tuple[int, Rope] | None]]


def _better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> bool:
    """Whether ``a`` is cheaper than ``b``, or as cheap with a smaller audit."""
    if a is None or b is None:
        return b is None and a is not None
    return a[0] < b[0] or a[0] == b[0] and a[1] < b[1]


def symbol_matrix(symbol: int) -> Matrix:
    """Least cost and audit over one row, insertions before it included."""
    kind, cut = (KINDS + "o")[symbol // 2] if symbol != GONE else "", symbol % 2 if symbol != GONE else 0
    table: Matrix = [[None] * STATES for _ in range(STATES)]
    for start in range(STATES):
        state = start
        for inserted in range(STATES):
            ways = [(DELETE, "D", state)]
            if symbol != GONE:
                if kind in STEPS[state]:
                    ways.append((KEEP + TRUNCATED * cut, _KEPT_SYSTEM if kind == "s" else "K", STEPS[state][kind]))
                ways += [(REROLE + TRUNCATED * cut, "R", to) for role, to in STEPS[state].items() if role in ROLES]
            for cost, initial, to in ways:
                found = (INSERT * inserted + cost, Rope("I" * inserted + initial))
                if _better(found, table[start][to]):
                    table[start][to] = found
            state = next(to for role, to in STEPS[state].items() if role in ROLES)
    return table


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product.  Audits over the same rows never begin with each other, as each ends with the
    edit of its last row; so the order of two of them is kept by whatever follows."""
    table: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        for k, first in enumerate(a[i]):
            if first is None:
                continue
            for j, second in enumerate(b[k]):
                if second is None or table[i][j] is not None and first[0] + second[0] > table[i][j][0]:
                    continue
                found = (first[0] + second[0], first[1] + second[1])
                if _better(found, table[i][j]):
                    table[i][j] = found
    return table


def matrices(sequences: list[tuple[int, ...]]) -> list[Matrix]:
    """One matrix for each (not empty) sequence of symbols; rules and equal sequences are worked out once."""
    distinct = sorted(set(sequences))
    rules, written = re_pair(distinct, GONE + 1)
    table = [symbol_matrix(s) for s in range(GONE + 1)]
    for left, right in rules:
        table.append(product(table[left], table[right]))

    def whole(symbols: list[int]) -> Matrix:
        # in halves, so that ropes of long sequences stay shallow
        parts = [table[s] for s in symbols]
        while len(parts) > 1:
            parts = [product(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    found = {s: whole(w) for s, w in zip(distinct, written)}
    return [found[s] for s in sequences]


def ended(reached: list[tuple[int, Rope] | None]) -> tuple[int, str]:
    """The least cost and audit of a whole conversation, from those of every state."""
    ways = [(way[0] + INSERT * len(ending), str(way[1]) + ending) for way, ending in zip(reached, ENDINGS) if way is not None]
    return min(ways)


# --- faults -------------------------------------------------------------------------------------------


def joined_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null, equal nulls meeting; the other columns must have different names."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    both = left.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), how)
    return both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], *[c for c in both.columns if c not in keys and c[1:] not in keys])


def faults(turns: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, initial, place, role, text, copies, blank, duplicate, truncated)``.

    Equal rows are one row with its number of ``copies``; ``duplicate`` is about the first of them.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    end = F.rtrim(text, F.lit(SPACE))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        F.substring(role, 1, 1).alias("initial"),
                        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("place"),
                        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    key = ["conv_id", "turn", "initial", "place"]
    folded = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    first = folded.groupBy("conv_id", "place").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "initial")).alias("f"))
    first = first.select("conv_id", F.col("f.turn").alias("turn"), F.col("f.initial").alias("initial"), "place", F.lit(True).alias("first"))
    marked = joined_on(folded, first, key)
    later = F.col("first").isNull()
    return marked.select(
        *key, "role", "text", "copies", "blank", (~F.col("blank") & later).alias("duplicate"),
        (~F.col("blank") & ~later & F.col("cut")).alias("truncated"))


# --- stretches ----------------------------------------------------------------------------------------

_COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
_SUMMARY = (T.StructType().add("conv_id", T.LongType()).add("at", T.LongType())
            .add("costs", T.ArrayType(T.LongType())).add("audits", T.ArrayType(T.StringType()))
            .add("first_turn", T.LongType()).add("last_turn", T.LongType()).add("first_initial", T.StringType()).add("last_initial", T.StringType()))
for _name in _COUNTS:
    _SUMMARY = _SUMMARY.add(_name, T.LongType())


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class _Stretch:
    """Consecutive rows of one conversation."""

    def __init__(self, conv: int | None, at: int):
        self.conv, self.at, self.symbols = conv, at, []
        self.count = dict.fromkeys(_COUNTS, 0)
        self.turns: list[int | None] = [None, None]
        self.initials = ["", ""]

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        count = self.count
        if not count["rows"]:
            self.initials[0] = initial
        elif not _legal(self.initials[1], initial):
            count["illegal"] += 1
        self.initials[1] = initial
        count["rows"] += 1
        count["blank"] += blank
        count["duplicate"] += duplicate
        count["truncated"] += truncated
        if turn is not None and turn != self.turns[1]:
            count["turns"] += 1
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn]
        place = KINDS.find(initial) if initial else -1
        self.symbols.append(GONE if blank or duplicate else 2 * (place if place >= 0 else len(KINDS)) + truncated)

    def summary(self, matrix: Matrix) -> tuple:
        cells = [c for row in matrix for c in row]
        return (self.conv, self.at, [None if c is None else c[0] for c in cells], [None if c is None else str(c[1]) for c in cells],
                *self.turns, *self.initials, *self.count.values())


def _stretches(rows: Iterator[tuple], first: int) -> Iterator[tuple]:
    """From sorted rows: those rows with their stretch and their number in it, then the stretches."""
    stretch, ready, held = None, [], 0
    for conv, turn, initial, _, role, text, copies, blank, duplicate, truncated in rows:
        done = 0
        while done < copies:
            if stretch is None or conv != stretch.conv or len(stretch.symbols) >= STRETCH:
                if stretch is not None:
                    ready.append(stretch)
                    held += len(stretch.symbols)
                if held >= TOGETHER:
                    yield from _summaries(ready)
                    ready, held = [], 0
                stretch = _Stretch(conv, first)
                first += 1
            again = duplicate or bool(done) and not blank
            n = len(stretch.symbols)
            stretch.add(turn, initial, blank, again, truncated and not done)
            if not (blank or again):
                yield stretch.conv, stretch.at, n, role, text, None
            done += 1
    if stretch is not None:
        yield from _summaries([*ready, stretch])


def _summaries(ready: list[_Stretch]) -> Iterator[tuple]:
    for stretch, matrix in zip(ready, matrices([tuple(s.symbols) for s in ready])):
        yield stretch.conv, stretch.at, None, None, None, stretch.summary(matrix)


_STRETCHED = (T.StructType().add("conv_id", T.LongType()).add("at", T.LongType()).add("n", T.LongType())
              .add("role", T.StringType()).add("text", T.StringType()).add("summary", _SUMMARY))


def stretched(turns: DataFrame) -> DataFrame:
    """Rows that may stay, numbered within stretches, and one row with a summary for every stretch; a written table,
    as the ranges that cut the stretches must not change between its readers."""
    found = faults(turns)
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "initial", "place"]
    ranged = found.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    schema = to_arrow_schema(_STRETCHED)
    names = [f.name for f in _SUMMARY]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        rows = _stretches(rows_of(batches), first)
        return batches_of(((*r[:5], None if r[5] is None else dict(zip(names, r[5]))) for r in rows), schema, 256)

    return staged(ranged.mapInArrow(cut, _STRETCHED), "stretches")


# --- conversations ------------------------------------------------------------------------------------

_EDIT = T.StructType().add("n", T.LongType()).add("inserted", T.StringType()).add("edit", T.StringType()).add("role", T.StringType())
_PLAN = (T.StructType().add("conv_id", T.LongType()).add("at", T.LongType()).add("edits", T.ArrayType(_EDIT)).add("whole", (
    T.StructType().add("gaps", T.LongType()).add("blank", T.LongType()).add("duplicate", T.LongType()).add("truncated", T.LongType())
    .add("illegal", T.LongType()).add("cost", T.LongType()).add("audit", T.StringType()).add("rows", T.LongType()))))


def _edits(audit: str, stretches: list[tuple[int, int]]) -> Iterator[tuple[int, list[dict]]]:
    """For each stretch ``(at, rows)`` the edits of its rows: roles inserted before, the edit, the role it gives."""
    state, i = START, 0

    def step(role: str) -> str:
        nonlocal state
        state = STEPS[state][role]
        return role

    def wanted() -> str:
        return next(r for r in STEPS[state] if r in ROLES)

    for k, (at, rows) in enumerate(stretches):
        out = []
        for n in range(rows + (k == len(stretches) - 1)):
            inserted = ""
            while i < len(audit) and audit[i] == "I":
                inserted += step(wanted())
                i += 1
            edit, role = (audit[i] if n < rows else "I"), None
            i += 1
            if edit == _KEPT_SYSTEM:
                step("s")
                edit = "K"
            elif edit in "KR" and n < rows:
                role = step(wanted())
            # a row that is kept as it is has no entry, nor has one deleted with nothing before it
            if inserted or edit == "R" or edit == "D":
                out.append({"n": n, "inserted": inserted, "edit": edit, "role": role})
        yield at, out


def _whole(conv: int | None, parts: list[dict]) -> Iterator[tuple]:
    """One conversation from its stretches, in order."""
    reached: list = [None] * STATES
    reached[START] = (0, Rope())
    count = dict.fromkeys(_COUNTS, 0)
    low = high = None
    initial = None
    for p in parts:
        costs, audits = p["costs"], p["audits"]
        matrix = [[None if costs[STATES * i + j] is None else (costs[STATES * i + j], Rope(audits[STATES * i + j])) for j in range(STATES)]
                  for i in range(STATES)]
        reached = product([reached] + [[None] * STATES] * (STATES - 1), matrix)[0]
        for name in _COUNTS:
            count[name] += p[name]
        if initial is not None and not _legal(initial, p["first_initial"]):
            count["illegal"] += 1
        initial = p["last_initial"]
        if p["last_turn"] is not None:
            if low is None:
                low = p["first_turn"]
            count["turns"] -= p["first_turn"] == high
            high = p["last_turn"]
    cost, audit = ended(reached)
    gaps = 0 if low is None else high - low + 1 - count["turns"]
    plans = list(_edits(audit, [(p["at"], p["rows"]) for p in parts]))
    for k, (at, edits) in enumerate(plans):
        last = k == len(plans) - 1
        yield conv, at, edits, {
            "gaps": gaps, **{n: count[n] for n in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost,
            "audit": audit.replace(_KEPT_SYSTEM, "K"), "rows": count["rows"]} if last else None


def plan_repairs(stretches: DataFrame) -> DataFrame:
    """One row per stretch: the edits of its rows that do not simply stay, and with the last stretch of a
    conversation the whole: ``gaps, blank, duplicate, truncated, illegal, cost, audit, rows``.

    The audit of a conversation is one string, so this step holds one conversation's stretches: some
    eighty bytes a row, not its texts.
    """
    parts = stretches.filter(F.col("summary").isNotNull()).select("conv_id", "at", F.struct("summary.*").alias("summary"))
    partitions = int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = to_arrow_schema(_PLAN)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            held, last = [], None
            for conv, _, summary in rows_of(batches):
                if held and conv != last:
                    yield from _whole(last, held)
                    held = []
                last = conv
                held.append(summary)
            if held:
                yield from _whole(last, held)
        return batches_of(made(), schema, 256)

    ordered = parts.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.mapInArrow(joined, _PLAN)


def conversations(plans: DataFrame) -> DataFrame:
    return plans.filter(F.col("whole").isNotNull()).select("conv_id", "whole.*")


def repaired_turns(stretches: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: ``(conv_id, at, n, k, role, text, edit)``, in the order of ``at, n, k``."""
    edits = plans.select("conv_id", "at", F.explode("edits").alias("e")).select("conv_id", "at", "e.*")
    edits = edits.withColumnsRenamed({"role": "new_role"})
    rows = stretches.filter(F.col("summary").isNull()).select("conv_id", "at", "n", "role", "text")
    both = joined_on(rows, edits, ["conv_id", "at", "n"], "full_outer")
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    given = F.transform(F.filter(F.split(F.coalesce("inserted", F.lit("")), ""), lambda c: c != ""), lambda c: F.struct(
        names[c].alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    edit = F.coalesce("edit", F.lit("K"))
    own = F.when(edit.isin("K", "R"), F.array(F.struct(
        F.when(edit == "R", names[F.col("new_role")]).otherwise(F.col("role")).alias("role"), F.col("text").alias("text"), edit.alias("edit"))))
    all_of = F.concat(given, F.coalesce(own, F.array().cast("array<struct<role:string,text:string,edit:string>>")))
    return both.select("conv_id", "at", "n", F.posexplode(all_of).alias("k", "t")).select("conv_id", "at", "n", "k", "t.*")
