"""Chat formatting with typed content parts, with DataFrame operations only.

A turn is a list of parts.  A visitor flattens them in order: text is escaped, an image, audio or
document part becomes a placeholder, and its reference and the number of tokens that it expands
to are recorded.  Turns of the answering role stand between ``<s>`` and ``</s>``, others between
``[INST]`` and ``[/INST]``; the role's line comes first.  Stretches of answer text are recorded as
the loss mask, in code points.

Control strings inside texts and roles are escaped: every backslash is doubled, and one is put
after the first character of a control string.  Taking the backslashes out again is the inverse,
since a lone backslash can only come from escaping.

Defined results: a null text is empty, a null role is an empty role, a null part list has no
parts, null parts are passed over and parts of an unknown type are documents; turns with equal
numbers follow each other by role and text, null numbers first; rows without a conversation id are
one conversation; an empty table gives no rows.  A conversation is one row of the result and is
put together in one task; conversations are spread over tasks by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANSWERS = "assistant"
OPEN_ANSWER, CLOSE_ANSWER, OPEN_PROMPT, CLOSE_PROMPT = "<s>", "</s>", "[INST]", "[/INST]"
#: Placeholder and tokens it expands to where a part does not say.
PLACEHOLDERS = {"image": ("<image>", 256), "audio": ("<audio>", 128), "document": ("<document>", 512)}
CONTROL = [OPEN_ANSWER, CLOSE_ANSWER, OPEN_PROMPT, CLOSE_PROMPT, *(p for p, _ in PLACEHOLDERS.values())]

PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        c = F.replace(c, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return c


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def role_line(role: Column) -> Column:
    """A role without line breaks."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def role_of(line: Column) -> Column:
    return F.replace(F.replace(unescaped(line), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _by_type(part: Column, cases: dict, text: Column, other: Column) -> Column:
    """The visitor: one branch per type of part."""
    out = F.when(part["type"] == "text", text)
    for kind, value in cases.items():
        out = out.when(part["type"] == kind, value)
    return out.otherwise(other)


def flattened(parts: Column) -> Column:
    """Struct of ``body``, ``attachments`` in order and ``expanded_tokens``."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    marks = {k: F.lit(mark) for k, (mark, _) in PLACEHOLDERS.items()}
    tokens = {k: F.lit(n).cast("long") for k, (_, n) in PLACEHOLDERS.items()}
    body = F.array_join(F.transform(parts, lambda p: _by_type(
        p, marks, escaped(F.coalesce(p["text"], F.lit(""))), marks["document"])), "")
    attached = F.transform(F.filter(parts, lambda p: ~p["type"].eqNullSafe("text")), lambda p, i: F.struct(
        i.alias("place"), F.coalesce(p["type"], F.lit("document")).alias("type"), p["ref"].alias("ref"),
        F.coalesce(p["tokens"], _by_type(p, tokens, F.lit(0).cast("long"), tokens["document"])).alias("tokens")))
    expanded = F.aggregate(attached, F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    return F.struct(body.alias("body"), attached.alias("attachments"), expanded.alias("expanded_tokens"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation from rows ``(conv_id, turn, role, parts)``.

    ``formatted`` is the text, ``loss`` its stretches ``(start, size)`` to learn from (counted from 0),
    ``attachments`` the references with turn and place, ``expanded_tokens`` their tokens in sum.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    answer = role == ANSWERS
    rows = turns.select("conv_id", "turn", role.alias("role"), answer.alias("answer"), flattened(F.col("parts")).alias("flat"))
    rows = rows.withColumn("head", F.concat(F.when(answer, OPEN_ANSWER).otherwise(OPEN_PROMPT), role_line(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("piece", F.concat("head", "flat.body", F.when(F.col("answer"), CLOSE_ANSWER).otherwise(CLOSE_PROMPT)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "flat.body")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select(
        "conv_id", F.struct(
            F.row_number().over(order).alias("n"), "piece", "answer", (before + F.length("head")).alias("start"),
            F.length("flat.body").cast("long").alias("size"), "flat.attachments", "flat.expanded_tokens").alias("t"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(
        "conv_id", F.array_join("t.piece", "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["answer"]), lambda t: F.struct(t["start"], t["size"])).alias("loss"),
        F.flatten(F.transform("t", lambda t: F.transform(
            t["attachments"], lambda a: F.struct(t["n"].alias("turn"), a["place"], a["type"], a["ref"], a["tokens"])))).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda s, t: s + t["expanded_tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """Array of ``(role, text)`` read back from a formatted conversation."""
    pieces = F.split(formatted, r"</s>|\[/INST\]")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        opened = F.when(F.startswith(piece, F.lit(OPEN_ANSWER)), len(OPEN_ANSWER)).otherwise(len(OPEN_PROMPT))
        rest = F.substring(piece, opened + 1, F.length(piece))
        line = F.substring_index(rest, "\n", 1)
        return F.struct(role_of(line).alias("role"),
                        unescaped(F.substring(rest, F.length(line) + 2, F.length(rest))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(
        F.substring(formatted, s["start"].cast("int") + 1, s["size"].cast("int")))), "")


def text_parts(text: Column) -> Column:
    """A part list of one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("long").alias("tokens")))
