import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salesloom.llm import chat

CONTROLS = chat.CONTROL + ["\\", "<", "[INST", "\n", "%0A", "%", "é", "\U0001f600", "<\\s>", "$1", "x"]
SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>, t int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(st.sampled_from(CONTROLS), max_size=12).map("".join),
                          st.lists(st.sampled_from(CONTROLS), max_size=12).map("".join)), min_size=40, max_size=60))
def test_any_text_and_role_come_back(spark, turns):
    rows = [(i // 4, i, "assistant" if i % 3 == 0 else role, [("text", text, None, None)], 1) for i, (role, text) in enumerate(turns)]
    made = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3][0][1]) for x in mine]
        assert r.learned == "".join(x[3][0][1] for x in mine if x[2] == "assistant")


def test_parts_become_placeholders_and_references(spark):
    parts = [("text", "see <image>: ", None, None), ("image", None, "a.png", None), None, ("audio", "x", "b.wav", 7),
             ("text", None, None, None), ("film", None, "c.mov", None), (None, None, None, None), ("document", None, None, 3)]
    rows = [(1, 0, "user", parts, 0), (1, 1, "assistant", [("text", "yes", None, None), ("image", None, "d.png", 1)], 0),
            (2, None, None, None, 0), (2, 3, "assistant", [], 0), (None, 0, "user", [], 0), (None, 0, "user", [], 0)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = got[1]
    assert one.formatted == ("[INST]user\nsee <\\image>: <image><audio><document><document><document>[/INST]"
                             "<s>assistant\nyes<image></s>")
    assert [(a.turn, a.place, a.type, a.ref, a.tokens) for a in one.attachments] == [
        (1, 0, "image", "a.png", 256), (1, 1, "audio", "b.wav", 7), (1, 2, "film", "c.mov", 512), (1, 3, "document", None, 512),
        (1, 4, "document", None, 3), (2, 0, "image", "d.png", 1)]
    assert one.expanded_tokens == 256 + 7 + 512 + 512 + 3 + 1
    assert [one.formatted[s.start:s.start + s.size] for s in one.loss] == ["yes<image>"]
    assert got[2].formatted == "[INST]\n[/INST]<s>assistant\n</s>" and got[2].expanded_tokens == 0
    assert got[None].formatted == "[INST]user\n[/INST]" * 2
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_the_table(spark):
    from salesloom.llm.queries import op4_chat_formatting
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in op4_chat_formatting(spark, sf).collect()}
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(x[1:] for x in rows if x[0] == conv)
        learned = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
