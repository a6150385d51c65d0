import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import same
from tidemark.llm import chat_format, queries
from tidemark.llm.chat_format import Escaper, Reader, Template

SCHEMA = "conv_id long, turn long, role string, text string"


def test_oracle(spark, sf, duck):
    same(queries.op2_chat_format(spark, sf), duck.sql(queries.ORACLE["op2_chat_format"]))


PIECE = st.one_of(st.sampled_from([*Template().controls, "\\", "<", "[", "[INST[INST]", "</s></s>", "\n"]), st.text(max_size=4))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<|text|>"]), st.lists(PIECE, max_size=6).map("".join)), max_size=5))
def test_round_trip(turns):
    t = Template()
    esc, reader, got = Escaper(t), Reader(t), []
    for role, text in turns:
        a, b = t.marks.get(role) or (t.other[0] + esc.escape(role) + t.other[1], t.other[2])
        assert not any(c in esc.escape(text) for c in t.controls)
        for piece in (a, esc.escape(text), b):
            got += list(reader.feed(piece))
    assert got == turns and not reader.rest


def rows(spark, data):
    return {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(data, SCHEMA))).collect()}


def test_order_is_validated(spark):
    got = rows(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, "user", "a"), (3, 1, "user", "b"), (4, 0, "robot", "x"), (5, 0, None, None)])
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert got[1].loss_chars == 1 and got[4].loss_chars == 0 and got[5].n_turns == 1


def test_nulls_ties_and_repeated_rows(spark):
    got = rows(spark, [(None, 1, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "user", "z")])
    assert got[None].n_turns == 1 and got[1].n_turns == 3


def test_empty(spark):
    assert chat_format.read_back(chat_format.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_broken_text_is_refused(spark):
    seg = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)).filter("seg_no < 2")
    with pytest.raises(Exception, match="ends inside a turn"):
        chat_format.read_back(seg).collect()


def test_segments_and_long_texts(spark):
    seg = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", "a" * 300_000), (1, 1, "assistant", "ok")], SCHEMA)).orderBy("seg_no").collect()
    assert [(s.kind, s.loss) for s in seg] == [("mark", False), ("text", False), ("mark", False), ("mark", False), ("text", True), ("mark", False)]
    assert "".join(s.text for s in seg) == "[INST] " + "a" * 300_000 + " [/INST]<s> ok</s>"


def test_columns_that_clash_are_not_read(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn int, role string, text string")
    extra = ["kind", "loss", "seg_no", "turn_no", "valid", "n_turns"]
    plain = chat_format.read_back(chat_format.format_conversations(rows)).collect()
    assert chat_format.read_back(chat_format.format_conversations(rows.select("*", *[F.lit(c).alias(c) for c in extra]))).collect() == plain
