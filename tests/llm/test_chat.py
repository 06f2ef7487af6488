import hashlib
import os
import sys
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import connection, difference  # noqa: E402

from barwise.llm import chat
from barwise.llm.chat import Template, format_conversations, read_back

T = Template()
pieces = st.lists(st.sampled_from([*T.controls, "\\", "]", "[", "<", ">", "s", "/", "\n", " ", "é", "INST"]) | st.text(max_size=3), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.sampled_from(["system", "user", "assistant", "tool", ""]) | pieces, pieces)
def test_round_trip(role, text):
    segments = T.segments(role, text)
    formatted = "".join(p for p, _ in segments)
    assert T.read(formatted) == (role, text, len(formatted))
    assert T.read(formatted + formatted) == (role, text, len(formatted))
    inner = segments[1][0]
    assert not any(c in inner for c in T.controls)
    assert T.unescape(inner) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]) | pieces, pieces), max_size=6))
def test_whole_conversation_is_read_from_its_joined_text(turns):
    rest, got = "".join(p for role, text in turns for p, _ in T.segments(role, text)), []
    while rest:
        role, text, size = T.read(rest)
        got.append((role, text))
        rest = rest[size:]
    assert got == turns


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        assert difference(chat.op5_chat_format(spark, sf), connection(sf), chat.ORACLE["op5_chat_format"]) == ""


def test_conversations(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "</s>[INST] \\ok"), (1, 2, "assistant", "[OUT]é"), (2, 1, "assistant", None), (2, 0, "user", "q"), (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 5, None, None), (4, 0, "tool]", "x" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segment", "2 AS loss")
    got = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    for c in (1, 2, 3, None, 4):
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        lost = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert [got[c].valid for c in (1, 2, 3, 4)] == [True, True, False, False]
    assert read_back(format_conversations(df.limit(0))).count() == 0
