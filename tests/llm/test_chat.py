import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kithgraph.llm import chat

PART = st.sampled_from(["### ", "###", "</turn>", " </turn>\n", "\\", ": ", "a", "\n", " ", "Assistant", "é"])
TEXT = st.lists(PART, max_size=8).map("".join)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
@settings(max_examples=400, deadline=None)
def test_parser_gives_turns_back(turns):
    made = [chat.render(r, t) for r, t in turns]
    assert chat.parse("".join(m[0] for m in made)) == turns
    assert [chat.ESCAPED.sub(r"\1", m[0][m[1] : m[1] + m[2]]) for m in made] == [t for _, t in turns]


def test_plain_text_is_not_touched():
    assert chat.render("user", "hello \\ # there")[0] == "### user: hello \\ # there </turn>\n"


def test_parser_rejects_other_text():
    with pytest.raises(ValueError):
        chat.parse("### user: x")


def test_rows(spark):
    rows = [(1, 1, "assistant", "b</turn>"), (1, 0, "user", None), (1, 1, "assistant", "b</turn>"), (None, 0, None, ""), (None, None, "assistant", "x" * 50_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.read_back(chat.render_turns(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 16
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb</turn>\nassistant\nb</turn>\n").hexdigest()
    assert got[None].n_turns == 2 and got[None].loss_sha256 == hashlib.sha256(b"x" * 50_000).hexdigest()
    assert chat.read_back(chat.render_turns(df.limit(0))).count() == 0
