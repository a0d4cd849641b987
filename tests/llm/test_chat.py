import hashlib

from hypothesis import given
from hypothesis import strategies as st

from mailframe.llm import chat


@given(st.text(alphabet="\\#<>|:\n ab/turnAsi:é🎉"), st.text(alphabet="\\#<:\n ax"))
def test_turn_round_trip(text, role):
    flat = chat.Flattener()
    segment, a, b = chat._segment(flat, role, [{"type": "text", "text": text}], frozenset([role]))
    assert chat.parse_segment(segment) == (role, text)
    assert chat.unescape(segment[a:b]) == text


def test_parts_are_flattened_in_order(spark):
    parts = [
        {"type": "text", "text": "see # "}, {"type": "image", "ref": "a.png", "width": 56, "height": 57},
        {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "other", "text": "end"},
    ]
    df = spark.createDataFrame([(1, 0, "user", parts, "x")], f"conv_id long, turn long, role string, parts array<struct<{chat.PART.replace(' ', ':').replace(',:', ',')}>>, seq string")
    [row] = chat.format_chat(df).collect()
    assert row.segment == "### user:\nsee \\# <|image:0|><|audio:1|><|document:2|>end</turn>\n"
    assert [(a.position, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 6), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1536)]
    assert row.expanded_tokens == 1580


def test_digest_against_brute_force(spark):
    turns = [(1, 1, "assistant", "b ### </turn>"), (1, 0, "user", None), (1, 2, None, "\\x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 3, "assistant", "z" * 70000), (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chat(chat.text_parts(df))).collect()}
    assert set(got) == {1, 2, None, -7}
    for c, r in got.items():
        own = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c)
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_chat(chat.text_parts(df))).count() == 0
