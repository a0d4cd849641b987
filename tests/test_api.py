import pytest

from mailframe import api
from mailframe.operators.preprocess import preprocess, with_llm_context
from tests.mails import GMAIL, NESTED, REPLY, SIMPLE


def test_records_and_text_are_those_of_the_table(spark):
    mails = [SIMPLE, REPLY, NESTED, GMAIL]
    got = api.preprocess_many([m.encode() for m in mails])
    df = preprocess(spark.createDataFrame(list(enumerate(mails)), "i int, raw string"), "raw", keep=("i",))
    df = with_llm_context(with_llm_context(df, 0, "latest"), 1, "history").orderBy("i")
    for mine, r in zip(got, df.collect(), strict=True):
        assert (mine.body, mine.subject, mine.signature, mine.references) == (r.body, r.subject, r.signature, r.references)
        assert api.to_llm_context(mine) == r.latest
        assert api.to_llm_context_with_options(mine, api.LlmContextOptions(api.RenderMode.ThreadHistory)) == r.history


def test_single_messages_and_errors(spark):
    assert api.preprocess_string(SIMPLE) == api.preprocess(SIMPLE.encode()) == api.preprocess_with_options(SIMPLE.encode(), api.PreprocessOptions())
    assert str(api.preprocess_string(SIMPLE).from_address) == "Alice <alice@example.com>"
    with pytest.raises(api.ParseError):
        api.preprocess(b"")
    assert isinstance(api.preprocess_many([b""])[0], ValueError)
    options = api.LlmContextOptions()
    options.render_mode = "threadHistory"
    assert "THREAD HISTORY" in api.to_llm_context_with_options(api.preprocess_string(GMAIL), options)


def test_options_can_be_set_and_records_have_short_forms():
    options = api.PreprocessOptions()
    options.strip_quotes = False
    assert repr(options) == "PreprocessOptions(strip_quotes=False, strip_signature=True, max_body_length=0)"
    assert repr(api.LlmContextOptions("threadHistory")) == "LlmContextOptions(render_mode=ThreadHistory)"
    assert repr(api.Address("A", "a@b.c")) == "Address(name='A', email='a@b.c')"
    assert repr(api.Address(None, "a@b.c")) == "Address(email='a@b.c')"
    assert repr(api.CallToAction("u", "t", 0.5)) == "CallToAction(url='u', text='t', confidence=0.50)"
    assert repr(api.ThreadMessage("S", None, "ü")) == "ThreadMessage(sender='S', timestamp=None, body=(2 chars))"
    assert repr(api.ThreadMessage("S", "2026", "")) == "ThreadMessage(sender='S', timestamp=Some(\"2026\"), body=(0 chars))"
    mail = api.ProcessedEmail("b", None, None, [], [], None, None, None, None, None, 1, 1, None)
    assert repr(mail) == "ProcessedEmail(subject='', body=(1 chars))"
