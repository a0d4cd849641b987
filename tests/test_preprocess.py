import json

from email.utils import getaddresses

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailframe import schema
from mailframe.functions.sql import register
from mailframe.operators import anonymize, mime
from mailframe.operators.mime import parse
from mailframe.operators.preprocess import preprocess, to_json, with_llm_context
from mailframe.schema import PreprocessOptions
from mailframe.sources.eml import from_strings, read_eml, stream_eml
from mailframe.streaming.stream import records, write
from tests.mails import GMAIL, NESTED, REPLY, SIMPLE, plain


def rows(spark, *mails, **options):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(mails)], "i int, raw string").coalesce(1)
    return preprocess(df, "raw", keep=("i",), **options).orderBy("i").collect()


def test_simple_message(spark):
    [r] = rows(spark, SIMPLE)
    assert r.body == "Hi Bob,\n\nShall we meet?" and r.signature == "Best,\nAlice"
    assert (r.subject, r.date, r.rfc_message_id) == ("Hello", "2026-02-10T10:30:00Z", "m1@example.com")
    assert (r["from"].name, r["from"].email, [tuple(a) for a in r.to], r.cc) == ("Alice", "alice@example.com", [("Bob", "bob@example.com")], [])
    assert r.in_reply_to is None and r.references is None and r.primary_cta is None and r.thread_messages == []
    assert r.clean_body_length == len(r.body) and r.raw_body_length == len(SIMPLE.split("\r\n\r\n", 1)[1])


def test_reply(spark):
    [r] = rows(spark, REPLY)
    assert r.body == "Yes, on Tuesday."
    assert (r.in_reply_to, r.references, r.date) == (["m1@example.com"], ["m0@example.com", "m1@example.com"], "2026-02-10T11:00:00Z")
    assert r.clean_body_length < r.raw_body_length


def test_mime_tree_charsets_and_words():
    m = parse(NESTED.encode())
    assert m["from"] == {"name": "Jürgen Röés", "email": "j@example.com"} and m["subject"] == "Café"
    assert (m["text"], m["html"], m["has_html"], m["date"]) == ("plain €", "<p>Hello <b>world</b>!</p>", True, "2025-11-08T13:04:26Z")
    assert m["to"][-1] == {"name": "Roe, Ann", "email": "ann@example.com"}
    attached = "Subject: a\nContent-Type: multipart/mixed; boundary=b\n\n--b\n\nplain <text>\n--b\nContent-Type: text/html\nContent-Disposition: attachment\n\n<p>x\n--b--\n"
    assert parse(attached.encode())["html"] == "<html><body>plain &lt;text&gt;</body></html>"
    odd = parse(b"Subject: a\nSubject: b\nDate: no date\nContent-Type: text/plain; charset=none-such\n\n\xff\xe9")
    assert (odd["subject"], odd["date"], odd["text"]) == ("b", None, "��")
    assert parse(b"")["error"] == parse(None)["error"] == parse(b"no header here")["error"] == schema.PARSE_FAILED


def test_thread_history_and_rendering(spark):
    df = with_llm_context(preprocess(spark.createDataFrame([(GMAIL,)], "raw string"), "raw"), "ThreadHistory")
    [r] = df.collect()
    assert r.body == "Hello Max,\n\nthat works." and r.signature == "Kind regards, \nDana\n"
    assert [tuple(m) for m in r.thread_messages] == [
        ("Dana <dana@example.com>", "2026-02-26T09:16:00", "We have a room."),
        ("Max Roe <max@example.com>", "2026-02-27T11:53:00", "Great, thanks.\n\nOne line.\n\n\\- a question"),
    ]
    assert r.llm_context == (
        "FROM: Dana <dana@example.com>\nSUBJECT: Re: Room\nCONTENT:\nHello Max,\n\nthat works.\n\n---\n\nTHREAD HISTORY:\n\n"
        "[2026-02-26T09:16:00] Dana <dana@example.com>\nWe have a room.\n\n---\n\n[2026-02-27T11:53:00] Max Roe <max@example.com>\nGreat, thanks.\n\nOne line.\n\n\\- a question"
    )
    [x] = with_llm_context(preprocess(spark.createDataFrame([(SIMPLE,)], "raw string"), "raw")).collect()
    assert x.llm_context == "FROM: Alice <alice@example.com>\nTO: Bob <bob@example.com>\nSUBJECT: Hello\nDATE: 2026-02-10T10:30:00Z\nCONTENT:\nHi Bob,\n\nShall we meet?"


def test_options(spark):
    [r] = rows(spark, REPLY, options=PreprocessOptions(strip_quotes=False))
    assert "> Shall we meet?" in r.body
    [r] = rows(spark, SIMPLE, options=PreprocessOptions(strip_signature=False))
    assert r.signature is None and r.body.endswith("Best,\nAlice")
    [r] = rows(spark, plain("🎉🎊🎈 party"), options=PreprocessOptions(max_body_length=2))
    assert (r.body, r.clean_body_length) == ("🎉🎊", 8)
    assert rows(spark, SIMPLE) == rows(spark, SIMPLE, options=PreprocessOptions())


@given(st.lists(st.tuples(st.sampled_from(["", "Ann", "Ann B-C", "=?utf-8?q?J=C3=BC?=", '"Roe, A"', "A (c) B", "Dr. X"]), st.sampled_from(["a@b.org", "x.y+z@m.example.org", "odd", "a@[1.2.3.4]"]), st.booleans()), max_size=4))
def test_plain_address_lists_are_read_as_the_parser_does(people):
    value = ", ".join(f"{n} <{a}>".strip() if n or bare else a for n, a, bare in people)
    want = [{"name": mime.decode_words(n) or None, "email": a} for n, a in getaddresses([value], strict=False) if n or a]
    assert mime.addresses(value) == want


def test_error_modes(spark):
    assert [r.i for r in rows(spark, "", SIMPLE, mode=schema.DROPMALFORMED)] == [1]
    bad, good = rows(spark, "", SIMPLE, mode=schema.PERMISSIVE)
    assert (bad.body, bad._corrupt, good._corrupt) == (None, schema.PARSE_FAILED, None)
    with pytest.raises(Exception, match=schema.PARSE_FAILED):
        rows(spark, "", SIMPLE)


def test_invariants(spark):
    for r in rows(spark, SIMPLE, REPLY, NESTED, GMAIL, plain("a\n\n\n\n\nb ​ \n \n\nc")):
        assert "\n\n\n" not in r.body and not any(c in r.body for c in "​ ﻿")
        assert all(line == line.rstrip() for line in r.body.split("\n"))
        assert r.clean_body_length == len(r.body.encode())


def test_unasked_fields_are_not_computed(spark):
    df = spark.createDataFrame([(SIMPLE,)], "raw string")
    plan = preprocess(df, "raw", fields=("subject", "date"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    plan = preprocess(df, "raw")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "BatchEvalPython" not in plan and "Exchange" not in plan


def test_render_modes():
    assert {schema.render_mode(m) for m in ("LatestOnly", "latestOnly", "LATEST_ONLY", 0)} == {schema.LATEST_ONLY}
    assert schema.render_mode(1) == schema.render_mode("threadHistory") == schema.THREAD_HISTORY
    with pytest.raises(ValueError):
        schema.render_mode("none")


def test_json_is_camel_case(spark):
    [r] = preprocess(spark.createDataFrame([(SIMPLE,)], "raw string"), "raw").select(to_json().alias("j")).collect()
    data = json.loads(r.j)
    assert data["rfcMessageId"] == "m1@example.com" and data["cleanBodyLength"] == 23 and "threadMessages" not in data


def test_files_streams_and_sql(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, m in enumerate((SIMPLE, GMAIL, "")):
        (tmp_path / "in" / f"m{i}.eml").write_bytes(m.encode())
    batch = preprocess(read_eml(spark, f"{tmp_path}/in"), keep=("path",), mode=schema.DROPMALFORMED)
    query = write(records(stream_eml(spark, f"{tmp_path}/in"), keep=("path",)), f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, got.select(batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert set(register(spark)) >= {"mail_decode", "mail_html", "mail_trim"}
    from_strings(spark.createDataFrame([(SIMPLE,)], "raw string"), "raw").createOrReplaceTempView("mails")
    [r] = spark.sql("SELECT mail_decode(content).subject AS s, mail_html('<p>a</p>').markdown AS m, mail_trim(' x ') AS t, mail_collapse_newlines('a\n\n\n\nb') AS n, mail_clean_invisible('a&zwnj;b') AS c, mail_mask_emails('x@y.org') AS e FROM mails").collect()
    assert tuple(r) == ("Hello", "a", "x", "a\n\nb", "ab", "test@example.com")


def test_more_sql_functions(spark):
    register(spark)
    [r] = spark.sql("SELECT mail_mask_urls('see https://static.licdn.com/a \\'https://x.org/y') AS u, mail_mask_tokens('?midToken=1&lipi=2') AS t, mail_quoted_at('a\nOn Mon, Feb 2, 2026 at 10 A B wrote:\n> x') AS q, mail_quoted_at('a') AS n").collect()
    assert tuple(r) == ("see https://example.com/static/image.png 'https://example.com/", "?midToken=REDACTED&lipi=REDACTED", 3, 0)


def test_anonymize(spark):
    text = "see https://www.linkedin.com/comm/in/jane?trk=x https://example.org/a https://example-shop.com/b mail a.b@c.org ?midToken=AQ&otpToken=1 lipi=u trkEmail=e"
    [r] = spark.createDataFrame([(text,)], "x string").select(anonymize.mask_text(F.col("x")).alias("y")).collect()
    assert r.y == "see https://example.com/ https://example.com/ https://example-shop.com/b mail test@example.com ?midToken=REDACTED&otpToken=REDACTED lipi=REDACTED trk=REDACTED"
    raw = "Received: x\nFrom: Jane Roe <jane@roe.org>\nTo: pat.doe@x.org\nMessage-ID: <1@x>\nContent-Type: multipart/mixed; boundary=b\n\npre Jane\n--b\nContent-Transfer-Encoding: quoted-printable\n\nDear Pat, caf=C3=A9 https://x.org/=\ny Jane=20Roe\n--b--\n"
    out = anonymize.anonymize_eml(spark.createDataFrame([(raw,)], "x string"), F.col("x")).first().anonymized
    assert "Received" not in out and "From: Jane Roe" not in out and "From: Max Mustermann <noreply@example.com>" in out
    assert "To: test@example.com" in out and "Message-ID: <test-message-id@example.com>" in out and "pre Max" in out
    assert "Dear Max, caf=C3=A9 https://example.com/ Max Mustermann" in out
    senders = [("Events GmbH <x@y.org>", ""), ("WERK1 <x@y.org>", ""), ("Jane <info@y.org>", ""), ("Jane Roe via Net <x@y>", ""), ("x", "Elias just messaged you"), ("Ann  van Roe <a@b.c>", "")]
    rows = spark.createDataFrame(senders, "f string, s string").select(anonymize.sender_name(F.col("f"), F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == ["", "", "", "Jane Roe", "Elias", "Ann  van Roe"]
    rows = spark.createDataFrame([("Pat <p@x>",), ("pat.doe_x@x.org",), ("",), ("<p@x>",)], "t string").select(anonymize.recipient_name(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == ["Pat", "Pat Doe X", "", ""]
    odd = ["no empty line", "Subject: a (b\\E [c\n\nx", None, "From: A(b <a@b.cd>\nTo: x\n\nA(b, a(B c", "To: q\nContent-Type: multipart/x; boundary=b\n\npre q@r.de\n--b\nno gap q@r.de\n--b--\nend q@r.de"]
    got = [r.y for r in anonymize.anonymize_eml(spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string"), F.col("x"), ("i",), "y").orderBy("i").collect()]
    assert got[:3] == [odd[0], odd[1], None] and got[3].endswith("\n\nMax, Max c")
    assert got[4].endswith("\n\npre test@example.com\n--b\nno gap q@r.de\n--b--\nend test@example.com")
    df = spark.createDataFrame([("file:/a/b.eml", raw.encode())], "path string, content binary")
    assert anonymize.anonymize_files(df).first().path == "file:/a/b.anon.eml"


def test_plain_messages_are_read_as_by_the_parser():
    """The short way of plain messages against the standard library's parser."""
    heads = ["Subject: a\nContent-Type: text/plain; charset=latin-1\n", "Subject:\n folded\n\tmore\n", "X:1\r\nSubject: =?utf-8?B?Q2Fmw6k=?= x\r\n", "Content-Type: text/html\nTo: a@b.cd\n", "From x\nSubject: y\n", "bad line\nSubject: y\n", "Subject: a\nSubject: b\nContent-Type: text/plain\nContent-Type: text/html\n", "Content-Transfer-Encoding: base64\nSubject: c\n", "Subject: d\nContent-Type: text/plain; charset=nosuch; format=flowed\n", "Content-Disposition: attachment\nSubject: e\n", "Content-Type: multipart/mixed\nMessage-ID: <a@b>\n", "Subject: é\n", "Content-Type: TEXT/Plain ; CharSet=\"UTF-8\"\nDate: Mon, 10 Feb 2026 10:30:00 +0000\n", ""]
    bodies = ["", "\n", "\nbody é\r\nline\n", "\r\nbody\n\nlast", "\n\nSGk=\n", "no gap"]
    for head in heads:
        for body in bodies:
            for raw in ((head + body).encode(), (head + body).encode("latin-1")):
                assert mime.parse(raw) == mime.parse(raw, short=False), raw
