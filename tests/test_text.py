import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailframe.functions import text as t
from mailframe.operators import quotes, signature
from mailframe.operators.thread import parse_attribution

NBSP, LS, NEL = " ", " ", "\u0085"


def run(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").coalesce(1)
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def one(spark, column, value):
    return run(spark, column, value)[0]


def python_lines(x):
    parts = x.split("\n")
    out = [p[:-1] if p.endswith("\r") else p for p in parts[:-1]]
    return out + ([parts[-1]] if parts[-1] else [])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=f"ab \t\r\n{NBSP}{LS}{NEL}\x1c🎉", max_size=25), min_size=1, max_size=20))
def test_lines_trim_and_collapse_against_python(spark, values):
    white = "[\\t\\n\\x0b\\x0c\\r \u0085  ]"
    assert run(spark, t.lines, *values) == [python_lines(v) for v in values]
    assert run(spark, t.trim, *values) == [re.sub(rf"\A{white}+|{white}+\Z", "", v) for v in values]
    assert run(spark, t.trim_lines, *values) == ["\n".join(re.sub(rf"{white}+\Z", "", x) for x in python_lines(v)) for v in values]
    assert run(spark, t.collapse_newlines, *values) == [re.sub("\n{3,}", "\n\n", v) for v in values]


def test_clean_invisible(spark):
    assert one(spark, t.clean_invisible, "a&zwnj;b&#x200c;c&#8204;d&ZWNJ;" + "".join(t.INVISIBLE) + f"e{NBSP}f") == "abcd&ZWNJ;e f"
    assert [hex(ord(c)) for c in t.INVISIBLE] == ["0x34f", "0x200b", "0x200c", "0x200d", "0xfeff", "0xad", "0x2007"]


def test_truncate_counts_characters_and_lengths_count_bytes(spark):
    assert one(spark, lambda c: t.truncate(c, 2), "🎉🎊🎈") == "🎉🎊"
    assert one(spark, lambda c: t.truncate(c, 0), "abc") == "abc"
    assert one(spark, t.byte_length, "é🎉") == 6


def test_collapse_whitespace(spark):
    assert one(spark, t.collapse_whitespace, f"a \t{NBSP} b\n\n\n\nc") == "a b\n\nc"


QUOTED = [
    ("new\n\nOn Mon, Feb 10, 2026 at 10:30 AM Alice <a@b.c> wrote:\n> old", "new\n\n"),
    ("new\n---- Original Message ----\nold", "new\n"),
    ("new\nFrom: A\nSent: Monday\nold", "new\n"),
    ("🎉 new\nAm Mo., 3. Feb. 2026 um 10:00 Uhr schrieb Bob:\n> old", "🎉 new\n"),
    ("new\nLe lun. 3 févr. 2026 à 10:00, Bob a écrit :\nold", "new\n"),
    ("new\nEl lun, 3 feb 2026 a las 10:00, Bob escribio:\nold", "new\n"),
    ("new\nBob from accounting wrote:\nold", "new\n"),
    ("new\n\n> one\n> two\nrest", "new\n"),
    ("new\n\n> one\n> two", "new\n\n> one\n> two"),
    ("new\n\n> just one\nrest", "new\n\n> just one\nrest"),
    ("\n> one\n> two\n\nreply\nmore\n> three\nend", "reply\nmore"),
    ("On Mon, Feb 10, 2026 Alice wrote:\n> one\nreply", "On Mon, Feb 10, 2026 Alice wrote:"),
    ("\n> a\n> b\n", ""),
    ("", ""),
    ("Fwd\n-------- Forwarded Message --------\nFrom: A\nDate: x\n\nkept", "Fwd\n-------- Forwarded Message --------\nFrom: A\nDate: x\n\nkept"),
    ("crlf\r\nFrom: A\r\nSent: x", "crlf\r\n"),
]


def test_strip_quotes(spark):
    got = run(spark, quotes.strip_quotes, *(b for b, _ in QUOTED))
    assert list(zip((b for b, _ in QUOTED), got, strict=True)) == QUOTED


def test_long_inputs_do_not_exhaust_the_stack(spark):
    long_ = "new\n\n" + "> quoted line\n" * 20_000
    assert one(spark, quotes.strip_quotes, long_) == "new\n"
    patterns = (*quotes.QUOTE_HEADERS, *(p for p, _ in signature.DELIMITERS))
    run(spark, lambda c: F.array(*(F.rlike(c, F.lit(t.java(p, "m"))) for p in patterns)), "a" * 200_000, "a b\n" * 20_000, f"x{NBSP}{LS}\r\n🎉")


TAIL12 = "\n".join(f"line {i}" for i in range(12))
SIGNED = [
    ("text\n-- \nJane\nWorks", "text\n", "-- \nJane\nWorks"),
    ("text\n--\nJane", "text\n", "--\nJane"),
    ("text\nsent from my phone", "text\n", "sent from my phone"),
    ("text\nEnvoyé de mon mobile", "text\n", "Envoyé de mon mobile"),
    ("text\nEnviado desde mi casa ", "text\n", "Enviado desde mi casa"),
    ("text\nBest,\nJane", "text", "Best,\nJane"),
    ("text\nBEST REGARDS\n\nJane\n", "text", "BEST REGARDS\n\nJane"),
    ("text\nLIEBE GRÜßE\nJana", "text", "LIEBE GRÜßE\nJana"),
    ("text\nGracias,", "text", "Gracias,"),
    ("no signature", "no signature", None),
    ("", "", None),
    (f"text\n--\n{TAIL12}", f"text\n--\n{TAIL12}", None),
    (f"text\nKind regards\n{TAIL12}", f"text\nKind regards\n{TAIL12}", None),
    (f"text\nKind regards\n{TAIL12}\n+49 170 1234567\nwww.example.org", "text", f"Kind regards\n{TAIL12}\n+49 170 1234567\nwww.example.org"),
    ("Thanks\n" + "x" * 250 + "\nmore\nlines", "Thanks\n" + "x" * 250 + "\nmore\nlines", None),
    ("text\r\nCheers,\r\nBo\r\n", "text", "Cheers,\nBo"),
]


def test_extract_signature(spark):
    got = run(spark, signature.extract_signature, *(b for b, _, _ in SIGNED))
    assert [(b, r.text, r.signature) for (b, _, _), r in zip(SIGNED, got, strict=True)] == SIGNED


ATTRIBUTED = [
    (f"Am Fr., 27. Feb. 2026 um 11:53{NBSP}Uhr schrieb Max Roe &lt;m@e.org>:", "Max Roe <m@e.org>", "2026-02-27T11:53:00"),
    ("On Mon, 2 Feb 2026 at 9:05, Alice wrote:", "Alice", "2026-02-02T09:05:00"),
    ("Le mar. 31 février 2026 à 9:05, Jean a écrit :", "Jean", "2026-02-31T09:05:00"),
    ("Le 27 mars 2026 à 9:05, Jean a écrit :", "Jean", "2026-03-07T09:05:00"),
    ("El lun, 5 de enero de 2026 a las 8:30, Ana escribió:", "Ana", "2026-01-05T08:30:00"),
    ("On Thu, Feb 5, 2026 at 10:00 AM Bob wrote:", "On Thu, Feb 5, 2026 at 10:00 AM Bob wrote", None),
    (" someone::", "someone", None),
]


def test_parse_attribution(spark):
    got = run(spark, parse_attribution, *(a for a, _, _ in ATTRIBUTED))
    assert [(a, r.sender, r.timestamp) for (a, _, _), r in zip(ATTRIBUTED, got, strict=True)] == ATTRIBUTED
