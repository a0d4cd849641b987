"""Mail-like corpora made from the driver's tables, in SQL that Spark and DuckDB both read.

The driver's tables hold no mail, so each corpus adds, by rule, the features that the operators look for, to
every row and its whole text. {table} stands for a table. Backslashes and lambdas differ between the engines and are not used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NL, CRLF = "chr(10)", "(chr(13) || chr(10))"


def _case(kind: str, branches: list[str]) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(branches)) + " END"


_PREVIOUS = "coalesce(p.text, 'nothing before')"
_QUOTED = f"('> ' || replace({_PREVIOUS}, {NL}, {NL} || '> '))"
_REPLY = [
    "c.text",
    f"c.text || {NL} || {NL} || 'On Mon, Feb 2, 2026 at 10:00 AM Alice Roe <alice@example.org> wrote:' || {NL} || {_QUOTED}",
    f"c.text || {NL} || '-----Original Message-----' || {NL} || {_PREVIOUS}",
    f"c.text || {NL} || 'From: Alice Roe' || {NL} || 'Sent: Monday' || {NL} || {_PREVIOUS}",
    f"c.text || {NL} || 'On the second of February in the year 2026, at 10:00 UTC, Alice Roe of the example team wrote:' || {NL} || {_PREVIOUS}",
    f"c.text || {NL} || 'Am Mo., 2. Feb. 2026 um 10:00 Uhr schrieb Alice Roe <alice@example.org>:' || {NL} || {_QUOTED}",
    f"c.text || {NL} || 'Le lun. 2 févr. 2026 à 10:00, Alice Roe a écrit :' || {NL} || {_QUOTED}",
    f"c.text || {NL} || 'El lun, 2 feb 2026 a las 10:00, Alice Roe escribió:' || {NL} || {_QUOTED}",
    f"c.text || {NL} || 'Alice Roe of the example team wrote:' || {NL} || {_PREVIOUS}",
    f"c.text || {NL} || {NL} || {_QUOTED} || {NL} || '> and so on' || {NL} || '> until here' || {NL}",
    f"'On Mon, Feb 2, 2026 at 10:00 AM Alice Roe wrote:' || {NL} || {_QUOTED} || {NL} || c.text",
    f"{NL} || '> first' || {NL} || '> second' || {NL} || {NL} || c.text || {NL} || '> third' || {NL} || 'after'",
]
REPLIES = f"""
SELECT c.conv_id * 1000 + c.turn AS msg_id, CAST((c.conv_id + c.turn) % {len(_REPLY)} AS INT) AS kind, c.conv_id, c.turn,
       {_case(f"(c.conv_id + c.turn) % {len(_REPLY)}", _REPLY)} AS body
FROM {{conversations}} c LEFT JOIN {{conversations}} p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
"""

_CORPORATE = f"'Kind regards,' || {NL} || " + f" || {NL} || ".join(f"'Line {i} of the Example Works'" for i in range(12))
_SIGNED = [
    f"'-- ' || {NL} || 'Jane Roe' || {NL} || 'Example Works'",
    f"'--' || {NL} || 'Jane Roe'",
    "'Sent from my pocket'",
    "'sent from mail for desks'",
    "'Sent from Outlook'",
    "'Sent via a web page'",
    "'Gesendet von unterwegs'",
    "'Envoyé de mon mobile'",
    "'Enviado desde mi casa'",
    "'Get Outlook for shelves'",
    f"'Best regards,' || {NL} || 'Jane'",
    f"'Mit freundlichen Grüßen' || {NL} || 'Jana Roe'",
    f"'CORDIALEMENT,' || {NL} || 'Jeanne'",
    f"'Gracias' || {NL} || 'Juana'",
    "'Thanks'",
    f"{_CORPORATE} || {NL} || '+49 170 1234567' || {NL} || 'jane@example.org'",
    f"{_CORPORATE} || {NL} || 'https://example.org' || {NL} || 'end'",
    "'no signature here'",
    f"'--' || {NL} || replace('x y z a b c d e f g h i', ' ', {NL})",
]
SIGNED = f"""
SELECT doc_id AS msg_id, CAST(doc_id % {len(_SIGNED)} AS INT) AS kind, coalesce(text, '') || {NL} || {_case(f"doc_id % {len(_SIGNED)}", _SIGNED)} AS body FROM {{documents}}
"""

_DIRTY = [
    "text",
    "replace(text, ' ', '&zwnj; &#x200c;')",
    "replace(replace(text, ' ', ' '), '.', '.​͏')",
    "'﻿' || replace(text, 'e', 'e­') || ' &#8204;'",
    f"replace(text, {NL}, '  ' || chr(9) || {NL})",
    f"replace(text, '. ', '.' || {NL} || {NL} || {NL} || {NL} || {NL})",
    f"replace(text, {NL}, {CRLF}) || {CRLF}",
    f"'  ' || {NL} || replace(text, '.', '. 🎉') || ' ' || {NL} || {NL} || {NL} || ' '",
]
DIRTY_ALL = f"SELECT doc_id AS msg_id, CAST(doc_id % {len(_DIRTY)} AS INT) AS kind, {_case(f'doc_id % {len(_DIRTY)}', _DIRTY)} AS body FROM {{documents}}"
#: What the DuckDB counterparts read; the queries read DIRTY_ALL, where a null text is a null body.
DIRTY = f"{DIRTY_ALL} WHERE text IS NOT NULL"

#: (url, title, text, class, role, aria label, parent tag, parent style, logo, excluded, points: 0 where a filter drops it)
LINKS = [
    ("https://a.example/x", None, "Press", "btn-primary", None, None, "div", None, False, False, 30),
    ("https://a.example/x", None, "View the whole message now", None, None, None, "p", None, False, False, 65),
    ("https://a.example/x", "Open", "x", None, "button", None, "p", None, False, False, 55),
    ("https://a.example/x", None, "Security and access", None, None, None, "td", "padding: 12px; background: #fff", False, False, 75),
    ("https://a.example/x", None, "Open", "cta", "button", "Reply to it", "td", "text-align: center; padding:20px", False, False, 90),
    ("https://a.example/x", None, "unsubscribe me", "btn", None, None, "p", None, False, False, 0),
    ("https://a.example/privacy", None, "Open it", "btn", None, None, "p", None, False, False, 0),
    ("https://www.a.example/", None, "Open it", "btn", None, None, "p", None, False, False, 0),
    ("mailto:a@example.org", None, "Open it", "btn", None, None, "p", None, False, False, 0),
    ("https://a.example/x", "", "Open it", "btn", None, None, "p", None, False, False, 0),
    ("https://a.example/x", None, "Open it", "btn", None, None, "p", None, True, False, 0),
    ("https://a.example/x", None, "Open it", "btn", None, None, "p", None, False, True, 0),
    ("http://a.example/x?y=1", None, "Hier geht es zum Postfach", None, None, None, "p", "text-align:center", False, False, 85),
    ("https://a.example/x", None, "plain", None, None, "see more", "p", None, False, False, 15),
]


def _sql(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


LINK_COLUMNS = ("href", "title", "text", "class", "role", "aria_label", "parent_tag", "parent_style", "logo", "excluded")


def _feature(i: int, cast: str) -> str:
    return f"CAST(CASE page_id % {len(LINKS)} " + " ".join(f"WHEN {k} THEN {_sql(link[i])}" for k, link in enumerate(LINKS)) + f" END AS {cast})"


#: One link with its features for each page.
PAGE_LINKS = "SELECT page_id AS msg_id, " + ", ".join(f"{_feature(i, 'BOOLEAN' if n in ('logo', 'excluded') else 'VARCHAR(200)')} AS {n}" for i, n in enumerate(LINK_COLUMNS)) + " FROM {pages}"


def _fragment(link: tuple) -> str:
    """The link as HTML with just these features."""
    href, title, text, cls, role, aria, parent, style, logo, excluded, _ = link
    attrs = "".join(f' {n}="{v}"' for n, v in (("title", title), ("class", cls), ("role", role), ("aria-label", aria)) if v is not None)
    image = '<img alt="Our LOGO">' if logo else ""
    inner = f'<a href="{href}"{attrs}>{image}{text}</a>'
    inner = f"<{parent}" + (f' style="{style}"' if style else "") + f">{inner}</{parent}>"
    inner = f"<table><tr>{inner}</tr></table>" if parent == "td" else inner
    return f"<footer>{inner}</footer>" if excluded else inner


HTML_LINKS = "SELECT page_id AS msg_id, CAST(page_id % {n} AS INT) AS kind, {case} || html AS html FROM {{pages}}".format(n=len(LINKS), case=_case(f"page_id % {len(LINKS)}", [_sql(_fragment(x)) for x in LINKS]))

_LD = ['{"name": "Track", "potentialAction": {"target": "https://t.example/1"}}', '{"potentialAction": {"target": "https://t.example/2"}}', '{"potentialAction": {"target": {"url": "x"}}}', '[{"potentialAction": {"target": "https://t.example/3"}}]', "{broken", '{"name": 5, "potentialAction": {"target": "https://t.example/4"}}']
LD_TYPES = ["application/ld+json"] * len(_LD) + ["text/json"]
_SCRIPTS = [f'<script type="{t}">{x}</script>' for t, x in zip(LD_TYPES, [*_LD, _LD[0]], strict=True)]
LD_PAGES = "SELECT page_id AS msg_id, CAST(page_id % {n} AS INT) AS kind, {case} || html AS html FROM {{pages}}".format(n=len(_SCRIPTS), case=_case(f"page_id % {len(_SCRIPTS)}", [_sql(x) for x in _SCRIPTS]))

#: (attribution, sender, timestamp)
ATTRIBUTIONS = [
    ("Am Fr., 27. Feb. 2026 um 09:16 Uhr schrieb Max Roe <max@example.org>:", "Max Roe <max@example.org>", "2026-02-27T09:16:00"),
    ("On Mon, 2 Feb 2026 at 9:05, Alice Roe <alice@example.org> wrote:", "Alice Roe <alice@example.org>", "2026-02-02T09:05:00"),
    ("Le ven. 27 mars 2026 à 11:53, Jean Roe <jean@example.org> a écrit :", "Jean Roe <jean@example.org>", "2026-03-27T11:53:00"),
    ("El lun, 5 de enero de 2026 a las 8:30, Ana Roe <ana@example.org> escribió:", "Ana Roe <ana@example.org>", "2026-01-05T08:30:00"),
    ("On Thu, Feb 5, 2026 at 10:00 AM Bob Roe wrote:", "On Thu, Feb 5, 2026 at 10:00 AM Bob Roe wrote", None),
    ("Le lun. 2 févr. 2026 à 10:00, Jean Roe a écrit :", "Jean Roe", None),
    ("Am 27. Feb. 2026 um 09:16 Uhr schrieb Max Roe:", "Max Roe", "2026-02-07T09:16:00"),
    ("Someone said::", "Someone said", None),
]


def _html(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


_N = len(ATTRIBUTIONS)
ATTRIBUTION_LINES = f"SELECT conv_id * 1000 + turn AS msg_id, CAST((conv_id + turn) % {_N} AS INT) AS kind, {_case(f'(conv_id + turn) % {_N}', [_sql(a) for a, _, _ in ATTRIBUTIONS])} AS attribution FROM {{conversations}}"
_CITE = _case(f"(c.conv_id + c.turn) % {_N}", [_sql(f'<div class="gmail_attr">{_html(a)}<br></div>') for a, _, _ in ATTRIBUTIONS])
#: A reply around the turn before, which quotes itself; every ninth without attribution; some with equal bodies.
THREADS = f"""
SELECT c.conv_id * 1000 + c.turn AS msg_id, CAST((c.conv_id + c.turn) % {_N} AS INT) AS kind, CAST((c.conv_id + c.turn) % 9 AS INT) AS form,
       '<html><body><div dir="ltr">' || c.text || '</div><div class="gmail_quote">' ||
       CASE WHEN (c.conv_id + c.turn) % 9 = 8 THEN '' ELSE {_CITE} END ||
       '<blockquote class="gmail_quote_inner"><div>' || {_PREVIOUS} || '</div><div class="gmail_signature">Roe</div>' ||
       '<div class="gmail_quote"><div class="gmail_attr">On Sun, 1 Feb 2026 at 7:00, Carol wrote:</div><blockquote><p>' ||
       CASE WHEN (c.conv_id + c.turn) % 9 = 7 THEN {_PREVIOUS} ELSE 'first of ' || c.conv_id END || '</p></blockquote></div></blockquote></div></body></html>' AS html,
       {_PREVIOUS} AS before, c.conv_id
FROM {{conversations}} c LEFT JOIN {{conversations}} p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
"""

#: Whole plain-text messages around the replies; the body's line ends stay \\n.
RAW = f"""
SELECT msg_id, kind, conv_id, turn, body,
       'From: Alice Roe <alice' || conv_id || '@example.org>' || {CRLF} ||
       'To: Bob <bob@example.org>, carol@example.org' || {CRLF} ||
       CASE WHEN conv_id % 3 = 0 THEN 'Cc: "Roe, Dan" <dan@example.org>' || {CRLF} ELSE '' END ||
       'Subject: =?UTF-8?Q?Caf=C3=A9_' || conv_id || '?= topic' || {CRLF} ||
       'Date: Mon, 02 Feb 2026 10:' || CASE WHEN turn % 60 < 10 THEN '0' ELSE '' END || (turn % 60) || ':00 +0100' || {CRLF} ||
       'Message-ID: <c' || conv_id || '.t' || turn || '@example.org>' || {CRLF} ||
       CASE WHEN turn > 0 THEN 'In-Reply-To: <c' || conv_id || '.t' || (turn - 1) || '@example.org>' || {CRLF} || 'References: <c' || conv_id || '.t0@example.org>' || {CRLF} || ' <c' || conv_id || '.t' || (turn - 1) || '@example.org>' || {CRLF} ELSE '' END ||
       'Content-Type: text/plain; charset=UTF-8' || {CRLF} || 'Content-Transfer-Encoding: 8bit' || {CRLF} || {CRLF} || body AS raw
FROM ({REPLIES}) r
"""

#: The thread corpus as messages with one HTML part.
RAW_HTML = f"""
SELECT msg_id, kind, form, before, conv_id, 'From: Alice <alice@example.org>' || {CRLF} || 'Subject: Thread ' || conv_id || {CRLF} || 'MIME-Version: 1.0' || {CRLF} || 'Content-Type: text/html; charset=UTF-8' || {CRLF} || {CRLF} || html AS raw
FROM ({THREADS}) t
"""



def _b64(x: str, charset: str = "UTF-8") -> str:
    return f"base64(encode({x}, '{charset}'))"


def _qp(x: str) -> str:
    """Quoted-printable with every byte coded."""
    return f"regexp_replace(hex(encode({x}, 'UTF-8')), '(..)', '=$1')"


def _mime_part(kind: str, code: str, body: str, more: str = "") -> str:
    return f"'Content-Type: {kind}' || {NL} || 'Content-Transfer-Encoding: {code}' || {NL} || '{more}' || {NL} || {body}"


def _multipart(kind: str, mark: str, *parts: str) -> str:
    return f"'Content-Type: multipart/{kind}; boundary=\"{mark}\"' || {NL} || {NL} || 'before' || {NL} || " + " || ".join(f"'--{mark}' || {NL} || {p} || {NL} ||" for p in parts).replace("|| ||", "||") + f" '--{mark}--' || {NL} || 'after'"


_PARAGRAPH = "'<p>' || text || '</p>'"
_ALTERNATIVE = lambda plain, rich: _multipart("alternative", "inner", plain, rich)
#: (message from its content headers on, what its body is as text, as HTML, whether it has HTML)
MIME_KINDS = [
    (_mime_part("text/plain; charset=UTF-8", "base64", _b64("text")), "text", "NULL", False),
    (_mime_part("text/plain; charset=utf-8", "quoted-printable", _qp("text")), "text", "NULL", False),
    (_mime_part("text/plain; charset=iso-8859-1", "quoted-printable", "'Gr=FC=DFe ' || conv_id"), "'Grüße ' || conv_id", "NULL", False),
    (_ALTERNATIVE(_mime_part("text/plain; charset=utf-16le", "base64", _b64("text", "UTF-16LE")), _mime_part("text/html; charset=utf-8", "quoted-printable", _qp(_PARAGRAPH))), "text", _PARAGRAPH, True),
    (
        _multipart("mixed", "outer", _ALTERNATIVE(_mime_part("text/plain; charset=utf-8", "quoted-printable", _qp("text")), _mime_part("text/html; charset=utf-8", "base64", _b64(_PARAGRAPH))), _mime_part("text/html", "7bit", "'<p>attached</p>'", "Content-Disposition: attachment; filename=a.html" + "' || chr(10) || '")),
        "text", _PARAGRAPH, True,
    ),
    (_multipart("mixed", "one", _mime_part("text/html; charset=utf-8", "base64", _b64(_PARAGRAPH)), _mime_part("application/pdf", "base64", "'AAAA'")), _PARAGRAPH, _PARAGRAPH, True),
]
_MIME_KIND = f"CAST((conv_id + turn) % {len(MIME_KINDS)} AS INT)"
#: Messages of one and many parts in several charsets and transfer encodings, written for Spark; the subject has words of both forms.
MIME = f"""
SELECT conv_id * 1000 + turn AS msg_id,
       'From: A <a@example.org>' || {NL} || 'Subject: =?utf-8?B?' || {_b64("'Größe ' || conv_id")} || '?=' || {NL} || ' =?iso-8859-1?q?_f=FCr_alle?= x' || {NL} || 'MIME-Version: 1.0' || {NL} ||
       {_case(_MIME_KIND, [m for m, _, _, _ in MIME_KINDS])} AS raw
FROM {{conversations}}
"""
MIME_WANT = f"""
SELECT conv_id * 1000 + turn AS msg_id, 'Größe ' || conv_id || ' für alle x' AS subject, {_case(_MIME_KIND, [t for _, t, _, _ in MIME_KINDS])} AS text,
       {_case(_MIME_KIND, [h for _, _, h, _ in MIME_KINDS])} AS html, {_case(_MIME_KIND, [str(b).lower() for _, _, _, b in MIME_KINDS])} AS has_html
FROM {{conversations}}
"""

_FRAGMENTS = [
    ("'<p>' || words || '</p><p>second</p>'", "words || {nl} || {nl} || 'second'"),
    ("'<ul><li>' || words || '</li><li>b</li></ul>'", "'* ' || words || {nl} || '* b'"),
    ("'<ol><li>a</li><li>' || words || '</li></ol>'", "'1. a' || {nl} || '2. ' || words"),
    ("'<b>' || words || '</b> and <a href=\"https://x.example/y\">link</a>'", "'**' || words || '** and [link]'"),
    ("'<table><tr><td>' || words || '</td><td></td><td>c | d</td></tr></table>'", "words || {nl} || {nl} || 'c | d'"),
    ("'<div>one</div><hr><div>' || words || '</div>'", "'one' || {nl} || {nl} || '* * *' || {nl} || {nl} || words"),
    ("'<style>p</style><h2>' || words || '</h2>- x'", "'## ' || words || {nl} || {nl} || '\\- x'"),
    ("'<p>' || words || '<br>next &amp; last</p>'", "words || ' ' || {nl} || 'next & last'"),
]
#: HTML in a small grammar with the Markdown it must give; words are a conversation turn's letters.
FRAGMENTS = f"""
SELECT msg_id, kind, {_case("kind", [h for h, _ in _FRAGMENTS])} AS html
FROM (SELECT conv_id * 1000 + turn AS msg_id, CAST((conv_id + turn) % {len(_FRAGMENTS)} AS INT) AS kind, replace(text, {NL}, ' ') AS words FROM {{conversations}}) w
"""
FRAGMENTS_WANT = f"""
SELECT msg_id, {_case("kind", [m.format(nl=NL) for _, m in _FRAGMENTS])} AS markdown
FROM (SELECT conv_id * 1000 + turn AS msg_id, CAST((conv_id + turn) % {len(_FRAGMENTS)} AS INT) AS kind, replace(text, {NL}, ' ') AS words FROM {{conversations}}) w
"""

_MASKED = [
    "' see https://www.linkedin.com/comm/messaging/thread/2-abc?midToken=AQ1&midSig=0x'",
    "' see https://static.licdn.com/a.png and https://lh3.googleusercontent.com/b'",
    "' mail jane.roe+x@mail.example.org, lipi=urn%3Ali&trkEmail=eml-1 '",
    "' at https://www.meetup.com/x/y) https://forms.monday.com/z?otpToken=1&amp;eid=77'",
]
MASKED = f"SELECT doc_id AS msg_id, CAST(doc_id % 4 AS INT) AS kind, coalesce(text, '') || {_case('doc_id % 4', _MASKED)} AS body FROM {{documents}}"


def for_duckdb(sql: str) -> str:
    return re.sub(r"\{([a-z]+)\}", r"\1", sql)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The corpus as a DataFrame over the tables below sf_dir."""
    names = sorted(set(re.findall(r"\{([a-z]+)\}", sql)))
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    for n, df in tables.items():
        df.createOrReplaceTempView(f"_mailframe_{n}")
    return spark.sql(re.sub(r"\{([a-z]+)\}", r"_mailframe_\1", sql))


def _words(x: str) -> str:
    """Text of HTML without tags in it, as Markdown writes it."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"regexp_replace({x}, '([\\\\*_`\\[\\]])', '\\\\\\1', 'g')"
    return f"regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '^([-+>=])', '\\\\\\1')"


def _bold(before: str, own: str, x: str) -> str:
    """x in the marks of three at most of the <b> before it, and of its own."""
    marks = f"repeat('**', least(3, {before}) + {own})"
    return f"{marks} || {x} || {marks}"


#: Markdown of the pages by their grammar. No <b> there has an end tag, so a browser opens it anew in each later block, but three alike at most.
PAGES_WANT = f"""
SELECT page_id, array_to_string(list_filter([
         array_to_string(list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1), lambda x: '* [' || {_words('x')} || ']'), {NL}),
         {_words("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")},
         '# ' || {_words("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")},
         array_to_string(list_filter(list_transform(range(2, len(p) + 1), lambda i: {_bold("len(list_filter(p[:i - 1], lambda x: starts_with(x, '<b>')))", "starts_with(p[i], '<b>')::INT", _words("regexp_replace(p[i], '<[^>]*>', '', 'g')"))}), lambda x: x <> ''), {NL} || {NL}),
         {_bold("len(list_filter(p, lambda x: starts_with(x, '<b>')))", "0", _words("regexp_extract(html, '<footer>([^<]*)</footer>', 1)"))}], lambda x: x <> ''), {NL} || {NL}) AS markdown
FROM (SELECT page_id, html, string_split(regexp_extract(html, '</h1>(.*?)</article>', 1, 's'), '<p>') AS p FROM {{pages}}) e
"""
