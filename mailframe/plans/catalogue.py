"""Registered queries and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailframe.functions import text as t
from mailframe.operators import anonymize, cta, signature
from mailframe.operators import quotes as q
from mailframe.operators.html import read_html
from mailframe.operators.mime import decode_message
from mailframe.operators.preprocess import preprocess
from mailframe.operators.render import to_llm_context
from mailframe.operators.thread import MONTHS, parse_attribution, thread_messages
from mailframe.operators.thread import ATTRIBUTIONS as ATTRIBUTION_PATTERNS
from mailframe.plans import corpora as c
from mailframe.schema import THREAD_HISTORY, PreprocessOptions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, corpus: str, make: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(c.frame(spark, sf_dir, corpus))
    if oracle:
        ORACLES[name] = c.for_duckdb(oracle)


def _column(name: str, corpus: str, out: str, f: Callable[[Column], Column], oracle: str, whole: str | None = None) -> None:
    """A query of one text operator: msg_id and f(body); over whole, if given, where the oracle's corpus leaves rows out."""
    _query(name, whole or corpus, lambda df: df.select("msg_id", f(F.col("body")).alias(out)), f"SELECT msg_id, {oracle} AS {out} FROM ({corpus}) e")


# DuckDB's patterns know ASCII white space only; the corpora have no other left where these are used.


def _clean(x: str) -> str:
    for gone in (*t.INVISIBLE_ENTITIES, *t.INVISIBLE):
        x = f"replace({x}, '{gone}', '')"
    return f"replace({x}, '{t.NBSP}', ' ')"


def _lines(x: str) -> str:
    return f"string_split(regexp_replace(regexp_replace({x}, '\\r\\n', chr(10), 'g'), '\\n\\z', ''), chr(10))"


def _trim_lines(x: str) -> str:
    return f"array_to_string(list_transform({_lines(x)}, lambda x: regexp_replace(x, '\\s+\\z', '')), chr(10))"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '\\A\\s+|\\s+\\z', '', 'g')"


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def _tidy(x: str) -> str:
    return _collapse(_trim_lines(_trim(x)))


_column("clean_invisible", c.DIRTY, "body", t.clean_invisible, _clean("body"), c.DIRTY_ALL)
_column("trim_lines", c.DIRTY, "body", lambda b: t.trim_lines(t.clean_invisible(b)), _trim_lines(_clean("body")), c.DIRTY_ALL)
_column("collapse_newlines", c.DIRTY, "body", t.collapse_newlines, _collapse("body"), c.DIRTY_ALL)
_column("tidy_body", c.DIRTY, "body", lambda b: t.tidy(t.clean_invisible(b)), _tidy(_clean("body")), c.DIRTY_ALL)
_column("truncate_body", c.DIRTY, "body", lambda b: t.truncate(b, 100), "left(body, 100)", c.DIRTY_ALL)
_query(
    "body_lengths", c.DIRTY_ALL,
    lambda df: df.select("msg_id", t.byte_length(F.col("body")).alias("raw_length"), t.byte_length(t.tidy(t.clean_invisible(F.col("body")))).alias("clean_length")),
    f"SELECT msg_id, strlen(body)::BIGINT AS raw_length, strlen({_tidy(_clean('body'))})::BIGINT AS clean_length FROM ({c.DIRTY}) e",
)

_ANY = "(?m)(?:" + "|".join(q.QUOTE_HEADERS) + ")"


def _strip_quotes(x: str) -> str:
    head = f"string_split_regex({x}, '{_ANY}')"
    ls = _lines(x)
    first = f"list_position(list_transform({ls}, lambda l: NOT starts_with(l, '>') AND trim(l) <> ''), true)"
    rest = f"list_slice({ls}, {first}, len({ls}))"
    stop = f"coalesce(nullif(list_position(list_transform({rest}, lambda l: starts_with(l, '>')), true), 0) - 1, len({rest}))"
    bottom = f"CASE WHEN coalesce({first}, 0) = 0 THEN '' ELSE array_to_string(list_slice({rest}, 1, {stop}), chr(10)) END"
    return f"CASE WHEN len({head}) = 1 THEN {x} WHEN {head}[1] <> '' THEN {head}[1] ELSE {bottom} END"


_column("strip_quotes", c.REPLIES, "body", q.strip_quotes, _strip_quotes("body"))
_query(
    "quote_header_kind", c.REPLIES,
    lambda df: df.select("msg_id", *(F.rlike("body", F.lit(t.java(p, "m"))).alias(f"q{i}") for i, p in enumerate(q.QUOTE_HEADERS, 1))),
    "SELECT msg_id, " + ", ".join(f"regexp_matches(body, '(?m){p}') AS q{i}" for i, p in enumerate(q.QUOTE_HEADERS, 1)) + f" FROM ({c.REPLIES}) e",
)


def _markers(x: str) -> str:
    link = f"(contains({x}, 'http://') OR contains({x}, 'https://') OR contains({x}, 'www.'))"
    return f"(regexp_matches({x}, '{signature.PHONE}')::INT + regexp_matches({x}, '{signature.EMAIL}')::INT + {link}::INT)"


def _signature_sql(source: str, keep: str = "") -> str:
    """A query of msg_id, text and signature over source (msg_id, body and what keep names)."""
    cut, pick = [], []
    for i, (p, flags) in enumerate(signature.DELIMITERS):
        head = f"string_split_regex(body, '(?{flags}){p}')"
        cut.append(f"CASE WHEN len({head}) > 1 THEN {head}[1] END AS h{i}")
        tail = f"substr(body, length(h{i}) + 1)"
        pick.append(f"WHEN h{i} IS NOT NULL AND len({_lines(tail)}) <= {signature.SHORT} THEN {{'t': h{i}, 's': {_trim(tail)}}}")
    tail = "list_slice(l, i, len(l))"
    plain = f"(len(list_filter({tail}, lambda x: strlen(x) >= {signature.LINE_BYTES})) = 0 AND len(list_filter(list_slice(l, i + 1, len(l)), lambda x: trim(x) <> '')) > 0)"
    looks = f"CASE WHEN NOT {plain} THEN len(l) - i + 1 <= 2 WHEN len(l) - i + 1 <= {signature.SHORT} THEN true ELSE {_markers(f'array_to_string({tail}, chr(10))')} >= 2 END"
    at = f"list_filter(range(greatest(1, len(l) - {signature.LONG - 1}), len(l) + 1), lambda i: regexp_full_match(l[i], '(?i)(?:{'|'.join(signature.SIGN_OFFS)}),?\\s*') AND {looks})[1]"
    keep_ = f", {keep}" if keep else ""
    return f"""
SELECT msg_id, s.t AS text, s.s AS signature{keep_} FROM (
  SELECT msg_id{keep_}, CASE {' '.join(pick)}
         WHEN i IS NOT NULL THEN {{'t': array_to_string(list_slice(l, 1, i - 1), chr(10)), 's': array_to_string(list_slice(l, i, len(l)), chr(10))}}
         ELSE {{'t': body, 's': NULL}} END AS s
  FROM (SELECT *, {at} AS i FROM (SELECT *, CASE WHEN body = '' THEN [] ELSE {_lines('body')} END AS l, {', '.join(cut)} FROM ({source}) e) e) e) e
"""


_query("extract_signature", c.SIGNED, lambda df: df.select("msg_id", signature.extract_signature(F.col("body")).alias("s")).select("msg_id", "s.text", "s.signature"), _signature_sql(f"SELECT msg_id, body FROM ({c.SIGNED}) e"))
_column("corporate_markers", c.SIGNED, "markers", signature.corporate_markers, _markers("body"))

_MONTH_SQL = "CASE lower({m}) " + " ".join(f"WHEN '{n}' THEN '{i:02d}'" for i, names in enumerate(MONTHS, 1) for n in names.split()) + " END"


def _attribution_sql(x: str) -> tuple[str, str]:
    who = f"regexp_replace({_trim(x)}, ':+\\z', '')"
    when = "NULL"
    for p in reversed(ATTRIBUTION_PATTERNS):
        p = p.replace("\\w", "[\\pL\\pN_]")
        g = lambda i, p=p: f"regexp_extract({x}, '{p}', {i})"
        at = f"{g(3)} || '-' || {_MONTH_SQL.format(m=g(2))} || '-' || lpad({g(1)}, 2, '0') || 'T' || lpad({g(4)}, 2, '0') || ':' || {g(5)} || ':00'"
        who = f"CASE WHEN regexp_matches({x}, '{p}') THEN {_trim(g(6))} ELSE {who} END"
        when = f"CASE WHEN regexp_matches({x}, '{p}') THEN {at} ELSE {when} END"
    return who, when


_WHO, _WHEN = _attribution_sql("attribution")
_query("attribution_parse", c.ATTRIBUTION_LINES, lambda df: df.select("msg_id", parse_attribution(F.col("attribution")).alias("a")).select("msg_id", "a.sender", "a.timestamp"), f'SELECT msg_id, {_WHO} AS sender, {_WHEN} AS "timestamp" FROM ({c.ATTRIBUTION_LINES}) e')

# Calls to action: over a table of links by rules written again, and through HTML by the corpus's known features.


def _link(df: DataFrame) -> DataFrame:
    link = F.struct(*(F.col(n) for n in c.LINK_COLUMNS))
    return df.select("msg_id", F.transform(F.array(link), lambda x: F.struct(cta.eligible(x, cta.link_text(x)).alias("eligible"), cta.score(x, cta.link_text(x)).cast("long").alias("points")))[0].alias("s")).select("msg_id", "s.*")


_TEXT = f"{_trim('coalesce(title, text)')}"
_MATCH = lambda x, p: f"coalesce(regexp_matches({x}, '(?i){p}'), false)"
_LINK_SQL = f"""
SELECT msg_id,
       regexp_matches(href, '^https?://') AND x <> '' AND NOT logo AND NOT excluded AND NOT {_MATCH('x', cta.BLACKLIST)} AND NOT {_MATCH('href', cta.BLACKLIST)} AND NOT {_MATCH('href', cta.BARE_HOMEPAGE)} AS eligible,
       (CASE WHEN {_MATCH('class', cta.BUTTON_CLASS)} OR coalesce(role = 'button', false) OR coalesce(parent_tag = 'td' AND parent_style LIKE '%padding%' AND (parent_style LIKE '%background%' OR parent_style LIKE '%border%'), false) THEN 30 ELSE 0 END
        + CASE WHEN {_MATCH('x', cta.ACTION)} THEN 25 + CASE WHEN strlen(x) >= 20 THEN 40 ELSE 0 END ELSE 0 END
        + CASE WHEN {_MATCH('parent_style', cta.CENTERED)}::INT + {_MATCH('parent_style', cta.BIG_PADDING)}::INT + (strlen(x) > 10)::INT >= 2 THEN 20 ELSE 0 END
        + CASE WHEN {_MATCH('aria_label', cta.ARIA_ACTION)} THEN 15 ELSE 0 END)::BIGINT AS points
FROM (SELECT *, {_TEXT} AS x FROM ({c.PAGE_LINKS}) e) e
"""
_query("cta_score", c.PAGE_LINKS, _link, _LINK_SQL)


def _cta(df: DataFrame) -> DataFrame:
    html = df.select("msg_id", read_html(t.clean_invisible(F.col("html")), ("links", "jsonld")).alias("h"))
    return html.select("msg_id", cta.primary_cta(F.col("h")).alias("c")).select("msg_id", "c.url", "c.text", "c.confidence")


def _known(rows: list[tuple], i: int, cast: str) -> str:
    return f"(CASE kind {' '.join(f'WHEN {k} THEN {c._sql(r[i])}' for k, r in enumerate(rows))} END)::{cast}"


_BEST = [(x[0], (x[1] if x[1] is not None else x[2]).strip(), x[10]) if x[10] >= cta.LEAST else (None, None, None) for x in c.LINKS]
_query("cta_from_html", c.HTML_LINKS, _cta, f"SELECT msg_id, {_known(_BEST, 0, 'VARCHAR')} AS url, {_known(_BEST, 1, 'VARCHAR')} AS text, {_known(_BEST, 2, 'DOUBLE')} / 100.0 AS confidence FROM ({c.HTML_LINKS}) e")
_STRUCTURED = [("https://t.example/1", "Track", 1), ("https://t.example/2", "View", 1), *[(None, None, None)] * 3, ("https://t.example/4", "View", 1), (None, None, None)]
_query("jsonld_cta", c.LD_PAGES, _cta, f"SELECT msg_id, {_known(_STRUCTURED, 0, 'VARCHAR')} AS url, {_known(_STRUCTURED, 1, 'VARCHAR')} AS text, {_known(_STRUCTURED, 2, 'DOUBLE')} AS confidence FROM ({c.LD_PAGES}) e")

# Threads: messages exploded, with their place.


def _threads(df: DataFrame) -> DataFrame:
    html = df.select("msg_id", read_html(t.clean_invisible(F.col("html")), ("quotes",)).alias("h"))
    each = html.select("msg_id", F.posexplode(thread_messages(F.col("h.quotes"))).alias("place", "m"))
    return each.select("msg_id", F.col("place").cast("long").alias("place"), "m.sender", "m.timestamp", "m.body")


_THREAD_SQL = f"""
WITH e AS (SELECT *, regexp_replace({_trim('before')}, '\\s+', ' ', 'g') AS outer_body, CASE WHEN form = 7 THEN regexp_replace({_trim('before')}, '\\s+', ' ', 'g') ELSE 'first of ' || conv_id END AS inner_body FROM ({c.THREADS}) t)
SELECT msg_id, 0::BIGINT AS place, 'Carol' AS sender, '2026-02-01T07:00:00' AS "timestamp", inner_body AS body FROM e WHERE form <> 7
UNION ALL
SELECT msg_id, CASE WHEN form = 7 THEN 0 ELSE 1 END::BIGINT, {_known([(s, w) for _, s, w in c.ATTRIBUTIONS], 0, 'VARCHAR')}, {_known([(s, w) for _, s, w in c.ATTRIBUTIONS], 1, 'VARCHAR')}, outer_body FROM e WHERE form <> 8
"""
_query("thread_messages", c.THREADS, _threads, _THREAD_SQL)

# Messages: headers, and the whole way.


def _decoded(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select("msg_id", decode_message(F.encode("raw", "UTF-8")).alias("m")).select("msg_id", *columns)


def _joined(people: str) -> Column:
    return F.array_join(F.transform(people, lambda a: F.concat_ws("|", F.coalesce(a["name"], F.lit("-")), a["email"])), ",")


_SUBJECT, _DATE = "'Café ' || conv_id || ' topic'", "'2026-02-02T09:' || lpad((turn % 60)::VARCHAR, 2, '0') || ':00Z'"
_query(
    "parse_headers", c.RAW,
    lambda df: _decoded(df, F.col("m.subject"), F.col("m.from.name").alias("from_name"), F.col("m.from.email").alias("from_email"), _joined("m.to").alias("to_list"), _joined("m.cc").alias("cc_list"), F.col("m.has_html")),
    f"SELECT msg_id, {_SUBJECT} AS subject, 'Alice Roe' AS from_name, 'alice' || conv_id || '@example.org' AS from_email, 'Bob|bob@example.org,-|carol@example.org' AS to_list, CASE WHEN conv_id % 3 = 0 THEN 'Roe, Dan|dan@example.org' ELSE '' END AS cc_list, false AS has_html FROM ({c.RAW}) e",
)
_query(
    "message_ids", c.RAW,
    lambda df: _decoded(df, F.col("m.rfc_message_id"), F.array_join("m.in_reply_to", " ").alias("in_reply_to"), F.array_join("m.references", " ").alias("refs")),
    f"SELECT msg_id, 'c' || conv_id || '.t' || turn || '@example.org' AS rfc_message_id, CASE WHEN turn > 0 THEN 'c' || conv_id || '.t' || (turn - 1) || '@example.org' END AS in_reply_to, CASE WHEN turn > 0 THEN 'c' || conv_id || '.t0@example.org c' || conv_id || '.t' || (turn - 1) || '@example.org' END AS refs FROM ({c.RAW}) e",
)
_query("date_to_utc", c.RAW, lambda df: _decoded(df, F.col("m.date"), F.to_timestamp("m.date").cast("long").alias("epoch")), f"SELECT msg_id, {_DATE} AS date, epoch(({_DATE.replace(':00Z', ':00')})::TIMESTAMP)::BIGINT AS epoch FROM ({c.RAW}) e")

_PLAIN = ("subject", "from", "date", "body", "signature", "raw_body_length", "clean_body_length")


def _records(df: DataFrame, options: PreprocessOptions | None = None) -> DataFrame:
    out = preprocess(df, "raw", options, fields=(*_PLAIN, "to", "thread_messages"), keep=("msg_id",))
    return out.select("msg_id", "subject", F.col("from.email").alias("from_email"), "date", "body", "signature", "raw_body_length", "clean_body_length")


def _plain_sql(strip: bool = True, sign: bool = True, limit: int = 0) -> str:
    """Rows of msg_id, subject, from_email, date, body, signature and lengths for the plain messages."""
    source = f"SELECT msg_id, conv_id, turn, strlen(body)::BIGINT AS raw_body_length, {_strip_quotes('body') if strip else 'body'} AS body FROM ({c.RAW}) e"
    cut = _signature_sql(source, "conv_id, turn, raw_body_length") if sign else f"SELECT msg_id, body AS text, NULL::VARCHAR AS signature, conv_id, turn, raw_body_length FROM ({source}) e"
    body = f"left({_tidy('text')}, {limit})" if limit else _tidy("text")
    return f"""
SELECT msg_id, {_SUBJECT} AS subject, 'alice' || conv_id || '@example.org' AS from_email, {_DATE} AS date, b AS body, signature, raw_body_length, strlen(b)::BIGINT AS clean_body_length
FROM (SELECT *, {body} AS b FROM ({cut}) e) e
"""


_query("preprocess_plain", c.RAW, _records, _plain_sql())
_query("preprocess_options", c.RAW, lambda df: _records(df, PreprocessOptions(strip_quotes=False, strip_signature=False, max_body_length=80)), _plain_sql(False, False, 80))
_query(
    "llm_context_latest", c.RAW,
    lambda df: preprocess(df, "raw", fields=("from", "to", "subject", "date", "body"), keep=("msg_id",)).select("msg_id", to_llm_context().alias("llm_context")),
    f"SELECT msg_id, 'FROM: Alice Roe <' || from_email || '>' || chr(10) || 'TO: Bob <bob@example.org>, carol@example.org' || chr(10) || 'SUBJECT: ' || subject || chr(10) || 'DATE: ' || date || chr(10) || 'CONTENT:' || chr(10) || body AS llm_context FROM ({_plain_sql()}) e",
)


def _history(df: DataFrame) -> DataFrame:
    records = preprocess(df, "raw", fields=("from", "to", "subject", "date", "body", "thread_messages"), keep=("msg_id",))
    text = to_llm_context(mode=THREAD_HISTORY)
    return records.select("msg_id", F.get(F.split(text, "\n---\n\nTHREAD HISTORY:\n\n", 2), F.lit(1)).alias("history"), F.get(F.split(text, "\nCONTENT:\n", 2), F.lit(0)).alias("head"))


_query(
    "llm_context_history", c.RAW_HTML, _history,
    f"""SELECT e.msg_id, string_agg('[' || coalesce("timestamp", '?') || '] ' || sender || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS history,
               'FROM: Alice <alice@example.org>' || chr(10) || 'SUBJECT: Thread ' || any_value(conv_id) AS head
        FROM ({c.RAW_HTML}) e LEFT JOIN ({_THREAD_SQL}) t ON t.msg_id = e.msg_id GROUP BY e.msg_id""",
)
def _html_sql() -> str:
    """Records of the HTML messages: their Markdown by the corpus's grammar, and then the way of plain ones."""
    flat = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    turn = f"replace(split_part(split_part(html, '<div dir=\"ltr\">', 2), '</div>', 1), {c.NL}, ' ')"
    cite = f"{_known([(a,) for a, _, _ in c.ATTRIBUTIONS], 0, 'VARCHAR')}"
    quote = f"'> ' || {flat('before')} || {c.NL} || '> ' || {c.NL} || '> Roe' || {c.NL} || '> ' || {c.NL} || '> On Sun, 1 Feb 2026 at 7:00, Carol wrote:' || {c.NL} || '> ' || {c.NL} || '> > ' || CASE WHEN form = 7 THEN {flat('before')} ELSE 'first of ' || conv_id END"
    whole = f"{flat(turn)} || {c.NL} || {c.NL} || CASE WHEN form = 8 THEN '' ELSE {cite} || {c.NL} || {c.NL} END || {quote}"
    source = f"SELECT msg_id, conv_id, form, strlen(md)::BIGINT AS raw_body_length, {_strip_quotes('md')} AS body FROM (SELECT *, {whole} AS md FROM ({c.THREADS}) t) t"
    return f"""
SELECT msg_id, 'Thread ' || conv_id AS subject, 'alice@example.org' AS from_email, {_tidy('text')} AS body, signature, raw_body_length, strlen({_tidy('text')})::BIGINT AS clean_body_length,
       NULL::VARCHAR AS cta_url, ((form <> 7)::INT + (form <> 8)::INT)::INT AS n_thread
FROM ({_signature_sql(source, 'conv_id, form, raw_body_length')}) e
"""


_query(
    "preprocess_html", c.RAW_HTML,
    lambda df: preprocess(df, "raw", keep=("msg_id",)).select("msg_id", "subject", F.col("from.email").alias("from_email"), "body", "signature", "raw_body_length", "clean_body_length", F.col("primary_cta.url").alias("cta_url"), F.size("thread_messages").alias("n_thread")),
    _html_sql(),
)
_query("html_to_markdown", "SELECT page_id, html FROM {pages}", lambda df: df.select("page_id", read_html(t.clean_invisible(F.col("html")), ("markdown",)).alias("h")).select("page_id", "h.markdown"), c.PAGES_WANT)
_query("markdown_fragments", c.FRAGMENTS, lambda df: df.select("msg_id", read_html(F.col("html"), ("markdown",)).alias("h")).select("msg_id", "h.markdown"), c.FRAGMENTS_WANT)

# Masks. RE2 has no look-ahead: the last URL rule is written as a rule that keeps example sites through a group.
_column("mask_emails", c.MASKED, "body", anonymize.mask_emails, f"regexp_replace(body, '{anonymize.EMAIL}', '{anonymize.EMAIL_PLACEHOLDER}', 'g')")


def _mask_tokens(x: str) -> str:
    for p, groups, to in anonymize.TOKENS:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', '{''.join(f'{chr(92)}{i}' for i in groups)}{to}', 'g')"
    return x


def _mask_urls(x: str) -> str:
    rest = anonymize._REST.replace("'", "''")
    for p, to in anonymize.URL_RULES[:-1]:
        x = f"regexp_replace({x}, '{p}{rest}', '{to}', 'g')"
    # example sites are set aside under a scheme of their own while the catch-all runs; the corpora have no w3.org
    x = f"regexp_replace({x}, 'https?://((?:www\\.)?(?:example[\\w-]*\\.com|w3\\.org)\\b)', 'kept~//\\1', 'g')"
    x = f"regexp_replace({x}, 'https?://{rest}', '{anonymize.GENERIC}', 'g')"
    return f"replace({x}, 'kept~//', 'https://')"


_column("mask_urls", c.MASKED, "body", anonymize.mask_urls, _mask_urls("body"))
_column("mask_tokens", c.MASKED, "body", anonymize.mask_tokens, _mask_tokens("body"))
_query("parse_mime", c.MIME, lambda df: _decoded(df, F.col("m.subject"), F.col("m.text"), F.col("m.html"), F.col("m.has_html")), c.MIME_WANT)


def _mask_names(x: str, *names: tuple[str, str]) -> str:
    """Words replaced whatever their case; twice, as a match takes the characters around it along."""
    for name, to in names:
        for _ in range(2):
            x = f"regexp_replace({x}, '(?i)(^|[^\\pL\\pN]){name}($|[^\\pL\\pN])', '\\1{to}\\2', 'g')"
    return x


_ANONYMOUS = _mask_names(f"regexp_replace({_mask_tokens(f'regexp_replace({_mask_urls("body")}, {chr(39)}{anonymize.EMAIL}{chr(39)}, {chr(39)}{anonymize.EMAIL_PLACEHOLDER}{chr(39)}, {chr(39)}g{chr(39)})')}, '(?i)Alice Roe', '{anonymize.FULL}', 'g')", ("Alice", anonymize.FIRST), ("Roe", anonymize.LAST), ("Bob", anonymize.FIRST))
_query(
    "anonymize_eml", c.RAW, lambda df: anonymize.anonymize_eml(df, F.col("raw"), ("msg_id",)),
    f"""SELECT msg_id, 'From: {anonymize.FULL} <{anonymize.SENDER_PLACEHOLDER}>' || {c.NL} || 'To: {anonymize.FULL}  <{anonymize.EMAIL_PLACEHOLDER}>, {anonymize.EMAIL_PLACEHOLDER}' || {c.NL} ||
               CASE WHEN conv_id % 3 = 0 THEN 'Cc: "Roe,{anonymize.FULL}  <{anonymize.EMAIL_PLACEHOLDER}>' || {c.NL} ELSE '' END || 'Subject: =?UTF-8?Q?Caf=C3=A9_' || conv_id || '?= topic' || {c.NL} ||
               'Date: Mon, 02 Feb 2026 10:' || lpad((turn % 60)::VARCHAR, 2, '0') || ':00 +0100' || {c.NL} || 'Message-ID: {anonymize.MESSAGE_ID}' || {c.NL} ||
               CASE WHEN turn > 0 THEN 'In-Reply-To: <c' || conv_id || '.t' || (turn - 1) || '@example.org>' || {c.NL} || 'References: <c' || conv_id || '.t0@example.org>  <c' || conv_id || '.t' || (turn - 1) || '@example.org>' || {c.NL} ELSE '' END ||
               'Content-Type: text/plain; charset=UTF-8' || {c.NL} || 'Content-Transfer-Encoding: 8bit' || {c.NL} || {c.NL} || {_ANONYMOUS} AS anonymized FROM ({c.RAW}) e""",
)
