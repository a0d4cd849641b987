"""Decoding of messages: one Arrow-batched function from bytes to headers and bodies.

A message without a single header is a parse failure, an empty one among them. Of repeated headers the last
counts. Attachments are not surfaced; a text/html attachment still makes has_html true.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
from datetime import UTC, datetime, timedelta
from email.message import Message
from email.parser import BytesParser
from email.policy import compat32
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mailframe import schema

_PARSER = BytesParser(policy=compat32)
_WORD = re.compile(r"=\?([^?*\s]+)(?:\*[^?]*)?\?([bBqQ])\?([^?]*)\?=")
_BETWEEN = re.compile(r"(=\?[^?\s]+\?[bBqQ]\?[^?]*\?=)\s+(?==\?[^?\s]+\?[bBqQ]\?)")
_FOLD = re.compile(r"\r?\n[ \t]*|\r(?=[ \t])")
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
_PLAIN = re.compile(rf"([A-Za-z0-9=?_ -]*)<({_ATOM}@{_ATOM})>|({_ATOM}@{_ATOM})")
_PLAIN_LIST = re.compile(rf"(?:(?:[A-Za-z0-9=?_-]+(?: [A-Za-z0-9=?_-]+)* )?<{_ATOM}@{_ATOM}>|{_ATOM}@{_ATOM})(?:, (?:(?:[A-Za-z0-9=?_-]+(?: [A-Za-z0-9=?_-]+)* )?<{_ATOM}@{_ATOM}>|{_ATOM}@{_ATOM}))*")
_ID = re.compile(r"<([^<>]+)>")


def _decode(data: bytes, charset: str | None) -> str:
    """By the charset named, else UTF-8; what can't be decoded is replaced."""
    try:
        return data.decode(charset or "utf-8", "replace")
    except (LookupError, UnicodeError):
        return data.decode("utf-8", "replace")


def _unfold(value: str) -> str:
    if value.isascii() and "\n" not in value and "\r" not in value:
        return value.strip()
    raw = value.encode("utf-8", "surrogateescape")
    return " ".join(x for x in _FOLD.split(_decode(raw, None)) if x).strip()


def _encoded_word(m: re.Match) -> str:
    charset, kind, text = m.groups()
    try:
        data = base64.b64decode(text + "=" * (-len(text) % 4)) if kind in "bB" else quopri.decodestring(text.replace("_", " "), header=True)
    except (binascii.Error, ValueError):
        return m[0]
    return _decode(data, charset)


def decode_words(value: str) -> str:
    """RFC 2047 words decoded; space between two of them goes."""
    return _WORD.sub(_encoded_word, _BETWEEN.sub(r"\1", value)) if "=?" in value else value


def addresses(value: str) -> list[dict]:
    if _PLAIN_LIST.fullmatch(value):  # most lists need no parser
        return [{"name": decode_words(m[1].strip()) if m[1] and m[1].strip() else None, "email": m[2] or m[3]} for m in _PLAIN.finditer(value)]
    found = getaddresses([value], strict=False)
    return [{"name": decode_words(n) or None, "email": a} for n, a in found if n or a]


def ids(value: str) -> list[str] | None:
    return _ID.findall(value) or value.split() or None


_DATE = re.compile(r"(?:[A-Z][a-z]{2}, )?([0-9]{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ([0-9]{4}) ([0-9]{2}):([0-9]{2}):([0-9]{2}) ([+-])([0-9]{2})([0-9]{2})")
_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


def date(value: str) -> str | None:
    try:
        if m := _DATE.fullmatch(value):  # as most dates are written
            day, month, year, hour, minute, second, sign, h, mm = m.groups()
            off = timedelta(hours=int(h), minutes=int(mm))
            at = datetime(int(year), _MONTHS[month], int(day), int(hour), int(minute), int(second)) + (off if sign == "-" else -off)  # noqa: DTZ001
            return f"{at.year:04d}-{at.month:02d}-{at.day:02d}T{at.hour:02d}:{at.minute:02d}:{at.second:02d}Z"
        at = parsedate_to_datetime(value)
        at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
        return f"{at.year:04d}-{at.month:02d}-{at.day:02d}T{at.hour:02d}:{at.minute:02d}:{at.second:02d}Z"
    except (ValueError, TypeError, OverflowError, IndexError):
        return None


def _content(part: Message) -> str:
    data = part.get_payload(decode=True)
    return _decode(data, part.get_content_charset()) if isinstance(data, bytes) else ""


def _walk(part: Message):
    """All parts, but none inside an attached message."""
    yield part
    if part.is_multipart() and part.get_content_maintype() == "multipart":
        for p in part.get_payload():
            yield from _walk(p)


def _bodies(part: Message) -> tuple[list[Message], list[Message]]:
    """The parts that make up the body as HTML and as text; alternatives stand for each other."""
    kind = part.get_content_type()
    if part.is_multipart() and kind.startswith("multipart/"):
        both = [_bodies(p) for p in part.get_payload()]
        if kind == "multipart/alternative":
            as_html = [p for h, _ in both for p in h if p.get_content_type() == "text/html"]
            as_text = [p for _, t in both for p in t if p.get_content_type() != "text/html"]
            return as_html or as_text, as_text or as_html
        return [p for h, _ in both for p in h], [p for _, t in both for p in t]
    if kind in ("text/plain", "text/html") and part.get_content_disposition() != "attachment":
        return [part], [part]
    return [], []


def text_as_html(text: str) -> str:
    return "<html><body>" + html.escape(text, quote=False).replace("\r\n", "\n").replace("\n", "<br/>") + "</body></html>"


_HEAD = re.compile(rb"(?:[!-9;-~]++:[^\r\n]*+\r?\n(?:[ \t][^\r\n]*+\r?\n)*+)++(?=\r?\n)")
_FIELD = re.compile(rb"([!-9;-~]+):([^\r\n]*(?:\r?\n[ \t][^\r\n]*)*)\r?\n")
_PLAIN_TYPE = re.compile(r"\s*(text/plain|text/html)\s*(?:;\s*charset=(?:([A-Za-z0-9_.:-]+)|\"([A-Za-z0-9_.:-]+)\"))?\s*", re.I)
_UNCODED = ("", "7bit", "8bit", "binary")


def _short(raw: bytes) -> tuple[dict[str, str], str, bool] | None:
    """Headers, content and whether it is HTML of a message of one part without a transfer encoding; None for any other, and for odd headers."""
    head = _HEAD.match(raw)
    if not head:
        return None
    fields = _FIELD.findall(head[0])
    headers = {k.decode("ascii").lower(): v.decode("ascii", "surrogateescape") for k, v in fields}
    if len(headers) < len(fields) or "content-disposition" in headers or headers.get("content-transfer-encoding", "").strip().lower() not in _UNCODED:
        return None
    kind = _PLAIN_TYPE.fullmatch(headers.get("content-type", "text/plain"))
    if not kind:
        return None
    at = head.end() + (2 if raw.startswith(b"\r\n", head.end()) else 1)
    return headers, _decode(raw[at:], (kind[2] or kind[3] or "").lower() or None), kind[1].lower() == "text/html"


def parse(raw: bytes | None, short: bool = True) -> dict:
    """A row of schema.MIME; short: messages of one plain part don't need the parser."""
    if short and raw and (found := _short(raw)):
        headers, content, is_html = found
        return _row(headers, is_html, content if is_html else None, content)
    message = _PARSER.parsebytes(raw) if raw else None
    headers = {k.lower(): str(v) for k, v in message.raw_items()} if message else {}
    if not headers:
        return dict.fromkeys(schema.MIME.names) | {"error": schema.PARSE_FAILED}
    has_html = any(p.get_content_type() == "text/html" for p in _walk(message))
    as_html, as_text = _bodies(message)
    body_html = None
    if has_html and as_html:
        body_html = _content(as_html[0]) if as_html[0].get_content_type() == "text/html" else text_as_html(_content(as_html[0]))
    return _row(headers, has_html, body_html, _content(as_text[0]) if as_text else None)


def _row(headers: dict[str, str], has_html: bool, body_html: str | None, text: str | None) -> dict:
    get = lambda name: _unfold(headers[name]) if name in headers else None
    subject, sender, to, cc, sent = get("subject"), get("from"), get("to"), get("cc"), get("date")
    message_id = ids(get("message-id") or "")
    return {
        "subject": decode_words(subject) if subject is not None else None,
        "from": next(iter(addresses(sender)), None) if sender is not None else None,
        "to": addresses(to) if to else [],
        "cc": addresses(cc) if cc else [],
        "date": date(sent) if sent else None,
        "rfc_message_id": message_id[0] if message_id else None,
        "in_reply_to": ids(get("in-reply-to") or ""),
        "references": ids(get("references") or ""),
        "html": body_html,
        "text": text,
        "has_html": has_html,
        "error": None,
    }


def _arrow(v: pa.Array) -> pa.Array:
    return pa.array([parse(x) for x in v.to_pylist()], to_arrow_type(schema.MIME))


def decode_message(content: Column) -> Column:
    """struct of schema.MIME for binary content; error is set where parsing failed."""
    # not deterministic as far as the optimizer knows, lest it repeats the function in each filter and projection above
    return F.arrow_udf(_arrow, schema.MIME).asNondeterministic()(content)
