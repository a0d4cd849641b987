"""The record that a message becomes, options, and the error of the strict mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ADDRESS = T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType(), False)])
CTA = T.StructType([T.StructField("url", T.StringType(), False), T.StructField("text", T.StringType(), False), T.StructField("confidence", T.DoubleType(), False)])
THREAD_MESSAGE = T.StructType([T.StructField("sender", T.StringType(), False), T.StructField("timestamp", T.StringType()), T.StructField("body", T.StringType(), False)])

#: What the MIME function gives: headers decoded, and the first body of each kind.
MIME = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("from", ADDRESS),
    T.StructField("to", T.ArrayType(ADDRESS)),
    T.StructField("cc", T.ArrayType(ADDRESS)),
    T.StructField("date", T.StringType()),
    T.StructField("rfc_message_id", T.StringType()),
    T.StructField("in_reply_to", T.ArrayType(T.StringType())),
    T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("html", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("has_html", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

LINK = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("href", "title", "text", "class", "role", "aria_label", "parent_tag", "parent_style")),
    T.StructField("logo", T.BooleanType()),
    T.StructField("excluded", T.BooleanType()),
])

HTML = T.StructType([
    T.StructField("markdown", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)),
    T.StructField("jsonld", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]))),
    T.StructField("quotes", T.ArrayType(T.StructType([T.StructField("attribution", T.StringType()), T.StructField("markdown", T.StringType())]))),
])

RECORD = ("body", "subject", "from", "to", "cc", "date", "rfc_message_id", "in_reply_to", "references", "signature", "raw_body_length", "clean_body_length", "primary_cta", "thread_messages")

LATEST_ONLY, THREAD_HISTORY = "latest_only", "thread_history"
FAILFAST, PERMISSIVE, DROPMALFORMED = "FAILFAST", "PERMISSIVE", "DROPMALFORMED"
PARSE_FAILED = "Failed to parse email message"


class ParseError(ValueError):
    """A message without a single header."""


@dataclass
class PreprocessOptions:
    """max_body_length counts characters; 0 is no limit. A plan takes the values that hold when it is built."""

    strip_quotes: bool = True
    strip_signature: bool = True
    max_body_length: int = 0


def render_mode(value: str | int) -> str:
    """latest_only or thread_history from any spelling: LatestOnly, latestOnly, LATEST_ONLY, 0, 1."""
    if value in (0, 1):
        return (LATEST_ONLY, THREAD_HISTORY)[value]
    plain = str(value).replace("_", "").lower()
    for mode in (LATEST_ONLY, THREAD_HISTORY):
        if plain == mode.replace("_", ""):
            return mode
    raise ValueError(f"no such render mode: {value}")
