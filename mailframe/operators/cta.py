"""The primary call to action: structured data first, then the best link by score, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailframe.functions.text import java, trim

# Patterns and scores.
BLACKLIST = r"unsubscribe|datenschutz|impressum|privacy|terms|abmelden"
BARE_HOMEPAGE = r"\Ahttps?://(www\.)?[^/]+/?\z"
BUTTON_CLASS = r"\b(btn|button|cta)\b"
ACTION = r"geht\s+es\s+zum|hier\s+klicken|mehr\s+erfahren|\b(view|read|open|see|check|reply|continue|go|access|confirm|download|get|start|register|subscribe|buy|order|shop|learn|discover|explore|join)\b"
ARIA_ACTION = r"\b(view|read|open|see|check|reply|continue|go|access|confirm)\b"
CENTERED = r"text-align:\s*center"
BIG_PADDING = r"padding:\s*\d{2,}"
BUTTON, KEYWORD, LONG_KEYWORD, PROMINENT, ARIA, LEAST = 30, 25, 40, 20, 15, 40


def _has(c: Column, pattern: str, flags: str = "i") -> Column:
    return F.coalesce(F.rlike(c, F.lit(java(pattern, flags))), F.lit(False))


def link_text(link: Column) -> Column:
    """The title if there is one, even an empty one; else the text."""
    return trim(F.coalesce(link["title"], link["text"]))


def eligible(link: Column, text: Column) -> Column:
    """Cheap tests first."""
    href = link["href"]
    return (
        (F.startswith(href, F.lit("http://")) | F.startswith(href, F.lit("https://")))
        & (text != "")
        & ~link["logo"]
        & ~link["excluded"]
        & ~_has(text, BLACKLIST)
        & ~_has(href, BLACKLIST)
        & ~_has(href, BARE_HOMEPAGE)
    )


def score(link: Column, text: Column) -> Column:
    style = F.coalesce(link["parent_style"], F.lit(""))
    styled = (link["parent_tag"] == "td") & F.contains(style, F.lit("padding")) & (F.contains(style, F.lit("background")) | F.contains(style, F.lit("border")))
    button = _has(link["class"], BUTTON_CLASS) | F.coalesce(link["role"] == "button", F.lit(False)) | F.coalesce(styled, F.lit(False))
    signals = _has(style, CENTERED).cast("int") + _has(style, BIG_PADDING).cast("int") + (F.octet_length(text) > 10).cast("int")
    keyword = F.when(_has(text, ACTION), F.when(F.octet_length(text) >= 20, KEYWORD + LONG_KEYWORD).otherwise(KEYWORD)).otherwise(0)
    return F.when(button, BUTTON).otherwise(0) + keyword + F.when(signals >= 2, PROMINENT).otherwise(0) + F.when(_has(link["aria_label"], ARIA_ACTION), ARIA).otherwise(0)


def confidence(points: Column) -> Column:
    return F.least(points / F.lit(100.0), F.lit(1.0))


def best_link(links: Column) -> Column:
    """The link of greatest score, the first of them at ties; null below the least score."""
    scored = F.transform(links, lambda x: F.struct(x["href"].alias("url"), link_text(x).alias("text"), F.when(eligible(x, link_text(x)), score(x, link_text(x))).otherwise(0).alias("points")))
    none = F.struct(F.lit("").alias("url"), F.lit("").alias("text"), F.lit(LEAST - 1).alias("points"))
    best = F.aggregate(scored, none, lambda a, x: F.when(x["points"] > a["points"], x).otherwise(a))
    return F.transform(F.array(best), lambda b: F.when(b["points"] >= LEAST, F.struct(b["url"].alias("url"), b["text"].alias("text"), confidence(b["points"]).alias("confidence"))))[0]


def primary_cta(html: Column) -> Column:
    """From the HTML function's output: struct<url, text, confidence>, null if there is none."""
    ld = F.get(html["jsonld"], F.lit(0))
    structured = F.when(ld.isNotNull(), F.struct(ld["url"].alias("url"), ld["text"].alias("text"), F.lit(1.0).alias("confidence")))
    return F.coalesce(structured, best_link(html["links"]))
