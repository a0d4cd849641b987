"""Text cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as invisible.
INVISIBLE_ENTITIES = ("&zwnj;", "&#x200c;", "&#8204;")
INVISIBLE = "͏​‌‍﻿­ "
NBSP = " "


def java(pattern: str, flags: str = "") -> str:
    """A pattern for the JVM's engine with \\n as the only line end and Unicode classes, as d and U set."""
    return f"(?dU{flags}){pattern}"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean_invisible(c: Column) -> Column:
    """Without invisible characters and the entities of some; no-break spaces become spaces."""
    for e in INVISIBLE_ENTITIES:
        c = F.replace(c, F.lit(e), F.lit(""))
    return F.translate(c, NBSP + INVISIBLE, " ")


def lines(c: Column) -> Column:
    """Lines without their ends, \\n or \\r\\n; a final line end opens no further line."""
    return let(F.split(c, "\r?\n", -1), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))


def trim(c: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(c, java(r"\A\s+|\s+\z"), "")


def trim_lines(c: Column) -> Column:
    """Each line without white space at its end, joined by \\n."""
    return F.array_join(F.transform(lines(c), lambda x: F.regexp_replace(x, java(r"\s+\z"), "")), "\n")


def collapse_newlines(c: Column) -> Column:
    """At most one empty line in a row."""
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def collapse_whitespace(c: Column) -> Column:
    """White space other than \\n to one space a run, then at most two \\n in a row."""
    return collapse_newlines(F.regexp_replace(c, java(r"[\s&&[^\n]]+"), " "))


def tidy(c: Column) -> Column:
    """The final cleaning of a body."""
    return collapse_newlines(trim_lines(trim(c)))


def truncate(c: Column, n: int) -> Column:
    """The first n characters; 0 is no limit."""
    return F.left(c, F.lit(n)) if n > 0 else c


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("long")
