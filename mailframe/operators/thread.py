"""Thread history from the quotes of an HTML message, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailframe.functions.text import java, let, tidy, trim
from mailframe.operators.signature import extract_signature

# Attribution lines (day, month, year, hour, minute, sender) and month names.
ATTRIBUTIONS = (
    r"Am\s+.+?(\d{1,2})\.\s*(\w+)\.?\s+(\d{4})\s+um\s+(\d{1,2}):(\d{2})\s*Uhr\s+schrieb\s+(.+?):",
    r"On\s+\w+,\s+(\d{1,2})\s+(\w+)\s+(\d{4})\s+at\s+(\d{1,2}):(\d{2}),\s*(.+?)\s+wrote:",
    r"Le\s+.+?(\d{1,2})\s+(\w+)\.?\s+(\d{4})\s+à\s+(\d{1,2}):(\d{2}),?\s*(.+?)\s+a\s+écrit\s*:",
    r"El\s+.+?(\d{1,2})\s+de\s+(\w+)\.?\s+de\s+(\d{4})\s+a\s+las\s+(\d{1,2}):(\d{2}),?\s*(.+?)\s+escribió\s*:",
)
MONTHS = (
    "jan january januar janvier enero",
    "feb february februar février febrero",
    "mar march märz mär mars marzo",
    "apr april avril abril",
    "may mai mayo",
    "jun june juni juin junio",
    "jul july juli juillet julio",
    "aug august août agosto",
    "sep september septembre septiembre",
    "oct october okt oktober octobre octubre",
    "nov november novembre noviembre",
    "dec december dez dezember décembre diciembre",
)


def sender(raw: Column) -> Column:
    """Trimmed, with the entities of <, > and & decoded in this order."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")), trim(raw))


def _month(name: Column) -> Column:
    numbers = F.create_map(*(F.lit(x) for i, names in enumerate(MONTHS, 1) for n in names.split() for x in (n, f"{i:02d}")))
    return F.try_element_at(numbers, F.lower(name))


def _timestamp(part) -> Column:
    digits = lambda c, n: F.lpad(c, n, "0")
    ascii_ = F.rlike(F.concat(part(1), part(3), part(4), part(5)), F.lit("\\A[0-9]+\\z"))
    day = F.concat(part(3), F.lit("-"), _month(part(2)), F.lit("-"), digits(part(1), 2))
    return F.when(ascii_, F.concat(day, F.lit("T"), digits(part(4), 2), F.lit(":"), part(5), F.lit(":00")))


def parse_attribution(text: Column) -> Column:
    """struct<sender, timestamp> of an attribution line; dates are not validated."""
    out = F.struct(sender(F.regexp_replace(trim(text), ":+\\z", "")).alias("sender"), F.lit(None).cast("string").alias("timestamp"))
    for p in reversed(ATTRIBUTIONS):
        p = java(p)
        part = lambda i, p=p: F.regexp_extract(text, p, i)
        out = F.when(F.rlike(text, F.lit(p)), F.struct(sender(part(6)).alias("sender"), _timestamp(part).alias("timestamp"))).otherwise(out)
    return out


def thread_messages(quotes: Column) -> Column:
    """array<struct<sender, timestamp, body>>, oldest first: one for each quote with a body of its own."""

    def message(q: Column) -> Column:
        body = trim(tidy(extract_signature(q["markdown"])["text"]))
        return let(parse_attribution(q["attribution"]), lambda a: F.struct(a["sender"].alias("sender"), a["timestamp"].alias("timestamp"), body.alias("body")))

    some = F.filter(F.transform(quotes, message), lambda m: m["body"] != "")
    first = let(some, lambda ms: F.filter(ms, lambda m, i: F.array_position(F.transform(ms, lambda x: x["body"]), m["body"]) == i + 1))
    return F.reverse(first)
