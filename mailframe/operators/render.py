"""A record as plain text for a prompt, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailframe.schema import LATEST_ONLY, THREAD_HISTORY, render_mode


def address(a: Column) -> Column:
    return F.when(a["name"].isNull(), a["email"]).otherwise(F.concat(a["name"], F.lit(" <"), a["email"], F.lit(">")))


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{label}: "), value))


def to_llm_context(record: Column | None = None, mode: str | int = LATEST_ONLY) -> Column:
    """Header lines that the record has, CONTENT with the body, and the thread history where asked for.

    record: a struct column, or None for top-level columns.
    """
    at = (lambda c: record[c]) if record is not None else (lambda c: F.col(f"`{c}`"))
    to = F.when(F.size(at("to")) > 0, F.array_join(F.transform(at("to"), address), ", "))
    head = [_line("FROM", F.when(at("from").isNotNull(), address(at("from")))), _line("TO", to), _line("SUBJECT", at("subject")), _line("DATE", at("date"))]
    parts = [*head, F.lit("CONTENT:"), at("body")]
    if render_mode(mode) == THREAD_HISTORY:
        message = lambda m: F.concat(F.lit("["), F.coalesce(m["timestamp"], F.lit("?")), F.lit("] "), m["sender"], F.lit("\n"), m["body"])
        history = F.array_join(F.transform(at("thread_messages"), message), "\n\n---\n\n")
        parts.append(F.when(F.size(at("thread_messages")) > 0, F.concat(F.lit("\n---\n\nTHREAD HISTORY:\n\n"), history)))
    return F.concat_ws("\n", *parts)
