"""Removal of quoted replies as a column expression."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailframe.functions.text import java, let, lines, trim

# What opens a quoted reply. The last needs two quoted lines, however many follow.
QUOTE_HEADERS = (
    r"^On .{10,80} wrote:\s*$",
    r"^-{2,}\s*Original Message\s*-{2,}\s*$",
    r"^From:\s+.+\nSent:\s+",
    r"^On .{10,80}, at .{4,20}, .{1,60} wrote:\s*$",
    r"^Am .{10,80} schrieb .{1,60}:\s*$",
    r"^Le .{10,80} a écrit\s*:\s*$",
    r"^El .{10,80} escribi[óo]\s*:\s*$",
    r"^.{10,120} wrote:\s*$",
    r"^\s*\n(?:>\s?.+\n){2}",
)
#: The leftmost match of any is the leftmost match of all.
#: Each header holds one of these, so a body without any needs no pattern.
HINTS = ("wrote:", "Original Message", "Sent:", "schrieb ", "écrit", "escribi", "\n>")
ANY_HEADER = java("(?:" + "|".join(QUOTE_HEADERS) + ")", "m")


def _bottom_posted(body: Column) -> Column:
    """Of a body that opens with a quote: its first stretch of lines that are not quoted."""

    def stretch(ls: Column) -> Column:
        rest = F.filter(ls, lambda x, i: i >= _first(ls, lambda y: ~F.startswith(y, F.lit(">")) & (trim(y) != "")))
        return let(rest, lambda r: F.filter(r, lambda x, i: i < F.coalesce(_first(r, lambda y: F.startswith(y, F.lit(">"))), F.size(r))))

    return let(lines(body), lambda ls: F.array_join(stretch(ls), "\n"))


def _first(items: Column, test) -> Column:
    """Index from 0 of the first item that passes, else null."""
    marked = F.transform(items, lambda x: test(x))
    at = F.array_position(marked, F.lit(True))
    return F.when(at > 0, at - 1)


def strip_quotes(body: Column) -> Column:
    """The body before the first header of a quoted reply."""
    cut = let(
        F.split(body, ANY_HEADER, 2),
        lambda parts: F.when(F.size(parts) == 1, body).when(F.get(parts, F.lit(0)) != "", F.get(parts, F.lit(0))).otherwise(F.coalesce(_bottom_posted(body), F.lit(""))),
    )
    return F.when(reduce(or_, (F.contains(body, F.lit(h)) for h in HINTS)), cut).otherwise(body)
