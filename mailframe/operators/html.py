"""Everything that needs a document tree, in one Arrow-batched function with one parse a message."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mailframe import schema
from mailframe.operators.dom import Node, parse
from mailframe.operators.markdown import to_markdown

FIELDS = ("markdown", "links", "jsonld", "quotes")
_QUOTE_CLASSES = ("gmail_quote", "gmail_quote_container")


def _ancestors(node: Node):
    while node.parent is not None and node.parent.tag != "#document":
        node = node.parent
        yield node


def _excluded(link: Node) -> bool:
    return any(a.tag in ("header", "footer") or a.attrs.get("role") in ("banner", "contentinfo") for a in _ancestors(link))


def _logo(link: Node) -> bool:
    alts = (n.attrs.get("alt", "").lower() for n in link.elements() if n.tag == "img")
    return any("logo" in a or "brand" in a for a in alts)


def links(root: Node) -> list[dict]:
    """Every link with a target, in document order, with what scoring looks at."""
    out = []
    for n in root.elements():
        if n.tag == "a" and "href" in n.attrs:
            parent = n.parent if n.parent is not None and n.parent.tag != "#document" else None
            out.append({
                "href": n.attrs["href"], "title": n.attrs.get("title"), "text": n.text(), "class": n.attrs.get("class"), "role": n.attrs.get("role"), "aria_label": n.attrs.get("aria-label"),
                "parent_tag": parent.tag if parent else None, "parent_style": parent.attrs.get("style") if parent else None, "logo": _logo(n), "excluded": _excluded(n),
            })
    return out


def _not_json(value: str):
    raise ValueError(value)


def jsonld(root: Node) -> list[dict]:
    """Target and name of every structured action whose target is a string."""
    out = []
    for n in root.elements():
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                data = json.loads(n.text(), parse_constant=_not_json)
            except (ValueError, RecursionError):
                continue
            action = data.get("potentialAction") if isinstance(data, dict) else None
            target = action.get("target") if isinstance(action, dict) else None
            if isinstance(target, str):
                out.append({"url": target, "text": data["name"] if isinstance(data.get("name"), str) else "View"})
    return out


def _attribution(quote: Node) -> str | None:
    """Text of the nearest attribution before the quote, else of the first in the container around it."""
    around = quote.parent.children
    at = next(i for i, c in enumerate(around) if c is quote)
    for c in reversed(around[:at]):
        if isinstance(c, Node) and "gmail_attr" in c.classes():
            return c.text()
    if any(k in quote.parent.classes() for k in _QUOTE_CLASSES):
        for c in around:
            if isinstance(c, Node) and "gmail_attr" in c.classes():
                return c.text()
    return None


def _left_out(node: Node) -> bool:
    return node.tag == "blockquote" or node.tag == "div" and any(k in ("gmail_signature", *_QUOTE_CLASSES) for k in node.classes())


def _source(node: Node | str, out: list[str]) -> None:
    """Markup as the quote's body is read again: nothing is escaped and every element has an end tag."""
    todo: list[Node | str] = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif not _left_out(n):
            out.append("<" + n.tag + "".join(f' {k}="{v}"' for k, v in n.attrs.items()) + ">")
            todo.append(_End(n.tag))
            todo += reversed(n.children)


class _End(str):
    """An end tag on the list of things to write."""

    def __new__(cls, tag: str):
        return super().__new__(cls, f"</{tag}>")


def quotes(root: Node) -> list[dict]:
    """Attribution and Markdown of what each block quote itself says, outer ones first."""
    out = []
    for n in root.elements():
        if n.tag != "blockquote":
            continue
        attribution = _attribution(n)
        if attribution is None:
            continue
        source: list[str] = []
        for c in n.children:
            _source(c, source)
        direct = "".join(source)
        if direct.strip():
            out.append({"attribution": attribution, "markdown": to_markdown(parse(direct))})
    return out


def read(html: str | None, fields: tuple[str, ...]) -> dict | None:
    if html is None:
        return None
    root = parse(html)
    make = {"markdown": to_markdown, "links": links, "jsonld": jsonld, "quotes": quotes}
    return {f: make[f](root) if f in fields else None for f in FIELDS}


def read_all(v, fields: tuple[str, ...] = FIELDS):
    return pa.array([read(x, fields) for x in v.to_pylist()], to_arrow_type(schema.HTML))


def _arrow(v: pa.Array) -> pa.Array:
    return read_all(v)


def read_html(html: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """struct of schema.HTML; fields that are not asked for are null and cost nothing."""

    def run(v: pa.Array) -> pa.Array:
        return read_all(v, fields)

    # not deterministic as far as the optimizer knows, lest it repeats the function in each filter and projection above
    return F.arrow_udf(run, schema.HTML).asNondeterministic()(html)


