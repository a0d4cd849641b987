"""Markdown of a document tree, made compact for prompts: links lose their targets, layout tables their cells' borders."""

from __future__ import annotations

import re

from mailframe.operators.dom import Node

# What is left out, what is a paragraph of its own, and what is escaped.
SKIP = frozenset("script style img head svg title template noscript".split())
BLOCKS = frozenset("div p ul ol section article aside main nav header footer body html center form fieldset figure figcaption address dl dt dd details summary td th".split())
TRANSPARENT = frozenset("table thead tbody tfoot tr".split())
_SPACE = re.compile(r"[ \t\r\n\f]+")
_INNER = re.compile(r"[\\*_`\[\]]")
_LEADING = re.compile(r"\A(\s*)([-+>=#~])")
_AFTER_NEWLINE = re.compile(r"\n +")
_OTHER_SPACE = re.compile(r"[^\S\n]+")
_NEWLINES = re.compile(r"\n{3,}")
_TRIM = " \n"
#: Marks around the number of a finished quote in the text around it; they are no characters, and go from texts.
_MARK, _END = "\ufdd0", "\ufdd1"
_QUOTE = re.compile(f"{_MARK}([0-9]+){_END}")


def _escape(text: str) -> str:
    if _MARK in text or _END in text:
        text = text.replace(_MARK, "").replace(_END, "")
    return _LEADING.sub(r"\1\\\2", _INNER.sub(lambda m: "\\" + m[0], text))


def _block(inner: str) -> str:
    inner = inner.strip(_TRIM)
    return f"\n\n{inner}\n\n" if inner else ""


def _inline(mark: str, inner: str) -> str:
    inner = inner.strip()
    return f"{mark}{inner}{mark}" if inner else ""


def _list(node: Node, inner: dict[int, str]) -> str:
    items, number = [], int(node.attrs["start"]) if node.attrs.get("start", "").isascii() and node.attrs.get("start", "").isdigit() else 1
    for c in node.children:
        text = inner[id(c)].strip(_TRIM) if isinstance(c, Node) else inner.get(id(c), "")
        if not isinstance(c, Node):
            continue
        if c.tag == "li":
            items.append(f"{number}. {text}" if node.tag == "ol" else f"* {text}")
            number += 1
        elif text:
            items.append(text)
    return _block("\n".join(items))


def _unfold(text: str, quotes: list[str]) -> str:
    """text with the quotes it holds, each line's marks written once; as long as what it gives."""
    out: list[str] = []
    todo: list[tuple[str, int]] = [(text, 0)]
    while todo:
        text, depth = todo.pop()
        m = _QUOTE.search(text)
        before = text[: m.start()] if m else text
        out.append(before.replace("\n", "\n" + "> " * depth))
        if m:
            todo.append((text[m.end() :], depth))
            out.append("> ")
            todo.append((quotes[int(m[1])], depth + 1))
    return "".join(out)


def _render(node: Node, inner: str, parts: dict[int, str], quotes: list[str]) -> str:
    tag = node.tag
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag in ("b", "strong"):
        return _inline("**", inner)
    if tag in ("i", "em"):
        return _inline("*", inner)
    if tag == "code" and not (node.parent and node.parent.tag == "pre"):
        return _inline("`", node.text())
    if tag == "pre":
        text = node.text().strip("\n")
        return f"\n\n```\n{text}\n```\n\n" if text.strip() else ""
    if tag == "a":
        inner = inner.strip()
        return f"[{inner}]" if inner else ""
    if tag in ("ul", "ol"):
        return _list(node, parts)
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        inner = " ".join(_unfold(inner, quotes).split())
        return _block(f"{'#' * int(tag[1])} {inner}") if inner else ""
    if tag == "blockquote":
        inner = _NEWLINES.sub("\n\n", _AFTER_NEWLINE.sub("\n", inner.strip(_TRIM)))
        if not inner:
            return ""
        quotes.append(_OTHER_SPACE.sub(" ", inner))
        return _block(f"{_MARK}{len(quotes) - 1}{_END}")
    if tag in ("td", "th"):
        inner = inner.strip()
        return f"\n\n{inner}\n\n" if inner else ""
    if tag == "li" or tag in BLOCKS:
        return _block(inner)
    return inner


def to_markdown(root: Node) -> str:
    """Children before parents, without recursion, as mail nests deeply."""
    done: dict[int, str] = {}
    quotes: list[str] = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if node.tag in SKIP:
            done[id(node)] = ""
        elif ready:
            inner = "".join(done[id(c)] if isinstance(c, Node) else _escape(_SPACE.sub(" ", c)) for c in node.children)
            done[id(node)] = _render(node, inner, done, quotes)
            if node.tag not in ("ul", "ol"):
                for c in node.children:
                    done.pop(id(c), None) if isinstance(c, Node) and node is not root else None
        else:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node)]
    text = _AFTER_NEWLINE.sub("\n", done[id(root)]).strip()
    text = _NEWLINES.sub("\n\n", _OTHER_SPACE.sub(" ", text))
    return _unfold(text, quotes) if quotes else text
