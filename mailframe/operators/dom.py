"""A small document tree for mail HTML, built on the standard tokenizer with the tree rules that mail depends on."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD_ONLY = frozenset("title meta link style script base noscript template".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements that an end or implied end of an inline element does not reach beyond.
_MARKERS = frozenset("td th caption table html button object applet marquee".split())
#: A start tag that ends open elements, and the elements where the search for them stops.
_IMPLIED = {
    "li": (("li",), frozenset(("ul", "ol", "table"))),
    "dt": (("dt", "dd"), frozenset(("dl", "table"))),
    "dd": (("dt", "dd"), frozenset(("dl", "table"))),
    "option": (("option",), frozenset(("select",))),
    "td": (("td", "th"), frozenset(("tr", "table"))),
    "th": (("td", "th"), frozenset(("tr", "table"))),
    "tr": (("tr",), frozenset(("table",))),
    "tbody": (("tbody", "thead", "tfoot"), frozenset(("table",))),
    "thead": (("tbody", "thead", "tfoot"), frozenset(("table",))),
    "tfoot": (("tbody", "thead", "tfoot"), frozenset(("table",))),
}
_TABLE_PARTS = frozenset("td th tr tbody thead tfoot table caption".split())
#: Inline elements that live on in later blocks until their own end tag; those between which and later ones a wall stands.
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_WALLS = frozenset("td th caption object applet marquee".split())
#: Blocks, in the sense that formatting does not reach around them, and start tags before which no formatting is opened anew.
_BLOCKS = _CLOSES_P | (frozenset(_IMPLIED) - {"option"}) | _HEAD_ONLY | frozenset("html head body caption colgroup col param source track textarea iframe".split())
#: Elements whose own text stands outside of any formatting.
_BARE = _HEAD_ONLY | frozenset("head html table tbody thead tfoot tr colgroup select textarea".split())
#: Equal formatting elements, and formatting elements at all, that are kept for later blocks.
MOST_ALIKE, MOST_ACTIVE = 3, 64


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "is_open")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.is_open = tag, attrs or {}, parent, False
        self.children: list[Node | str] = []

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def _detach(node: Node) -> None:
    if node.parent is not None:
        node.parent.children.remove(node)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        self.count: Counter = Counter()  # of open elements by tag, so that a look for one that isn't there costs nothing
        self.active: list[Node | None] = []  # formatting without an end tag so far; None is a wall

    def _find(self, tags, stops=frozenset()) -> int | None:
        """Place of the innermost open element among tags, unless a stop stands before it."""
        if not any(self.count[t] for t in tags):
            return None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in stops:
                return None
        return None

    def _close(self, tags, stops=frozenset()) -> bool:
        if (i := self._find(tags, stops)) is not None:
            self._cut(i)
        return i is not None

    def _cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.count[node.tag] -= 1
            node.is_open = False
            if node.tag in _WALLS and None in self.active:
                while self.active.pop() is not None:
                    pass
        del self.open[i:]

    def _push(self, node: Node, place: int | None = None) -> None:
        self.open.insert(len(self.open) if place is None else place, node)
        self.count[node.tag] += 1
        node.is_open = True

    def _scope(self) -> int:
        """Place in active behind the last wall."""
        return next((i + 1 for i in range(len(self.active) - 1, -1, -1) if self.active[i] is None), 0)

    def _reopen(self) -> None:
        """Open formatting anew that a block's end took along."""
        if not self.active or self.active[-1] is None or self.active[-1].is_open:
            return
        first = len(self.active)
        while first and (last := self.active[first - 1]) is not None and not last.is_open:
            first -= 1
        for i in range(first, len(self.active)):
            node = Node(self.active[i].tag, self.active[i].attrs)
            self.open[-1].append(node)
            self._push(node)
            self.active[i] = node

    def _activate(self, node: Node) -> None:
        start = self._scope()
        alike = [x for x in self.active[start:] if x.tag == node.tag and x.attrs == node.attrs]
        if len(alike) >= MOST_ALIKE:
            self.active.remove(alike[0])
        elif len(self.active) - start >= MOST_ACTIVE:
            del self.active[start]
        self.active.append(node)

    def _end_formatting(self, tag: str) -> None:
        """End the latest such element: directly, or, around blocks, by giving each its own copy of it."""
        for _ in range(8):
            node = next((x for x in reversed(self.active[self._scope() :]) if x.tag == tag), None)
            if node is None:
                self._close((tag,), _MARKERS | _BLOCKS)
                return
            if not node.is_open:
                self.active.remove(node)
                return
            at = self.open.index(node)
            if any(x.tag in _MARKERS for x in self.open[at:]):
                return
            block = next((x for x in self.open[at:] if x.tag in _BLOCKS), None)
            if block is None:
                self._cut(at)
                self.active.remove(node)
                return
            self._hand_down(node, at, block)

    def _hand_down(self, node: Node, at: int, block: Node) -> None:
        """Take block out of a formatting element (open at place at), and let a copy of the element hold what block held."""
        lowest, before = block, node  # the copy takes the place in active behind before
        for depth, inner in enumerate(self.open[self.open.index(block) - 1 : at : -1], 1):
            if depth > MOST_ALIKE and inner in self.active:
                self.active.remove(inner)
            if inner not in self.active:
                self.open.remove(inner)
                self.count[inner.tag] -= 1
                inner.is_open = False
                continue
            copy = Node(inner.tag, inner.attrs)
            copy.is_open, inner.is_open = True, False
            self.open[self.open.index(inner)] = self.active[self.active.index(inner)] = copy
            before = copy if lowest is block else before
            _detach(lowest)
            copy.append(lowest)
            lowest = copy
        _detach(lowest)
        self.open[at - 1].append(lowest)
        copy = Node(node.tag, node.attrs)
        copy.children, block.children = block.children, []
        for child in copy.children:
            if isinstance(child, Node):
                child.parent = copy
        block.append(copy)
        self.active.insert(self.active.index(before) + 1, copy)
        self.active.remove(node)
        self.open.remove(node)
        self.count[node.tag] -= 1
        node.is_open = False
        self._push(copy, self.open.index(block) + 1)

    def handle_starttag(self, tag, attrs):
        if tag not in _HEAD_ONLY and tag != "head":
            self._close(("head",))
        if tag in ("html", "body") and self._find((tag,)) is not None:
            return
        if tag in _CLOSES_P:
            self._close(("p",), _MARKERS)
        if tag in _IMPLIED:
            self._close(*_IMPLIED[tag])
        elif tag == "a" and (last := next((x for x in self.active[self._scope() :] if x.tag == "a"), None)) is not None:
            self._end_formatting("a")
            if last in self.active:
                self.active.remove(last)
            if last.is_open:
                self._cut(self.open.index(last))
        if self.active and tag not in _BLOCKS:
            self._reopen()
        node = Node(tag, {}, self.open[-1])
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)
        if tag in _FORMATTING:
            self._activate(node)
        elif tag in _WALLS:
            self.active.append(None)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "title", "textarea") and self.open[-1].tag == tag:
            self._cut(-1)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and self._find(("p",), _MARKERS) is None:
            self.handle_starttag("p", [])
            self._cut(-1)
        elif tag in _FORMATTING:
            self._end_formatting(tag)
        elif tag in _TABLE_PARTS:
            self._close((tag,), frozenset(("table",)) if tag != "table" else frozenset())
        elif tag not in VOID and tag not in ("html", "body"):
            self._close((tag,), _MARKERS - {tag})

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._cut(-1)
        if self.active and self.open[-1].tag not in _BARE:
            self._reopen()
        own = self.open[-1].children
        if own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except (AssertionError, ValueError):  # a broken declaration: what was built so far stands
        pass
    return builder.root
