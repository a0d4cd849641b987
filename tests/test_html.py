import random

import pytest

from mailframe.operators import dom
from mailframe.operators.dom import parse
from mailframe.operators.html import jsonld, links, quotes
from mailframe.operators.markdown import to_markdown

MARKDOWN = [
    ("<p>Hello <b>world</b>!</p>", "Hello **world**!"),
    ("<style>x</style><p>Visible</p><script>alert(1)</script><svg><text>s</text></svg>", "Visible"),
    ("<p>Tom &amp; Jerry &mdash; x</p>", "Tom & Jerry — x"),
    ("<p>first</p><p>second", "first\n\nsecond"),
    ("<p>\n  <a href='https://x'>Unsubscribe</a>\n</p>", "[Unsubscribe]"),
    ("<a href='x'> </a>y", "y"),
    ("<ol><li>a<li>b</ol>", "1. a\n2. b"),
    ("<ol start=3><li>a</li></ol>", "3. a"),
    ("<ul><li>a</li><li>b</li></ul>", "* a\n* b"),
    ("<p>a</p><hr/><p>b</p>", "a\n\n* * *\n\nb"),
    ("one<br/>two", "one \ntwo"),
    ("one</br>two", "one \ntwo"),
    ("<table><tr><td><p>one</p></td><td>a | b</td></tr><tr><td></td></tr></table>", "one\n\na | b"),
    ("<div>- x</div><div>a*b_c[d]</div>", "\\- x\n\na\\*b\\_c\\[d\\]"),
    ("<h2>Head\nline</h2>text", "## Head line\n\ntext"),
    ("<em>a</em> <i> </i><code>c*d</code>", "*a* `c*d`"),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b".replace(">\n", "> \n")),
    ("<html><head><title>t</title></head><body>b</body></html>", "b"),
    ("<!--[if mso]><p>old</p><![endif]-->new", "new"),
    ("", ""),
]


@pytest.mark.parametrize(("html", "want"), MARKDOWN)
def test_markdown(html, want):
    assert to_markdown(parse(html)) == want


def test_links_in_cells_of_links_keep_the_outer_link():
    root = parse("<a href='1'><table><tr><td style='padding:1px;border:0'><a href='2'>in</a></td></tr></table></a><a href='3'>x<a href='4'>y</a></a>")
    found = links(root)
    assert [x["href"] for x in found] == ["1", "2", "3", "4"]
    assert [x["text"] for x in found] == ["in", "in", "x", "y"]
    assert found[1]["parent_tag"] == "td" and found[1]["parent_style"] == "padding:1px;border:0"


def test_link_flags():
    root = parse("<footer><p><a href=1>a</a></p></footer><div role=banner><a href=2>b</a></div><a href=3><img alt='Our Logo'></a><a href=4>d</a>")
    assert [(x["excluded"], x["logo"]) for x in links(root)] == [(True, False), (True, False), (False, True), (False, False)]


def test_jsonld_takes_string_targets_of_objects():
    make = lambda x, kind="application/ld+json": f'<script type="{kind}">{x}</script>'
    target = '{"name": "N", "potentialAction": {"target": "u"}}'
    html = make("{bad") + make(f"[{target}]") + make(target, "text/plain") + make('{"potentialAction": {"target": {"a": 1}}}') + make(target) + make('{"potentialAction": {"target": "v"}}')
    assert jsonld(parse(html)) == [{"url": "u", "text": "N"}, {"url": "v", "text": "View"}]


def test_quotes_find_their_attribution():
    html = "<div class='gmail_quote'><blockquote>inner first<blockquote>deep</blockquote></blockquote><div class='gmail_attr x'>late</div></div><div class=gmail_attr>near</div><p>x</p><blockquote>a<br>b &lt;i&gt;c</blockquote>"
    found = quotes(parse(html))
    assert [(q["attribution"], q["markdown"]) for q in found] == [("late", "inner first"), ("near", "a \n\nb *c*")]


def test_deep_nesting():
    assert to_markdown(parse("<div>" * 5000 + "x" + "</div>" * 5000)) == "x"


def test_emphasis_code_quotes_and_headings():
    md = lambda x: to_markdown(parse(x))
    assert md("<blockquote>a<br>b<blockquote><p>c</p><p>d</p></blockquote></blockquote>e") == "> a \n> b\n> \n> > c\n> > \n> > d\n\ne"
    assert md("<ul><li><blockquote>a<p>b</p></blockquote></li></ul>") == "* > a\n> \n> b"
    assert md("<h3>x <blockquote>y<p>z</p></blockquote></h3>") == "### x > y > > z"
    assert md("<em>a</em> <i>b</i> <strong>c</strong> <code>d  e</code>") == "*a* *b* **c** `d e`"
    assert md("<pre>x\n y</pre>") == "```\nx\ny\n```"
    assert md("<h1>a</h1><h6>b</h6>") == "# a\n\n###### b"
    assert md("a\ufdd00\ufdd1<blockquote>b</blockquote>") == "a0\n\n> b"
    assert md("<div>a</div>\n   <div>b</div>   c") == "a\n\nb\n\nc"


def test_deep_nesting_takes_linear_time():
    import time

    began = time.perf_counter()
    for deep in ("<blockquote>x" * 3000, "<div>" * 20_000 + "x", "<b><i>" * 10_000, "<table><tr><td>" * 3000 + "x", "<ul><li>" * 3000 + "x"):
        to_markdown(parse(deep))
    assert time.perf_counter() - began < 10


def test_a_broken_declaration_leaves_what_came_before():
    assert to_markdown(parse("<p>a</p><![bad[ <p>b</p>")).startswith("a")


def _shown(node):
    return node if isinstance(node, str) else f"<{node.tag}>{''.join(map(_shown, node.children))}</{node.tag}>"


@pytest.mark.parametrize(
    ("html", "tree"),
    [
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<p><b>A<p>B</p>", "<p><b>A</b></p><p><b>B</b></p>"),
        ("<p>1<s>2<b>3</p>4</s>5</b>", "<p>1<s>2<b>3</b></s></p><s><b>4</b></s><b>5</b>"),
        ("<a href=x><table><tr><td><a href=y>q</a></td></tr></table>t</a>", "<a><table><tr><td><a>q</a></td></tr></table>t</a>"),
        ("<a>1<a>2</a>", "<a>1</a><a>2</a>"),
        ("<a>1<div>2<div>3</a>4</div></div>", "<a>1</a><div><a>2</a><div><a>3</a>4</div></div>"),
        ("<b>1<i>2<p>3</b>4", "<b>1<i>2</i></b><i><p><b>3</b>4</p></i>"),
        ("<p><b><b><b><b><b>X<p>Y", "<p><b><b><b><b><b>X</b></b></b></b></b></p><p><b><b><b>Y</b></b></b></p>"),
    ],
)
def test_formatting_that_is_not_nested(html, tree):
    """The trees are those that the HTML standard gives for such mistakes."""
    assert "".join(map(_shown, dom.parse(html).children)) == tree


def test_random_tags_make_a_tree():
    choose = random.Random(1)
    tags = "a b i p div td table tr li ul font span br blockquote code object".split()

    def check(node):
        for child in node.children:
            if isinstance(child, dom.Node):
                assert child.parent is node
                check(child)

    for _ in range(500):
        check(dom.parse("".join(choose.choice(["<%s>", "</%s>", "x%s"]) % choose.choice(tags) for _ in range(25))))
