"""Main text of small pages whose article is known, and of all pages of the table."""

import html
import re

import pytest

import __spark_entry__ as entry
from orbitrank.llm.main_text import main_text

PAGES = [
    ("<p>a</p>", "a"),
    ("no tags &amp; all", "no tags & all"),
    ("<ul><li>one<li>two</ul>", "one\ntwo"),
    ("<table><tr><td>a<td>b</table>", "a\nb"),
    ("<p>x<br>y\n\t z&nbsp;w</p>", "x y z w"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<article><p>a<script>var x='</p>'</script>b</p><!-- c --><style>p{}</style></article>", "ab"),
    ("<article><p title='a>b'>q</p></article>", "q"),
    ("<article><h1>T</h1><p><b>bold.<br><p>next</article><footer>f</footer>", "T\nbold.\nnext"),
    ("<article><p>whole</p><p>cut of &am", "whole\ncut of &am"),
    ("<article><p>whole</p><p cl", "whole"),
    ("<header>H</header><main><header><h1>T</h1></header><p>Text</p><aside>no</aside></main><footer>f</footer>",
     "T\nText"),
    ("<div id=sidebar>x</div><div id=content><h1>T</h1><p>Hello, <a href=x>w</a> all.<p>Second</div>"
     "<div class='comments'><p>c1, c2, c3, a comment that is long enough to win</p></div>", "T\nHello, w all.\nSecond"),
    ("<article><p>Body, of it all.</p></article><section id=comments><article class='comment'><p>I, for one, think"
     "</p></article></section>", "Body, of it all."),
    ("<div class='layout has-sidebar'><div class='article-header'><h1>T</h1></div><div class='post-body'>"
     "<p>x, y and z are here</p><p>More text.</p><div class='ad-slot'>Buy</div></div><div class='sidebar'>"
     "<p>side, side, side, side</p></div></div>", "T\nx, y and z are here\nMore text."),
    ("<body><div class='cookie-banner'><p>We use cookies, for you, and all.</p></div><div><p>Real text here, one."
     "</p><p>Real text two.</p></div><form><p>mail, me, now</p></form><div role='complementary'>no</div></body>",
     "Real text here, one.\nReal text two."),
    ("<div>" * 3_000 + "deep" + "</div>" * 3_000, "deep"),
    ("<nav><a href=x>only</a></nav>", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_small_pages(page, text):
    assert main_text(page) == text


def test_all_pages_of_the_table(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = entry.queries()["op3_html_main_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", body))
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts)
        assert r["text"] == "\n".join(x for x in lines if x)
        assert r["n_chars"] == len(r["text"])


SIBLINGS = [
    ("<article><p class='lead'>The lead, in short.</p><div class='article-body'><p>The body, of it all, is here.</p>"
     "<p>It goes on.</p></div></article>", "The lead, in short.\nThe body, of it all, is here.\nIt goes on."),
    ("<div><section class='content'><p>Part one, of two, is here.</p></section><section class='content'>"
     "<p>Part two, the rest.</p></section></div><div class='comments'><p>I, for one, think so.</p></div>",
     "Part one, of two, is here.\nPart two, the rest."),
    ("<main><article><p>Part one, of two, is here.</p></article><article><p>Part two, the rest.</p></article></main>",
     "Part one, of two, is here.\nPart two, the rest."),
]


@pytest.mark.parametrize("page, text", SIBLINGS)
def test_siblings_of_named_containers_are_kept(page, text):
    assert main_text(page) == text


WRAPPED = "<h1>T</h1><p>The text, of it all, is here.</p><p>It goes on.</p>"
LINES = "T\nThe text, of it all, is here.\nIt goes on."
NAMES = ["layout sidebar-right", "post comments-open", "content share-enabled", "post tag-popular category-social"]


@pytest.mark.parametrize("name", NAMES)
def test_a_wrapper_is_not_removed_for_its_name(name):
    assert main_text(f"<div class='{name}'><article>{WRAPPED}</article></div>") == LINES
    assert main_text(
        f"<div class='{name}'><div class='content'>{WRAPPED}</div><div class='comments'><p>I, for one.</p></div></div>"
    ) == LINES
    assert main_text(f"<div class='{name}'><p>Alone, and plain.</p></div>") == "Alone, and plain."


def test_long_remarks_are_still_removed():
    remarks = "<p>I, for one, and he, for two, think so, too.</p>" * 9
    for inner in (remarks, f"<div class='body'>{remarks}</div>", f"<article class='comment'>{remarks}</article>"):
        assert main_text(f"<div>{WRAPPED}</div><div class='comments'>{inner}</div>") == LINES


def test_a_list_of_sources_stays():
    links = "<ul><li><a href=x>Source one</a></li><li><a href=y>Source two</a></li></ul>"
    assert main_text(f"<article>{WRAPPED}<h2>Sources</h2>{links}</article>") == f"{LINES}\nSources\nSource one\nSource two"
    assert main_text(f"<article>{links}{WRAPPED}</article>") == LINES


ATTRIBUTES = [
    "style=\"overflow:hidden\"", "title=\"The hidden valley\"", "data-hidden=\"false\"", "data-href=\"/hidden/path\"",
    "onclick=\"hidden()\"", "alt=don't", "data-x='class=\"ad\"'", "data-class=ad", "data-role=navigation",
    "title = \"a > b\"", "x=\"'\" y='\"'", "aria-hidden=false", "a=b\"c", "/", "a b c=d/e", "= x",
]


@pytest.mark.parametrize("tag", ["div", "article", "main"])
@pytest.mark.parametrize("attribute", ATTRIBUTES)
def test_attributes_that_hide_nothing(tag, attribute):
    assert main_text(f"<{tag} {attribute}>{WRAPPED}</{tag}>") == LINES
    assert main_text(f"<{tag}>{WRAPPED}<p {attribute}>It's the end.</p></{tag}>") == f"{LINES}\nIt's the end."


@pytest.mark.parametrize("attribute", [
    "hidden", "HIDDEN=''", "hidden=hidden", "a='x' hidden", "aria-hidden=\"true\"", "role = navigation", "x=y'z role='menu'",
])
def test_attributes_that_hide(attribute):
    assert main_text(f"<article>{WRAPPED}<div {attribute}><p>Away, with this.</p></div></article>") == LINES


@pytest.mark.parametrize("unit", [
    "<div><p>x, y</p>", "<div><p>x</p></section>", "<div><li>x", "<header><p>x</p>", "<div class='layout ad'><p>x, y</p>",
    "<ul><li><a href=x>x</a>",
])
def test_deep_pages_take_linear_time(unit):
    import time

    def seconds(levels):
        started = time.perf_counter()
        main_text(unit * levels)
        return time.perf_counter() - started

    seconds(500)
    assert seconds(8_000) < 2.0  # a quadratic way takes ten


def _tree(draw, depth=0):
    """A random element: tag and children, which are elements or (text, characters in links)."""
    if depth == 4 or draw.random() < 0.35:
        words = draw.choices(["plain", "word,", "long" * 9, "x,"], k=draw.randint(1, 40))
        linked = draw.choice([0, 0, 0, 1]) * draw.randint(0, len(words))
        text = " ".join(words)
        link = " ".join(words[:linked])
        return ("p", (text, link))
    return ("div", [_tree(draw, depth + 1) for _ in range(draw.randint(1, 5))])


def _html(node):
    tag, inner = node
    if tag == "p":
        text, link = inner
        return f"<p><a href=x>{link}</a>{text[len(link):]}</p>" if link else f"<p>{text}</p>"
    return f"<div>{''.join(map(_html, inner))}</div>"


def _plain_article(tree):
    """Lines of the best container and of its siblings, from the rules alone."""
    nodes = []  # tag, parent, children or text, in page order

    def walk(node, parent):
        me = len(nodes)
        nodes.append((node[0], parent, node[1] if node[0] == "p" else None))
        for child in node[1] if node[0] == "div" else []:
            walk(child, me)

    nodes.append(("", None, None))
    walk(tree, 0)

    def up(i):
        while i is not None:
            yield i
            i = nodes[i][1]

    leaves = [i for i, n in enumerate(nodes) if n[0] == "p"]
    points, chars, linked = ([0.0] * len(nodes) for _ in range(3))
    for i in leaves:
        text, link = nodes[i][2]
        for at in up(i):
            chars[at] += len(text)
            linked[at] += len(link)
        own = 1 + text.count(",") + min(len(text) / 100, 3.0)
        for at, share in zip(up(nodes[i][1]), (1, 1 / 2, 1 / 3, 1 / 4, 1 / 5), strict=False):
            points[at] += own * share
    score = [p * (1 - k / c) if c else 0.0 for p, k, c in zip(points, linked, chars, strict=True)]
    best = max((i for i, n in enumerate(nodes) if n[0] != "p" and chars[i]), key=lambda i: (score[i], -i))
    kept = {best} | {
        i for i, n in enumerate(nodes) if n[1] == nodes[best][1] and i != best and best
        and linked[i] <= 0.25 * chars[i] and (n[0] == "p" or score[i] >= 0.2 * score[best])
    }
    lines = []
    for i in leaves:
        path = list(up(i))
        inside = path[:path.index(best)] if best in path else path
        menu = [x for x in inside if nodes[x][0] == "div" and linked[x] > 0.5 * chars[x]]
        if kept & set(path) and not menu:
            lines.append(nodes[i][2][0])
    return "\n".join(lines)


@pytest.mark.parametrize("seed", range(60))
def test_scores_against_the_rules_alone(seed):
    import random

    tree = ("div", [_tree(random.Random(seed), 1) for _ in range(4)])
    assert main_text(_html(tree)) == _plain_article(tree)
