"""Main text of web pages by scoring the tree of their elements.

Every block of running text passes points to the elements around it: one, one more for
each comma and up to three for its length, whole to its parent, half to the next, then a
third, a quarter and a fifth. An element's score is discounted by the share of its text
that lies in links. The element with the best score is the article; siblings that score
a fifth of it, and paragraphs between them with few links, are kept with it. What is
menu, header, footer, sidebar, notice, advert, form, script, style or reader comment, by
its tag, role, class or id, gives no points and no text. A class or id alone does not
remove what holds the strongest container, most of the page's points and a sign of an
article, nor all of a page's paragraphs. A list that is mostly links is left out unless a
heading below h1 leads it, as one does a list of sources.

Defined results: null, empty and text-free pages have an empty text; unclosed, crossed
and cut-off tags are taken as a browser would, and a tag that the page's end cuts off is
dropped; a line break is white space inside its block; repeated pages are extracted
each. Columns other than those read are left out, whatever their names. The whole page
is read, whatever its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements without end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and those that hold nothing to read.
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_DROPPED = frozenset(
    "script style textarea title xmp noembed noframes iframe head nav footer aside form button "
    "select option noscript template svg canvas object audio video dialog menu math".split()
)
#: Elements that run on inside a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that end an open element of the second set, inside an element of the third.
_CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split()
)
_SIBLING_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE = frozenset("article main".split())
_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split()
)
#: Words of a class or id that name what is not the article.
_AWAY = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored "
    "promo promotion banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar "
    "sidebars aside rail widget widgets footer header masthead topbar toolbar comment comments "
    "commentlist disqus respond replies reply discussion notice notices cookie cookies consent gdpr "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social related recommended recommendations trending popular pagination pager tags hidden "
    "skip toc outbrain taboola paywall form".split()
)
#: Of an article element, only these.
_REMARKS = frozenset("ad advert advertisement sponsored promo comment comments reply replies related".split())
#: Names like ``has-sidebar`` and ``article-header`` are about the article itself.
_STATES = frozenset("has with no without is".split())
_PIECES = frozenset("header body title text content".split())
_SUBJECTS = frozenset("article post entry story".split())
_NEAR = frozenset("article body content entry main page post story text".split())

# A value is in quotes or runs to the next white space; a quote anywhere else is a character.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*{_VALUE}?)*+)(>|$)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_READ = frozenset("class id role hidden aria-hidden".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Levels that get points from a block, with their shares.
_SHARES = (1.0, 1 / 2, 1 / 3, 1 / 4, 1 / 5)
#: Share of the best score that a kept sibling has, and link share of a kept paragraph.
SIBLING_SHARE, PARAGRAPH_LINKS = 0.2, 0.25
#: Points of an element for its name.
NAMED_POINTS = 25.0


class _Element:
    __slots__ = ("tag", "parent", "away", "points", "chars", "linked", "first", "last", "near", "named")

    def __init__(self, tag: str, parent: _Element | None, away: bool, near: bool, named: set[str], at: int) -> None:
        self.tag, self.parent, self.away, self.near, self.named = tag, parent, away, near, named
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.first, self.last = at, -1  # range of the blocks inside


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, set[str]]:
    """Whether an element is surely not the article, whether it may well be, and names against it."""
    away, near, named = tag in _DROPPED, False, set()
    if tag == "header":  # the header of an article holds its title
        away = not in_article
    if attributes and not away:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name not in _READ:
                continue
            value = "".join(values)
            if name == "role":
                away = away or value.strip().lower() in _ROLES
                near = near or value.strip().lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden":
                away = away or name == "hidden" or value.lower() == "true"
            elif tag not in ("html", "body"):
                for part in value.split():
                    words = {x.lower() for x in _WORDS.findall(part)}
                    against = words & (_REMARKS if tag in _ARTICLE else _AWAY)
                    if against and not (words & _STATES or words & _PIECES and words & _SUBJECTS):
                        named |= against
                    else:
                        near = near or bool(words & _NEAR)
    return away, near or tag in _ARTICLE and not named, named


class _Page:
    """The elements and text blocks of one page, in page order."""

    def __init__(self, source: str) -> None:
        self.root = _Element("", None, False, False, set(), 0)
        self.elements = [self.root]
        self.blocks: list[tuple[_Element, str, int]] = []
        self._at, self._text, self._link_text = self.root, [], 0
        self._opened: Counter = Counter()  # open elements by tag
        self._links = 0
        self._read(source)
        self._end_block()
        while self._at is not None:
            self._at.last = len(self.blocks)
            self._at = self._at.parent

    def _say(self, text: str) -> None:
        if text and not self._at.away:
            text = html.unescape(text)
            self._text.append(text)
            if self._links:
                self._link_text += len(" ".join(text.split()))

    def _end_block(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._at, text, min(self._link_text, len(text))))
            self._text = []
        self._link_text = 0

    def _close(self, element: _Element) -> None:
        """End ``element`` and all that is open in it."""
        self._end_block()
        while True:
            at = self._at
            at.last = len(self.blocks)
            self._at = at.parent
            self._opened[at.tag] -= 1
            if at is element:
                return

    def _open(self, tag: str, attributes: str) -> None:
        self._end_block()
        if tag in _CLOSES_P and self._at.tag == "p":
            self._close(self._at)
        elif tag in _SIBLING_ENDS and any(self._opened[x] for x in _SIBLING_ENDS[tag][0]):
            ends, within = _SIBLING_ENDS[tag]
            at, last = self._at, None
            while at is not None and at.tag not in within:
                if at.tag in ends:
                    last = at
                at = at.parent
            if last is not None:
                self._close(last)
        if tag in _VOID:
            return
        parent = self._at
        in_article = any(self._opened[x] for x in _ARTICLE)
        away, near, named = (True, False, set()) if parent.away else _marks(tag, attributes, in_article)
        self._at = _Element(tag, parent, away, near, named, len(self.blocks))
        self.elements.append(self._at)
        self._opened[tag] += 1

    def _end(self, tag: str) -> None:
        if self._opened[tag]:
            at = self._at
            while at.tag != tag:
                at = at.parent
            self._close(at)
        elif tag == "p":
            self._end_block()

    def _read(self, source: str) -> None:
        place = 0
        for found in _TOKEN.finditer(source):
            if found.start() < place:  # inside what is not markup
                continue
            self._say(source[place:found.start()])
            place = found.end()
            tag = (found[2] or "").lower()
            if not tag or not found[4]:
                continue  # no tag, or one that the page's end cuts off
            ending = bool(found[1])
            if tag in _RAW:
                if not ending:
                    close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, place)
                    place = close.start() if close else len(source)
            elif tag in _INLINE:
                if tag == "br":
                    self._say(" ")
                elif tag == "a":
                    self._links = max(0, self._links + (-1 if ending else 1))
            elif ending:
                self._end(tag)
            else:
                self._open(tag, found[3])
        self._say(source[place:])

    def score(self) -> None:
        """Points of the blocks to the elements around them, characters to all around."""
        for element in self.elements:
            element.points = NAMED_POINTS if element.near else 0.0
            element.chars = element.linked = 0
        for element, text, linked in self.blocks:
            element.chars += len(text)
            element.linked += linked
            if element.tag in _HEADINGS:
                continue
            points = self._block_points(text)
            at = element.parent if element.tag in ("p", "pre", "td", "li", "dd", "dt") and element.parent else element
            for share in _SHARES:
                at.points += points * share
                if at.parent is None:
                    break
                at = at.parent
        # Elements come after their parents, so the last ones are summed first.
        for element in reversed(self.elements[1:]):
            element.parent.chars += element.chars
            element.parent.linked += element.linked

    @staticmethod
    def _block_points(text: str) -> float:
        return 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)

    def _best(self) -> _Element:
        skipped = ("p", "li", "td", "tr", "dd", "dt", *_HEADINGS)
        candidates = [x for x in self.elements if x.chars and not x.away and x.tag not in skipped]
        return max(candidates, key=self._discounted, default=self.root)

    def _spared(self) -> set[int]:
        """Elements that a name is against, but which hold the article."""
        points = (0.0 if e.tag in _HEADINGS else self._block_points(t) for e, t, _ in self.blocks)
        so_far = [0.0, *accumulate(points)]
        spared, at = set(), self._best()
        while at is not None:
            if at.named and so_far[at.last] - so_far[at.first] > 0.5 * so_far[-1]:
                remark = at.named & _REMARKS
                inside = (x for x in self.elements if x.chars and at.first <= x.first and x.last <= at.last)
                if at.near or any(
                    x.tag == "h1" or x.near and (x.tag in _ARTICLE or not remark) for x in inside
                ):
                    spared.add(id(at))
            at = at.parent
        return spared

    def _drop_named(self) -> None:
        """Take away what names are against, unless it holds the article."""
        spared = self._spared()
        gone: set[int] = set()
        for element in self.elements:  # parents come first
            if id(element.parent) in gone or element.named and id(element) not in spared:
                gone.add(id(element))
        keep = [id(x[0]) not in gone for x in self.blocks]
        if not any(keep) and any(x[0].tag == "p" for x in self.blocks):
            return
        before = [0]
        for kept in keep:
            before.append(before[-1] + kept)
        self.blocks = [x for x, kept in zip(self.blocks, keep, strict=True) if kept]
        for element in self.elements:
            element.first, element.last = before[element.first], before[element.last]
            element.away = element.away or id(element) in gone
        self.score()

    @staticmethod
    def _discounted(element: _Element) -> float:
        return element.points * (1 - element.linked / element.chars) if element.chars else 0.0

    def main_blocks(self) -> list[str]:
        """Texts of the best element and its kept siblings, in page order."""
        if not self.blocks:
            return []
        self.score()
        if any(x.named for x in self.elements):
            self._drop_named()
        best = self._best()
        top = self._discounted(best)
        kept = [best]
        if best.parent is not None:
            for element in self.elements:
                if element.parent is best.parent and element is not best and element.chars:
                    few_links = element.linked <= PARAGRAPH_LINKS * element.chars
                    if few_links and (
                        element.tag in ("p", "pre", "blockquote", *_HEADINGS)
                        or self._discounted(element) >= SIBLING_SHARE * top
                    ):
                        kept.append(element)
        chosen = sorted({i for x in kept for i in range(x.first, x.last)})
        # Lists and the like that are mostly links are menus, wherever they stand.
        menus = self._link_lists(best)
        return [self.blocks[i][1] for i in chosen if id(self.blocks[i][0]) not in menus]

    def _link_lists(self, top: _Element) -> set[int]:
        """Elements in a container that is mostly links; below ``top`` only those inside it count."""
        judged: dict[int, bool] = {}  # by the outermost such container
        for element in self.elements:  # parents come first
            if element is top:
                continue
            if id(element.parent) in judged:
                judged[id(element)] = judged[id(element.parent)]
            elif element.tag in ("ul", "ol", "dl", "div", "section", "table") and element.linked > 0.5 * element.chars:
                led = self.blocks[max(element.first - 1, top.first):element.first + 1]
                judged[id(element)] = not any(x[0].tag in _HEADINGS and x[0].tag != "h1" for x in led)
        return {x for x, menu in judged.items() if menu}


def main_text(source: str | None) -> str:
    """The article of one page: a line for every block."""
    return "\n".join(_Page(source).main_blocks()) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            column = batch.column(2)
            texts = [main_text(column[row].as_py()) for row in range(len(column))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(
        batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )
