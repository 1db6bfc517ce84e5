"""Main text of web pages by scoring the tree of elements.

A page is read once into elements and blocks (runs of text between block-level tags). Blocks in menus, headers, footers, side
bars, notices, adverts, forms, scripts, styles and reader comments are left out. Each remaining block of ``LEAST_CHARS`` or more passes points for its length and its
commas to the elements around it: all to the nearest container, half to the next, less above. Scores are discounted by the
share of text in links. Words in class or id only make an element suspect: it is left out, unless it holds most of the text of the page and little stands outside
suspect elements. The best container is kept, up to the article or main element it stands in, with what stands beside it or beside the elements around
it, holds few links, and holds paragraphs or headings or scores well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_CHARS = 25
SIBLING_SHARE = 0.2
#: What stands beside the best container and has this share of its text in links, or more, is a list of links.
LINK_SHARE = 0.25
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s>/]*+)[^>]*>|<([a-zA-Z][^\s>/]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s>/]*+)([^>]*)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noframes", "noembed")}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_COMMAS = re.compile("[,،、，]")
#: Fixed values of HTML: elements that end a block, have no content, or end an open paragraph or item.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset(("table", "ul", "ol", "dl", "td", "th", "select", "body", "html", "article", "section", "main", "div", "aside", "footer", "header", "nav"))
#: Elements, roles and words in class or id that mark what is no part of an article.
DROPPED = frozenset("script style noscript template nav aside footer form button select input textarea iframe svg math object applet canvas audio video dialog head title menu option datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion comment comments commentlist disqus replies reply respond menu menus nav navbar navigation breadcrumb breadcrumbs sidebar "
    "sidebars aside footer foot masthead topbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login pagination pager toolbar skiplink social sharing".split()
)
#: A class that holds one of these tells a state ("no-sidebar", "comments-open") and marks nothing; one with a word of the second list and an article word is a frame.
STATES = frozenset("no has have with without hide hides show shows is not open opened closed enabled disabled on off supports".split())
FRAMES = frozenset("wrap wrapper wrapped container inner outer holder layout grid row columns".split())
#: A suspect element is no longer one with more than this share of the text, if all that stands outside suspect elements is less than the second share of its text.
MOST, LITTLE = 0.5, 0.25
#: These count only where no word of the second list stands beside them.
PERHAPS = frozenset("header banner notice notices alert warning share related recommended recommendations widget widgets search form hidden rail meta tags".split())
ARTICLE_WORDS = frozenset("article content post entry main story body text page".split())
CONTAINERS = frozenset(("article", "main"))
PARAGRAPHS = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary".split())


def _marked(value: str) -> bool:
    """Whether a class or id says that the element is no part of an article."""
    words: set[str] = set()
    for name in value.split():
        own = {w.lower() for w in _WORD.findall(name)}
        if not (own & STATES or (own & FRAMES and own & ARTICLE_WORDS)):
            words |= own
    return bool(words & NEVER) or bool(words & PERHAPS and not words & ARTICLE_WORDS)


def _unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is left out for what it is, and whether its class or id makes it suspect."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True, False
    if not attributes or tag in ("html", "body", "main"):
        return False, False
    named = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            named.append(value)
        elif (
            (name == "role" and value.lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true")
            or (name == "style" and "display:none" in value.replace(" ", "").lower())
        ):
            return True, False
    return False, _marked(" ".join(named))


class Page:
    """Elements (parent, tag, whether dropped) and blocks (element, text, characters in links) of a page."""

    def __init__(self, source: str, forms: bool = False):
        self.parent, self.tag, self.dropped, self.suspect = [-1], ["html"], [False], [False]
        self._links, self._articles = [0], [0]  # open links and article containers at each element
        self._open: Counter[str] = Counter()
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._linked = 0
        stack = [0]  # open elements
        at = 0
        while True:
            found = _TAG.search(source, at)
            if not self.dropped[stack[-1]]:
                text = source[at : found.start() if found else len(source)]
                if text:
                    text = html.unescape(text) if "&" in text else text
                    self._text.append(text)
                    if self._links[stack[-1]]:
                        self._linked += len(text)
            if not found:
                break
            at = found.end()
            end, tag, attributes = found[1], found[2] or found[4], found[3] or found[5] or ""
            if tag:
                tag = tag.lower()
                if tag == "br":
                    self._text.append(" ")
                if tag in BLOCK:
                    self._flush(stack[-1])
                    if tag not in ("option", "optgroup"):
                        self._close(stack, ("p",))
                    if tag in ENDS:
                        self._close(stack, ENDS[tag])
                if tag in VOID:
                    continue
                above = stack[-1]
                drop, suspect = _unwanted(tag, attributes, self._articles[above] > 0) if not self.dropped[above] else (True, False)
                drop = drop and not (forms and tag == "form" and not self.dropped[above])
                if not attributes.endswith("/") or tag in BLOCK or tag in _RAW:
                    self.parent.append(above)
                    self.tag.append(tag)
                    self.dropped.append(drop)
                    self.suspect.append(suspect)
                    self._links.append(self._links[above] + (tag == "a"))
                    self._articles.append(self._articles[above] + (tag in CONTAINERS))
                    self._open[tag] += 1
                    stack.append(len(self.tag) - 1)
                if tag in _RAW:
                    close = _RAW[tag].search(source, at)
                    at = close.end() if close else len(source)
                    self._open[tag] -= 1
                    stack.pop()
            elif end:
                end = end.lower()
                if end in BLOCK:
                    self._flush(stack[-1])
                self._close(stack, (end,))
        self._flush(stack[-1])

    def _close(self, stack: list[int], tags: tuple[str, ...]) -> None:
        """End the innermost open element of ``tags``; a paragraph or item only up to the container around it."""
        if not any(self._open[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in tags:
                self._open.subtract([self.tag[e] for e in stack[k:]])
                del stack[k:]
                return
            if tag in SCOPE and tags[0] not in SCOPE:
                return

    def _flush(self, element: int) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text and not self.dropped[element]:
                while self.tag[element] not in BLOCK and element:
                    element = self.parent[element]
                self.blocks.append((element, text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def clear_suspects(self) -> None:
        """Trust suspect elements that must hold the article, from the outside in, and forget the blocks in the others."""
        chars = [0] * len(self.tag)
        for element, text, _ in self.blocks:
            chars[element] += len(text)
        for e in range(len(chars) - 1, 0, -1):
            chars[self.parent[e]] += chars[e]
        while True:
            top, outer = [-1] * len(chars), []  # the outermost suspect element around each element
            for e in range(1, len(chars)):
                top[e] = top[self.parent[e]]
                if top[e] < 0 and self.suspect[e]:
                    top[e] = e
                    outer.append(e)
            largest = max(outer, key=lambda e: chars[e], default=0)
            free = chars[0] - sum(chars[e] for e in outer)
            if not largest or chars[largest] <= MOST * chars[0] or free >= LITTLE * chars[largest]:
                break
            self.suspect[largest] = False
        self.blocks = [b for b in self.blocks if top[b[0]] < 0]

    def main_blocks(self) -> list[str]:
        """The texts of the blocks that are kept."""
        self.clear_suspects()
        if not self.blocks:
            return []
        n = len(self.tag)
        score, chars, linked = [0.0] * n, [0] * n, [0] * n
        for element, text, in_links in self.blocks:
            chars[element] += len(text)
            linked[element] += in_links
            if len(text) >= LEAST_CHARS:
                points = 1 + len(_COMMAS.findall(text)) + min(len(text) / 100, 3)
                points *= 1 - in_links / len(text)
                at = self.parent[element] if self.tag[element] in PARAGRAPHS and element else element
                level = 0
                while at >= 0:
                    score[at] += points / (1, 2)[level] if level < 2 else points / (3 * level)
                    at = self.parent[at]
                    level += 1
        for element in range(n - 1, 0, -1):  # elements stand after their parents
            chars[self.parent[element]] += chars[element]
            linked[self.parent[element]] += linked[element]
        density = [b / a if a else 0.0 for a, b in zip(chars, linked, strict=True)]
        final = [s * (1 - d) for s, d in zip(score, density, strict=True)]
        best = max(range(n), key=lambda e: (final[e], -e))
        if final[best] <= 0:
            holders = [e for e in range(n) if self.tag[e] in CONTAINERS and chars[e]]
            best = max(holders, key=lambda e: chars[e]) if holders else 0
        at = best
        while at > 0:
            if self.tag[at] in CONTAINERS:
                best = at
                break
            at = self.parent[at]
        keep = {best}
        if self.tag[best] not in CONTAINERS and best:
            holds = [False] * n  # paragraphs or headings
            for element, _, _ in self.blocks:
                holds[element] = self.tag[element] in PARAGRAPHS
            for e in range(n - 1, 0, -1):
                holds[self.parent[e]] |= holds[e]
            above, at = {best}, best
            while at > 0:
                at = self.parent[at]
                above.add(at)
            for e in range(1, n):
                if self.parent[e] in above and self.parent[e] != best and e not in above and chars[e] and density[e] < LINK_SHARE:
                    if holds[e] or final[e] >= SIBLING_SHARE * final[best]:
                        keep.add(e)
        inside = [False] * n
        for e in range(n):
            inside[e] = e in keep or (e > 0 and inside[self.parent[e]])
        return [text for element, text, _ in self.blocks if inside[element]]


def main_text(source: str | None) -> str:
    """The article of a page: blocks in page order, joined by an empty line; empty if there is none."""
    blocks = Page(source or "").main_blocks()
    if not blocks and source and "<form" in source.lower():
        blocks = Page(source, forms=True).main_blocks()  # a page that is one form
    return "\n\n".join(blocks)


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text``, ``n_chars`` (code points). Null or empty pages have an empty text.

    White space inside a block is one space, blocks are joined by two line feeds. Repeated rows come out as often as they went in, an empty table gives no
    rows. Other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "url")}
    return rows.mapInArrow(_extracting, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
