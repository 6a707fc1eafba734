"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text. A block is the text between two
block-level tags; its path is the chain of open block elements with their class
names. Text length, punctuation and link text are summed per path over the page.
Length per block and punctuation per block of a path, damped by its share of
link text, are smoothed along the page with a Gaussian, fused by their product,
and paths at or above a threshold are content. The element that holds most of the
selected text is the article; its blocks are returned in page order, lists of
links and, where only the whole body qualifies, paths below the threshold aside.

Elements that are never article text (scripts, menus, forms, footers, elements
hidden or named after adverts, notices, comments and the like) weigh nothing and
are left out inside the article too. Where only a word of a longer name says so,
an element that holds most of the page's text stays. Ids of headings, and of
sections in an article, say nothing.

Null, empty and tagless html: no tags means that the text is one block. Pages
without text give the empty string. Unclosed elements end where their parent
ends; a tag cut off by the end of the page is dropped. Repeated rows give repeated
rows; other columns are not read, so their names cannot clash.

Time and memory are linear in the page, also where elements are nested or left open by
the hundred thousand: paths are numbers, what elements hold is summed once from the
leaves up, and no search for a closing tag is made twice in vain."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, rows

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: content of these is not parsed
RAW = frozenset("script style noscript template textarea iframe svg canvas object audio video annotation annotation-xml".split())
#: of these, an unclosed one takes the rest of the page
RAW_TEXT = frozenset("script style noscript textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mtable mtr mtd mpadded mphantom menclose merror mmultiscripts".split()
)
NOT_TEXT = frozenset("head title nav aside form footer button select menu dialog".split())
#: a word of a class name, id or role that marks what is not the article
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget "
    "footer comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended teaser pagination pager toolbar toc copyright legal disclaimer search form masthead".split()
)
#: what these mark can hold more text than the article
OFTEN_LONGER = frozenset("comment comments commentlist reply replies respond disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li td th".split())
ARTICLES = frozenset(("article", "main"))
KEPT_ROOTS = frozenset(("html", "body", "article", "main"))
#: an open element of the first kind ends when one of these begins, up to the nearest of the last
P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table select article section div body html".split())
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
SIGMA = 1.0
RADIUS = 2
#: content paths reach this share of the page's highest fused ratio, on a root scale
THRESHOLD = 0.1
#: the article holds at least this share of the selected text
SHARE = 0.6


#: open elements that a beginning one may end, or that shelter them
_INTERESTING = SCOPES | {n for names in SIBLINGS.values() for n in names}


class Element:
    __slots__ = ("name", "parent", "path", "depth", "dead", "named", "holds", "open_at")

    def __init__(self, name: str, parent: "Element | None", path: int, dead: bool, named: int = 0):
        self.name, self.parent, self.path, self.dead, self.named = name, parent, path, dead, named
        self.depth = 0 if parent is None else parent.depth + 1
        self.holds = 0
        # the nearest element, itself included, that is looked for when another begins
        self.open_at = self if parent is None or name in _INTERESTING else parent.open_at


class Block:
    __slots__ = ("element", "text", "links")

    def __init__(self, element: Element, text: str, links: int):
        self.element, self.text, self.links = element, text, links

    @property
    def path(self) -> int:
        return self.element.path


def _sum_up(elements: list[Element]) -> None:
    """Adds what each element holds to its parent; parents come before their children."""
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.holds += e.holds


def _unwanted(name: str, attributes: str, inside_article: bool) -> tuple[bool, int, str]:
    """(whether the element is never article text, whether its names say so: 2 a whole name, 1 a word of one, its class words)."""
    if name in NOT_TEXT or (name == "header" and not inside_article):
        return True, 0, ""
    words: list[str] = []
    dead, named = False, 0
    if attributes and attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                own = re.findall(r"[a-z]+", value)
                words += own
                # ids of headings and of an article's sections name what they are about
                if not (key == "id" and (name in HEADINGS or (name == "section" and inside_article))) and NOT_ARTICLE.intersection(own):
                    named = max(named, 1 + (not NOT_ARTICLE.isdisjoint(value.split()) or not OFTEN_LONGER.isdisjoint(own)))
            elif (key == "hidden" and not m[0].lower().startswith("hidden=\"until")) or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                dead = True
    if not inside_article and not named and "header" in words:
        named = 1
    if name in KEPT_ROOTS:
        return False, 0, " ".join(words)
    return dead, named, " ".join(words)


def _spared(blocks: list[Block], elements: list[Element]) -> list[Block]:
    """The blocks outside elements that are named as no article is.

    Where only a word of a longer name says so, an element that holds most of the
    page's text is spared; where nothing is left, so is any that holds most of it."""

    def worst() -> dict[Element, int]:
        """The strongest name of each element and those around it."""
        found: dict[Element, int] = {}
        for e in elements:
            found[e] = e.named if e.parent is None else max(e.named, found[e.parent])
        return found

    def spare(most: int) -> list[Block]:
        total, strongest = 0, worst()
        for e in elements:
            e.holds = 0
        for b in blocks:
            if strongest[b.element] <= most:
                total += len(b.text)
                b.element.holds += len(b.text)
        _sum_up(elements)
        for e in elements:
            if 2 * e.holds > total and e.named:
                e.named = 0
        strongest = worst()
        return [b for b in blocks if not strongest[b.element]]

    return spare(1) or spare(2)


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks of a page in order, those of unwanted elements left out, and all elements, parents first."""
    root = Element("", None, 0, False)
    stack, out, elements = [root], [], [root]
    text: list[str] = []
    links, in_link, at = 0, 0, 0
    paths: dict[tuple[int, str], int] = {}
    open_names: dict[str, int] = {}
    n_articles = 0

    def flush() -> None:
        nonlocal links
        if text:
            top = stack[-1]
            if not top.dead:
                joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
                if joined:
                    out.append(Block(top, joined, links))
            text.clear()
        links = 0

    def pop_to(depth: int) -> None:
        nonlocal n_articles, in_link
        flush()
        while len(stack) > depth:
            gone = stack.pop()
            open_names[gone.name] -= 1
            n_articles -= gone.name in ARTICLES
        in_link = 0

    lowered = None
    unclosed: set[str] = set()
    while True:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            links += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[4] is not None and not m[0].endswith(">"):
            break  # cut off by the end of the page
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = -1
                if name not in unclosed:
                    lowered = page.lower() if lowered is None else lowered
                    end = lowered.find(f"</{name}", at) if len(lowered) == len(page) else re.compile(f"</{name}", re.I).search(page, at)
                    end = end if isinstance(end, int) else end.start() if end else -1
                if end < 0:
                    if name in RAW_TEXT:
                        break
                    unclosed.add(name)
                    continue  # only the tag is left out
                close = page.find(">", end)
                at = close + 1 if close >= 0 else len(page)
            text.append(" ")
            continue
        if name in VOID:
            if name in ("br", "hr", "img", "input"):
                text.append(" ")
            if name == "hr":
                flush()
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        if closing:
            if open_names.get(name):
                while stack[-1].name != name:
                    pop_to(len(stack) - 1)
                pop_to(len(stack) - 1)
            else:
                flush()
            continue
        flush()
        if stack[-1].name == "head" and name != "title":
            pop_to(len(stack) - 1)
        if name in P_ENDERS and stack[-1].name == "p":
            pop_to(len(stack) - 1)
        if name in SIBLINGS:
            near = stack[-1].open_at
            while near is not root:
                if near.name in SIBLINGS[name]:
                    pop_to(near.depth)
                elif near.name in SCOPES:
                    break
                near = near.parent.open_at
        parent = stack[-1]
        unwanted, named, words = _unwanted(name, attributes, n_articles > 0)
        path = paths.setdefault((parent.path, f"{name}.{words}" if words else name), len(paths) + 1)
        here = Element(name, parent, path, parent.dead or unwanted, named)
        n_articles += name in ARTICLES
        open_names[name] = open_names.get(name, 0) + 1
        elements.append(here)
        stack.append(here)
    pop_to(1)
    return _spared(out, elements), elements


def ratios(blocks: list[Block]) -> dict[int, float]:
    """The fused ratio of every path, smoothed along the page."""
    total: dict[int, list[float]] = {}
    for b in blocks:
        t = total.setdefault(b.path, [0, 0, 0, 0])
        t[0] += len(b.text)
        t[1] += len(PUNCTUATION.findall(b.text))
        t[2] += min(b.links, len(b.text))
        t[3] += 1
    by_path = {p: (size / n * (1 - links / size), marks / n * (1 - links / size)) for p, (size, marks, links, n) in total.items()}
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    smoothed: dict[int, list[float]] = {}
    for i, b in enumerate(blocks):
        size = marks = weight = 0.0
        for d, k in enumerate(kernel, -RADIUS):
            if 0 <= i + d < len(blocks):
                s, p = by_path[blocks[i + d].path]
                size, marks, weight = size + k * s, marks + k * p, weight + k
        s = smoothed.setdefault(b.path, [0.0, 0])
        s[0] += math.sqrt(size / weight * (1 + marks / weight))
        s[1] += 1
    return {p: s / n for p, (s, n) in smoothed.items()}


def main_text(page: str | None) -> str:
    """The article of a page; blocks are joined by a line feed."""
    blocks, elements = blocks_of(page or "")
    if not blocks:
        return ""
    fused = ratios(blocks)
    least = THRESHOLD * max(fused.values())
    whole = 0
    for e in elements:
        e.holds = 0
    for b in blocks:
        if fused[b.path] >= least and 2 * b.links <= len(b.text):
            whole += len(b.text)
            b.element.holds += len(b.text)
    if not whole:
        return ""
    _sum_up(elements)
    best, best_rank = None, (False, -1)
    for e in elements:
        if e.holds >= SHARE * whole and e.name not in LEAVES and (e.name in ARTICLES, e.depth) > best_rank:
            best, best_rank = e, (e.name in ARTICLES, e.depth)
    # a page's body may hold anything, an element that was singled out only the article and lists of links
    narrow = best is not None and best.name not in ("", "html", "body")
    inside: set[Element] = set()
    for e in elements:
        if e is best or e.parent in inside:
            inside.add(e)
    kept = []
    for b in blocks:
        if b.element in inside and (best_rank[0] or 2 * b.links <= len(b.text) and (narrow or fused[b.path] >= least or b.element.name in HEADINGS)):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, the article's text and its code points."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        def out():
            for i, u, h in rows(batches, "page_id", "url", "html"):
                text = main_text(h)
                yield i, u, text, len(text)

        yield from batched(out(), schema)

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
