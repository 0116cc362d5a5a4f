"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags (and at doubled line breaks).  The first pass
looks at one block: blocks of menus, headers, footers, sidebars, notices, adverts, forms and
reader comments (by element, role or words of class and id) and blocks of much link text are
boilerplate; long blocks with many stop words are content; other long ones lean to content,
and are content where a page has no better ones; short ones stay open.  A class or id with such
a word as a part does not count for a container of most of the page's unlinked text, nor does
any around the only article.  Where a page marks its
article, the mark counts as evidence: blocks in it need no stop words and blocks outside it
are boilerplate.  The second pass decides the open and leaning blocks: they take the label of
the nearest decided block, in the article if there is one; if both neighbours are equally near
and differ, leaning blocks and headings take the following one's, and open blocks are
boilerplate.  Without any decided neighbour, blocks of the article are content, leaning ones
are content and open ones are not.  Blocks of the article that are mostly links are open, too:
they stay between blocks of content, and one or two of them at its ends; longer lists of links
there go.  Where nothing at all is content, the open blocks of a page are.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by a line feed in page order.  Null html is empty.  Open comments, scripts and tags run
to the end of the page.  Rows with equal ids are handled each for itself.  Long pages are read
whole, one at a time.  An empty table gives no rows; the operator is a column, so other columns
may have any name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = {
    "en": "a about all also an and are as at be been but by can for from had has have he her his i if in into is it its "
    "more not of on one or she so than that the their there they this to was we were what when which who will with would you",
    "de": "als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im in ist "
    "mit nach nicht noch oder sich sie sind so über um und von vor war werden wie wird zu zum zur",
    "fr": "au aux avec ce cette dans de des du elle en est et il ils la le les leur mais ne ou par pas plus pour qui que "
    "sa se ses son sont sur un une vous",
    "es": "al como con de del el ella en entre era es esta este fue ha la las lo los más me mi muy no nos o para pero por "
    "que se si sin sobre su sus también un una y ya",
}

BOILERPLATE_TAGS = frozenset(
    "nav header footer aside form menu dialog button select option textarea label input fieldset iframe object applet "
    "svg canvas audio video map head title".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notification alert popup modal overlay newsletter subscribe subscription sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies related recommended share "
    "sharing social widget toolbar pagination pager login signup".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "html body main article section div nav header footer aside form menu dialog table tbody thead tfoot tr td th ul ol "
    "dl li dt dd blockquote figure figcaption fieldset details summary center address button select option textarea label "
    "iframe object applet svg canvas audio video map head title".split()
)
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 hr pre".split()) - {"label", "button"}
_RAW = "script|style|noscript|template|xmp|noframes|noembed"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|"
    r"<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|"
    r"</?(?P<loose>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RIGHTS = re.compile(r"\N{COPYRIGHT SIGN}|\A(?:copyright\b|all rights reserved\b)", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_DENSE = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")
_STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())

GOOD, LEANING, OPEN, BAD = "good", "leaning", "open", "bad"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass."""

    link_density: float = 0.33
    article_link_density: float = 0.6
    short: int = 70
    long: int = 200
    stop_high: float = 0.30
    link_list: int = 3  # linked blocks at an end of the article that make a list


@dataclass
class Block:
    boiler: bool
    article: bool
    heading: bool
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = OPEN
    named: tuple = ()  # containers around it that only a class or id makes boilerplate


@dataclass(eq=False)
class Named:
    """A container with boilerplate words in its class or id."""

    whole: bool  # a class or id is such a word, not only a part of it
    inside: bool  # stands inside an article


def _hides(attrs: str) -> bool:
    for name, *values in _ATTR.findall(attrs):
        value = "".join(values)
        if name.lower() == "hidden" and not value or name.lower() == "style" and _UNSEEN.search(value):
            return True
    return False


def _boilerplate(tag: str, attrs: str, in_article: bool) -> bool | Named:
    if tag in BOILERPLATE_TAGS and not (tag == "header" and in_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if _hides(attrs):
        return True
    found = False
    for name, *values in _ATTR.findall(attrs):
        value = "".join(values)
        name = name.lower()
        if name == "role" and value.lower() in BOILERPLATE_ROLES:
            return True
        if name in ("class", "id"):
            words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)
            if any(w.lower() in BOILERPLATE_WORDS for w in words):
                whole = any(v.lower() in BOILERPLATE_WORDS for v in value.split())
                found = Named(whole or bool(found and found.whole), in_article)
    return found


def _unlinked(b: Block) -> int:
    return max(0, len(b.text) - b.linked)


def _judge_names(blocks: list[Block]) -> None:
    """Blocks in named containers are boilerplate, but a container with a word in a part of its
    names only does not count if most of the unlinked text is in it, and names around the
    article do not count if no other article is left."""
    total, inside = 0, {}
    for b in blocks:
        if not b.boiler and not any(n.whole for n in b.named):
            total += _unlinked(b)
            for n in b.named:
                inside[n] = inside.get(n, 0) + _unlinked(b)
    void = {n for n, size in inside.items() if not n.whole and 2 * size > total}
    open_ = [b for b in blocks if not b.boiler]
    if not any(b.article and void.issuperset(b.named) for b in open_):
        void |= {n for b in open_ if b.article for n in b.named if not n.inside}
    for b in open_:
        b.boiler = not void.issuperset(b.named)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that hold text, in order."""
    found: list[Block] = []
    # (tag, boilerplate, article, named containers) with what is inherited
    stack: list[tuple[str, bool, bool, tuple]] = []
    links, heading, breaks, unseen = 0, False, 0, False
    block: Block | None = None
    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        text = m.group("text")
        if text is not None:
            if block is None:
                _, boiler, article, named = stack[-1] if stack else ("", False, False, ())
                block = Block(boiler or unseen, article, heading, named=named)
                found.append(block)
            if breaks and text.strip():
                breaks = 0
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())
            continue
        if kind == "raw" or m.group("raw"):
            continue
        tag = (m.group("tag") or m.group("loose") or "").lower()
        if not tag:
            continue
        close = bool(m.group("close")) or m.group().startswith("</")
        if tag == "a":
            links = 0 if close else 1
        elif tag == "br":
            breaks += 1
            if block is not None:
                block.parts.append(" ")
            if breaks > 1:
                block = None
        elif tag in BLOCKS:
            block, breaks = None, 0
            # a paragraph or heading that is not shown; containers pass this on themselves
            unseen = not close and tag not in CONTAINERS and _hides(m.group("attrs") or "")
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = not close
            elif tag not in CONTAINERS:
                heading = False
            if tag in CONTAINERS:
                links = 0
        if tag in CONTAINERS and tag not in VOID_TAGS:
            if close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif not m.group().endswith("/>"):
                _, boiler, article, named = stack[-1] if stack else ("", False, False, ())
                attrs = m.group("attrs") or ""
                own = False if boiler else _boilerplate(tag, attrs, article)
                if isinstance(own, Named):
                    named = (*named, own)
                stack.append((tag, boiler or own is True, article or tag in ("article", "main"), named))
    for b in found:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    found = [b for b in found if b.text]
    _judge_names(found)
    return found


def _size(text: str) -> int:
    """Characters; those of scripts without spaces between words count three times."""
    return len(text) + 2 * len(_DENSE.findall(text))


def classify(blocks: list[Block], rules: Rules = Rules()) -> None:
    """Both passes; afterwards every label is GOOD or BAD."""
    marked = any(b.article and not b.boiler for b in blocks)
    for b in blocks:
        density = b.linked / len(b.text)
        words = _WORD.findall(b.text.lower())
        stop = sum(w in _STOP for w in words) / len(words) if words else 0.0
        if b.boiler or (marked and not b.article):
            b.label = BAD
        elif b.article and density > rules.article_link_density:
            b.label = OPEN
        elif density > rules.link_density and not b.article:
            b.label = BAD
        elif b.article:
            b.label = GOOD if len(b.text) >= rules.short or stop >= rules.stop_high else LEANING
        elif _size(b.text) < rules.short:
            b.label = BAD if _RIGHTS.search(b.text) else OPEN
        elif stop >= rules.stop_high:
            b.label = GOOD if len(b.text) > rules.long else LEANING
        else:
            # the language may be another, so few stop words take nothing away
            b.label = LEANING
    if not marked and not any(b.label == GOOD for b in blocks):
        leaning = [b for b in blocks if b.label == LEANING]
        short = [b for b in blocks if b.label == OPEN]
        for b in [b for b in leaning if _size(b.text) > rules.long] or leaning or short:
            b.label = GOOD
    near = [b for b in blocks if b.article and not b.boiler] if marked else blocks
    decided = [b.label if b.label in (GOOD, BAD) else None for b in near]
    before: list[tuple[int, str] | None] = []
    last = None
    for k, label in enumerate(decided):
        last = (k, label) if label else last
        before.append(last)
    after, last = [None] * len(near), None
    for k in range(len(near) - 1, -1, -1):
        last = (k, decided[k]) if decided[k] else last
        after[k] = last
    for k, b in enumerate(near):
        if decided[k]:
            continue
        left, right = before[k], after[k]
        if marked:
            # inside a marked article only its own boilerplate on both sides takes a block away, and
            # lists of links at its ends go
            if b.label == OPEN and not (left and right):
                run = right[0] if right else len(near) - 1 - left[0] if left else 0
                b.label = BAD if run >= rules.link_list else GOOD
            else:
                b.label = BAD if left and right and left[1] == right[1] == BAD else GOOD
        elif left and right:
            if left[1] == right[1] or k - left[0] < right[0] - k:
                b.label = left[1]
            elif k - left[0] > right[0] - k or b.label == LEANING or b.heading:
                b.label = right[1]
            else:
                b.label = BAD
        elif left or right:
            b.label = (left or right)[1]
        else:
            b.label = GOOD if b.label == LEANING else BAD


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The content blocks of a page, a line each."""
    if not isinstance(page, str) or not page:
        return ""
    blocks = blocks_of(page)
    classify(blocks, rules)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(page: Column, rules: Rules = Rules()) -> Column:
    """main_text of an html column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, rules) for p in pages], dtype=object)

    return F.pandas_udf(run, "string")(page.cast("string"))
