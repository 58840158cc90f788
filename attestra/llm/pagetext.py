"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with the path of block tags from the root. Text length (without links) and
punctuation are averaged per path, the two ratios are fused by their geometric mean, smoothed with the ratio of the
element that holds most of the text, and paths below a share of the page's mean are dropped. Before that go menus and the like:
by tag, role or hidden state whatever they hold; by a word of their class or id only if they hold no main or article and are
outside one or below a share of the page's text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, restored, small_batches, text_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
# Names of the HTML standard and words that mark parts of pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var "
             "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover "
             "mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split())
RAW = set("script style title iframe textarea xmp noembed noframes".split())
# What stands in these is no text of the page if their own end tag follows; else they end with their parent and count for nothing.
CLOSED = set("noscript template svg object canvas audio video button".split())
APART = set("nav header footer aside form menu dialog fieldset select annotation annotation-xml".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
APART_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
APART_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager header "
    "masthead footer comment comments reply replies respond disqus discussion share sharing social related recommended recommendations trending toolbar "
    "search copyright".split())
ABOUT_OTHERS = {"with", "has", "no", "without", "open", "closed"}
WHOLE = {"html", "body", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、！？]")
ROOT_SHARE = 0.7
KEEP_SHARE = 0.4
# Of the punctuated text without links: from here on a class word drops no element, and from half of it on an article counts as one.
APART_SHARE = 0.2


def _set_apart(tag: str, attributes: str) -> bool:
    """Whether an element is a part of the page around the article, by its tag, role or hidden state."""
    if tag in APART:
        return True
    if tag in WHOLE or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in APART_ROLES or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named_apart(tag: str, attributes: str) -> bool:
    """Whether a word of the class or id says that an element may be a part of the page around the article."""
    if tag in WHOLE or "=" not in attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            for word in value.split():
                parts = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower()))
                if parts & APART_WORDS and not parts & ABOUT_OTHERS and (tag != "article" or parts & {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "sponsored"}):
                    return True
    return False


class Blocks:
    """Text blocks of a page in order: text, characters of links, path, element; and the parent of every element."""

    def __init__(self, page: str) -> None:
        self.found: list[tuple[str, int, tuple[str, ...], int]] = []
        self.parents = [-1]
        self.dropped: set[int] = set()  # elements of CLOSED with an end tag of their own
        self.named: set[int] = set()  # elements that a class word names, to be judged by what they hold
        self.articles: list[int] = []  # main and article elements that no class word names
        self._stack: list[tuple[str, bool, int]] = []  # tag, set apart, element (of a block tag, else that around it)
        self._mains: set[int] = set()
        self._held: list[tuple[int, int, int]] = []  # elements of CLOSED since the last flush: place in the stack, texts and linked characters before
        self._text: list[str] = []
        self._linked = 0
        self._read(page)
        self._flush()
        for drop in (lambda: self.dropped, self._parts_around):
            gone = self._below(drop())
            self.found = [f for f in self.found if not gone[f[3]]]

    def _parts_around(self) -> set[int]:
        """The elements named apart that hold no main or article and are outside one or hold little of the text."""
        if not self.named:
            return set()
        weight = [(len(t) - linked) * bool(PUNCTUATION.search(t)) for t, linked, _, _ in self.found]
        weight = weight if any(weight) else [len(t) - linked + 1 for t, linked, _, _ in self.found]
        held, last = [0] * len(self.parents), list(range(len(self.parents)))
        for (_, _, _, element), w in zip(self.found, weight):
            held[element] += w
        for element in range(len(held) - 1, 0, -1):
            held[self.parents[element]] += held[element]
            last[self.parents[element]] = max(last[self.parents[element]], last[element])
        articles = [a for a in self.articles if held[a] and (held[a] >= APART_SHARE / 2 * held[0] or a in self._mains)]
        return {e for e in self.named if not any(e < a <= last[e] for a in articles)
                and (any(not a < e <= last[a] for a in articles) or held[e] < APART_SHARE * held[0])}

    def _below(self, elements: set[int]) -> list[bool]:
        """Per element whether it is one of the given ones or inside one."""
        found = [0 in elements]
        for element in range(1, len(self.parents)):
            found.append(element in elements or found[self.parents[element]])
        return found

    def _flush(self) -> None:
        begin = linked = 0
        for depth, end, so_far in [*self._held, (len(self._stack), len(self._text), self._linked)]:
            text = " ".join("".join(self._text[begin:end]).split())
            if text:
                around = self._stack[:depth]
                path = tuple(t for t, _, _ in around if t not in INLINE)
                self.found.append((text, min(so_far - linked, len(text)), path, around[-1][2] if around else 0))
            begin, linked = end, so_far
        self._held, self._text, self._linked = [], [], 0

    def _pop_to(self, tags: set[str], bounds: set[str]) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            tag = self._stack[k][0]
            if tag in tags:
                self._flush()
                del self._stack[k:]
                return
            if tag in bounds:
                return

    def _open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            apart = tag in APART or bool(attributes.strip(" />")) and (_set_apart(tag, attributes) or _named_apart(tag, attributes))
            if apart:
                self._text.append(" ")
            self._stack.append((tag, self._apart() or apart, self._stack[-1][2] if self._stack else 0))
            return
        if self._stack and self._stack[-1][0] in ("select", "option", "optgroup") and tag not in ("option", "optgroup", "hr"):
            self._pop_to({"select"}, {"datalist"})
        if tag in CLOSES_P:
            self._pop_to({"p"}, {"td", "th", "button", "object", "table"})
        if tag in SIBLINGS:
            self._pop_to(*SIBLINGS[tag])
        if tag in ("main", "article"):
            self._pop_to({"nav"}, {"aside", "footer"})
        if tag in CLOSED:
            self._held.append((len(self._stack), len(self._text), self._linked))
        else:
            self._flush()
        if tag == "hr":
            return
        self.parents.append(self._stack[-1][2] if self._stack else 0)
        self._stack.append((tag, self._apart() or _set_apart(tag, attributes), len(self.parents) - 1))
        if _named_apart(tag, attributes):
            self.named.add(len(self.parents) - 1)
        elif tag in ("main", "article"):
            self.articles.append(len(self.parents) - 1)
            if tag == "main":
                self._mains.add(len(self.parents) - 1)

    def _apart(self) -> bool:
        return bool(self._stack) and self._stack[-1][1]

    def _close(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                if self._held and self._held[-1][0] == k:  # the text around it stays one block
                    _, size, self._linked = self._held.pop()
                    del self._text[size:]
                elif tag not in INLINE:
                    self._flush()
                if tag in CLOSED:
                    self.dropped.add(self._stack[k][2])
                del self._stack[k:]
                return
            if tag in INLINE and self._stack[k][0] not in INLINE:
                return

    def _read(self, page: str) -> None:
        at = 0
        while at < len(page):
            match = TOKEN.search(page, at)
            begin = match.start() if match else len(page)
            if begin > at and not self._apart():
                text = html.unescape(page[at:begin])
                self._text.append(text)
                if any(t == "a" for t, _, _ in self._stack):
                    self._linked += len(text)
            if not match:
                return
            at = match.end()
            if not match["tag"]:
                continue
            tag, attributes = match["tag"].lower(), match["attributes"]
            if match["end"]:
                self._close(tag)
            elif attributes.endswith("/>") and (tag in CLOSED or tag in RAW or any(t in ("svg", "math") for t, _, _ in self._stack)):
                continue
            elif self._stack and self._stack[-1][0] == "svg" and tag not in RAW and tag not in CLOSES_P and tag not in WHOLE:
                continue
            elif tag in RAW:
                end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag == "br":
                self._text.append(" ")
            elif tag not in VOID or tag == "hr":
                self._open(tag, attributes)


def main_text(page: str) -> str:
    """The kept blocks in page order, parted by an empty line."""
    blocks = Blocks(page)
    found = blocks.found
    if not found:
        return ""
    length = [len(t) - linked for t, linked, _, _ in found]
    marks = [len(PUNCTUATION.findall(t)) for t, _, _, _ in found]
    weight = [n * (m > 0) for n, m in zip(length, marks)]
    weight = weight if any(weight) else [n + 1 for n in length]
    below = [0] * len(blocks.parents)
    for (_, _, _, element), w in zip(found, weight):
        below[element] += w
    for element in range(len(below) - 1, 0, -1):
        below[blocks.parents[element]] += below[element]
    root = max((e for e in range(len(below)) if below[e] >= ROOT_SHARE * below[0]), default=0)
    if root and root not in blocks.parents:  # a single paragraph that outweighs the others: the element around it
        root = blocks.parents[root]

    def inside(element: int) -> bool:
        while element > root:
            element = blocks.parents[element]
        return element == root

    fused = lambda n, chars, points: ((chars / n) * (points / n + 0.2)) ** 0.5 if n else 0.0
    sums = defaultdict(lambda: [0, 0, 0])
    within = [0, 0, 0]
    held = [inside(element) for _, _, _, element in found]
    for (_, _, path, _), n, m, h in zip(found, length, marks, held):
        for total in [sums[path]] + [within] * h:
            total[0] += 1
            total[1] += n
            total[2] += m
    specific = any(path and h and len(path) > 2 for (_, _, path, _), h in zip(found, held)) and all(
        len(path) > 2 for (_, _, path, _), h in zip(found, held) if h)
    around = fused(*within)
    score = [0.5 * fused(*sums[path]) + 0.5 * around if h and specific else fused(*sums[path]) for (_, _, path, _), h in zip(found, held)]
    mean = sum(s * n for s, n in zip(score, length)) / max(1, sum(length))
    keep = [s >= KEEP_SHARE * mean for s in score]
    for k in range(len(found) - 2, -1, -1):  # a heading goes with what follows it
        if found[k][2] and found[k][2][-1] in HEADINGS and not keep[k]:
            keep[k] = keep[k + 1] and (held[k] or not specific)
    return "\n\n".join(t for (t, _, _, _), k in zip(found, keep) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Key, url, text and n_chars (code points) of every page; other columns are dropped.

    Null and empty pages, and pages without text outside their menus and the like, give the empty text. Repeated rows
    stay. An empty table gives an empty result.
    """
    small_batches(pages.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p) for p in batch["_page"]]
            yield pd.DataFrame({"key": batch["_key"], "url": batch["_url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(carried(key).alias("_key"), F.col(url).alias("_url"), text_of(page).alias("_page"))
    out = rows.mapInPandas(read, "key string, url string, text string, n_chars long")
    return out.select(restored(pages, key, "key").alias(key), F.col("url").alias(url), "text", "n_chars")
