"""Main text of web pages from streamed parser events and smoothed text-to-tag ratios."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.rows import map_texts

#: Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content, and elements that surround it; these may be wrapped around it.
NEVER = frozenset("script style noscript template head title svg iframe object canvas audio video select option button textarea label".split())
AROUND, WRAPPERS = frozenset("nav aside footer dialog menu".split()), frozenset("form header".split())
#: Roles, and words of class and id names, of what surrounds an article.
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside widget footer header masthead topbar toolbar comment comments disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toc skip hidden".split())
#: Those of the names that mean the same inside an article; the others may name a part of its text.
INNER_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsored navbar breadcrumb breadcrumbs sidebar sidenav comments disqus".split())
#: Names of readers' remarks, words that turn a name round, and words of layout beside a name.
REMARKS = frozenset("comment comments disqus reply replies respond".split())
TURNED = frozenset("no not non has with without is".split())
LAYOUT = frozenset("site page main top left right bottom box bar area wrapper wrap container block section list links link item items slot unit widget inner outer row col column global primary secondary post user reader form buttons button icons group panel region content module".split())
#: Factor on the text-to-tag ratio of a block for each box around it whose name holds a furniture word among others.
DOUBT = 0.25
CONTAINERS = frozenset("article main section div td body html blockquote".split())
#: Elements of an unclosed frame of the page that the start of an article ends.
FRAME = frozenset("nav header footer".split())
WORD, HEADING = re.compile(r"[a-z]+"), frozenset("h1 h2 h3 h4 h5 h6".split())
#: The beginning of a tag that has no end.
UNFINISHED = re.compile(r"<[A-Za-z/!?]")
FEED = 1 << 16


@dataclass
class Block:
    """A run of text between block boundaries; box: the container it lies in; item: in a
    list item outside of any article or main element; heading: in h1 to h6; mark: the innermost
    marked box around it; linked: characters in links."""

    box: int
    item: bool
    heading: bool
    mark: int
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Events(HTMLParser):
    """Blocks of text, from a stream of parser events.

    stack holds (tag, kind, box before, mark before) of the open block elements and marked boxes,
    and what is open is kept in counts, so an event costs the same at any depth; boxes holds
    (parent, element) of containers and marks (parent, kind) of marked boxes, parents first.
    kinds: "never" holds no content; "around" is furniture; "wrapper" is so unless it holds most of
    the text; "doubt" lowers its blocks' ratios.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.boxes: list[tuple[int, str]] = [(-1, "page")]
        self.stack: list[tuple[str, str, int, int]] = []
        self.open: Counter[str] = Counter()
        self.marks: list[tuple[int, str]] = []
        self.box, self.mark = 0, -1
        self.skipping = self.links = self.items = self.articles = self.headings = 0
        self.block: Block | None = None

    def _break(self) -> None:
        self.block = None

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in NEVER:
            return "never"
        if tag in AROUND:
            return "around"
        if tag in WRAPPERS:
            return "" if tag == "header" and self.articles else "wrapper"
        if tag in ("body", "html", "article", "main"):
            return ""
        own = {k: (v or "").lower() for k, v in attrs}
        if own.get("role") in ROLES or own.get("aria-hidden") == "true" or "hidden" in own or "display:none" in own.get("style", "").replace(" ", ""):
            return "around"
        if self.articles and tag in HEADING:
            return ""
        names, kind = INNER_NAMES if self.articles else NAMES, ""
        for token in f"{own.get('class', '')} {own.get('id', '')}".split():
            words = WORD.findall(token)
            if not any(w in names for w in words) or words[0] in TURNED:
                continue
            if any(w not in NAMES and w not in LAYOUT for w in words):
                kind = kind or "doubt"
            elif self.articles or any(w in REMARKS for w in words):
                return "around"
            else:
                kind = "wrapper"
        return kind

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.block:
            self.block.tags += 1
        if tag in ("br", "td", "th") or tag in VOID:
            if self.block:
                self.block.parts.append(" ")
            if tag in VOID:
                if tag == "hr":
                    self._break()
                return
        if tag in ("article", "main"):
            while self.stack and self.stack[-1][0] in FRAME:
                self._pop()
        if tag == "a":
            self.links += 1
        kind = self._kind(tag, attrs)
        if tag not in BLOCKS:
            # Inside of a line, furniture is left out and the line goes on.
            kind = "never" if kind in ("around", "wrapper") and self.block else "" if kind == "doubt" and self.block else kind
        if tag in BLOCKS or kind not in ("", "never"):
            self._break()
        if tag in BLOCKS or kind or self.open[tag] > 0:  # the end of an inner element must not be taken for that of an outer one
            if tag in ("p", "li", "dd", "dt", "tr", "td", "th", "option") or tag in HEADING:
                self._close_open(tag)
            self.stack.append((tag, kind, self.box, self.mark))
            self.open[tag] += 1
            if tag in CONTAINERS or kind == "wrapper":
                self.boxes.append((self.box, tag))
                self.box = len(self.boxes) - 1
            if kind and kind != "never":
                self.marks.append((self.mark, kind))
                self.mark = len(self.marks) - 1
            self._count(tag, kind, 1)
            self.links = 0 if tag in BLOCKS else self.links

    def _count(self, tag: str, kind: str, by: int) -> None:
        self.skipping += by * (kind == "never")
        self.items += by * (tag == "li")
        self.articles += by * (tag in ("article", "main"))
        self.headings += by * (tag in HEADING)

    def _close_open(self, tag: str) -> None:
        """A paragraph or item ends where the next of its kind begins in the same container."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag or name == "p":
                while len(self.stack) > k:
                    self._pop()
                return
            if name in CONTAINERS or name in ("ul", "ol", "dl", "table", "tbody", "thead", "tr") or self.stack[k][1]:
                return

    def _pop(self) -> None:
        tag, kind, self.box, self.mark = self.stack.pop()
        self.open[tag] -= 1
        self._count(tag, kind, -1)
        if tag in BLOCKS or kind not in ("", "never"):
            self._break()

    def handle_endtag(self, tag: str) -> None:
        if self.block:
            self.block.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.open[tag] > 0:
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag in BLOCKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if not self.block:
            if not data.strip():
                return
            self.block = Block(self.box, self.items > 0 and not self.articles, self.headings > 0, self.mark)
            self.blocks.append(self.block)
        self.block.parts.append(data)
        if self.links:
            self.block.linked += len(data.strip())


def parsed(html: str) -> Events:
    """Events of a whole page.

    What follows the last ">" holds no whole tag: a tag begun there is dropped unread, as the parser
    would read a long run of such beginnings again and again.
    """
    events, end = Events(), html.rfind(">") + 1
    for at in range(0, end, FEED):
        events.feed(html[at : min(end, at + FEED)])
    events.feed(UNFINISHED.split(html[end:], maxsplit=1)[0])
    events.close()
    return events


def smoothed(ratios: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    mode = "reflect" if len(ratios) > reach else "edge"
    return np.convolve(np.pad(ratios, reach, mode=mode), kernel / kernel.sum(), mode="valid")


def regions(values: np.ndarray) -> np.ndarray:
    """True where the smoothed ratio is in the upper of two clusters, split at a threshold that moves
    to the middle of the clusters' means until it stays; all True where the clusters lie close."""
    threshold = values.mean()
    for _ in range(30):
        high, low = values[values >= threshold], values[values < threshold]
        if not len(low) or low.mean() > 0.5 * high.mean():
            return np.ones(len(values), bool)
        moved = (high.mean() + low.mean()) / 2
        if abs(moved - threshold) < 1e-9:
            break
        threshold = moved
    return values >= threshold


def _upwards(tree: list[tuple[int, str]], at: list[int], values: np.ndarray) -> np.ndarray:
    """Sums of values (of things that lie `at` a node, -1 for none) over each node and all below it; parents come first."""
    total = [0.0] * len(tree)
    for k, v in zip(at, values, strict=True):
        if k >= 0:
            total[k] += float(v)
    for k in range(len(tree) - 1, -1, -1):
        if tree[k][0] >= 0:
            total[tree[k][0]] += total[k]
    return np.array(total)


def _downwards(tree: list[tuple[int, str]], own: Callable[[int, str], int]) -> list[int]:
    """Sums of own(k, kind) over each node and all above it, and 0 at the end for what lies in none."""
    total: list[int] = []
    for k, (parent, kind) in enumerate(tree):
        total.append(own(k, kind) + (total[parent] if parent >= 0 else 0))
    return [*total, 0]


def _furniture(events: Events, free: np.ndarray) -> list[int]:
    """Above 0 for marked boxes whose text goes: in one of kind "around", or in a "wrapper" other than one that
    holds more than half of the text outside of the former while no article or main element outside
    of it holds text."""
    around = _downwards(events.marks, lambda _, kind: int(kind == "around"))
    named = _downwards(events.boxes, lambda _, tag: int(tag in ("article", "main")))
    left = np.array([not around[b.mark] for b in events.blocks], bool)
    inner = np.array([named[b.box] > 0 for b in events.blocks], bool) & left
    at = [b.mark for b in events.blocks]
    held, articles = _upwards(events.marks, at, np.where(left, free, 0.0)), _upwards(events.marks, at, inner)
    total, all_articles = free[left].sum(), inner.sum()
    return _downwards(events.marks, lambda m, kind: int(kind == "around" or kind == "wrapper" and (2 * held[m] <= total or all_articles > articles[m])))


def main_text(html: str) -> str:
    """Text of the main content, one line for each block.

    Blocks outside of furniture get the ratio of their unlinked text to their tags, lowered by
    DOUBT for doubtful names; the ratios are smoothed over neighbours and clustered.  The
    containers of blocks in content regions, weighed by their text, select the article: the
    innermost article or main element that holds most of it, or else the innermost container that
    does.  All of its blocks are kept, short ones too, but for list items that are links outside of
    an article or main element and, there, blocks of links or with doubtful names before the first
    or after the last content region.  An element inside of a line never ends it.
    """
    events = parsed(html)
    texts = [b.text() for b in events.blocks]
    free = np.array([max(0, len(t) - b.linked) for b, t in zip(events.blocks, texts, strict=True)], float)
    gone = _furniture(events, free)
    keep = [k for k, b in enumerate(events.blocks) if texts[k] and not gone[b.mark] and not (b.item and b.linked * 2 > len(texts[k]))]
    if not keep:
        return ""
    blocks, texts, free = [events.blocks[k] for k in keep], [texts[k] for k in keep], free[keep]
    doubts = _downwards(events.marks, lambda _, kind: int(kind == "doubt"))
    doubt = np.array([DOUBT ** doubts[b.mark] for b in blocks])
    chosen = regions(smoothed(doubt * free / np.array([b.tags + 1 for b in blocks])))
    weight = np.where(chosen, free, 0.0)
    if not weight.any():
        weight = free + 1.0
    held = _upwards(events.boxes, [b.box for b in blocks], weight)
    enough = np.flatnonzero(held >= max(weight.sum() / 2, 1e-9)).tolist()
    named = [b for b in enough if events.boxes[b][1] in ("article", "main")]
    best = max(named or enough, default=0)  # later boxes lie deeper
    if not named:
        best = _widened(best, held, events.boxes)
    within = _downwards(events.boxes, lambda k, _: int(k == best))
    inside = [k for k, b in enumerate(blocks) if within[b.box]]
    content = [k for k in inside if chosen[k]]
    if not named and content:
        aside = lambda k: blocks[k].linked * 2 > len(texts[k]) or doubts[blocks[k].mark] > 0
        inside = [k for k in inside if content[0] <= k <= content[-1] or blocks[k].heading or not aside(k)]
    return "\n".join(texts[k] for k in inside)


def _widened(box: int, held: np.ndarray, boxes: list[tuple[int, str]]) -> int:
    """The outermost container around box for which box isn't one of several text-bearing parts but
    the mass: a single paragraph's own container gives way to that of its neighbours."""
    while boxes[box][0] > 0 and boxes[boxes[box][0]][1] not in ("body", "html") and held[box] < held[boxes[box][0]]:
        box = boxes[box][0]
    return box


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every row, from its whole html.

    Null, empty and text-free pages have an empty text; an empty table gives no rows.  A very long or
    deeply nested page takes time and memory in proportion to its length.  Character references are decoded and
    white space inside a block becomes one space.  Repeated rows give repeated results; other
    columns are ignored.
    """
    keyed = df.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("key"), F.col(html_col).alias("html"))

    def rows(pages: list[str]) -> list[list]:
        texts = [main_text(p) for p in pages]
        return [texts, [len(t) for t in texts]]

    out = map_texts(keyed, "key", "html", "text string, n_chars long", lambda: rows)
    return out.select(F.col("key.id").alias(id_col), F.col("key.url").alias(url_col), "text", "n_chars")
