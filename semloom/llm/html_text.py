"""Main text of HTML pages by text-to-tag ratios over streaming parser events.

Method. The standard library's parser streams events; every block-level tag ends a line, and each line
counts its text characters and its tags. The ratios of text to tags, smoothed with a Gaussian kernel over
neighbouring lines, are clustered into two groups by a threshold (the split of least variance within);
lines of the upper group are content. The smallest element that holds all of a page's content lines is
its region: all lines inside are returned, so that a short paragraph between long ones stays whole, and a
title that stands before the region goes first.

What is no part of an article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) is left out. A tag, a role or a word of class or id only nominates an element; it stays
nevertheless if it is a wrapper: if it holds all of the page's articles (or titles, where no article is
marked), or on a page without either most of the text in long lines of few links. So an unclosed menu, a
form around the page or a body named has-sidebar never empties a page. Marked articles bound the region
if they hold most of the text that is left. Reader comments are known by name, or by a heading such as
"3 Comments" or "Leave a reply", from which the rest of its parent is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, read_table

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("head base link meta noscript script style template title".split())
DROPPED = frozenset("script style noscript template svg math head nav footer aside form button select textarea iframe object canvas dialog menu title".split())
#: Words of class, id or role that nominate an element.
MARKED = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice popup modal overlay newsletter subscribe share sharing social related recommended pagination pager toolbar login signup search complementary contentinfo".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond responses reply replies".split())
#: A name with one of these words says something about the content itself, as has-sidebar or post-header do.
ABOUT = frozenset("has no with without post entry article story".split())
ARTICLE = ("article", "main")
#: Elements that are never the place of a page's own article.
_BESIDE = frozenset("aside nav footer".split())
#: An end tag or another block closes an open paragraph or item, as browsers do.
_CLOSES = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}}
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\s\xa0]+")
_HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
_COMMENT_HEADING = re.compile(r"(?i)(\d+ )?(reader )?(comments?|responses?|replies|kommentare?|commentaires?|comentarios?)( ?\(\d+\))?:?|(leave|post|add|write) (a|your) (comment|reply).{0,20}")
#: A page without a marked article or title: so long a line, and this share of the text, make a nominated element a wrapper.
LONG_LINE, MOST = 80, 0.5


def _named(attrs, words: frozenset) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for token in value.lower().split():
                found = _WORD.findall(token)
                if not words.isdisjoint(found) and ABOUT.isdisjoint(found):
                    return True
    return False


class _Page(HTMLParser):
    """Text items of a page in order, the elements they stand in, and how many tags came before.

    Elements are numbered as they begin, so that parents come before their children; each covers a range of items.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parent, self.begin, self.end = ["html"], [0], [0], [0]
        self.nominated: list[bool] = [False]
        self.comments: list[bool] = [False]
        self.items: list[tuple[int, str | None, int]] = []  # element, text or None at the end of a line, tags before
        self.open = [0]
        self.count: Counter[str] = Counter()  # of open tags
        self.seen = 0

    def line_ends(self):
        if self.items and self.items[-1][1] is not None:
            self.items.append((self.open[-1], None, self.seen))

    def handle_starttag(self, tag, attrs):
        if self.count["head"] and tag not in HEAD_ONLY and not self.count["noscript"] and not self.count["template"]:
            self.close_tag("head")  # anything else begins the body
        if tag in BLOCKS:
            self.line_ends()
            for k in range(len(self.open) - 1, 0, -1):
                name = self.tags[self.open[k]]
                if tag in _CLOSES.get(name, ()):
                    self.close_from(k)
                    break
                if name in BLOCKS:
                    break
        elif tag == "br":
            self.items.append((self.open[-1], " ", self.seen))
        self.seen += 1
        if tag in VOID:
            return
        comments = _named(attrs, COMMENTS)
        plain = tag in ("article", "main", "body", "html")
        header = tag == "header" and not self.count["article"] and not self.count["main"]
        self.open.append(len(self.tags))
        self.count[tag] += 1
        self.parent.append(self.open[-2])
        self.tags.append(tag)
        self.begin.append(len(self.items))
        self.end.append(-1)
        self.comments.append(comments and tag not in ("body", "html"))
        self.nominated.append(self.comments[-1] or tag in DROPPED or header or not plain and _named(attrs, MARKED))

    def close_from(self, k: int):
        for e in self.open[k:]:
            self.end[e] = len(self.items)
            self.count[self.tags[e]] -= 1
        del self.open[k:]

    def close_tag(self, tag: str):
        if self.count[tag]:
            self.close_from(next(k for k in range(len(self.open) - 1, 0, -1) if self.tags[self.open[k]] == tag))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.seen += 1
        if tag in BLOCKS:
            self.line_ends()
            self.close_tag(tag)
        elif self.count[tag]:
            for k in range(len(self.open) - 1, 0, -1):
                name = self.tags[self.open[k]]
                if name == tag:
                    self.close_from(k)
                    return
                if name in BLOCKS and tag not in DROPPED:  # an inline end tag does not close blocks
                    return

    def handle_data(self, data):
        self.items.append((self.open[-1], data, self.seen))

    def finish(self):
        self.line_ends()
        self.close_from(1)
        self.end[0] = len(self.items)

    def sums(self, own: list[int]) -> list[int]:
        """Per element, with all elements inside."""
        for e in range(len(own) - 1, 0, -1):
            own[self.parent[e]] += own[e]
        return own

    def inside(self, those: list[bool]) -> list[bool]:
        """Whether an element is one of those or lies in one."""
        out = list(those)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def left_out(self) -> list[bool]:
        """Whether an element is left out, itself or with one around it."""
        if not any(self.nominated):
            return [False] * len(self.tags)
        beside = self.inside([c or t in _BESIDE for c, t in zip(self.comments, self.tags, strict=True)])
        kinds = [[t in ARTICLE and not b for t, b in zip(self.tags, beside, strict=True)], [t == "h1" and not b for t, b in zip(self.tags, beside, strict=True)]]
        kinds += [[t in ARTICLE and not c for t, c in zip(self.tags, self.inside(self.comments), strict=True)], [t == "h1" for t in self.tags]]
        anchors = next((k for k in kinds if any(k)), None)
        if anchors:
            held = self.sums(list(map(int, anchors)))
            return self.inside([n and h < held[0] for n, h in zip(self.nominated, held, strict=True)])
        chars, linked, longest = ([0] * len(self.tags) for _ in range(3))
        link = self.inside([t == "a" for t in self.tags])
        hidden = self.inside([t in ("script", "style", "head", "title", "template") for t in self.tags])
        for e, text, _ in self.items:
            if text and not hidden[e]:
                size = len(text.strip())
                chars[e] += size
                linked[e] += size * link[e]
                longest[e] = max(longest[e], size * (not link[e]))
        for e in range(len(longest) - 1, 0, -1):
            longest[self.parent[e]] = max(longest[self.parent[e]], longest[e])
        chars, linked = self.sums(chars), self.sums(linked)
        wrapper = [c > MOST * chars[0] and 2 * k < c and n >= LONG_LINE for c, k, n in zip(chars, linked, longest, strict=True)]
        return self.inside([n and not w for n, w in zip(self.nominated, wrapper, strict=True)])

    def lines(self, out: list[bool]) -> list[tuple[str, int, int, int]]:
        """(text, tags, first item, block element at its end) of every line of text outside left-out elements."""
        found: list[tuple[str, int, int, int]] = []
        pieces: list[str] = []
        first, before, stop = 0, 0, -1
        for at, (e, text, tags) in enumerate(self.items):
            if text is None:
                if pieces and (line := _SPACE.sub(" ", "".join(pieces)).strip()):
                    while self.tags[e] not in BLOCKS and e:
                        e = self.parent[e]
                    if found and self.tags[e] in _HEADINGS and _COMMENT_HEADING.fullmatch(line):
                        stop = max(stop, self.end[self.parent[e]])
                    if first >= stop or self.tags[e] == "h1":
                        found.append((line, tags - before, first, e))
                    before = tags
                pieces = []
            elif out[e]:
                before = tags
            else:
                if not pieces:
                    first = at
                pieces.append(text)
        return found


def smoothed(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel, "full")[reach : reach + len(ratio)] / weight


def threshold(values: np.ndarray) -> float:
    """The cut that leaves the least variance within the two groups; below all values if there is one group only."""
    v = np.sort(values)
    if v[0] == v[-1]:
        return v[0]
    n, sums = len(v), np.cumsum(v)
    k = np.arange(1, n)
    between = k * (n - k) * (sums[:-1] / k - (sums[-1] - sums[:-1]) / (n - k)) ** 2
    return v[int(np.argmax(between)) + 1]


def content_lines(lines) -> list[int]:
    """Numbers of the lines whose smoothed ratio of text to tags lies in the upper group."""
    ratio = smoothed(np.array([len(text) / max(tags, 1) for text, tags, _, _ in lines]))
    return np.flatnonzero(ratio >= threshold(ratio)).tolist()


def main_text(page: str) -> str:
    p = _Page()
    p.feed(page)
    p.close()
    p.finish()
    out = p.left_out()
    lines = whole = p.lines(out)
    if not lines:
        return ""
    bound = 0  # the element within which the region lies
    marked = p.inside([t in ARTICLE and not o for t, o in zip(p.tags, out, strict=True)])
    inside = [x for x in lines if marked[x[3]]]
    if 2 * sum(len(x[0]) for x in inside) >= sum(len(x[0]) for x in lines):
        lines = inside
        bound = 1
    content = content_lines(lines)
    first, last = lines[content[0]], lines[content[-1]]
    region = first[3]
    while region and not (p.begin[region] <= first[2] and last[2] < p.end[region]):
        region = p.parent[region]
    if bound:  # the marked article is the least that is returned
        while marked[region] and p.tags[region] not in ARTICLE:
            region = p.parent[region]
        if not marked[region]:
            region = 0
    elif first is last and region:  # one content line alone: its neighbours in the same parent belong to it
        region = p.parent[region]
    kept = [x for x in lines if p.begin[region] <= x[2] < p.end[region]]
    if not any(p.tags[x[3]] == "h1" for x in kept):
        title = next((x for x in whole if x[2] < kept[0][2] and p.tags[x[3]] == "h1"), None)
        kept = [title, *kept] if title else kept
    return "\n".join(x[0] for x in kept)


def _rows(texts):
    for page in texts:
        text = main_text(page)
        yield text, len(text)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``.

    Null and empty pages give an empty text, and so do pages without any text outside left-out elements.
    Pages are parsed whole where they lie, broken markup included; repeated rows give equal rows; null
    ids and urls are kept; an empty table gives an empty one; other columns are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("text"))
    out = per_text(rows, ["page_id", "url"], "main string, n_chars long", _rows)
    return out.withColumnRenamed("main", "text").select("page_id", "url", "text", "n_chars")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
