"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser turns a page into lines, one a block, each with its text, its tags, the containers it lies in,
whether an element about it is no content by its name (`nav`, `form`) or hidden, and its trust: names in class, id, role or label
that are usual for boilerplate lower it. The ratio of text to tags per line, times its trust, is smoothed with a Gaussian; lines above a
threshold form content clusters, a line of lower trust only by a ratio of its own. The clusters select the region: the articles if
these hold half of the clusters' text, else the main part if it does, else the deepest container that holds them all. Within it
lines of full trust stay, and those of lower trust that are content; beside articles, lines of nothing but links before the first and
after the last cluster do not. Without a cluster there is no text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices, text_or_empty

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_CONTENT = set(
    "script style noscript template head title svg math iframe object canvas audio video map select datalist button textarea form "
    "fieldset nav menu aside footer header dialog".split()
)
REGIONS = set("article main section div td body center".split())
#: Words in class, id, role or aria-label by which an element is likely to be no part of the article, and the trust that is left.
LIKELY, UNSURE = 0.05, 0.5
MARKS = dict.fromkeys(
    "nav navbar menubar breadcrumb breadcrumbs sidebar sidebars footer masthead ad ads adv advert adverts advertisement advertising adbox sponsor "
    "sponsored promo promos promoted cookie cookies consent gdpr popup modal newsletter signup comment comments commentlist disqus toolbar "
    "pager copyright contentinfo".split(),
    LIKELY,
) | dict.fromkeys(
    "navigation menu header topbar banner promotion notice notices alert overlay subscribe subscription login share sharing social related "
    "recommended recommendations reply replies respond pagination disclaimer search complementary hidden".split(),
    UNSURE,
)
#: An article is distrusted only as a comment; its own class may name a theme.
COMMENT_MARKS = {"comment", "comments", "commentlist", "disqus", "reply", "replies"}
HEADINGS = {"h1", "h2", "h3"}
#: Elements that an opening block ends.
CLOSED_BY_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
OPEN_TAG = re.compile(r"<[a-zA-Z/!?]")
WORDY = re.compile(r"[^\W_]")


@dataclass
class Line:
    pieces: list[str] = field(default_factory=list)
    tags: int = 0
    region: int = -1
    boiler: bool = False
    trust: float = 1.0
    heading: bool = False
    #: Has letters or digits outside links.
    prose: bool = False
    text: str = ""


def unseen(attrs: dict) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()


def trust(tag: str, attrs: dict) -> float:
    """How far the attributes let an element be content."""
    names = " ".join(attrs.get(k) or "" for k in ("class", "id", "role", "aria-label"))
    if not names or tag in ("html", "body", "main"):
        return 1.0
    words = set(SPLIT.split(CAMEL.sub(" ", names).lower()))
    if tag == "article":
        return LIKELY if words & COMMENT_MARKS else 1.0
    return min((MARKS[w] for w in words if w in MARKS), default=1.0)


class PageLines(HTMLParser):
    """Collects lines; `stack` holds the open elements as (tag, boilerplate about here, trust, innermost region, in an article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, float, int, bool]] = []
        self.open: dict[str, int] = {}
        #: Tag of each region and the region about it, numbered as they open.
        self.regions: list[str] = []
        self.about: list[int] = []
        self.lines: list[Line] = []
        self.line = Line()
        #: How far from the end of the page the last comment and the last marked section close.
        self.closed = {"<!--": 0, "<![": 0}

    def unclosed(self, start: str, i: int) -> bool:
        return self.rawdata.startswith(start, i) and len(self.rawdata) - i <= self.closed[start]

    def parse_comment(self, i, report=True):
        """What nothing closes is cut at the next ">", instead of a search to the end of the page for each."""
        return self.parse_bogus_comment(i) if self.unclosed("<!--", i) else super().parse_comment(i, report)

    def parse_marked_section(self, i, report=True):
        return self.parse_bogus_comment(i) if self.unclosed("<![", i) else super().parse_marked_section(i, report)

    def state(self):
        return self.stack[-1][1:] if self.stack else (False, 1.0, -1, False)

    def end_line(self, heading: bool = False):
        if self.line.pieces:
            self.line.text = " ".join("".join(self.line.pieces).split())
        if self.line.text:
            self.line.pieces = []
            self.lines.append(self.line)
        tags = 0 if self.line.text else self.line.tags
        boiler, share, region, _ = self.state()
        self.line = Line([], tags, region, boiler, share, heading)

    def pop_to(self, tag: str):
        """Closes elements up to and with the last open one of this name."""
        while self.stack:
            name = self.stack.pop()[0]
            self.open[name] -= 1
            if name == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.line.tags += 1
            if tag in ("br", "hr"):
                self.line.pieces.append(" ")
            return
        inline = tag in INLINE
        if not inline:
            if self.open.get("p") and tag != "p":
                self.close_paragraph()
            if tag in CLOSED_BY_ITSELF and self.stack and self.open.get(tag):
                near = next((name for name, *_ in reversed(self.stack) if name == tag or name in ("ul", "ol", "dl", "table", "select") or name in REGIONS and name != "td"), None)
                if near == tag:
                    self.pop_to(tag)
        boiler, share, region, article = self.state()
        attrs = dict(attrs)
        # a header of an article keeps its headings
        own = (tag in NO_CONTENT and not (tag == "header" and article)) or unseen(attrs)
        less = min(share, trust(tag, attrs))
        if tag in REGIONS:
            self.about.append(region)
            region = len(self.regions)
            self.regions.append(tag)
        self.stack.append((tag, boiler or own, less, region, article or tag == "article"))
        self.open[tag] = self.open.get(tag, 0) + 1
        if inline and not own and less == share:
            self.line.tags += 1
        else:
            self.end_line(tag in HEADINGS)
            self.line.tags += 1

    def close_paragraph(self):
        for name, *_ in reversed(self.stack):
            if name == "p":
                return self.pop_to("p")
            if name in REGIONS or name in ("li", "td", "table"):
                return None
        return None

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.line.tags += 1

    def handle_endtag(self, tag):
        if self.open.get(tag):
            own = self.stack[-1]
            self.pop_to(tag)
            if tag not in INLINE or own[1:3] != self.state()[:2]:
                self.end_line()
                return
        self.line.tags += 1

    def handle_data(self, data):
        self.line.pieces.append(data)
        if not self.line.prose and not self.open.get("a"):
            self.line.prose = WORDY.search(data) is not None


def page_lines(html: str) -> PageLines:
    parser = PageLines()
    # at once, as after a part an open tag would be read again from its start; behind the last ">" no tag is whole: its text ends there
    end = html.rfind(">") + 1
    for start, close in (("<!--", "-->"), ("<![", "]]>")):
        parser.closed[start] = end - max(0, html.rfind(close, 0, end))
    parser.feed(html[:end])
    parser.close()
    parser.handle_data(unescape(OPEN_TAG.split(html[end:], maxsplit=1)[0]))
    parser.end_line()
    return parser


def content_lines(lines: list[Line], sigma: float = 1.0, level: float = 0.5) -> np.ndarray:
    """Which lines lie in a content cluster: smoothed text-to-tag ratio of at least `level` standard deviations, boilerplate never.

    A line of lower trust than the page's best must reach it without its neighbours, too.
    """
    shares = np.array([x.trust for x in lines])
    ratio = np.array([0.0 if x.boiler else x.trust * len(x.text) / max(1, x.tags) for x in lines])
    reach = np.arange(-3, 4)
    weights = np.exp(-0.5 * (reach / sigma) ** 2)
    smooth = np.convolve(np.pad(ratio, 3, mode="edge"), weights / weights.sum(), mode="valid")
    good = np.array([not x.boiler for x in lines])
    least = min(level * smooth.std() + 1e-9, smooth.max())
    best = shares[good].max(initial=0)
    return good & (smooth >= least) & ((shares == best) | (ratio >= least)) & (ratio > 0)


def main_text(html: str | None, sigma: float = 1.0, level: float = 0.5) -> str:
    """The article's blocks, joined by one space; empty if the page has none."""
    page = page_lines(html or "")
    lines = page.lines
    content = content_lines(lines, sigma, level) if lines else np.zeros(0, bool)
    if not content.any():
        return ""
    sizes = np.array([x.trust * len(x.text) for x in lines])
    # smoothing may draw a menu beside the article into a cluster, which must not widen the region
    sure = content & np.array([x.prose for x in lines])
    sure = sure if sure.any() else content
    held = {name: np.zeros(len(page.regions) + 1) for name in ("content", "sure", "prose")}  # the last is for lines in none
    where = np.array([x.region for x in lines])
    for name, mask in (("content", content), ("sure", sure), ("prose", np.array([x.prose and not x.boiler for x in lines]))):
        np.add.at(held[name], where[mask], sizes[mask])
        for r in range(len(page.regions) - 1, -1, -1):  # a region is numbered after the one about it
            held[name][page.about[r]] += held[name][r] if page.about[r] >= 0 else 0
    needed, total = sizes[sure].sum(), sizes[content].sum()

    def within(chosen: set[int]) -> list[int]:
        """Lines in a chosen region that are no boilerplate and have full trust or are content."""
        inside: list[bool] = []
        for r in range(len(page.regions)):
            inside.append(r in chosen or page.about[r] >= 0 and inside[page.about[r]])
        best = max((x.trust for x, yes in zip(lines, content, strict=True) if yes), default=1.0)
        return [k for k, x in enumerate(lines) if not x.boiler and (not chosen or x.region >= 0 and inside[x.region]) and (content[k] or x.trust >= best)]

    for kind in ("article", "main"):
        own = {r for r, tag in enumerate(page.regions) if tag == kind and (held["sure"][r] or held["prose"][r])}
        outer = [r for r in own if not any(a in own for a in above(page.about, r))]
        if 2 * sum(held["sure"][r] for r in outer) >= needed:
            return " ".join(lines[k].text for k in within(own))
    deep = max((r for r in range(len(page.regions)) if held["sure"][r] >= (1 - 1e-9) * needed and held["content"][r] >= 0.7 * total), default=None)
    own = within(set() if deep is None else {deep})
    hits = [k for k in own if content[k]]
    first, last = hits[0], hits[-1]
    before = [k for k in own if k < first and lines[k].heading]
    return " ".join(lines[k].text for k in own if first <= k <= last or lines[k].prose or k in before[-1:])


def above(about: list[int], r: int):
    while (r := about[r]) >= 0:
        yield r


def main_texts(pages: DataFrame, html: str = "html", **settings) -> DataFrame:
    """`page_id, url, text, n_chars` per row, in one pass without a shuffle. Null html gives an empty text; rows that repeat stay.

    A page is held whole by its task and read once, so time grows with its length, unclosed tags included. Other columns are not read.
    """

    def run(batches):
        for b in slices(batches):
            texts = [main_text(t, **settings) for t in b["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", text_or_empty(html).alias("t"))
    return rows.mapInArrow(run, rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
