"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, threshold clustering.

Events of the standard library's streaming parser are cut into lines, one per block element.  The
text-to-tag ratio of the lines is smoothed by a Gaussian and split into two clusters; regions of the
page (an article or main element, else the container around a line) that hold a line of the upper
cluster are content.  A page's other articles are content with one of them.  A region outside articles grows to its
outermost container below the body, so that short paragraphs in wrappers of their own stay, and takes in the body's
lines between regions and the headings before them; parts that are mostly links stay out.
All lines of a region are returned, short ones too, except those inside elements that are boilerplate by
name, role or class.

Defined results: a null, empty or text-free page gives an empty text; unclosed and misnested elements
are closed as far as the open elements tell; repeated rows give repeated rows; ids may be null; an empty table gives
an empty table; pages of any length are read whole; extra columns of any name are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from loadcurve.llm.columns import picked, type_of

SIGMA = 1.0
# Names of HTML elements and of usual page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
# Elements that open a region; headings, lists, quotes and tables lie in the region of their container.
CONTAINERS = frozenset("html body center div section".split())
FURNITURE = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form head iframe menu nav noscript object script "
    "select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CLASSES = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related "
    "share sharing sidebar social sponsor sponsored subscribe topbar widget".split()
)
# Words that make a compound with those above, such as site-footer or share-buttons.
COMPOUNDS = frozenset(
    "area articles bar block body bottom box button buttons container content cta footer form global group header icons inner item "
    "items left link links list main media message module overlay page panel post posts primary reader right row secondary section "
    "signup site slot text thread title top unit user wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that a start tag of the same kind ends.
ENDS = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}),
        "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
        "option": frozenset({"option"})}


def is_furniture_name(name: str) -> bool:
    """A class or id that is furniture as a whole: ``ad``, ``site-footer``, ``ad_slot_2``, but not ``ad-free-text``."""
    parts = [p for p in name.replace("_", "-").split("-") if p and not p.isdigit()]
    return not CLASSES.isdisjoint(parts) and all(p in CLASSES or p in COMPOUNDS for p in parts)


def is_furniture(tag: str, attrs: list, in_article: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_article):
        return True
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return True
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main", "article"):
            if any(is_furniture_name(word) for word in value.lower().split()):
                return True
    return False


class Open(NamedTuple):
    """An open element and what holds inside it."""

    name: str
    furniture: bool
    region: int
    in_article: bool
    in_link: bool
    in_heading: bool


class Line(NamedTuple):
    text: str
    tags: int
    region: int
    furniture: bool
    linked: int  # characters inside links
    heading: bool


class Lines(HTMLParser):
    """Collects a line per block, and the regions that lines lie in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = self.elements = 0
        self.open = [Open("", False, 0, False, False, False)]
        self.parents: dict[int, int] = {}  # of the regions, by number; 0 is the page
        self.articles: set[int] = set()
        self.pages = {0}  # regions of the page as a whole

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            at = self.open[-1]
            self.lines.append(Line(text, self.tags, at.region, at.furniture, self.linked, at.in_heading))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS or tag in FURNITURE:
            self.end_line()
        if tag in VOID:
            return
        if tag in BLOCKS and tag not in ENDS and self.open[-1].name == "p":
            self.open.pop()
        if tag in ENDS:
            self.close_siblings(ENDS[tag])
        self.elements += 1
        at = self.open[-1]
        region, article = at.region, tag in ("article", "main") or ("role", "main") in attrs
        if not at.in_article and (article or tag in CONTAINERS):
            region = self.elements
            self.parents[region] = at.region
            if article:
                self.articles.add(region)
            elif tag in ("html", "body"):
                self.pages.add(region)
        furniture = at.furniture or is_furniture(tag, attrs, at.in_article)
        self.open.append(Open(tag, furniture, region, at.in_article or article, at.in_link or tag == "a", at.in_heading or tag in HEADINGS))

    def close_siblings(self, names: frozenset[str]) -> None:
        """End an open element of these names unless another block stands between."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                del self.open[k:]
                return
            if self.open[k].name in BLOCKS or self.open[k].name in FURNITURE:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in FURNITURE or tag not in BLOCKS):
            self.handle_endtag(tag)  # blocks of prose stay open, as the standard has it
            self.tags -= 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in FURNITURE:
            self.end_line()
        if tag in VOID:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return
            if tag not in BLOCKS and tag not in FURNITURE and self.open[k].name in BLOCKS:
                return  # an inline end tag does not close blocks

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.open[-1].in_link:
            self.linked += len(data)


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(w, values[i + k]) for k, w in zip(range(-reach, reach + 1), weights) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """The border of two clusters, moved to the middle of their means until it rests."""
    border = sum(values) / len(values)
    for _ in range(50):
        low = [v for v in values if v < border]
        high = [v for v in values if v >= border]
        if not low or not high:
            break
        moved = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(moved - border) < 1e-9:
            break
        border = moved
    return border


def content_lines(parser: Lines, chosen: set[int]) -> list[Line]:
    """Lines with text outside furniture that belong to the chosen regions, or that these grow to."""
    lines = [line for line in parser.lines if line.text and not line.furniture]
    if not chosen:
        return lines
    if chosen & parser.articles:
        chosen = chosen | parser.articles

    def top(region: int) -> int:
        """The outermost container below the page as a whole; an article, and the page, are their own."""
        while region not in parser.pages and region not in parser.articles and parser.parents[region] not in parser.pages:
            region = parser.parents[region]
        return region

    def linked(some: list[Line]) -> bool:
        return 2 * sum(line.linked for line in some) > sum(len(line.text) for line in some)

    of_region: dict[int, list[Line]] = {}
    for line in lines:
        of_region.setdefault(line.region, []).append(line)
    grown = {top(r) for r in chosen - parser.articles - parser.pages}
    inside = [r in chosen or (top(r) in grown and not linked(some)) for r, some in of_region.items()]
    kept = {r for r, found in zip(of_region, inside) if found}
    at = [i for i, line in enumerate(lines) if line.region in kept]
    if not at or chosen & parser.articles:
        return [lines[i] for i in at]
    # lines of the page between the regions, and headings right before them
    first, last = at[0], at[-1]
    while first > 0 and lines[first - 1].heading and not linked(of_region[lines[first - 1].region]):
        first -= 1
    return [line for line in lines[first : last + 1] if line.region in kept or not linked(of_region[line.region])]


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not any(line.text and not line.furniture for line in lines):
        return ""
    ratios = smoothed([0.0 if line.furniture else len(line.text) / max(1, line.tags) for line in lines], sigma)
    border = threshold(ratios)
    chosen = {line.region for line, r in zip(lines, ratios) if line.text and not line.furniture and r >= border}
    return "\n".join(line.text for line in content_lines(parser, chosen))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            chars = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), chars]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    source = picked(pages, page_id=id_col, url=url_col, html=html_col)
    return source.mapInArrow(run, f"page_id {type_of(source, 'page_id')}, url string, text string, n_chars long")
