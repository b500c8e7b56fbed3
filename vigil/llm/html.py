"""Operator 6, HTML extraction: parser events, text-to-tag ratio per line, smoothing, clustering.

The standard library's streaming parser sends events; a line is the text between two block boundaries,
and its ratio is its characters of content over the tags met in it. Characters don't count as content in
elements that are boilerplate by their tag or role (menus, headers, footers, forms, scripts and so on),
nor in elements that a class or id names as boilerplate (``cookie-notice``, but not ``no-sidebar``)
where the text agrees: they hold less than half of the page's other text, or an article lies elsewhere.

Ratios are smoothed with a Gaussian along the page. Lines whose smoothed ratio reaches a threshold, half
the standard deviation of the smoothed ratios, form clusters of neighbours. The region is where the mass of the
clusters' ratios lies: from the page down, the element that holds nearly all of it, and its articles where they hold most
of that. So a tag only counts where the ratios agree: a story in a ``div`` wins over teasers and comments that are
articles, and small articles beside it are left out. A region's lines with a ratio above 0 are content however short they are, and so is a main
heading above it; but outside articles and ``main``, lines before the first and behind the last cluster are
content only if they are headings or have text that isn't a link.

White space within a line becomes one space; lines are trimmed and joined by two newlines. Time is linear
in the page, however deep its elements are nested.

Defined results: null and empty pages give an empty text; a page whose every line is boilerplate gives an
empty text; broken markup is read as far as the parser can; repeated rows are rows of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vigil.llm.storage import table

# HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section"
    " select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label menu nav noscript"
    " script search select style svg template textarea title video".split()
)
BOILERPLATE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
#: Start tags that end an open element of these, as HTML allows those end tags to be left out.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
SCOPES = frozenset(("ul", "ol", "dl", "table", "select", "menu"))
#: Elements within which a new block ends an open paragraph no further out.
HOLDERS = SCOPES | frozenset(("article", "main", "section", "div", "td", "body", "blockquote", "center"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that may hold a story, and how much of the mass above it one has to hold.
CONTAINERS = frozenset("page html body main article section div table tbody tr td center".split())
NEARLY_ALL = 0.85
#: An article beside a story with less of the mass is a teaser or a comment.
SMALL = 0.2

#: Chosen words. A class or id names boilerplate if one of its words is among these and all others are among ``NEUTRAL_WORDS``.
BOILERPLATE_WORDS = frozenset(
    "ad ads adsbox advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments"
    " commentlist consent cookie cookies copyright discussion disqus footer gdpr header masthead menu menus modal nav navbar"
    " navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion"
    " related replies respond share sharing sidebar sidenav signup skip social sponsor sponsored subscribe"
    " toolbar topbar widget widgets".split()
)
NEUTRAL_WORDS = frozenset(
    "area article articles bar block blog bottom box buttons container form global inline inner item items left link"
    " links list main message middle overlay page post posts primary reader right secondary section shell site slot"
    " sticky the thread top unit user wrap wrapper".split()
)
#: But not these within an article, where they hold its title.
TITLE_WORDS = frozenset(("header", "masthead", "banner"))
#: Elements that no class or id makes boilerplate.
KEPT_WHOLE = frozenset(("html", "body", "main", "article"))

_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0


def named_boilerplate(value: str, inside: bool) -> bool:
    """Whether a token of a class or id says boilerplate as a whole."""
    for token in value.split():
        found = set(_WORDS.findall(_CAMEL.sub(" ", token).lower()))
        named = found & BOILERPLATE_WORDS
        if named and found <= BOILERPLATE_WORDS | NEUTRAL_WORDS and not (inside and named <= TITLE_WORDS):
            return True
    return False


@dataclass(slots=True)
class Element:
    parent: int
    tag: str
    #: within an article or main
    inside: bool
    #: boilerplate by tag, role or as it isn't shown
    hidden: bool
    #: boilerplate by its class or id, if the text agrees
    suspect: bool = False


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    element: int
    #: all of its text lies in links
    linked: bool


class LineParser(HTMLParser):
    """Collects lines and elements; an element knows its parent, and children come after it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements = [Element(-1, "page", False, False)]
        #: open elements, and the places of each tag and of blocks among them
        self.stack: list[int] = [0]
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.text: list[str] = []
        self.free = False
        self.tags = 0

    def end_line(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                at = self.stack[-1]
                while self.elements[at].tag not in BLOCKS and at:
                    at = self.elements[at].parent
                self.lines.append(Line(text, max(1, self.tags), at, not self.free))
            self.text.clear()
        self.tags, self.free = 0, False

    def judge(self, element: Element, attrs: list[tuple[str, str | None]]) -> None:
        tag, inside = element.tag, element.inside
        if tag in BOILERPLATE or (tag == "header" and not inside):
            element.hidden = True
            return
        if tag in KEPT_WHOLE:
            return
        for name, value in attrs:
            if name in ("class", "id") and value:
                element.suspect = element.suspect or named_boilerplate(value, inside)
            elif name == "role":
                element.hidden = element.hidden or (value or "").lower() in BOILERPLATE_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                element.hidden = True
            elif name == "style" and value and re.search(r"display\s*:\s*none", value):
                element.hidden = True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag != "option":
                self.end_within("p", HOLDERS)
            for other in CLOSES.get(tag, ()):
                self.end_within(other, SCOPES)
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        above = self.elements[self.stack[-1]]
        element = Element(self.stack[-1], tag, above.inside or above.tag in ("article", "main"), above.hidden)
        if not element.hidden:
            self.judge(element, attrs)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(len(self.elements))
        self.elements.append(element)

    def cut(self, place: int) -> None:
        """Close the element at that place of the stack and all above it."""
        while len(self.stack) > place:
            tag = self.elements[self.stack.pop()].tag
            self.open[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def end_within(self, tag: str, barrier: frozenset[str]) -> None:
        places = self.open.get(tag)
        if places and all(not at or at[-1] < places[-1] for at in map(self.open.get, barrier)):
            self.cut(places[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        places = self.open.get(tag)
        # a stray end tag of an inline element doesn't close a block
        if places and (tag in BLOCKS or not self.blocks or self.blocks[-1] < places[-1]):
            self.cut(places[-1])

    def handle_data(self, data: str) -> None:
        if not self.elements[self.stack[-1]].hidden:
            self.text.append(data)
            self.free = self.free or (not self.open.get("a") and not data.isspace())


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Convolution with a Gaussian, normalised at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for at in range(len(values)):
        total = weight = 0.0
        for k in range(max(0, at - reach), min(len(values), at + reach + 1)):
            w = kernel[k - at + reach]
            total += w * values[k]
            weight += w
        out.append(total / weight)
    return out


def text_to_tag_ratios(lines: list[Line], elements: list[Element]) -> list[float]:
    """Characters of content over tags, for each line."""
    sizes = [0] * len(elements)
    articles = [0] * len(elements)
    for line in lines:
        sizes[line.element] += len(line.text)
    for k in range(len(elements) - 1, 0, -1):  # children before their parents
        element = elements[k]
        if element.tag in ("article", "main") and sizes[k] and not element.hidden:
            articles[k] += 1
        if not element.suspect:
            articles[element.parent] += articles[k]
        sizes[element.parent] += sizes[k]
    out_of = [e.hidden for e in elements]
    for k in range(1, len(elements)):
        element = elements[k]
        # an article within a suspect isn't counted above it, so these lie elsewhere
        weak = element.suspect and (2 * sizes[k] < sizes[0] or (articles[0] > 0 and not articles[k]))
        out_of[k] = out_of[k] or out_of[element.parent] or weak
    return [0.0 if out_of[line.element] else len(line.text) / line.tags for line in lines]


def content_threshold(ratios: list[float]) -> float:
    """Half the standard deviation of smoothed ratios."""
    mean = sum(ratios) / len(ratios)
    return math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)) / 2


def content_clusters(ratios: list[float]) -> list[tuple[int, int]]:
    """Runs (first, last) of neighbouring lines whose smoothed ratio reaches the threshold."""
    smooth = smoothed(ratios)
    least = content_threshold(smooth)
    found: list[tuple[int, int]] = []
    for k, (ratio, average) in enumerate(zip(ratios, smooth, strict=True)):
        if ratio > 0 and average >= least:
            if found and found[-1][1] == k - 1:
                found[-1] = found[-1][0], k
            else:
                found.append((k, k))
    return found


def trimmed(clusters: list[tuple[int, int]], lines: list[Line], ratios: list[float]) -> list[tuple[int, int]]:
    """Clusters without link lines at their ends that only smoothing lifts over the threshold; all of them if nothing is left."""
    least = content_threshold(smoothed(ratios))
    found = []
    for first, last in clusters:
        while first <= last and lines[first].linked and ratios[first] < least:
            first += 1
        while first <= last and lines[last].linked and ratios[last] < least:
            last -= 1
        if first <= last:
            found.append((first, last))
    return found or clusters


@dataclass
class Region:
    """Elements that hold the content, whether they are articles or main, an element that all of them lie in, and what to leave out."""

    elements: set[int]
    marked: bool
    within: int
    without: set[int] = field(default_factory=set)


def content_region(lines: list[Line], elements: list[Element], ratios: list[float], clusters: list[tuple[int, int]]) -> Region:
    """Where most of the clusters' ratios lie.

    From the page down, the child that holds nearly all of an element's mass takes its place, until there is none or an
    article or main is reached. Articles within that element are the regions if they hold most of its mass; teasers and
    comments beside a story don't, so then the element itself is.
    """
    mass, count = [0.0] * len(elements), [0] * len(elements)
    for first, last in clusters:
        for k in range(first, last + 1):
            mass[lines[k].element] += ratios[k]
            count[lines[k].element] += ratios[k] > 0
    heaviest = [0] * len(elements)
    for k in range(len(elements) - 1, 0, -1):  # children before their parents
        above = elements[k].parent
        mass[above] += mass[k]
        count[above] += count[k]
        if mass[k] > 0 and (not heaviest[above] or mass[k] >= mass[heaviest[above]]):
            heaviest[above] = k
    at = 0
    while (below := heaviest[at]) and elements[at].tag not in ("article", "main"):
        whole = count[below] == count[at]
        tag = elements[below].tag
        nearly = whole or (tag != "article" and count[below] >= 2 and mass[below] >= NEARLY_ALL * mass[at])
        if tag not in CONTAINERS or not nearly:  # one article among others doesn't stand for them
            break
        at = below
    if elements[at].tag == "article":
        return Region({at}, True, at)
    article = [0] * len(elements)  # the outermost one below ``at``
    inside = [False] * len(elements)
    for k in range(len(elements)):
        above = elements[k].parent
        inside[k] = k == at or (above >= 0 and inside[above])
        if inside[k] and k != at:
            article[k] = article[above] or (k if elements[k].tag == "article" else 0)
    articles = {k for k in range(1, len(elements)) if article[k] == k}
    held = {k for k in articles if mass[k] > 0}
    if held and 2 * sum(mass[k] for k in held) >= mass[at]:
        return Region(held, True, at)
    small = {k for k in articles if mass[k] < SMALL * mass[at]}
    return Region({at}, elements[at].tag == "main", at, small)


def content_lines(lines: list[Line], elements: list[Element]) -> list[str]:
    if not lines:
        return []
    ratios = text_to_tag_ratios(lines, elements)
    clusters = trimmed(content_clusters(ratios), lines, ratios)
    if not clusters:
        return []
    region = content_region(lines, elements, ratios, clusters)
    within = [False] * len(elements)
    main = [0] * len(elements)  # the outermost main that an element lies in
    for k, e in enumerate(elements):
        within[k] = k not in region.without and (k in region.elements or (k > 0 and within[e.parent]))
        main[k] = k and (main[e.parent] or (k if e.tag == "main" else 0))
    own = [k for first, last in clusters for k in range(first, last + 1) if within[lines[k].element] and ratios[k] > 0]
    first, last = own[0], own[-1]
    mains = {main[k] for k in region.elements} - {0}
    above = set()  # elements that the region lies in
    at = region.within
    while at:
        at = elements[at].parent
        above.add(at)
    out = []
    for k, (line, ratio) in enumerate(zip(lines, ratios, strict=True)):
        if ratio <= 0:
            continue
        e = elements[line.element]
        if within[line.element]:
            if region.marked or first <= k <= last or e.tag in HEADINGS or not line.linked:
                out.append(line.text)
        elif e.tag == "h1" and k < first and (main[line.element] in mains if region.marked else e.parent in above):
            out.append(line.text)
    return out


def extract_text(html: str) -> str:
    parser = LineParser()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return "\n\n".join(content_lines(parser.lines, parser.elements))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    rows = pages.selectExpr(f"`{page_id}` AS page_id", f"`{url}` AS url", f"CAST(`{html}` AS STRING) AS html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))
