"""Main text of web pages.

The standard library's streaming parser turns a page into lines (one per block element). Each line has a text-to-tag ratio: its
characters outside links over its tags. The ratios are smoothed with a Gaussian and cut by a threshold into content and other
lines, and these decide what is kept. Tags, roles, classes and ids only weigh the ratios: a line in an element that never holds
article text (menu, header, footer, sidebar, advert, form, reader comments, ...) weighs nothing, one in an element whose name only
hints at that (``promo-history``) a little less, and one outside the article or main element that holds most of the content a quarter.

The core is that article or main element, or else the smallest container of nearly all content lines. It is kept as a whole, so that
short paragraphs between long ones stay, without the marked elements that are mostly not content lines. Outside the core, the
content lines of elements that are mostly content are kept.

Cases: null, empty and markup-free html are defined (empty text; the plain text). Repeated rows give repeated rows.
Unclosed and stray tags are tolerated. ``<br>`` inside a block counts as white space. Other columns are not used. The work
grows in proportion to the page, however deep or wide it is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements that are tracked as open; the others (p, li, b, ...) are often left unclosed and need no tracking.
CONTAINERS = frozenset(
    "article aside blockquote body div details dialog fieldset figure footer form header main nav ol section table template ul menu "
    "noscript svg math iframe object audio video canvas button select textarea label head title span dl search script style".split()
)
#: Elements whose text is not shown, or stands inside a line without being part of it.
INVISIBLE = frozenset("head title script style template noscript svg math iframe object audio video canvas button select textarea label".split())
#: Elements that never hold article text.
NEVER = frozenset("nav header footer aside form dialog menu search fieldset".split())
#: What an article or main element closes, if it was left open around it.
YIELDING = frozenset("nav header form fieldset head title button label select".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar status toolbar".split())
MARKED = re.compile(
    r"(nav|navbar|navigation|menu\w*|breadcrumbs?|masthead|header|footer\w*|sidebar\w*|ads?|adv|advert\w*|adbox|adslot|banner\w*|"
    r"sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification\w*|alert|popup|modal|newsletter|subscribe\w*|signup|login|"
    r"share|sharing|social\w*|related|recommend\w*|widget\w*|comment\w*|disqus|respond|repl(y|ies)|pagination|pager|toolbar|copyright)"
)
NEGATING = frozenset("no has with without hide non not".split())
#: Words beside a mark that say where or how an element stands; others may give the mark another sense.
PLACING = frozenset(
    "main top bottom left right center inner outer upper lower first last wrapper wrap container content contents box block section area "
    "list item items link links bar row col column columns panel group site page post posts article articles story entry global primary secondary "
    "sticky fixed desktop mobile small large mini big full btn button buttons icon icons text title body form input field count thread reply user "
    "new more view unit slot space zone region overlay inline widget web view card cards media nav".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Weights of lines in elements with a hint, and outside of the core.
HINT, OUTSIDE = 0.7, 0.25


def evidence(attrs: dict[str, str | None]) -> float:
    """Weight of an element's lines by its role, class and id: 1, ``HINT`` where a mark stands beside a word of its own, 0 where marked."""
    if (attrs.get("role") or "").lower() in ROLES:
        return 0.0
    weight = 1.0
    for name in ("class", "id"):
        for value in (attrs.get(name) or "").split():
            words = [w.lower() for w in WORD.findall(value)]
            marks = [bool(MARKED.fullmatch(w)) and (k == 0 or words[k - 1] not in NEGATING) for k, w in enumerate(words)]
            if any(marks):
                if all(m or w in PLACING or len(w) <= 2 or w.isdigit() and len(w) <= 3 for w, m in zip(words, marks)):
                    return 0.0
                weight = HINT
    return weight


def hidden(attrs: dict[str, str | None]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style") or ""))


class PageLines(HTMLParser):
    """Collects lines ``(text, tags, container, link characters)`` from the parser's events, and of each container its parent, kind and weight."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parents, self.kinds, self.weights = [-1], ["root"], [1.0]
        #: open elements: tag, container, whether its text is skipped; and how many there are of each tag
        self.open: list[tuple[str, int, bool]] = []
        self.counts: dict[str, int] = {}
        self.skipped = self.yielding = self.tags = self.links = self.linked = 0
        self.parts: list[str] = []

    def cut(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.tags, self.open[-1][1] if self.open else 0, self.linked))
                self.tags = 0
            self.parts, self.linked = [], 0

    def push(self, tag: str, kind: str, weight: float, skip: bool) -> None:
        up = self.open[-1][1] if self.open else 0
        self.parents.append(up)
        self.kinds.append(kind)
        self.weights.append(weight * self.weights[up])
        self.open.append((tag, len(self.kinds) - 1, skip))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.skipped += skip
        self.yielding += tag in YIELDING

    def pop(self, upto: int) -> None:
        while len(self.open) > upto:
            tag, _, skip = self.open.pop()
            self.counts[tag] -= 1
            self.skipped -= skip
            self.yielding -= tag in YIELDING

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
            if self.open and self.open[-1][0] in ("p", "li"):
                self.pop(len(self.open) - 1)
        elif tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links += 1
        elif tag in CONTAINERS:
            if tag in ("article", "main") and self.yielding:
                self.pop(next(k for k, (kind, _, _) in enumerate(self.open) if kind in YIELDING))
            named = dict(attrs)
            weight = 0.0 if tag in NEVER else evidence(named) if attrs and tag not in ("body", "main") else 1.0
            # a marked element inside a line is not part of it
            skip = tag in INVISIBLE or bool(attrs) and tag not in ("body", "main") and hidden(named) or not weight and tag not in BLOCKS
            if skip and tag not in BLOCKS and tag not in ("script", "style"):
                self.parts.append(" ")
            self.push(tag, "main" if named.get("role") == "main" else tag, weight, skip)
        elif tag in ("p", "li") and attrs and ((weight := evidence(named := dict(attrs))) < 1 or hidden(named)):
            # a paragraph marked as a notice ends with itself
            self.push(tag, tag, weight, hidden(named))

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if tag == "a":
            self.links = max(0, self.links - 1)
        if not self.counts.get(tag):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.pop(k)
                break
            if self.open[k][0] in ("article", "main", "table") and tag in ("p", "li", "span", "div", "ul", "ol"):
                break

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(values: list[float], sigma: float, weights: list[float] | None = None) -> list[float]:
    """Gaussian means of neighbouring values, each as much as it weighs; 0 where no neighbour weighs anything."""
    r = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(j * j) / (2 * sigma * sigma)) for j in range(-r, r + 1)]
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for j in range(max(-r, -i), min(r, n - 1 - i) + 1):
            own = kernel[j + r] * (weights[i + j] if weights else 1.0)
            total += values[i + j] * own
            weight += own
        out.append(total / weight if weight else 0.0)
    return out


def content_lines(lines: list[tuple[str, int, int, int]], sigma: float = 1.0, weights: list[float] | None = None) -> list[bool]:
    """Lines whose smoothed text-to-tag ratio, times their weight, reaches the threshold (the smaller of mean and deviation of these)."""
    weights = weights or [1.0] * len(lines)
    ratios = [(len(t) - linked) / max(1, tags) for t, tags, _, linked in lines]
    flat = [x * w for x, w in zip(smoothed(ratios, sigma, weights), weights)]
    own = [x for x, w in zip(flat, weights) if w] or [0.0]
    mean = sum(own) / len(own)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in own) / len(own))
    threshold = min(mean, deviation) if deviation > 0 else mean
    return [w > 0 and x >= threshold for x, w in zip(flat, weights)]


class Masses:
    """Characters of each container with all below it: ``total``, ``weighty`` (in lines with a weight) and ``dense`` (of content lines, without links)."""

    def __init__(self, page: PageLines, content: list[bool]) -> None:
        count = len(page.kinds)
        self.total, self.weighty, self.dense = [0] * count, [0] * count, [0] * count
        for (text, _, at, linked), is_content in zip(page.lines, content):
            self.total[at] += len(text)
            self.weighty[at] += len(text) * (page.weights[at] > 0)
            self.dense[at] += max(0, len(text) - linked) * is_content
        for mass in (self.total, self.weighty, self.dense):
            for k in range(count - 1, 0, -1):  # parents come before their children
                mass[page.parents[k]] += mass[k]


def inside(parents: list[int], nodes: set[int]) -> list[bool]:
    """Whether each container is one of ``nodes`` or below one."""
    out = []
    for k, up in enumerate(parents):
        out.append(k in nodes or up >= 0 and out[up])
    return out


def tagged_core(page: PageLines, masses: Masses) -> set[int] | None:
    """The article or main elements, if they hold most of the content: the inner ones if these do, else the outer ones."""

    def outermost(kind: str) -> list[int]:
        every = {k for k, x in enumerate(page.kinds) if x == kind and masses.weighty[k]}
        below = inside(page.parents, every)
        return [k for k in sorted(every) if not below[page.parents[k]]]

    def dense_of(nodes: list[int]) -> list[int]:
        """Without those of which hardly anything is content, such as lists of links."""
        return [k for k in nodes if masses.dense[k] and 10 * masses.dense[k] >= masses.weighty[k]]

    mains = dense_of(outermost("main"))
    below = inside(page.parents, set(mains))
    articles = dense_of([k for k in outermost("article") if below[k] or not mains])
    return next((set(nodes) for nodes in (articles, mains) if 2 * sum(masses.dense[k] for k in nodes) > masses.dense[0]), None)


def smallest_core(page: PageLines, masses: Masses) -> set[int]:
    """The smallest container that holds nearly all content lines and most of the text of the one around it."""
    children: list[list[int]] = [[] for _ in page.kinds]
    for k, up in enumerate(page.parents[1:], 1):
        children[up].append(k)
    at, mass = 0, masses.dense[0]
    while mass:
        below = next((k for k in children[at] if masses.dense[k] >= 0.9 * mass and masses.weighty[k] >= 0.8 * masses.weighty[at]), None)
        if below is None:
            break
        at = below
    return {at}


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Blocks of the article in page order, joined by one newline."""
    if not html:
        return ""
    page = PageLines()
    page.feed(html)
    page.close()
    page.cut()
    lines, parents = page.lines, page.parents
    if not lines:
        return ""
    weights = [page.weights[x[2]] for x in lines]
    masses = Masses(page, content_lines(lines, sigma, weights))
    core = tagged_core(page, masses)
    tagged = core is not None
    core = core if tagged else smallest_core(page, masses)
    within = inside(parents, core)
    # what is outside the core has to stand out more; the lines are told again
    content = content_lines(lines, sigma, [w if within[x[2]] or not tagged else w * OUTSIDE for x, w in zip(lines, weights)])
    masses = Masses(page, content)
    minor = [2 * d < t for d, t in zip(masses.dense, masses.total)]
    marked = {k for k, up in enumerate(parents) if k and page.weights[k] < page.weights[up] and minor[k]}
    holding = {0}
    for k in core:
        while k not in holding:
            holding.add(k)
            k = parents[k]
    # elements beside the core, of which hardly half is content
    beside = {k for k, up in enumerate(parents) if up in holding and k not in holding and not within[k] and minor[k]}
    dropped = inside(parents, marked | beside)
    kept = [(x, c) for x, c in zip(lines, content) if not dropped[x[2]] and (within[x[2]] or c)]
    # rows of links at the edges of the region are menus without a mark
    edge = lambda x: x[0][3] >= 0.8 * len(x[0][0]) and not x[1]
    first, last = 0, len(kept)
    if not tagged and any(not edge(x) for x in kept):
        while edge(kept[first]):
            first += 1
        while edge(kept[last - 1]):
            last -= 1
    return "\n".join(x[0] for x, _ in kept[first:last])


def extract_pages(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``; no shuffle."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, name="html"):
            out = [main_text(h, sigma) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema=schema)

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
