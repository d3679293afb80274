"""Main text of web pages (operator 12).

The standard library's parser gives events, of which no tree is built: a stack of open elements says what a text belongs to. Texts
between the borders of blocks are lines. A line in a menu, header, footer, sidebar, notice, advert, form or among comments,
by element, role, class or id, is out. Of the others, each has a text-to-tag ratio: its characters outside links over its tags. The ratios are
smoothed with a Gaussian, a threshold between their two clusters tells content from the rest, and the smallest element
with nearly all content lines is the region: an article's lines are kept whole; of other regions the
lines between the first and the last content line, but for parts that are mostly links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements without text of their own, with what is in them.
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title select option datalist textarea button".split())
#: Elements that aren't article text.
BESIDE = frozenset("nav aside footer menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that an open paragraph ends at.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: What a start tag ends, if it is open and inside the nearest of the second.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)), "thead": (("caption",), ("table",)), "tfoot": (("thead", "tbody"), ("table",)), "body": (("head",), ()),
}
SCOPE = frozenset("table td th caption html".split())
#: Elements of running text, which may follow a region's last content line.
PROSE = frozenset("p ul ol dl blockquote pre".split())
#: Words of roles, classes and ids.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
AWAY = COMMENTS | frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
    "widgets pagination pager toolbar skip copyright legal disclaimer".split()
)
ARTICLE = frozenset("article articlebody post content entry main story body text maincontent".split())
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMENT_END = re.compile(r"--!?>")
#: Shares: of the content lines' characters that a region holds, and of a page's that is too much for a class to take away.
MOST, WHOLE = 0.9, 0.6


def _away(tag: str, attrs: list, in_article: bool) -> bool:
    """Whether an element's role, class or id says that it isn't article text."""
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return True
        elif name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "hidden" or name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value == "true":
            return True
        elif name in ("class", "id"):
            for part in value.split():
                names = [x.lower() for x in _NAMES.findall(part)]
                found = [x for x in names if x in AWAY]
                if found and not (in_article and found == ["header"]) and (names[-1] in AWAY or not ARTICLE.intersection(names)):
                    return True
    return False


class Lines(HTMLParser):
    """The lines of a page: texts, with tags and characters in links, and the element that each is in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, box, silent, beside, link.
        self.stack: list[tuple] = [("html", 0, False, False, False)]
        self.open: dict[str, list[int]] = {}
        self.borders: list[int] = [0]  # places of block elements
        self.scopes: list[int] = [0]
        #: Elements that lines can be in: the one around it, whether class or role take it away, its tag, whether it is an article.
        self.boxes: list[tuple] = [(-1, False, "html", False)]
        self.lines: list[tuple] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.articles = 0
        self.cut = False  # by a comment without an end

    # Declarations of any kind and comments have no text; what isn't closed runs to the end.
    def parse_html_declaration(self, i: int) -> int:
        raw = self.rawdata
        if raw.startswith("<!--", i):
            return self.parse_comment(i)
        end = raw.find(">", i + 2)
        return len(raw) if end < 0 else end + 1

    def parse_comment(self, i: int, report: bool = True) -> int:
        found = _COMMENT_END.search(self.rawdata, i + 2)
        self.cut = self.cut or found is None
        return found.end() if found else len(self.rawdata)

    def border(self) -> None:
        """A block begins or ends here."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1]
                self.lines.append((text, self.tags, self.linked, top[1], self.boxes[top[1]][2] if top[0] in INLINE else top[0]))
                self.tags = self.linked = 0
            self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self._close_p()
                self.border()
            return
        inline = tag in INLINE
        if not inline:
            if tag in ENDS_P:
                self._close_p()
            elif tag in ENDS:
                self._close_implied(*ENDS[tag])
            self.border()
        _, box, silent, beside, link = self.stack[-1]
        silent = silent or tag in SILENT
        in_article = self.articles > 0
        away = tag in BESIDE or tag == "header" and not in_article or bool(attrs) and _away(tag, attrs, in_article) and tag not in ("body", "html")
        if not inline or away:
            soft = away and tag not in BESIDE or tag == "form"
            article = not away and (tag in ("article", "main") or bool(attrs) and any(n == "role" and v == "main" or n == "itemprop" and v == "articleBody" for n, v in attrs))
            self.boxes.append((box, soft, tag, article))
            box = len(self.boxes) - 1
            beside = beside or away and not soft
            self.articles += article
        at = len(self.stack)
        self.stack.append((tag, box, silent, beside, link or tag == "a"))
        self.open.setdefault(tag, []).append(at)
        if not inline:
            self.borders.append(at)
        if tag in SCOPE:
            self.scopes.append(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash of other than void elements means nothing

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        places = self.open.get(tag)
        if places and places[-1] > (self.borders[-1] if tag in INLINE else -1 if tag in SCOPE or tag in ("tr", "body") else self.scopes[-1]):
            self._pop(places[-1])
        if tag not in INLINE:
            self.border()

    def _close_p(self) -> None:
        places = self.open.get("p")
        if places and places[-1] > self.scopes[-1]:
            self._pop(places[-1])

    def _close_implied(self, tags: tuple, inside: tuple) -> None:
        least = max((self.open[t][-1] for t in inside if self.open.get(t)), default=0)
        at = min((self.open[t][-1] for t in tags if self.open.get(t) and self.open[t][-1] > least), default=0)
        if at:
            self._pop(at)

    def _pop(self, at: int) -> None:
        """Closes everything from a place on."""
        if self.borders[-1] >= at:
            self.border()
        while len(self.stack) > at:
            tag, box, *_ = self.stack.pop()
            place = len(self.stack)
            self.open[tag].pop()
            if self.borders[-1] == place:
                self.borders.pop()
            if self.scopes[-1] == place:
                self.scopes.pop()
            if box != self.stack[-1][1]:
                self.articles -= self.boxes[box][3]

    def handle_data(self, data: str) -> None:
        _, box, silent, beside, link = self.stack[-1]
        if not (silent or beside):
            self.parts.append(data)
            if link:
                self.linked += len(data.strip())


def lines_of(page: str) -> Lines:
    """The lines of a page. What follows the last '>' holds no whole tag: it is text up to a tag's beginning."""
    parser, end = Lines(), page.rfind(">") + 1
    parser.feed(page[:end])
    parser.close()
    tail = re.match(r"(?:[^<]|<(?![a-zA-Z/!?]))*", page[end:])
    if parser.cdata_elem is None and not parser.cut:
        parser.handle_data(html.unescape(tail[0]))
    parser.border()
    return parser


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """The ratios under a Gaussian of so many lines, cut at 3 sigma and at the ends of the page."""
    reach = int(3 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    both = np.convolve(ratios, weights)[reach : reach + len(ratios)]
    return both / np.convolve(np.ones(len(ratios)), weights)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of the values: halfway between their means, from the overall mean on until it stays."""
    cut = float(values.mean())
    for _ in range(20):
        high = values > cut
        if high.all() or not high.any():
            return cut
        now = float(values[high].mean() + values[~high].mean()) / 2
        if now == cut:
            break
        cut = now
    return cut


def main_lines(page: Lines, sigma: float = 1.0) -> list[str]:
    """The lines of the page's content region."""
    lines, boxes = page.lines, page.boxes
    if not lines:
        return []
    size = np.array([len(x[0]) for x in lines])
    box = [x[3] for x in lines]
    # characters in each element, from the inner ones out (an element has a higher number than the one around it)
    chars, holds = [0] * len(boxes), [x[3] for x in boxes]
    for b, n in zip(box, size.tolist()):
        chars[b] += n
    for b in range(len(boxes) - 1, 0, -1):
        chars[boxes[b][0]] += chars[b]
        holds[boxes[b][0]] = holds[boxes[b][0]] or holds[b]
    # what class, role or form takes away, unless it holds an article or, outside of articles, most of the page
    gone, inside = [False] * len(boxes), [-1] * len(boxes)
    for b, (up, soft, _, article) in enumerate(boxes):
        if b:
            inside[b] = b if article and inside[up] < 0 else inside[up]
            gone[b] = gone[up] or soft and not holds[b] and (inside[b] >= 0 or chars[b] < WHOLE * chars[0])
    kept = [i for i, b in enumerate(box) if not gone[b]]
    if not kept:
        return []
    ratio = np.array([max(0, len(lines[i][0]) - lines[i][2]) / max(1, lines[i][1]) for i in kept])
    smooth = smoothed(np.log1p(ratio), sigma)
    content = smooth >= threshold(smooth)
    # the articles' content, and the smallest element with nearly all of the content
    weight = [0] * len(boxes)
    for i, is_content in zip(kept, content.tolist()):
        if is_content:
            weight[box[i]] += int(size[i])
    for b in range(len(boxes) - 1, 0, -1):
        weight[boxes[b][0]] += weight[b]
    own = {inside[box[i]] for i in kept} - {-1}
    if own:
        best = max(chars[b] for b in own)
        own = {b for b in own if chars[b] >= 0.2 * best}
        if sum(chars[b] for b in own) >= 0.3 * sum(int(size[i]) for i in kept) or sum(weight[b] for b in own) >= 0.5 * weight[0]:
            return [lines[i][0] for i in kept if inside[box[i]] in own]
    region = 0
    for b in range(1, len(boxes)):  # from outer to inner: each holds nearly all of what the one around it holds
        if boxes[b][0] == region and weight[b] >= MOST * weight[0] > 0:
            region = b
    return _in_region(lines, boxes, box, kept, content, region, weight)


def _in_region(lines: list, boxes: list, box: list, kept: list, content: np.ndarray, region: int, weight: list) -> list[str]:
    """The region's lines from its first content line to its last, but for parts without content, and the heading before it."""
    if boxes[region][2] in ("p", "td", "li", "pre", "blockquote") and weight[region] and boxes[region][0] >= 0 and weight[boxes[region][0]] == weight[region]:
        region = boxes[region][0]  # one paragraph alone: with its neighbours
    part = [-2] * len(boxes)  # -1: the region itself, else its child that the element is in
    for b in range(len(boxes)):
        if b == region:
            part[b] = -1
        elif b > region:
            up = part[boxes[b][0]]
            part[b] = b if up == -1 else up
    inside = [k for k, i in enumerate(kept) if part[box[i]] != -2]
    marked = [k for k in inside if content[k]]
    if not marked:
        return []
    out = []
    for k in range(marked[0]):
        if lines[kept[k]][4] == "h1":
            out = [lines[kept[k]][0]]
    sizes, links = {}, {}
    for k in inside:
        text, _, linked, _, _ = lines[kept[k]]
        b = part[box[kept[k]]]
        sizes[b], links[b] = sizes.get(b, 0) + len(text), links.get(b, 0) + linked
    for k in inside:
        text, _, linked, _, tag = lines[kept[k]]
        b = part[box[kept[k]]]
        prose = b == -1 or weight[b] > 0 or 2 * links[b] < sizes[b]
        after = k > marked[-1] and not linked and (tag in PROSE or b != -1 and boxes[b][2] in PROSE)
        if content[k] or marked[0] <= k <= marked[-1] and prose or after:
            out.append(text)
    return out


def extract(pages: DataFrame, source: str = "html", text: str = "text", sigma: float = 1.0) -> DataFrame:
    """pages without the source column, with text: the main text of each page, a line for each block.

    White space inside a block is one space. A null or empty page, and one without text, has the text ''. Markup may be
    broken in any way; pages and lines of any length are taken whole, in time linear in their length. Repeated rows each get
    their text; other columns are kept (one named as the new column is replaced); an empty table gives an empty one.
    sigma: lines of the Gaussian.
    """
    keep = [c for c in pages.columns if c not in (source, text)]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{source}`").alias("page"))
    schema = rows.select("row", F.lit("").alias("text")).schema

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = ["\n".join(main_lines(lines_of(page), sigma)) if page else "" for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=schema.names)

    return rows.mapInArrow(texts, schema).select(*(F.col(f"row.`{c}`") for c in keep), F.col("text").alias(text))
