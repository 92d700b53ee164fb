"""Main text of web pages from parser events and text density (operator 4).

The standard library's streaming parser turns a page into lines (blocks). Each line has a text-to-tag ratio;
a Gaussian smooths the ratios over neighbouring lines, and a threshold splits them into clusters: content and
rest. The content lines select the region of the page that holds them; of that region every line counts that
is not in a menu, header, footer, sidebar, notice, advert, form or comment.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspan.llm.common import kind_of

#: Fixed values of HTML: elements without content, elements that begin a new line, elements never shown as text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search "
    "section summary table tbody td tfoot th thead title tr ul").split())
HIDDEN = frozenset((
    "script style noscript template head title iframe object svg canvas audio video map select option button "
    "textarea input datalist math").split())
#: Elements and roles outside the main text.
OUTSIDE = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset((
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar").split())
#: Words in class and id that name parts outside the main text.
MARKS = frozenset((
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored sponsors promo "
    "promoted promotion banner banners menu menus nav navbar navigation navi breadcrumb breadcrumbs sidebar "
    "sidebars aside footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist discussion disqus respond reply replies related "
    "recommended share sharing social widget widgets toolbar pagination pager skip masthead topbar copyright "
    "alert disclaimer").split())
HEADERS = frozenset("header heading head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new block of these kinds closes although they have no end tag.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th")}
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

SIGMA = 1.0
#: Lines whose smoothed ratio is above this share of the standard deviation are content.
THRESHOLD = 1.0
#: Inline elements, which never stand as a region of their own.
INLINE = frozenset("p b i em strong span a font u small sup sub code q cite abbr mark".split())


class Lines(HTMLParser):
    """Collects (text, tags, linked characters, outside, path of open elements) for each line of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, tuple[int, ...]]] = []
        self.names: dict[int, str] = {}
        self.open: list[tuple[str, int, bool, bool]] = []  # name, number, hidden, outside
        self.text: list[str] = []
        self.tags = self.linked = self.serial = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            outside = bool(self.open) and self.open[-1][3]
            self.lines.append((text, self.tags, self.linked, outside, tuple(x[1] for x in self.open)))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "body":
            self.close_element("head")
        if tag == "p" or tag in HEADINGS or tag in ("div", "ul", "ol", "table", "section", "article", "blockquote"):
            self.close_element("p")
        for name in CLOSES.get(tag, ()):
            self.close_element(name)
        hidden = outside = within = False
        if self.open:
            hidden, outside = self.open[-1][2:]
            within = any(x[0] in ("article", "main") for x in self.open)
        self.serial += 1
        self.names[self.serial] = tag
        self.open.append((tag, self.serial, hidden or tag in HIDDEN, outside or is_outside(tag, attrs, within)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag not in VOID:
            self.close_element(tag)

    def end(self) -> None:
        super().close()
        self.flush()

    def close_element(self, tag: str) -> None:
        """Closes the innermost open element of that name; p and items only within their own container."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag in BLOCK:
                    self.flush()
                del self.open[k:]
                return
            if (tag == "p" or tag in CLOSES) and self.open[k][0] in ("div", "ul", "ol", "dl", "table", "article", "section",
                                                                  "main", "body", "aside", "nav", "footer"):
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        self.text.append(data)
        if any(x[0] == "a" for x in self.open[-4:]):
            self.linked += len(data)


def is_outside(tag: str, attrs: list[tuple[str, str | None]], within: bool) -> bool:
    if tag in OUTSIDE or tag == "header" and not within:
        return True
    words: set[str] = set()
    for name, value in attrs:
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id"):
            words.update(SPLIT.split(CAMEL.sub(" ", value).lower()))
    if not words or tag in ("html", "body", "main") or tag in HEADINGS:
        return False
    if tag == "article":
        return bool(words & {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo"})
    return bool(words & MARKS) or not within and bool(words & HEADERS)


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing over neighbouring lines; the kernel is cut at three deviations and at the page's ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for k in range(len(values)):
        total = weight = 0.0
        for d in range(max(-reach, -k), min(reach, len(values) - 1 - k) + 1):
            total += kernel[d + reach] * values[k + d]
            weight += kernel[d + reach]
        out.append(total / weight)
    return out


def main_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The article of one page; the empty text for null, empty or text-free input."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.end()
    lines = parser.lines
    ratios = [0.0 if outside else max(len(text) - linked, 0) / (tags + 1) for text, tags, linked, outside, _ in lines]
    if not any(ratios):
        return " ".join(text for text, _, _, outside, _ in lines if not outside)
    smoothed = smooth(ratios, sigma)
    mean = sum(smoothed) / len(smoothed)
    limit = threshold * math.sqrt(sum((x - mean) ** 2 for x in smoothed) / len(smoothed))
    content = [k for k, x in enumerate(smoothed) if x >= limit and ratios[k] > 0]
    region = smallest_region([lines[k] for k in content or range(len(lines)) if not lines[k][3]], parser.names)
    return " ".join(text for text, _, _, outside, path in lines if not outside and (region is None or region in path))


def smallest_region(lines: list[tuple], names: dict[int, str]) -> int | None:
    """The smallest block element that holds every one of these lines, or the article or main around it;
    None: the whole page. All content lines lie inside it, so no part of the article is cut away."""
    if not lines:
        return None
    common = list(lines[0][4])
    for line in lines[1:]:
        path = line[4]
        n = 0
        while n < len(common) and n < len(path) and common[n] == path[n]:
            n += 1
        del common[n:]
    blocks = [e for e in common if names[e] not in INLINE]
    if not blocks:
        return None
    around = [e for e in blocks if names[e] in ("article", "main")]
    return around[-1] if around else blocks[-1]


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                              names=["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html); no shuffle, one pass.

    Null and empty html, and pages without text, give the empty text. Character references are decoded, white
    space inside a line becomes one blank, lines are joined by a blank in page order, nothing is cut. Repeated
    rows each get a row; further columns are ignored.
    """
    schema = f"page_id {kind_of(pages, 'page_id')}, url {kind_of(pages, 'url')}, text string"
    found = pages.select("page_id", "url", "html").mapInArrow(extract_batches, schema)
    return found.withColumn("n_chars", F.length("text").cast("long"))
