"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's HTML parser streams events. Block elements cut the page into lines (blocks of text); for each line
the ratio of its text to its tags is taken, smoothed with a Gaussian over its neighbours, and the smoothed ratios are
clustered in two by a threshold; lines of mostly links are never of the upper cluster. The text of the upper cluster selects the
region: the article-like element that holds most of it, whose lines are all text, or, on pages without one, the innermost block
element that holds nearly all of it. There the upper cluster selects the lines as well: those from its first to its last line, and
those of containers that directly hold one of it, with the lists and tables in them that are not mostly links. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments never count, by element, role or class and id names; an element that is only named so counts if it
holds the article or, on pages without one, WRAPS of the text.

Defined cases: null and empty pages, and pages without content, give an empty text; unclosed elements end with
their parent or the page; markup that nothing ends is text; very long and deeply nested pages, and those full of such markup, take time in proportion; equal rows repeat their result; columns that
differ from the three only in case, or have names used here, do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick, table

SIGMA = 1.0
RADIUS = 3
#: Share of the upper cluster's text that a region of a page without an article must hold.
HOLDS = 0.9
#: Share of a line's text inside links from which it is of the lower cluster.
LINKS = 0.6
#: Share of the text of a page without an article from which an element is a wrapper, whatever its name.
WRAPS = 0.75

# Names of HTML elements and attributes, and customary class names.
SKIP = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select", "textarea", "svg", "iframe", "object", "head", "dialog", "menu", "canvas", "audio", "video", "title"}
BLOCK = {"html", "body", "div", "article", "main", "section", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "fieldset", "center", "hr", "hgroup"}
FRAME = BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "hr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
#: Elements that order the text of the container they stand in, and are no containers of their own.
TEXTUAL = {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "blockquote", "pre", "figure", "figcaption", "details"}
# A class or id names something beside the content if the whole name is one of these, alone or with one of the customary words before or behind it.
_BESIDE = "ads?|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promos|promotion|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|widgets?|related|recommended|recommendations|share|sharing|social|comments?|disqus|repl(?:y|ies)|footer|header|masthead|toolbar|pagination|pager|copyright"
_BEFORE = "main|site|page|top|bottom|left|right|post|article|entry|global|primary|secondary|mobile|user|blog|reader|cookie|social|google|sub|site-main"
_BEHIND = "wrap|wrapper|container|box|area|section|list|links|buttons?|bar|block|slot|unit|banner|notice|consent|popup|modal|signup|form|posts|articles|stories|thread|inner|menu|nav|[0-9]+"
NOISE = re.compile(f"(?:(?:{_BEFORE})[-_])?(?:{_BESIDE})(?:[-_](?:{_BEHIND}))?", re.I)
MAIN_NAMES = {"article", "main"}
def noisy(value: str) -> bool:
    """Whether a class or id names something beside the content."""
    return any(NOISE.fullmatch(name) for name in value.split())


def closable(html: str) -> str:
    """html with markup that nothing ends turned into text: comments that are never closed, and what looks like tags behind the last
    end of one. The parser would look for their ends anew at each of them."""
    i = html.rfind("-->") + 3
    head, rest = (html[:i], html[i:]) if i > 2 else ("", html)
    rest = rest.replace("<!--", "&lt;!--")
    j = rest.rfind(">") + 1
    return head + rest[:j] + rest[j:].replace("<", "&lt;")


class _Page(HTMLParser):
    """Lines as (text, tags, characters in links, enclosing element). Elements are numbered in order of their start, so parents come
    first: parents, and sets of those that are article-like or only named like something beside the content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.stack, self.parents, self.kinds, self.mains, self.named = [], [], [0], [""], set(), set()
        self.skipped = self.links = self.open_mains = 0
        self.open: dict[str, int] = {}
        self.parts, self.tags, self.linked = [], 0, 0

    def cut(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.stack[-1][1] if self.stack else 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def pop(self, to: int):
        while len(self.stack) > to:
            tag, at, skip = self.stack.pop()
            self.open[tag] -= 1
            self.skipped -= skip
            self.open_mains -= at in self.mains

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID and tag != "hr":
            return
        if tag == "a":
            self.links += 1
        bad, named, main = tag in SKIP, False, tag in MAIN_NAMES
        # Articles inside another are often comments or teasers, and named so.
        outer = main and not self.open_mains
        for name, value in attrs:
            if name in ("class", "id") and value:
                named = named or (tag not in ("html", "body") and not outer and noisy(value))
            elif name == "role" and value:
                bad, main = bad or value.lower() in ROLES, main or value.lower() == "main"
            elif name == "itemprop" and value:
                main = main or value.lower() == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                bad = True
        if tag in BLOCK or tag in SKIP:
            self.cut()
            if tag == "body" and self.open.get("head"):  # ends a head whose end tag is missing
                self.pop(next(i for i, x in enumerate(self.stack) if x[0] == "head"))
            # A new block ends an open paragraph, whose end tag may be missing.
            for i in range(len(self.stack) - 1, -1, -1) if self.open.get("p") else ():
                if self.stack[i][0] in FRAME or self.stack[i][0] in SKIP:
                    break
                if self.stack[i][0] == "p":
                    self.pop(i)
                    break
        if (tag in FRAME or tag in SKIP or bad or named) and tag not in VOID:
            at = len(self.parents)
            self.parents.append(self.stack[-1][1] if self.stack else 0)
            self.kinds.append(tag)
            self.stack.append((tag, at, int(bad)))
            self.open[tag] = self.open.get(tag, 0) + 1
            self.skipped += bad
            if named:
                self.named.add(at)
            elif main and not bad:
                self.mains.add(at)
                self.open_mains += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        if tag in BLOCK or tag in SKIP:
            self.cut()
        for i in range(len(self.stack) - 1, -1, -1) if self.open.get(tag) else ():
            if self.stack[i][0] == tag:
                self.pop(i)
                break
            if tag not in FRAME and tag not in SKIP and self.stack[i][0] in FRAME:
                break

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratios: list[float]) -> list[float]:
    """A Gaussian over the neighbouring lines."""
    kernel = [math.exp(-((d / SIGMA) ** 2) / 2) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for d, k in enumerate(kernel, i - RADIUS):
            if 0 <= d < len(ratios):
                total, weight = total + k * ratios[d], weight + k
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Cuts values in two clusters: the mean of the two clusters' means, iterated."""
    cut = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high:
            break
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _held(parents: list[int], sizes: list[float]) -> list[float]:
    """What each element holds with all inside it. Children have greater numbers than their parents."""
    held = list(sizes)
    for at in range(len(parents) - 1, 0, -1):
        held[parents[at]] += held[at]
    return held


def _content(page: _Page) -> list[tuple[str, int, int, int]]:
    """The page's lines without those of elements named like something beside the content."""
    n = len(page.parents)
    if not page.named:
        return page.lines
    sizes, mains = [0.0] * n, [0.0] * n
    for text, _, _, at in page.lines:
        sizes[at] += len(text)
    for at in page.mains:
        mains[at] = 1.0
    held, of_mains = _held(page.parents, sizes), _held(page.parents, mains)
    noise = [False] * n
    for at in range(1, n):
        wraps = of_mains[at] > 0 or not page.mains and held[at] >= WRAPS * held[0]
        noise[at] = noise[page.parents[at]] or at in page.named and not wraps
    page.mains = {at for at in page.mains if not noise[at]}
    return [x for x in page.lines if not noise[x[3]]]


def extract(html: str | None) -> str:
    """The main text of one page, blocks joined by a newline."""
    page = _Page()
    page.feed(closable(html or ""))
    page.close()
    page.cut()
    lines = _content(page)
    if not lines:
        return ""
    raw = [len(t) / (1 + tags) for t, tags, _, _ in lines]
    ratio = smoothed(raw)
    cut = threshold(ratio)
    upper = [r >= cut and linked <= LINKS * len(t) for (t, _, linked, _), r in zip(lines, ratio, strict=True)]
    n = len(page.parents)
    sizes = [0.0] * n
    for (text, _, _, at), up in zip(lines, upper, strict=True):
        # The lower cluster decides only between regions without any of the upper one.
        sizes[at] += len(text) * (1.0 if up else 1e-6)
    held = _held(page.parents, sizes)
    mains = [m for m in page.mains if held[m]]
    if mains:
        # The fullest; of nested ones with the same text the innermost.
        region = max(mains, key=lambda m: (held[m], m))
    else:
        # Elements that hold nearly all lie inside each other: the last one is the innermost.
        region = next(at for at in range(n - 1, -1, -1) if held[at] >= HOLDS * held[0])
    inside = [False] * n
    for at in range(region, n):
        inside[at] = at == region or inside[page.parents[at]]
    own = [i for i, x in enumerate(lines) if inside[x[3]]]
    # Smoothing lifts a line beside the text as well: the first and the last one reach the threshold themselves.
    tops = [i for i in own if upper[i]]
    tops = [i for i in tops if raw[i] >= cut] or tops
    if not mains and tops:
        # Lists and tables belong to the container they stand in, like its paragraphs; those that are mostly links are menus.
        place = list(range(n))
        for at in range(1, n):
            if page.kinds[at] in TEXTUAL and at not in page.named:
                place[at] = place[page.parents[at]]
        blocks = {place[lines[i][3]] for i in tops}
        held_by = lambda i: lines[i][3] in blocks or place[lines[i][3]] in blocks and lines[i][2] <= LINKS * len(lines[i][0])
        own = [i for i in own if tops[0] <= i <= tops[-1] or held_by(i)]
    return "\n".join(lines[i][0] for i in own)


def _texts(batches):
    for b in batches:
        texts = [extract(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per page."""
    return pick(pages, page_id="long", url="string", html="string").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
