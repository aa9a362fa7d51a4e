"""Main text of web pages by tag-path ratios (operator 5).

Each page is cut into text blocks, each with its root-to-leaf tag path (block elements, with their class and id). Per
path, the text length, punctuation and link characters of all its blocks are summed; a path's ratios are characters per
block and punctuation per block, discounted by the share of link text. The ratios are smoothed along page order and
fused by their geometric mean; class and id words that tell boilerplate lower a path's weight in proportion to their
share of the name, which lowers its fused score but does not decide alone. Paths that pass a part of the page's mean,
in which each path counts by its characters and weight, are content.

The smallest element that holds all content blocks (the article or main element around it, if there is one) is then
taken with all it holds, link lists, tables and one-word paragraphs too, but for blocks of paths that did not pass and
whose names below that element say boilerplate. Where it is no article or main element, its leading and trailing
children that are links alone go as well. Headings that stand beside it or its ancestors before its end join it. What
the HTML standard itself sets apart never counts: navigation, asides, footers, the page's header, forms and controls,
scripts, styles, templates, hidden elements and landmark roles of those kinds.

One pass over the page and a few over its blocks and elements: time is linear in the page's size, whatever its depth.

Defined results: null html is an empty page; a page without content gives an empty text; very long and very deep pages
are read whole; repeated rows give a row each; paths of equal score pass or fail together; an empty table gives an empty
result; other columns are ignored, whatever their names. White space inside a block becomes one space, blocks are joined
by one newline, and nothing else is dropped or cut. Malformed markup never fails: unclosed tags are closed by their
parents, stray end tags are ignored, and an unclosed comment or script runs to the end of the page.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Opening the first closes an open one of the second, inside the nearest scope.
CLOSES = {t: {"p"} for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
CLOSES |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}
BOXES = frozenset("html body article section div main table td th li ul ol blockquote aside nav header footer form".split())

#: Boxes that may hold an article.
CONTAINERS = frozenset("html body article section div main td".split())
ARTICLES = frozenset(("article", "main"))

#: Elements that hold no content of their own or are set apart by the standard. A header counts as such outside an article or main.
NOT_CONTENT = frozenset(
    "head nav header footer aside form script style noscript template iframe object embed button select option input textarea svg math canvas audio video map menu dialog title label fieldset legend".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar tablist".split())
#: Words of a class or id (parts between - _ and case changes) that speak for boilerplate ...
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc header masthead topbar footer foot bottombar copyright legal "
    "sidebar side aside widget widgets related recommended recommendations trending popular "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer popup modal overlay paywall subscribe subscription newsletter signup login "
    "comment comments commentlist respond reply replies discussion disqus feedback "
    "share sharing social socials follow tags tagcloud form search searchbox toolbar skip hidden".split()
)
#: ... and words that say nothing either way.
NEUTRAL = frozenset(
    "box block wrap wrapper container section area list item items body inner outer content contents main primary secondary left right top bottom row col column bar panel "
    "text title link links button buttons btn group page site post article entry unit slot zone the of and js".split()
)
#: Weight of a path whose name is all boilerplate, share of the mean that content must pass, and the weight under which a path that did not pass goes.
LEAST = 0.02
PASS = 0.4
MARKED = 0.5
LINKS = 0.8
PUNCT = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
SPACE = re.compile(r"\s+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _weight(value: str) -> float:
    """1 less the largest share of boilerplate words among the telling words of a class or id."""
    share = 0.0
    for name in value.split():
        parts = [p.lower() for p in PART.findall(name)]
        told = [p in WORDS for p in parts if p not in NEUTRAL]
        share = max(share, sum(told) / len(told) if told else 0.0)
    return 1 - (1 - LEAST) * share


def _label(tag: str, attrs: str) -> tuple[str, bool, float]:
    """A path step, whether the standard sets the element apart, and its name's weight."""
    apart, weight, step = tag in NOT_CONTENT, 1.0, tag
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return step, apart, weight
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            step += "." + value
            if tag not in ("html", "body", "article", "main"):
                weight = min(weight, _weight(value))
        elif name == "role":
            apart = apart or value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            apart = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            apart = True
    return step, apart, weight


@dataclass
class Page:
    """Block elements in the order they open, tag paths, and text blocks in page order, as parallel lists. Number 0 is the root."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    weight: list[float] = field(default_factory=lambda: [1.0])
    path: list[int] = field(default_factory=lambda: [0])
    apart: list[bool] = field(default_factory=lambda: [False])
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    path_weight: list[float] = field(default_factory=lambda: [1.0])
    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)

    def open(self, parent: int, tag: str, step: str, apart: bool, weight: float) -> int:
        key = (self.path[parent], step)
        if key not in self.paths:
            self.paths[key] = len(self.path_weight)
            self.path_weight.append(min(self.path_weight[key[0]], weight))
        for column, x in ((self.tag, tag), (self.parent, parent), (self.weight, weight), (self.path, self.paths[key]), (self.apart, apart or self.apart[parent])):
            column.append(x)
        return len(self.tag) - 1


def parsed(page: str) -> Page:
    """Elements and blocks of a page, in one pass."""
    out = Page()
    stack: list[tuple[str, int, bool]] = []  # tag, its block element (an inline one: that around it), whether it is a block
    where: dict[str, list[int]] = {}  # places of each tag in the stack
    buf: list[str] = []
    linked = 0

    def here() -> int:
        return stack[-1][1] if stack else 0

    def nearest(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def flush():
        nonlocal linked
        if buf:
            text = SPACE.sub(" ", _html.unescape("".join(buf))).strip()
            if text and not out.apart[here()]:
                out.text.append(text)
                out.links.append(min(linked, len(text)))
                out.owner.append(here())
            buf.clear()
        linked = 0

    def pop(to: int):
        while len(stack) > to:
            if stack[-1][2]:
                flush()
            where[stack.pop()[0]].pop()

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            buf.append(text)
            if where.get("a"):
                linked += len(text)
        if m is None:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if page.startswith("<![CDATA[", m.start()):
                buf.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "br":
                flush()
                continue
            place = nearest((tag,))
            if place >= 0 and not (tag in INLINE and nearest(BOXES) > place):
                pop(place)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        closed = attrs.rstrip().endswith("/")
        if tag in RAW and not closed:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            flush()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in CLOSES:
            place = nearest(CLOSES[tag])
            if place > nearest(SCOPE.get(tag, BOXES) - CLOSES[tag]):
                pop(place)
        step, apart, weight = _label(tag, attrs)
        if tag == "header" and nearest(ARTICLES) >= 0:
            apart = False
        block = tag not in INLINE or apart or weight <= LEAST
        if block:
            flush()
        if not closed or tag in INLINE:
            stack.append((tag, out.open(here(), tag, step, apart, weight) if block else here(), block))
            where.setdefault(tag, []).append(len(stack) - 1)
    pop(0)
    flush()
    return out


def _smoothed(values: list[float]) -> list[float]:
    """Weighted mean with the neighbours in page order."""
    n = len(values)
    return [(values[max(i - 1, 0)] + 2 * v + values[min(i + 1, n - 1)]) / 4 for i, v in enumerate(values)]


def content_paths(page: Page) -> list[bool]:
    """For each path, whether its smoothed and fused ratios pass."""
    paths = [page.path[e] for e in page.owner]
    sums = [[0, 0, 0, 0] for _ in page.path_weight]
    for p, text, links in zip(paths, page.text, page.links, strict=True):
        s = sums[p]
        s[0] += 1
        s[1] += len(text)
        s[2] += len(PUNCT.findall(text))
        s[3] += links
    plain = [1 - s[3] / s[1] if s[0] else 0.0 for s in sums]
    length = _smoothed([sums[p][1] / sums[p][0] * plain[p] for p in paths])
    marks = _smoothed([(1 + sums[p][2]) / sums[p][0] * plain[p] for p in paths])
    fused = [0.0] * len(sums)
    for p, a, b in zip(paths, length, marks, strict=True):
        fused[p] += (a * b) ** 0.5 / sums[p][0] * page.path_weight[p]
    size = [s[1] * w for s, w in zip(sums, page.path_weight, strict=True)]
    mean = sum(f * x for f, x in zip(fused, size, strict=True)) / sum(size)
    good = [s[0] > 0 and f >= PASS * mean and k > 0.5 for f, s, k in zip(fused, sums, plain, strict=True)]
    if not any(good):
        best = max((p for p, s in enumerate(sums) if s[0]), key=lambda p: fused[p])
        good[best] = True
    return good


def main_text(html: str | None) -> str:
    """The article's text; see the module's docstring."""
    page = parsed(html or "")
    if not page.text:
        return ""
    passed = content_paths(page)
    good = [passed[page.path[e]] for e in page.owner]
    n, total = len(page.tag), sum(good)
    # children open after their parents, so sums over subtrees are one walk backwards
    held, length, links = [0] * n, [0] * n, [0] * n
    for e, g, text, k in zip(page.owner, good, page.text, page.links, strict=True):
        held[e] += g
        length[e] += len(text)
        links[e] += k
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        held[up] += held[e]
        length[up] += length[e]
        links[up] += links[e]
    box = max(e for e in range(n) if held[e] == total)  # the last to open is the deepest
    chain = [box]
    while chain[-1]:
        chain.append(page.parent[chain[-1]])
    box = next((e for e in chain if page.tag[e] in ARTICLES), next((e for e in chain if page.tag[e] in CONTAINERS), 0))
    # below the box: the child of it that each element is in, and the least weight from there on
    child, weight = [-1] * n, [1.0] * n
    for e in range(box + 1, n):
        up = page.parent[e]
        if up == box or child[up] >= 0:
            child[e], weight[e] = (e, page.weight[e]) if up == box else (child[up], min(weight[up], page.weight[e]))
    inside = [e == box or child[e] >= 0 for e in page.owner]
    first, last = (f(i for i, g in enumerate(good) if g) for f in (min, max))
    end = max(i for i, x in enumerate(inside) if x)
    above = set(chain[chain.index(box) :]) if box in chain else {0}
    out = []
    for i, (e, text) in enumerate(zip(page.owner, page.text, strict=True)):
        if inside[i]:
            c = child[e]
            edge = c >= 0 and page.tag[box] not in ARTICLES and not held[c] and not first <= i <= last and links[c] >= LINKS * length[c]
            keep = good[i] or weight[e] >= MARKED and not edge
        else:
            keep = i < end and page.tag[e] in HEADINGS and page.parent[e] in above and page.weight[e] >= MARKED
        if keep:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` for each row of ``pages``."""
    thin = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in (part for whole in batches for part in _base.slices(whole, "_html", 4 << 20)):
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"]
            )

    return thin.mapInArrow(run, schema)


def op5_html_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_base.read(spark, sf_dir, "pages"))


QUERIES = {"op5_html_tag_path_ratios": op5_html_tag_path_ratios}
ORACLES: dict[str, str] = {}
