"""Main text of web pages: parser events, text-to-tag ratio per block, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import small_batches, table, whole_text

# Fixed lists of HTML: elements that break text into blocks, that never show text of the page, and that have no end tag.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template svg iframe object canvas audio video select datalist textarea button head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that are page furniture by what they mean, and those that are so unless they hold the page's text.
HARD, SOFT = frozenset("nav footer".split()), frozenset("form aside dialog menu search".split())
SOFT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
ROOTS = frozenset("article main".split())
#: Elements whose class and id words count.
CONTAINERS = frozenset("div section ul ol dl table header p li figure blockquote details".split())
# A class or id is read as one of these words, perhaps with words of place or a naming scheme's letter before and words of layout after it. The first ones say what a reader would
# not call the article wherever they stand; the second ones are also names of an article's own parts.
_STRONG = (
    "ads?|adsbygoogle|adverts?|advertisements?|advertising|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|login|masthead|modal|newsletter|outbrain|popup|promos?|promoted|promotion|"
    "recommended|related|replies|respond|sidebar|signup|sponsor|sponsored|subscribe|subscription|taboola|(?:site|page|global)[-_]header"
)
_WEAK = "banner|breadcrumbs?|disclaimer|discussion|menu|nav|navbar|navigation|notices?|pager|pagination|share|sharing|social|toolbar|topbar|widgets?"
_BEFORE = "page|site|main|post|entry|left|right|top|bottom|global|primary|secondary|user|reader|cookie|social|share|byline|article|story|js|wp|[a-z]"
_AFTER = (
    "list|box|section|area|wrap|wrapper|container|block|bar|inner|item|items|content|links?|buttons?|form|left|right|top|bottom|main|primary|secondary|posts?|articles?|slot|unit|text|message|thread|"
    "cta|tools?|body|title|[0-9]+"
)


def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:(?:{_BEFORE})[-_]+)*(?:{words})(?:[-_]*(?:{_AFTER}|{_STRONG}|{_WEAK}))*", re.I)


STRONG, WEAK = _named(_STRONG), _named(_WEAK)
OF_ARTICLES = re.compile("ad|advert|comment|promo|related|reply|sponsored|teaser", re.I)
#: Elements that hold a text as a whole.
REGIONS = frozenset("body html div section td th center form fieldset details main article dialog".split())
#: A start tag of the key ends an open element of these kinds (optional end tags of HTML).
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
SPACE = re.compile(r"\s+")
#: Part of the text that is outside marked elements at least, if these are furniture.
SOME = 0.2
#: Elements that hold other ones: at the edges of a text such a neighbour counts by its own dense text alone.
GROUPS = frozenset("div section form table dl ul ol aside header footer fieldset details center dir menu".split())


class Node(NamedTuple):
    """An open or closed element that can hold blocks; ``parent`` is a place in the list of nodes. What ``hard``, ``header`` and ``heading`` say holds inside it too."""

    name: str
    parent: int
    hard: bool
    mark: int  # perhaps furniture, by its own name, role or words: 2 if these are used for nothing else, 1 if articles have such parts
    root: int  # the outermost article or main around it, or -1
    header: bool
    heading: bool
    silent: bool  # inside what never shows


class Block(NamedTuple):
    text: str
    tags: int
    linked: int
    node: int


class PageParser(HTMLParser):
    """Collects blocks as events arrive: text, number of tags since the last one, characters in links, and the element they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", -1, False, 0, -1, False, False, False)]
        self.open = [0]
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.link = 0  # how many elements were open when the link began

    def close_block(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(text, self.tags, self.linked, self.open[-1]))
            self.tags = 0
        self.parts, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        del self.open[depth:]
        if self.link > len(self.open):
            self.link = 0

    def top(self) -> Node:
        return self.nodes[self.open[-1]]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS and not self.top().silent:
            self.close_block()
        if tag not in IN_HEAD and tag != "head":
            for depth, at in enumerate(self.open):
                if self.nodes[at].name == "head":
                    self.close_to(depth)
                    break
        if tag in BLOCKS and self.top().name == "p":
            self.close_to(len(self.open) - 1)
        for name in CLOSES.get(tag, ()):
            if self.top().name == name:
                self.close_to(len(self.open) - 1)
        self.tags += 1
        if tag == "a":
            self.link = len(self.open)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID or tag not in BLOCKS and tag not in HIDDEN:
            return
        place, above = len(self.nodes), self.top()
        inside = above.root >= 0
        hard = above.hard or tag in HIDDEN or tag in HARD or tag == "header" and not inside or _hidden(attrs)
        mark = 2 if tag in SOFT else _marked(tag, attrs)
        root = above.root if inside else place if tag in ROOTS else -1
        header = above.header or tag == "header"
        self.nodes.append(Node(tag, self.open[-1], hard, mark, root, header, above.heading or tag in HEADINGS, above.silent or tag in HIDDEN))
        self.open.append(place)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.link = 0
        if tag in BLOCKS:
            if not self.top().silent:
                self.close_block()
        elif tag not in HIDDEN:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.nodes[self.open[depth]].name
            if name == tag:
                self.close_to(depth)
                return
            if name in ("article", "main", "body", "nav", "footer", "aside") and tag in ("p", "li", "div"):
                return  # a stray end tag doesn't close what holds it

    def handle_data(self, data: str) -> None:
        if not self.top().silent:
            self.parts.append(data)
            if self.link:
                self.linked += len(data.strip())


def _hidden(attrs: list) -> bool:
    return any(n == "hidden" or n == "aria-hidden" and v == "true" or n == "style" and v and re.search(r"display\s*:\s*none", v) for n, v in attrs)


def _marked(tag: str, attrs: list) -> int:
    found = 0
    for name, value in attrs:
        if name == "role" and value and value.lower() in SOFT_ROLES:
            found = 2
        if name in ("class", "id") and value and (tag in CONTAINERS or tag == "article"):
            if any(map((OF_ARTICLES if tag == "article" else STRONG).fullmatch, value.split())):
                return 2
            if tag != "article" and any(map(WEAK.fullmatch, value.split())):
                found = max(found, 1)
    return found


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Convolution with a Gaussian of ``2 * ceil(2 sigma) + 1`` points, renormalised at both ends."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def _ratio(block: Block) -> float:
    """Characters outside links per tag."""
    return (len(block.text) - block.linked) / max(1, block.tags)


def cluster(blocks: list[Block]) -> tuple[list[float], float]:
    """Smoothed ratios and the threshold of the cluster of text, their standard deviation."""
    ratios = smoothed(list(map(_ratio, blocks)))
    mean = sum(ratios) / max(1, len(ratios))
    return ratios, math.sqrt(sum((r - mean) ** 2 for r in ratios) / max(1, len(ratios)))


def dense(blocks: list[Block]) -> list[bool]:
    """Which blocks belong to the cluster of text: smoothed characters outside links per tag of at least their standard deviation."""
    ratios, threshold = cluster(blocks)
    return [r >= threshold for r in ratios]


def _linked(block: Block) -> bool:
    return 2 * block.linked > len(block.text)


def _mass(part: list[Block]) -> int:
    return sum(len(b.text) - b.linked for b in part)


def _furniture(nodes: list[Node], blocks: list[Block], wrappers: frozenset[int]) -> list[int]:
    """For every element the outermost marked one around it that is furniture, or -1. In an article or main, what is marked by a name that articles use for their parts has to be half of links, too."""
    text, linked = [0] * len(nodes), [0] * len(nodes)
    for b in blocks:
        text[b.node] += len(b.text)
        linked[b.node] += b.linked
    for i in range(len(nodes) - 1, 0, -1):
        text[nodes[i].parent] += text[i]
        linked[nodes[i].parent] += linked[i]
    soft = [-1] * len(nodes)
    for i, n in enumerate(nodes):
        around = soft[n.parent] if i else -1
        doubted = n.mark == 1 and 0 <= n.root != i and 2 * linked[i] < text[i]
        soft[i] = around if around >= 0 else i if n.mark and not doubted and i not in wrappers else -1
    return soft


def _visible(nodes: list[Node], blocks: list[Block], wrappers: frozenset[int] = frozenset()) -> list[Block]:
    """Blocks that are no furniture: neither in a hard element nor in a marked one, unless that holds the text itself.

    Marked elements hold the text where nothing else of an article or main has any, or where no article or main stands outside of them and less than ``SOME`` of the text does:
    the one of at least three blocks and half the text is then taken for a wrapper, and what is marked inside it is judged in turn.
    """
    shown = [b for b in blocks if not nodes[b.node].hard and (nodes[b.node].heading or not nodes[b.node].header)]
    soft = _furniture(nodes, shown, wrappers)
    free = [b for b in shown if soft[b.node] < 0]
    if any(n.name in ROOTS and soft[i] < 0 and not n.hard for i, n in enumerate(nodes)):
        held = [b for b in shown if nodes[b.node].root >= 0 and soft[nodes[b.node].root] < 0]
        if held and not any(nodes[b.node].root >= 0 for b in free):
            best = max({soft[b.node] for b in held}, key=lambda at: _mass([b for b in held if soft[b.node] == at]))
            return _visible(nodes, blocks, wrappers | {best})
        return free
    if _mass(free) >= SOME * _mass(shown):
        return free
    groups: dict[int, list[Block]] = {}
    for b in shown:
        groups.setdefault(soft[b.node], []).append(b)
    best = max((at for at in groups if at >= 0), key=lambda at: _mass(groups[at]), default=-1)
    if best < 0 or len(groups[best]) < 3 and not _holds_root(nodes, best) or 2 * _mass(groups[best]) < _mass(shown):
        return free
    return _visible(nodes, blocks, wrappers | {best})


def _holds_root(nodes: list[Node], at: int) -> bool:
    """Whether an article or main is the element or stands inside it."""
    inside = {at}
    for i in range(at + 1, len(nodes)):
        if nodes[i].parent in inside:
            inside.add(i)
    return any(nodes[i].name in ROOTS for i in inside)


def _inside(nodes: list[Node], regions: set[int]) -> list[bool]:
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = i in regions or n.parent >= 0 and inside[n.parent]
    return inside


def main_text(html: str) -> str:
    r"""The article's blocks in page order, joined by ``\n``; empty if there is no text.

    Hidden parts, menus, page headers and footers go by their elements; sidebars, notices, adverts, forms and comments by elements, roles and class words, but for one that holds the
    text itself. Of what remains, characters outside links per tag are smoothed over neighbouring blocks; blocks above the standard deviation of the smoothed ratios, by their own
    ratio too, are the text. If most of it stands in an ``article`` or ``main``, that is the region, with the articles beside it, and every block of it stays. Else the region is what :func:`_grown`
    makes of the innermost element around all text. Repeated blocks all stay.
    """
    parser = PageParser()
    parser.feed(html)
    parser.close()
    parser.close_block()
    nodes, blocks = parser.nodes, _visible(parser.nodes, parser.blocks)
    if not blocks:
        return ""
    ratios, threshold = cluster(blocks)
    text = [r >= threshold and _ratio(b) >= threshold and not _linked(b) for r, b in zip(ratios, blocks)]
    if not any(text):
        text = [not _linked(b) for b in blocks]
    if not any(text):
        text = [True] * len(blocks)
    roots: dict[int, int] = {}
    for chosen, b in zip(text, blocks):
        if chosen:
            roots[nodes[b.node].root] = roots.get(nodes[b.node].root, 0) + len(b.text)
    root = max(roots, key=lambda r: roots[r])
    if root >= 0 and nodes[root].name == "article":
        inside = _inside(nodes, {i for i, n in enumerate(nodes) if n.name == "article" and n.root == i and n.parent == nodes[root].parent})
        kept = [inside[b.node] for b in blocks]
    elif root >= 0:
        inside = _inside(nodes, {root})
        kept = [inside[b.node] for b in blocks]
    else:
        kept = _grown(nodes, blocks, text, [r >= threshold for r in ratios])
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def _grown(nodes: list[Node], blocks: list[Block], text: list[bool], near: list[bool]) -> list[bool]:
    """Which blocks belong to a text that no article or main holds.

    The innermost element of those that hold whole texts (:data:`REGIONS`) around all text is cut into its children. A child with text belongs to it, and between the first and the last of these any other that isn't mostly links. From
    there outwards single blocks follow (paragraphs, headings, quotes) up to the first child that groups others, which is where menus, adverts and footers
    begin; then headings right before. Groups before the first ``h1`` go if they hold less than what follows: a text begins with its title. Blocks of links inside stay where their surroundings are dense.
    """
    mass = [0] * len(nodes)
    for chosen, b in zip(text, blocks):
        mass[b.node] += chosen
    for i in range(len(nodes) - 1, 0, -1):
        mass[nodes[i].parent] += mass[i]
    region = max(i for i in range(len(nodes)) if mass[i] == mass[0])  # the innermost, as those with all of it are nested
    while region and nodes[region].name not in REGIONS:
        region = nodes[region].parent
    child = list(range(len(nodes)))  # the child of the region around each element
    for i, n in enumerate(nodes):
        if n.parent >= 0 and n.parent != region and i != region:
            child[i] = child[n.parent]
    inside, titled = _inside(nodes, {region}), _inside(nodes, {i for i, n in enumerate(nodes) if n.name == "h1"})
    own = [inside[b.node] for b in blocks]
    linked, total = {}, {}
    for b, mine in zip(blocks, own):
        if mine:
            at = child[b.node]
            linked[at], total[at] = linked.get(at, 0) + b.linked, total.get(at, 0) + len(b.text)
    heavy = {at for at in total if at != region and nodes[at].name in GROUPS and 2 * linked[at] > total[at]}
    places = [i for i, b in enumerate(blocks) if own[i] and (text[i] or child[b.node] != region and mass[child[b.node]])]
    first, last = places[0], places[-1]
    title = next((i for i, b in enumerate(blocks) if own[i] and i >= first and titled[b.node]), first)
    if sum(len(b.text) for b in blocks[first:title]) < sum(len(b.text) for b in blocks[title : last + 1]) and all(child[b.node] != region for b in blocks[first:title]):
        first = title
    single = lambda i: own[i] and (child[blocks[i].node] == region or nodes[child[blocks[i].node]].name not in GROUPS)
    while first and single(first - 1) and not _linked(blocks[first - 1]):
        first -= 1
    while last + 1 < len(blocks) and single(last + 1) and not _linked(blocks[last + 1]):
        last += 1
    kept = [own[i] and first <= i <= last and (mass[child[b.node]] > 0 or child[b.node] not in heavy) and (near[i] or not _linked(b)) for i, b in enumerate(blocks)]
    while first and nodes[blocks[first - 1].node].heading:
        first -= 1
        kept[first] = True
    return kept


def extract_pages(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` as they are, ``text`` and ``n_chars`` (its code points) per row; kept columns of these two names are replaced.

    Null and empty pages and pages without text give an empty text. Rows are independent (repeated ids or urls stay as they are): one
    pass without shuffle, the parser holds one page at a time, however long.
    """
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(len(keep)).to_pylist()]
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], names=[*keep, "text", "n_chars"])

    rows = df.select(*(F.col(f"`{c}`") for c in keep), whole_text(html_col).alias("__html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return small_batches(rows).mapInArrow(of_batches, f"{fields}, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; see :func:`extract_pages` for nulls and empty or repeated pages."""
    return extract_pages(table(spark, sf_dir, "pages"))
