"""Main text of HTML pages by tree scoring: paragraphs pass points to the elements around them, the best of which is kept.

A page is one row and one pass over its markup, so nothing is shuffled and a page's cost grows with its own length alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.llm.scratch import small_batches

#: A tag with its attributes, a comment, or what a browser takes for one; quotes count after an equals sign only. Whatever the
#: page ends within is matched to its end, so a page is read once.
_MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is no markup, or of which nothing is text.
_RAW = frozenset(
    """script style title textarea iframe noscript noembed noframes xmp template svg math object audio video canvas select
    datalist""".split()
)
#: Elements that never hold main text.
_NEVER = frozenset("nav footer aside form fieldset legend menu dialog search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that begin and end a block of text.
_BLOCKS = _HEADINGS | _NEVER | frozenset(
    """address article blockquote caption center dd details dir div dl dt figcaption figure header hgroup hr li main ol p pre
    section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements within a block: those whose text isn't read, those that may be marked so, and those that part words.
_MUTE, _SPANS, _BREAKS = frozenset(("button", "label")), frozenset(("span", "ins")), frozenset(("br", "img", "input", "embed"))
_CELLS, _WHOLES = frozenset("td th caption table".split()), frozenset(("article", "main"))
_TABLE = _CELLS | frozenset("tr tbody thead tfoot".split())
#: A start tag ends an open element of the first set, unless one of the second lies between.
_ENDS = {
    "li": (frozenset(("li",)), frozenset("ul ol menu dir".split()) | _CELLS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",)) | _CELLS),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",)) | _CELLS),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
}
#: Blocks that pass their points to what holds them; other text scores for its own element.
_PARAGRAPHS = frozenset("p pre td th li dd dt figcaption caption summary".split())

#: Words in class, id and role that mark what isn't main text; words that a class of a state begins with, which says nothing;
#: and words that mark main text.
_BAD_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment
    comments commentlist complementary contentinfo consent cookie cookies dialog disqus discussion feedback foot footer gdpr
    masthead menu menus menubar modal nav navbar navi navigation newsletter notice notices notification overlay pager
    pagination popup promo promotion promoted recommended related replies respond responses search share sharing sharebar
    shoutbox sidebar sidebars sidenav skip social sponsor sponsored subscribe subscription alert toolbar topbar widget widgets
    login signup signin outbrain taboola""".split()
)
_STATE_WORDS = frozenset("has no with without is js show hide enable enabled disable disabled open supports".split())
_GOOD_WORDS = frozenset("article body content entry hentry main post story text".split())
#: What a container is worth by its own tag and by a class that marks main text.
_WORTH = {"article": 25, "main": 25, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "th": -5}
_GOOD_CLASS = 25
#: So many elements around a paragraph get points of it, a half, a third and so on of what the first gets.
_LEVELS = 5
#: A list, table or section whose text is links by more than this share is a menu.
_MENU = 0.8
#: Neighbours of the best container stay from this share of its points on, and from so many points on.
_NEIGHBOUR, _LEAST_POINTS = 0.2, 5.0


@dataclass
class _Node:
    """An element; `hidden` ones go for what they are, `named` ones for their class, id or role."""

    tag: str
    parent: int
    hidden: bool = False
    named: bool = False
    good: bool = False
    mark: str = ""
    points: float = 0.0
    score: float = 0.0
    chars: int = 0
    linked: int = 0
    links: int = 0


@dataclass
class _Block:
    node: int
    text: str
    linked: int
    links: int


def _marks(rest: str) -> tuple[bool, bool, bool, str]:
    """What a tag's attributes say: something else than main text, main text, hidden; and its class."""
    if "=" not in rest and "hidden" not in rest:
        return False, False, False, ""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    words: set[str] = set()
    for name in ("class", "id", "role"):
        for token in found.get(name, "").split():
            parts = [w.lower() for w in _WORD.findall(token)]
            words.update(parts if parts and parts[0] not in _STATE_WORDS else ())
    good = not _GOOD_WORDS.isdisjoint(words)
    bad = not _BAD_WORDS.isdisjoint(words) or ("header" in words and not good)
    return bad, good, hidden, found.get("class", "")


class _Reader:
    """Reads a page once: the tree of its block elements, each after its parent, and its blocks of text in page order."""

    def __init__(self) -> None:
        self.nodes, self.blocks = [_Node("body", -1)], []
        self.path, self.open = [0], Counter()
        self.pieces: list[str] = []
        self.linked = self.links = self.muted = self.unread = 0
        self.in_link, self.spans = False, []

    def end_block(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(_Block(self.path[-1], text, min(self.linked, len(text)), self.links))
        self.pieces, self.linked, self.links = [], 0, 0

    def close(self, ends: frozenset[str], walls: frozenset[str], outermost: bool = False) -> None:
        """Ends the innermost (or outermost) open element of `ends`, with all in it, unless one of `walls` lies between."""
        if not any(self.open[tag] for tag in ends):
            return
        at = None
        for depth in range(len(self.path) - 1, 0, -1):
            tag = self.nodes[self.path[depth]].tag
            if tag in ends:
                at = depth
                if not outermost:
                    break
            elif tag in walls:
                break
        if at is not None:
            self.open.subtract(self.nodes[i].tag for i in self.path[at:])
            del self.path[at:]

    def text(self, piece: str) -> None:
        if self.muted or self.unread:
            return
        piece = html.unescape(piece) if "&" in piece else piece
        self.pieces.append(piece)
        if self.in_link:
            self.linked += len(" ".join(piece.split()))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        elif tag in _MUTE:
            self.muted = max(0, self.muted - 1)
        elif tag in _SPANS:
            self.unread -= self.spans.pop() if self.spans else 0
        elif tag in _BLOCKS:
            self.end_block()
            self.in_link = self.in_link and tag not in ("p", "li", "td")
            self.close(_HEADINGS if tag in _HEADINGS else frozenset((tag,)), frozenset() if tag in _TABLE else _CELLS)

    def start(self, tag: str, rest: str) -> None:
        if tag == "a":
            self.in_link = "href" in rest.lower()
            self.links += self.in_link
        elif tag in _MUTE:
            self.muted += 1
            self.pieces.append(" ")
        elif tag in _SPANS:
            bad, _, hidden, _ = _marks(rest)
            self.spans.append(int(bad or hidden))
            self.unread += self.spans[-1]
        elif tag in _BREAKS:
            self.pieces.append(" ")
        elif tag in _BLOCKS:
            self.end_block()
            self.muted = self.unread = 0
            self.spans = []
            if tag not in _TABLE:
                self.close(frozenset(("p",)), _CELLS)
            if tag in _ENDS:
                self.close(*_ENDS[tag], outermost=True)
            if tag == "hr":
                return
            bad, good, hidden, mark = _marks(rest)
            whole = self.open["article"] or self.open["main"]
            hidden = hidden or tag in _NEVER or (tag == "header" and not whole and not good)
            named = bad and not (good and tag in _WHOLES)
            self.nodes.append(_Node(tag, self.path[-1], hidden, named, good, mark))
            self.path.append(len(self.nodes) - 1)
            self.open[tag] += 1

    def read(self, page: str) -> tuple[list[_Node], list[_Block]]:
        at, size = 0, len(page)
        while at < size:
            match = _MARKUP.search(page, at)
            stop = match.start() if match else size
            if stop > at:
                self.text(page[at:stop])
            if match is None:
                break
            at = match.end()
            tag = (match["name"] or "").lower()
            if tag in _RAW and not match["end"]:
                if tag not in ("script", "style", "template", "noscript"):
                    self.pieces.append(" ")
                if not (tag in ("svg", "math") and match["rest"].endswith("/")):
                    closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                    at = closing.end() if closing else size
            elif tag:
                self.end(tag) if match["end"] else self.start(tag, match["rest"])
        self.end_block()
        return self.nodes, self.blocks


def _kept(nodes: list[_Node], by_name: bool) -> list[bool]:
    """Which elements lie in none that is dropped; a named one stays if it holds an article that isn't dropped itself."""
    holds = [n.tag in _WHOLES and not n.hidden and not n.named for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] = holds[nodes[i].parent] or (holds[i] and not nodes[i].hidden)
    kept: list[bool] = []
    for i, node in enumerate(nodes):
        gone = node.hidden or (by_name and node.named and not holds[i])
        kept.append(not gone and (node.parent < 0 or kept[node.parent]))
    return kept


def _score(nodes: list[_Node], blocks: list[_Block], kept: list[bool]) -> None:
    """Points of the kept paragraphs, passed to the elements around them and lessened by the share of links."""
    for node in nodes:
        node.points, node.chars, node.linked, node.links = 0.0, 0, 0, 0
    for block in blocks:
        if not kept[block.node]:
            continue
        own = nodes[block.node]
        own.chars, own.linked, own.links = own.chars + len(block.text), own.linked + block.linked, own.links + block.links
        if own.tag in _HEADINGS:
            continue
        points = 1 + block.text.count(",") + min(len(block.text) / 100, 3.0)
        around = own.parent if own.tag in _PARAGRAPHS and own.parent >= 0 else block.node
        for level in range(1, _LEVELS + 1):
            nodes[around].points += points / level
            around = nodes[around].parent
            if around < 0:
                break
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.chars, up.linked, up.links = up.chars + node.chars, up.linked + node.linked, up.links + node.links
    for node in nodes:
        node.points *= 1 - (node.linked / node.chars if node.chars else 0)
        node.score = node.points + (1 - (node.linked / node.chars if node.chars else 0)) * (_WORTH.get(node.tag, 0) + _GOOD_CLASS * node.good)


def _whole(nodes: list[_Node], best: int) -> int:
    """The article or main element that `best` is in, or the only one in it, if that has most of its text."""
    found, around = best, best
    while around >= 0:
        if nodes[around].tag == "article" or (nodes[around].tag == "main" and nodes[found].tag != "article"):
            found = around
        around = nodes[around].parent
    if nodes[found].tag == "article":
        return found
    inside, wholes = {found}, []
    for i in range(found + 1, len(nodes)):
        if nodes[i].parent in inside:
            inside.add(i)
            if nodes[i].tag in _WHOLES and 2 * nodes[i].chars >= nodes[found].chars:
                wholes.append(i)
    return wholes[-1] if wholes else found


def _chosen(nodes: list[_Node], kept: list[bool]) -> list[bool]:
    """Which elements belong to the best container or to a neighbour of it that is kept, but for lists of links."""
    no_holder = _HEADINGS | _PARAGRAPHS | {"tr", "tbody", "thead", "tfoot"} - {"pre"}
    holders = [i for i, n in enumerate(nodes) if n.chars and n.tag not in no_holder] or [0]
    best = _whole(nodes, max(holders, key=lambda i: (nodes[i].score, -i)))
    tops = {best}
    least = max(_LEAST_POINTS, nodes[best].points * _NEIGHBOUR)
    for i, node in enumerate(nodes):
        if node.parent == nodes[best].parent and node.parent >= 0 and node.chars:
            share = node.linked / node.chars
            same = node.mark == nodes[best].mark and (bool(node.mark) or node.tag in _WHOLES)
            if nodes[best].tag in _WHOLES:
                # what stands beside an article is none, unless it's another one of its kind
                near = same and node.tag == nodes[best].tag and node.points >= least
            elif node.tag in ("p", "pre", "blockquote") or node.tag in _HEADINGS:
                near = share < 0.25
            else:
                near = node.points >= least or (same and share < 0.5)
            tops.update((i,) if near else ())
    inside: list[bool] = []
    for i, node in enumerate(nodes):
        lists = i not in tops and node.tag in ("ul", "ol", "dl", "div", "table", "section") and node.links > 1
        menu = lists and node.linked > _MENU * node.chars
        inside.append(kept[i] and not menu and (i in tops or (node.parent >= 0 and inside[node.parent])))
    return inside


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks in page order, one a line; empty if it has none, or for null.

    Elements that never hold main text, are hidden, or are marked as something else by class, id or role go first. The
    rest is scored; the element with most points is kept whole, with neighbours like it, but for lists of links. If nothing
    else has text, the marks of class, id and role are not heeded."""
    if not page:
        return ""
    nodes, blocks = _Reader().read(page)
    for by_name in (True, False):
        kept = _kept(nodes, by_name)
        if any(kept[b.node] for b in blocks):
            _score(nodes, blocks, kept)
            inside = _chosen(nodes, kept)
            return "\n".join(b.text for b in blocks if inside[b.node])
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(value.as_py()) for value in batch.column(2)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: id, url, text (its main text, blocks joined by a line break), n_chars (code points of text).

    The whole page is read, whatever its length; character references are decoded, white space within a block becomes one
    space. A null or empty page, or one without main text, has the empty text. Repeated rows and null ids and URLs stay as
    they are; an empty table gives an empty result; other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    found = rows.mapInArrow(_extract, "id long, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars")
