"""Main text of web pages: blocks are labelled content or boilerplate by a minimum cut.

A page is read into blocks, the stretches of text between boundaries of block elements. A linear classifier gives each
block a cost for either label; these are the capacities to the two terminals. Blocks that follow each other, and blocks
that share a parent, are tied by edges whose capacity falls with their distance in the tree. The minimum cut is the
labelling of least total cost, so a short heading goes with the paragraphs around it and a sentence in a menu with the
menu. A block whose own cost outweighs all its edges is decided at once, which leaves the cut unchanged; what remains is
cut by augmenting paths.

Every page is one row and is labelled by itself: nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_of

# The element kinds of HTML, and words that name parts of a page in classes and ids.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button title head noframes noembed datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related recommended "
    "reply replies respond share sharing sidebar sitenav skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
CONTENT_NAMES = frozenset("article articlebody body content entry main post story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol menu dl table div article section body html td th aside nav".split())

# Weights of the classifier: positive speaks for content.
START, WORD, WORDS_MOST, SENTENCE, IN_CONTENT, NAMED, TEXT_TAG, LINKED, BOILER, PAGE_HEADER = -1.0, 0.06, 2.4, 1.2, 3.0, 1.5, 0.8, -4.0, -9.0, -4.0
# Capacities between neighbours: a part for being adjacent, and one that falls with the distance in the tree.
ADJACENT, PROXIMITY = 0.2, 0.6

_TAG = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAMING = frozenset("class id role itemprop".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
#: Elements that the search for an element to close stops at or looks for.
_STOPS = SCOPES | {"p", *SAME} | {t for group in SAME.values() for t in group}
#: Steps in the tree beyond which blocks are no neighbours.
FAR = 64


@dataclass(eq=False)
class Node:
    """A block element: its parent and its depth."""

    parent: Node | None
    depth: int


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    node: Node
    content: bool
    named: bool
    boiler: bool
    header: bool


@dataclass
class _Open:
    tag: str
    #: The nearest block element at or above, with its own name and marks.
    holder: _Open | None = None
    node: Node | None = None
    content: bool = False
    named: bool = False
    boiler: bool = False
    header: bool = False
    link: bool = False
    skipped: bool = False


def hidden(attributes: dict[str, str]) -> bool:
    """An element that a browser does not show, by its own attributes."""
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(attributes.get("style", "")))


def attributes_of(inside: str) -> dict[str, str]:
    """Attributes of a tag by their lower-case names; the first of equal names counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(inside):
        value = m[2] or ""
        found.setdefault(m[1].lower(), value[1:-1] if value[:1] in "\"'" else value)
    return found


@dataclass
class _Reader:
    """Reads a page into blocks, closing elements as browsers do."""

    page: str
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    #: Places in the stack of the elements that end a search, and how many elements of each name are open.
    stops: list[int] = field(default_factory=list)
    count: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def __post_init__(self) -> None:
        root = _Open("", node=Node(None, 0))
        root.holder = root
        self.stack.append(root)

    def run(self) -> list[Block]:
        at, page = 0, self.page
        while found := _TAG.search(page, at):
            self.text(page[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, closing = name.lower(), found[1] or found[4]
            if closing:
                self.end(name)
                continue
            self.start(name, found[3] or found[6] or "")
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
                self.end(name)
        self.text(page[at:])
        self.flush()
        return self.blocks

    def text(self, piece: str) -> None:
        top = self.stack[-1]
        if piece and not top.skipped:
            self.parts.append(piece)
            if top.link:
                self.linked += len(piece)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                holder = self.stack[-1].holder
                self.blocks.append(Block(text, self.linked, holder.tag, holder.node, holder.content, holder.named, holder.boiler, holder.header))
            self.parts, self.linked = [], 0

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
            if name in CLOSES_P:
                self.close_nearest({"p"})
            if name in SAME:
                self.close_nearest(SAME[name])
        elif name == "br":
            self.parts.append(" ")
        if name in VOID:
            return
        up = self.stack[-1]
        new = _Open(name, up.holder, None, up.content, up.named, up.boiler, up.header, up.link or name == "a", up.skipped)
        if name in BLOCKS:
            new.holder, new.node = new, Node(up.holder.node, up.holder.node.depth + 1)
        own = attributes_of(attributes) if attributes else {}
        if name in SKIPPED or own and hidden(own):
            new.skipped = True
        new.content |= name in CONTENT_TAGS
        new.header |= name == "header"
        new.boiler |= name in BOILER_TAGS
        if own and name not in ("html", "body", "p", *HEADINGS):
            names = {p.lower() for a in _NAMING & own.keys() for p in _PARTS.findall(own[a])}
            new.boiler |= not names.isdisjoint(BOILER_NAMES)
            new.named |= not names.isdisjoint(CONTENT_NAMES)
        if name in _STOPS:
            self.stops.append(len(self.stack))
        self.stack.append(new)
        self.count[name] += 1

    def cut(self, size: int) -> None:
        """Close all elements from this place on."""
        while len(self.stack) > size:
            self.count[self.stack.pop().tag] -= 1
        while self.stops and self.stops[-1] >= size:
            self.stops.pop()

    def close_nearest(self, names: set[str]) -> None:
        for k in reversed(self.stops):
            tag = self.stack[k].tag
            if tag in names:
                self.cut(k)
                return
            if tag in SCOPES:
                return

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if self.count[name]:
            k = len(self.stack) - 1
            while self.stack[k].tag != name:
                k -= 1
            self.cut(k)


def read_blocks(page: str) -> list[Block]:
    return _Reader(page).run()


def block_value(block: Block) -> float:
    """What labelling the block boilerplate costs above labelling it content."""
    words = block.text.count(" ") + 1
    value = START + min(WORDS_MOST, WORD * words) - min(1.0, block.linked / max(1, len(block.text))) * -LINKED
    value += SENTENCE * (block.text[-1] in ".!?…:;\"”»。！？")
    value += IN_CONTENT * block.content + NAMED * block.named + TEXT_TAG * (block.tag in HEADINGS or block.tag in ("p", "blockquote", "pre"))
    value += BOILER * block.boiler + PAGE_HEADER * (block.header and not (block.content and block.tag in HEADINGS))
    return value


def distance(a: Node, b: Node) -> int | None:
    """Steps between two block elements of a page in its tree; None beyond ``FAR``."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
        if steps > FAR:
            return None
    return steps


def ties(blocks: Sequence[Block]) -> list[tuple[int, int, float]]:
    """Edges of neighbours: each block with the next one, and with the last one before that under the same parent."""
    edges, last = [], {}
    for k, block in enumerate(blocks):
        parent = id(block.node.parent or block.node)
        if k:
            apart = distance(blocks[k - 1].node, block.node)
            edges.append((k - 1, k, ADJACENT + (0.0 if apart is None else PROXIMITY / (1 + max(0, apart - 2)))))
        before = last.get(parent)
        if before is not None and before < k - 1:
            edges.append((before, k, PROXIMITY / 2))
        last[parent] = k
    return edges


def minimum_cut(values: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of the least cut; on a tie the larger boilerplate side."""
    n, value = len(values), list(values)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        k = waiting.popleft()
        if label[k] is None and abs(value[k]) > sum(near[k].values()):
            label[k] = value[k] > 0
            for j, w in near[k].items():
                value[j] += w if label[k] else -w
                del near[j][k]
                waiting.append(j)
            near[k] = {}
    open_ = [k for k in range(n) if label[k] is None]
    for part in _joined(open_, near):
        place = {k: i for i, k in enumerate(part)}
        for k, side in zip(part, _max_flow([value[k] for k in part], [{place[j]: w for j, w in near[k].items()} for k in part]), strict=True):
            label[k] = side
    return [bool(x) for x in label]


def _joined(nodes: list[int], near: list[dict[int, float]]) -> Iterator[list[int]]:
    """The connected parts of the undecided nodes; each is cut by itself."""
    seen: set[int] = set()
    for node in nodes:
        if node not in seen:
            seen.add(node)
            part = [node]
            for k in part:
                new = [j for j in near[k] if j not in seen]
                seen.update(new)
                part += new
            yield sorted(part)


def _max_flow(value: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Nodes that the source reaches once no augmenting path is left (shortest paths first)."""
    n = len(value)
    source, sink = n, n + 1
    room: list[dict[int, float]] = [dict(x) for x in near] + [{}, {}]
    for k, v in enumerate(value):
        if v > 0:
            room[source][k], room[k][source] = v, 0.0
        else:
            room[k][sink], room[sink][k] = -v, 0.0
    while True:
        came, line = {source: source}, deque([source])
        while line and sink not in came:
            k = line.popleft()
            for j, w in room[k].items():
                if w > 1e-12 and j not in came:
                    came[j] = k
                    line.append(j)
        if sink not in came:
            return [k in came for k in range(n)]
        path = [sink]
        while path[-1] != source:
            path.append(came[path[-1]])
        steps = [(path[k + 1], path[k]) for k in range(len(path) - 1)]
        flow = min(room[a][b] for a, b in steps)
        for a, b in steps:
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line; empty for a page without any."""
    blocks = read_blocks(page or "")
    content = minimum_cut([block_value(b) for b in blocks], ties(blocks))
    return "\n".join(b.text for b, c in zip(blocks, content, strict=True) if c)


_TEXTS = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            yield batch_of(_TEXTS, [part.column(0), part.column(1), [main_text(p) for p in part.column(2).to_pylist()]])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: ``id``, ``url``, ``text``.

    A null or empty page has an empty text; repeated rows stay; an empty table gives no rows. Other columns stay outside.
    On a tie of the cut the larger side is boilerplate. Long pages and deep nesting take memory and time in their length.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(_extracted, "id long, url string, text string")
