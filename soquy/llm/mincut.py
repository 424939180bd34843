"""Main text of web pages by minimum-cut labelling of their text blocks.

A page becomes a sequence of text blocks. A classifier gives each block a cost for being labelled
content and one for being labelled boilerplate, from the elements it stands in, their class, id and
role, its length and its share of link text. The difference is the capacity of the block's edge to
one of the two terminals. Blocks next to each other, and blocks that follow each other within one
container, are joined by smoothness edges that get weaker with their distance in the document tree.
The minimum cut separates content from boilerplate; blocks on the content side make up the text.

* Blocks whose terminal capacity outweighs all their edges keep their side in some minimum cut, so
  they are settled first; the maximum flow runs over what is left.
* Comments, declarations, the head, scripts, styles and the like have no text. A tag or comment cut
  off at the end of the page is dropped; elements left open end with the page. Drawings, players and
  choice lists (``SKIPPED``) are left out with what they hold if they are closed; of one that is not,
  only the tag is. Formulas keep their text.
* Time is linear in the page, however deep its elements are nested; only the flow over blocks that
  are not settled takes longer.
* Character references are decoded, white space in a block (line breaks included) becomes one space,
  blocks are trimmed, empty ones dropped, and the rest joined by line ends in page order.
* A null or empty page has an empty text. Pages are independent of each other, so repeated rows get
  the same text each. Columns named as in ``ADDED`` are replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDED = ("text", "n_chars")

# Element names by what they mean for a page, and words in class and id attributes.
SILENT = frozenset("script style noscript iframe title textarea".split())
SKIPPED = frozenset("template object svg canvas audio video select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol search section table ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ALWAYS_OUT = frozenset("nav footer aside menu dialog search button".split())
MAIN = frozenset("article main".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright discussion disqus footer gdpr hidden login masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
IN_WORDS = frozenset("article content entry main maincontent post story".split())
# Parts of a class or id that say where or in what form something stands, not what it is.
FORM_WORDS = frozenset(
    "area articles bar block body bottom box button buttons col column container desktop fixed form group header icon icons id "
    "inner item items large latest layer left link links list mobile module more news outer page panel popular posts readers right "
    "row section site slot small sticky text title top unit user users wrap wrapper zone".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")

SETTLED = 1_000
LIKELY = 300
UNLIKELY = 20
NEAR = 60


@dataclass(slots=True)
class Place:
    """A container of the page, by its parent."""

    tag: str
    parent: Place | None
    depth: int
    bias: int
    inside: bool


@dataclass(slots=True)
class Block:
    text: str
    place: Place
    bias: int
    kind: str
    linked: int


def signal(tag: str, attributes: str, inside_main: bool) -> int:
    """What an element says of the text in it: settled out, likely in or out, or nothing."""
    if tag in ALWAYS_OUT:
        return -SETTLED
    if tag == "form" or (tag == "header" and not inside_main):
        return -LIKELY * 2
    if tag in MAIN:
        return LIKELY
    if not attributes or tag in ("html", "body"):
        return 0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    if role in OUT_ROLES:
        return -SETTLED
    if role in MAIN:
        return LIKELY
    if "none" in found.get("style", "") and re.search(r"display\s*:\s*none", found["style"]):
        return -SETTLED
    if found.get("aria-hidden") == "true" or re.search(r"(^|\s)hidden(\s|=|$)", re.sub(ATTRIBUTE, " ", attributes)):
        return -SETTLED
    names = [[p.lower() for p in NAME_PART.findall(n)] for n in f"{found.get('class', '')} {found.get('id', '')}".split()]
    parts = {p for name in names for p in name}
    if not parts & OUT_WORDS:
        return LIKELY // 2 if parts & IN_WORDS else 0
    # a name that is made of such words alone tells; one among others ("social-history") only hints
    plain = OUT_WORDS | FORM_WORDS | IN_WORDS
    if any(OUT_WORDS.intersection(name) and plain.issuperset(name) for name in names):
        return -LIKELY * 2
    return -UNLIKELY


def page_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    blocks: list[Block] = []
    here = Place("", None, 0, 0, False)
    opened: dict[str, int] = {}
    ends: dict[str, list[tuple[int, int]]] = {}
    held: list[str] = []
    links = linked = at = 0
    kind = ""

    def close() -> None:
        nonlocal held, linked
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                blocks.append(Block(text, here, here.bias, kind, linked))
        held, linked = [], 0

    def skipped(tag: str, at: int) -> int:
        """The end of an element that began before ``at``, or ``at`` where it is never closed."""
        if tag not in ends:  # all tags of that name, once for the page
            marks = re.finditer(rf"<(/?){re.escape(tag)}\b[^>]*(>|$)", page, re.I)
            ends[tag] = matched([(m.start(), m.end(), m[1] == "/") for m in marks], tag != "select")
        k = bisect_left(ends[tag], (at, -1))
        return ends[tag][k][1] if k < len(ends[tag]) and ends[tag][k][0] == at else at

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            held.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in SILENT and not closing and not m[3].endswith("/"):
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = found.end() if found else end
        elif tag in SKIPPED and not closing and not m[3].endswith("/"):
            at = skipped(tag, at)
        elif tag == "head" and not closing:
            found = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
            at = found.start() if found else at
        elif tag in BLOCKS or tag == "button":
            close()
            kind = "" if closing else tag
            if tag in CONTAINERS or tag == "button":
                if closing:
                    if opened.get(tag):
                        while (left := here.tag) and here.parent:
                            here = here.parent
                            opened[left] -= 1
                            if left == tag:
                                break
                else:
                    outer = here.bias
                    own = signal(tag, m[3], here.inside)
                    if outer <= -SETTLED or not own:
                        bias = outer
                    elif tag in MAIN or own < 0:
                        bias = min(own, outer) if own == -UNLIKELY else own
                    else:
                        bias = outer if outer < 0 else max(outer, own)
                    here = Place(tag, here, here.depth + 1, bias, here.inside or tag in MAIN)
                    opened[tag] = opened.get(tag, 0) + 1
    close()
    return blocks


def content_score(block: Block) -> int:
    """Cost of labelling a block boilerplate less that of labelling it content."""
    words = block.text.count(" ") + 1
    score = block.bias + min(words, 40) - 12
    score += 15 if block.text[-1] in ".!?:;\"'" else -5
    score += 10 if block.kind in ("p", "pre", "blockquote") else 0
    if len(block.text):
        score -= int(80 * min(1.0, block.linked / len(block.text)))
    return score


def matched(marks: list[tuple[int, int, bool]], nested: bool) -> list[tuple[int, int]]:
    """(end of the opening tag, end of the closing tag) of the elements that are closed, in order;
    an element that cannot hold one of its kind ends before the next."""
    open_, found = [], []
    for start, end, closing in marks:
        if closing:
            if open_:
                found.append((open_.pop(), end))
        else:
            if not nested:
                open_.clear()
            open_.append(end)
    return sorted(found)


def smoothness(a: Block, b: Block) -> int:
    """Weaker with the number of steps between the two containers in the tree; nothing beyond NEAR."""
    x, y, steps = a.place, b.place, 0
    while x is not y and steps < NEAR:
        if x.depth >= y.depth:
            x, steps = x.parent, steps + 1
        else:
            y, steps = y.parent, steps + 1
    return NEAR // (1 + steps) if x is y else 0


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut. A score is the capacity from the
    source, or to the sink if negative; edges carry their weight both ways."""
    near: list[dict[int, int]] = [{} for _ in scores]
    for a, b, w in edges:
        if w and a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    rest, side = list(scores), [None] * len(scores)
    waiting = deque(range(len(scores)))
    while waiting:  # settle what outweighs its edges, then its neighbours may follow
        k = waiting.popleft()
        if side[k] is None and abs(rest[k]) >= sum(near[k].values()):
            side[k] = rest[k] > 0
            for other, w in near[k].items():
                rest[other] += w if side[k] else -w
                del near[other][k]
                waiting.append(other)
            near[k] = {}
    rows = {k: row for row, k in enumerate(k for k, s in enumerate(side) if s is None)}
    if rows:
        left = max_flow_sides([rest[k] for k in rows], [{rows[o]: w for o, w in near[k].items()} for k in rows])
        for k, s in zip(rows, left, strict=True):
            side[k] = s
    return side


def max_flow_sides(scores: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Source side of the minimum cut, by augmenting along shortest level paths."""
    source, sink = len(scores), len(scores) + 1
    room: list[dict[int, int]] = [dict(x) for x in near] + [{}, {}]
    for k, score in enumerate(scores):
        if score > 0:
            room[source][k], room[k][source] = score, 0
        elif score < 0:
            room[k][sink], room[sink][k] = -score, 0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            k = queue.popleft()
            for o, w in room[k].items():
                if w > 0 and o not in level:
                    level[o] = level[k] + 1
                    queue.append(o)
        if sink not in level:
            return [k in level for k in range(len(scores))]
        left = {k: iter(list(room[k])) for k in level}
        path = [source]
        while path:
            k = path[-1]
            if k == sink:
                push = min(room[a][b] for a, b in zip(path, path[1:]))  # noqa: B905
                for a, b in zip(path, path[1:]):  # noqa: B905
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0) + push
                full = next(i for i, (a, b) in enumerate(zip(path, path[1:])) if not room[a][b])  # noqa: B905
                del path[full + 1 :]
                left[path[-1]] = iter([o for o in room[path[-1]] if room[path[-1]][o] > 0])
                continue
            step = next((o for o in left[k] if room[k].get(o, 0) > 0 and level.get(o) == level[k] + 1), None)
            if step is None:
                path.pop()
                level[k] = -1
            else:
                path.append(step)


def main_text(page: str | None) -> str:
    blocks = page_blocks(page) if page else []
    if not blocks:
        return ""
    edges, last_in = [], {}
    for k, block in enumerate(blocks):
        if k:
            edges.append((k - 1, k, smoothness(blocks[k - 1], block)))
        before = last_in.get(id(block.place))
        if before is not None and before < k - 1:
            edges.append((before, k, smoothness(blocks[before], block)))
        last_in[id(block.place)] = k
    sides = minimum_cut([content_score(b) for b in blocks], edges)
    return "\n".join(b.text for b, inside in zip(blocks, sides, strict=True) if inside)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All rows with the page's main text and its number of code points."""
    keep = [c for c in pages.columns if c not in ADDED]
    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch[html_col].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, *ADDED],
            )

    return pages.mapInArrow(run, schema)
