"""Main text of web pages by line-block distribution.

Markup is stripped to blocks (the lines).  Elements that never hold the
article (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments; by their name, role, class or id) contribute nothing.
Text lengths are summed over a sliding window of ``WINDOW`` lines; the text
surges where the sum first reaches ``SURGE`` characters and dives where it
falls below again.  The stretch between that holds most text is the core.  The
article is the container of the stretches: of every outermost article or main
element with text that surges, the least element of the kind that holds all
such text of it; if the core is in none, the least element around the core, or
one farther out as long as that adds text that surges and no more other text
before and after it.  All its blocks are kept, short ones too; where that is
only the page itself, the lines from the first surge to the last dive are kept,
and those that stand in the same places of the page.

Edge cases: null or empty html and pages without text give an empty text; an
element whose end tag is missing ends as in a browser (a head at the first
element or text of the page's body; li, dt, dd, tr, td and th at the next one; p
at a block; any at the end of an element around it); one without an end tag of its own also where
an article or main element begins, else with the page; a tag or quote that is
never ended takes the rest of the page, as in a browser; a page whose lines never surge keeps its article, or else all
its blocks; character references are decoded once; repeated rows and null ids
or urls are passed on; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ravelin.sources.tables import table

WINDOW = 3
SURGE = 80

# Elements by what they mean for the text.
RAW = "script style noscript template iframe object textarea title svg math canvas audio video select".split()
NEVER = {*RAW, *"head nav footer aside form button dialog menu input label fieldset".split()}
INLINE = {*"a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()}
VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
HOLDS = {"article", "main"}
BOXES = {*"table td th caption".split()}
# Elements that are a block of their own, not a container.
LINES = {*"p h1 h2 h3 h4 h5 h6 li dt dd tr td th".split()}
# Elements whose end tag may be left out: what starts end them, and what stops the search for them.
GROUPS = {*"thead tbody tfoot".split()}
LISTS = {*"ul ol menu dir".split()}
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, **dict.fromkeys(GROUPS, {*GROUPS, "caption", "tr", "td", "th"})}
STOPS = {"li": LISTS | BOXES, "dt": {"dl"} | BOXES, "dd": {"dl"} | BOXES, "p": BOXES, **dict.fromkeys(("td", "th"), {"table", "tr"}), **dict.fromkeys(("tr", *GROUPS), {"table"})}
# What a head may hold (further elements are raw or void).
HEADED = {*"html head base link meta".split()}
# Words of a class, id or role that mark what isn't the article.
MARKS = {
    *"ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus".split(),
    *"dialog feedback footer header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion".split(),
    *"related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split(),
    *"alert complementary contentinfo discussion footnav leaderboard reactions recommendations recommended".split(),
}
# Words of reader comments; a name of nothing but these and neutral words marks whatever stands beside it.
COMMENTS = {*"comment comments commentlist disqus replies reply respond discussion".split()}
NEUTRAL = {*"list area thread section item box wrapper container block body text content".split()}
# Words of a class or id that speak for the article.
SPEAKS = {*"article body content entry main post story text".split()}

#: The rest of a tag, as browsers read it: a quote begins a value after = alone, and what isn't ended takes the rest of the page.
_REST = r"(?:[^>=]++|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + rf")(?=[\s/>]){_REST}(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>{_REST})(?:>|\Z)|<[!?][^<>]*>?",
    re.DOTALL | re.IGNORECASE,
)
_MARKED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marked(rest: str, inside: bool, holds: bool = False) -> bool:
    """Whether a name in class, id or role marks the element, and none of the same attribute speaks for the article alone; reader comments are marked in any company.

    Within an article the word header marks nothing: its own title stands there.
    An article element (``holds``) must be marked by all of its names.
    """
    if "=" not in rest:
        return False
    for m in _MARKED.finditer(rest):
        names = [{p.lower() for p in _PARTS.findall(n)} for n in (m[2] or m[3] or m[4] or "").split()]
        if any(n & COMMENTS and n <= COMMENTS | NEUTRAL for n in names):
            return True
        against = [bool(n & MARKS - ({"header"} if inside else set())) for n in names]
        if holds:
            if against and all(against):
                return True
        elif any(against) and not any(n & SPEAKS and not bad for n, bad in zip(names, against, strict=True)):
            return True
    return False


def unended(tags: list[re.Match]) -> set[int]:
    """Where the start tags stand that no end tag of their own name belongs to (each end tag belongs to the last open start)."""
    open_: dict[str, list[int]] = {}
    for m in tags:
        name = (m["name"] or "").lower()
        if name and m["end"]:
            if open_.get(name):
                open_[name].pop()
        elif name:
            open_.setdefault(name, []).append(m.start())
    return {at for starts in open_.values() for at in starts}


class Node(NamedTuple):
    """An element that holds blocks: the one around it, whether it is an article or main, and its blocks' places."""

    parent: int
    holds: bool
    low: int
    high: int


def blocks_of(page: str) -> tuple[list[tuple[str, int, bool]], list[Node]]:
    """Blocks outside elements that never hold the article, and the elements around them, the page itself first.

    A block is its text, the number of the innermost element and whether all of
    it is link text.  Blocks of an element stand together in page order.
    """
    out: list[tuple[str, int, bool]] = []
    open_: list[tuple[str, int]] = []  # elements around, with a number if they are containers
    names: Counter[str] = Counter()  # of those around
    inner = [0]  # the containers around
    nodes: list[list] = [[0, False, 0, 0]]
    text: list[str] = []
    linked = plain = 0
    link = False
    dropped, last = -1, 0  # dropped: the place among those around of the element that contributes nothing
    tags = list(_TOKEN.finditer(page))
    bare, lasts = unended(tags), False  # lasts: whether the dropped element has an end tag of its own

    def close() -> None:
        nonlocal linked, plain
        if text and (words := html.unescape("".join(text)).split()):
            out.append((" ".join(words), inner[-1], linked > 4 * plain))
        text.clear()
        linked = plain = 0

    def enter(name: str, number: int = 0) -> None:
        open_.append((name, number))
        names[name] += 1
        if number:
            inner.append(number)

    def add(part: str) -> None:
        nonlocal linked, plain
        text.append(part)
        size = len(part.strip())
        linked, plain = linked + size * link, plain + size * (not link)

    def leave(place: int) -> None:
        nonlocal dropped, link
        while len(open_) > place:
            name, number = open_.pop()
            names[name] -= 1
            if number:
                inner.pop()
                nodes[number][3] = len(out)
        if 0 <= place <= dropped:
            dropped, link = -1, False

    def within(name: str, stops: set[str]) -> int:
        """Place of the innermost element of this name that no stop is within, or -1."""
        for k in range(len(open_) - 1, -1, -1) if names[name] else ():
            if open_[k][0] == name:
                return k
            if open_[k][0] in stops:
                break
        return -1

    def ended_by(name: str) -> int:
        """Place of the outermost element that the start of this one ends for want of an end tag, or -1."""
        place = -1
        if name in HOLDS and dropped >= 0 and not lasts:
            place = dropped
        elif name not in HEADED and dropped >= 0 and open_[dropped][0] == "head":
            place = dropped
        elif name in ENDED and any(names[n] for n in ENDED[name]):
            stops = STOPS[name]
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in ENDED[name]:
                    place = k
                elif open_[k][0] in stops:
                    break
                if place >= 0 and name in ("li", "dt", "dd", "td", "th"):
                    break
        if place < 0 and name not in INLINE and name not in VOID or name == "hr":
            place = within("p", BOXES)
        return place

    for m in tags:
        if m.start() > last:
            part = page[last : m.start()]
            if 0 <= dropped == len(open_) - 1 and open_[dropped][0] == "head" and not part.isspace():
                leave(dropped)  # text of the body
            if dropped < 0:
                add(part)
        last = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            place = within(name, STOPS.get(name, set()))
        else:
            place = ended_by(name)
        if dropped >= 0:
            if m["end"]:
                if place >= 0:
                    if place < dropped:
                        close()  # an element around it ends
                    leave(place)
                continue
            if place >= 0:
                if place <= dropped:
                    close()
                leave(place)
            if dropped >= 0:
                if name not in VOID and not m["rest"].endswith("/"):
                    enter(name)
                continue
            place = -1
        if name == "br":
            text.append(" ")
        elif name == "a":
            link = not m["end"]
        inside = any(names[n] for n in HOLDS)
        if name in INLINE and (m["end"] or not _marked(m["rest"], inside)) or name == "br":
            continue
        if name not in INLINE:
            close()
        if place >= 0:
            leave(place)
        if m["end"]:
            link = False
        elif name not in VOID:
            never = name in NEVER or (name == "header" and not inside) or (name not in ("body", "html", "main") and _marked(m["rest"], inside, name in HOLDS))
            if never and not m["rest"].endswith("/"):
                dropped, lasts = len(open_), m.start() not in bare
                enter(name)
                continue
            if name in ("html", "body"):
                continue  # the page
            if name in LINES:
                enter(name)
                continue
            nodes.append([inner[-1], name in HOLDS, len(out), 0])
            enter(name, len(nodes) - 1)
    if last < len(page):
        if 0 <= dropped == len(open_) - 1 and open_[dropped][0] == "head" and not page[last:].isspace():
            leave(dropped)
        if dropped < 0:
            add(page[last:])
    close()
    leave(0)
    nodes[0][3] = len(out)
    return out, [Node(*n) for n in nodes]


def stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[surge, dive) of the lines whose window sums reach ``surge``."""
    found: list[tuple[int, int]] = []
    start = None
    for i in range(len(lengths) + 1):
        high = i < len(lengths) and sum(lengths[i : i + window]) >= surge
        if high and start is None:
            start = i
        elif not high and start is not None:
            end = i
            while end < min(len(lengths), i + window - 1) and lengths[end] >= surge:
                end += 1
            found.append((start, end))
            start = None
    return found


def main_text(page: str | None) -> str:
    """The blocks of the article, two line feeds between them."""
    blocks, nodes = blocks_of(page or "")
    lengths = [0 if linked else len(t) for t, _, linked in blocks]
    found = stretches(lengths)
    outermost = [0] * len(nodes)  # article or main around each element
    for n, node in enumerate(nodes[1:], 1):
        outermost[n] = outermost[node.parent] or (n if node.holds else 0)
    if not found:
        held = [t for t, n, _ in blocks if outermost[n]]
        return "\n\n".join(held or (t for t, *_ in blocks))
    core = max(found, key=lambda s: sum(lengths[s[0] : s[1]]))
    own = [i for i in range(*core) if lengths[i]]
    surging = [i for s in found for i in range(*s) if lengths[i]]
    surges = set(surging)
    weight = [0, *accumulate(lengths[i] if i in surges else 0 for i in range(len(blocks)))]  # text that surges before each block
    chars = [0, *accumulate(len(t) for t, *_ in blocks)]
    inside = lambda n: weight[nodes[n].high] - weight[nodes[n].low]
    if any(outermost[blocks[i][1]] for i in own):
        # of each outermost one the element with most of the text that surges; of such that are within each other, the inner one
        best: dict[int, tuple[int, int]] = {}
        for n, node in enumerate(nodes):
            if node.holds and inside(n):
                best[outermost[n]] = max(best.get(outermost[n], (0, 0)), (inside(n), n))
        kept = sorted((nodes[n].low, nodes[n].high) for _, n in best.values())
        return "\n\n".join(t for low, high in kept for t, *_ in blocks[low:high])
    around = blocks[own[0]][1]
    while not nodes[around].low <= own[0] <= own[-1] < nodes[around].high:
        around = nodes[around].parent
    least = outer = around
    while outer:
        outer = nodes[outer].parent
        low, high = nodes[outer].low, nodes[outer].high
        start, end = surging[bisect_left(surging, low)], surging[bisect_left(surging, high) - 1] + 1
        more = inside(outer) - inside(around)
        # what is outside of the stretches there: menus and the like outweigh no text
        a, b = nodes[around].low, nodes[around].high
        beyond = chars[start] - chars[low] + chars[high] - chars[end] - max(0, chars[start] - chars[a]) - max(0, chars[b] - chars[end])
        if more and more >= beyond:
            around = outer
    if around:
        return "\n\n".join(t for t, *_ in blocks[nodes[around].low : nodes[around].high])
    # the page itself: what is between, and blocks that stand where those of the stretches do
    beside = {blocks[i][1] for i in surging}
    near = range(nodes[least].low, nodes[least].high) if least else range(0)
    return "\n\n".join(t for i, (t, n, linked) in enumerate(blocks) if found[0][0] <= i < found[-1][1] or i in near or (n in beside and not linked))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            out = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


def op7_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
