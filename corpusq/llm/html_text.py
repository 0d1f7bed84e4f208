"""HTML extraction by nearest-URL page differencing.

Pages are ordered by host and URL path, so that the pages around one are its
nearest by path within the host.  The text lines of a page are aligned with
those of up to ``REACH`` pages on either side by their longest common
subsequence.  Pages with the same lines are copies: a copy of the page is not
compared with it, and copies of a neighbour count once.

* A line that at least ``LEAST`` and most of the neighbours share is what the site
  repeats.  It is deleted inside the page's article (``article`` or ``main``)
  too.  A passage that fewer share is a quotation, text of both pages.  Where
  such lines are more than half of the text, the neighbours are versions of the
  page, not its frame, and nothing is deleted for them.
* Where a page marks its article, the other lines of it are the result.
  Elsewhere they are the lines outside menus, forms and the like, without those
  that the neighbour with the longest common path shares; a neighbour that
  shares most of the page is passed over for the next.
* What is furniture is told by elements, roles and names.  A name counts where all
  its words do (``comment-list``, not ``comments-on-policy``); in an article only names
  of containers do, and no id of a section or heading.  Headings and
  paragraphs in the header of an article are part of it.  An article in a container named like furniture is the text
  where the page has no other.

The order is by range, not by group: a host of any size spreads over many
tasks, and a task holds a few pages at a time.  Pages at the edges of the ranges
are settled in a second step, from a table of the pages around the edges, so the
text of a page does not depend on where the ranges are cut.

* null html counts as empty: text "" and n_chars 0; a null url is a page of the
  host "" and path "";
* repeated rows are separate pages and, being copies, do not delete each other's
  lines; pages of one url stand in order of page_id, then of a hash of the html;
* very long pages are read whole, tags in linear time; lines that repeat are aligned
  a machine word at a time; unclosed and stray tags are read as browsers
  roughly do;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from html import unescape
from math import isqrt
from os.path import commonprefix
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import cut
from .tokens import as_bytes

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^\"'<>]*+>)?|[!?])")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Element names by their role, and the words that name page furniture.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
FURNITURE = frozenset("head nav footer aside form button select dialog menu noscript template".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner sponsor sponsored promo promotion sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices newsletter "
    "subscribe subscription popup modal overlay share sharing social related recommended recommendations comment "
    "comments disqus reply replies respond widget widgets toolbar pagination pager alert".split()
)
# Words that leave a name what it is: a "comment-list" is comments, "comments-on-policy" is not.
NEUTRAL = frozenset(
    "site page main global top bottom left right upper lower inner outer primary secondary sticky fixed slot unit box "
    "bar block area section container wrapper wrap content body panel group list item items row col column entry form "
    "button buttons icon icons link links text title label thread user reader article articles post posts story "
    "stories news signup in on js".split()
)
CONTAINERS = frozenset("div section ul ol dl table details center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p blockquote".split())

#: Neighbours on either side that a page is compared with.
REACH = 3
#: Bits that are worked on at once, against one meeting of two lines.
WORD = 64
#: Neighbours that share a line of the frame, at least.
LEAST = 3
#: Pages around edges that are settled together.
BLOCK = 24
#: Compression of pages on their way through the shuffle, and of the table of texts.
CODEC = ("brotli", 6)
TABLE_OPTIONS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


class Line(NamedTuple):
    text: str
    article: bool
    furniture: bool
    wrapped: bool = False  # in an article that stands in a container named like furniture


class Page(NamedTuple):
    page_id: object
    url: str | None
    host: str
    path: str
    lines: list[Line]


def _is_named(names: str) -> bool:
    """Whether one of the names is furniture: of its words at least one names it and
    the others, figures aside, are neutral."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        words = [w for w in words if not re.fullmatch(r"[0-9x]+", w)]
        if any(w in NAMES for w in words) and all(w in NAMES or w in NEUTRAL for w in words):
            return True
    return False


def _hidden(found: dict[str, str], attributes: str) -> bool:
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true":
        return True
    return bool(re.search(r"display\s*:\s*none", found.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|$)", attributes))


def _named(name: str, found: dict[str, str], article: bool) -> bool:
    """Whether classes and ids make an element furniture.  In an article only those of
    containers do, and not the ids of sections, which are what links point to."""
    if name in HEADINGS or article and name not in CONTAINERS:
        return False
    ids = "" if article and name == "section" else found.get("id", "")
    return _is_named(f"{found.get('class', '')} {ids}")


class _Tags:
    """Tags of a page from left to right, in time linear in its length.  A quote
    without a partner is a plain character; a tag without an end is text."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.lone = {'"': len(html), "'": len(html)}  # from here on there is no partner
        self.dead: set[int] = set()  # places outside quotes from which no tag ends

    def _end(self, at: int) -> int:
        """Place after the ``>`` of a tag whose attributes start at ``at``, or -1."""
        html, seen = self.html, []
        while at <= self.last and at not in self.dead:
            seen.append(at)
            stop = _STOP.search(html, at)
            if stop is None:
                break
            at = stop.end()
            quote = stop[0]
            if quote == ">":
                return at
            if at < self.lone[quote]:
                partner = html.find(quote, at)
                if partner < 0:
                    self.lone[quote] = at
                else:
                    at = partner + 1
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" or "", name, attributes); no name for comments and the like."""
        html = self.html
        while True:
            tag = _OPEN.search(html, at)
            if tag is None:
                return None
            if tag[0] == "<!--":
                end = html.find("-->", tag.end())
                return tag.start(), len(html) if end < 0 else end + 3, "", "", ""
            if tag.start() > self.last:
                at = tag.end()
                continue
            if tag[2] is None:
                return tag.start(), html.find(">", tag.end()) + 1, "", "", ""
            begin = tag.end(2)
            end = tag.end() if tag[3] else self._end(begin)
            if end > 0:
                return tag.start(), end, tag[1], tag[2].lower(), html[begin : end - 1]
            at = begin


def lines_of(html: str | None) -> list[Line]:
    """The page's blocks of text in order, white space collapsed, none empty."""
    html = html or ""
    tags = _Tags(html)
    lines: list[Line] = []
    pieces: list[str] = []
    # (element, in an article, in furniture, in an article within furniture by name, furniture by name alone,
    # in the header of an article)
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = [("", False, False, False, False, False)]
    opened: Counter = Counter()  # elements on the stack
    at = 0

    def flush():
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                lines.append(Line(text, *stack[-1][1:4]))

    while True:
        tag = tags.next(at)
        if tag is None:
            pieces.append(html[at:])
            break
        start, end, closing, name, attributes = tag
        if start > at:
            pieces.append(html[at:start])
        at = end
        if not name:
            continue
        if name not in INLINE:
            flush()
        if closing:
            if opened[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                if name in INLINE and stack[-1][1:4] != stack[i - 1][1:4]:
                    flush()
                for entry in stack[i:]:
                    opened[entry[0]] -= 1
                del stack[i:]
            continue
        if name == "br":
            pieces.append(" ")
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else len(html)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        _, article, furniture, wrapped, by_name, header = stack[-1]
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        if name in ("body", "html"):
            pass
        elif name in FURNITURE or name == "header" and not article or found and name != "main" and _hidden(found, attributes):
            furniture, wrapped, by_name, header = True, False, False, False
        elif name == "header":
            header, furniture = header or not furniture, True
        elif header and name in PARAGRAPHS:
            furniture = False
        elif name in MAIN:
            if name == "article" and not furniture and _is_named(found.get("class", "")):
                furniture = by_name = True
            wrapped = wrapped or by_name
            article = article or not furniture
        elif not furniture and _named(name, found, article):
            furniture = by_name = True
        elif wrapped and _named(name, found, True):
            wrapped = by_name = False
        if (article, furniture, wrapped) != stack[-1][1:4]:
            flush()
        stack.append((name, article, furniture, wrapped, by_name, header))
        opened[name] += 1
    flush()
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of the two."""
    shared: set[int] = set()
    low, high_a, high_b = 0, len(a), len(b)
    while low < min(high_a, high_b) and a[low] == b[low]:
        shared.add(low)
        low += 1
    while min(high_a, high_b) > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
        shared.add(high_a)
    wanted = Counter(b[low:high_b])
    own = [i for i in range(low, high_a) if wanted[a[i]]]
    if own:
        kept = {a[i] for i in own}
        left, right = [a[i] for i in own], [x for x in b[low:high_b] if x in kept]
        meetings = sum(wanted[x] for x in left)
        align = _by_meetings if meetings * WORD <= len(left) * len(right) else _by_bits
        shared.update(own[i] for i in align(left, right))
    return shared


def _by_meetings(a: list[str], b: list[str]) -> list[int]:
    """Longest common subsequence by the pairs of equal lines, for lines that are mostly unlike."""
    places: dict[str, list[int]] = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        places[b[j]].append(j)
    tails: list[int] = []  # smallest end in b of a common subsequence of each length
    links: list[tuple] = []  # (position in a, chain before it) of those
    for i, line in enumerate(a):
        for j in places[line]:
            k = bisect_left(tails, j)
            chain = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(chain)
            else:
                tails[k], links[k] = j, chain
    found = []
    chain = links[-1] if links else None
    while chain:
        found.append(chain[0])
        chain = chain[1]
    return found


def _by_bits(a: list[str], b: list[str]) -> list[int]:
    """The same for lines that repeat: a row of the table of lengths is a whole number
    whose zero bits are its steps.  Rows are kept at every root of their number and the
    rows between worked out again on the way back."""
    full = (1 << len(b)) - 1
    places: dict[str, int] = defaultdict(int)
    for j, line in enumerate(b):
        places[line] |= 1 << j
    stride = isqrt(len(a)) + 1

    def after(row: int, line: str) -> int:
        steps = row & places[line]
        return ((row + steps) | (row - steps)) & full

    starts, row = [], full
    for i, line in enumerate(a):
        if i % stride == 0:
            starts.append(row)
        row = after(row, line)
    found, j = [], len(b)
    for block in range(len(starts) - 1, -1, -1):
        first = block * stride
        rows = [starts[block]]
        for line in a[first : first + stride]:
            rows.append(after(rows[-1], line))
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:  # no step here: the line of b is in no longer one
                j -= 1
                continue
            i -= 1
            if rows[i] >> (j - 1) & 1:  # the step begins with this line of a
                j -= 1
                found.append(first + i)
    return found


def _alignments(page: Page, others: list[Page | None]) -> list[set[int]]:
    """Lines of a page that each neighbour shares, nearest by path first."""
    texts = [x.text for x in page.lines]
    near = [o for o in others if o is not None and o.host == page.host]
    near.sort(key=lambda o: -len(commonprefix([o.path, page.path])))
    out, seen = [], {tuple(texts)}
    for other in near:
        lines = tuple(x.text for x in other.lines)
        if lines not in seen:
            seen.add(lines)
            out.append(shared_lines(texts, lines))
    return out


def main_text(page: Page, others: list[Page | None]) -> str:
    aligned = _alignments(page, others)
    inside = [i for i, x in enumerate(page.lines) if x.article and not x.furniture]
    inside = inside or [i for i, x in enumerate(page.lines) if x.wrapped]
    marked = bool(inside)
    kept = inside or [i for i, x in enumerate(page.lines) if not x.furniture]

    def size(lines) -> int:
        return sum(len(page.lines[i].text) for i in lines)

    counts = Counter(i for shared in aligned for i in shared)
    frame = {i for i in kept if counts[i] >= LEAST and 2 * counts[i] > len(aligned)}
    if 2 * size(frame) > size(kept):
        frame = set()
    if not marked:
        whole = size(range(len(page.lines)))
        frame |= next((shared for shared in aligned if 2 * size(shared) <= whole), set())
    return "\n".join(page.lines[i].text for i in kept if i not in frame)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def _packed(pages: DataFrame, kind: str) -> DataFrame:
    """Pages with their html compressed, for the way through the shuffle."""
    typed = StructType.fromDDL(f"page_id {kind}, url string, packed binary, size int, host string, path string, hash long")
    out_schema = to_arrow_schema(typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [as_bytes(t) for t in batch.column(2).to_pylist()]
            codec = pa.Codec(*CODEC)
            packed = pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())
            sizes = pa.array([len(r) for r in raw], pa.int32())
            columns = [batch.column(0), batch.column(1), packed, sizes, batch.column(3), batch.column(4), batch.column(5)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    columns = [_host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), F.xxhash64("html").alias("hash")]
    return pages.select("page_id", "url", "html", *columns).mapInArrow(run, typed)


def _page(page_id, url: str | None, packed: bytes, size: int, host: str, path: str) -> Page:
    html = pa.Codec(*CODEC).decompress(packed, size, asbytes=True).decode("utf-8", "surrogatepass")
    return Page(page_id, url, host, path, lines_of(html))


def _ranges(ordered: DataFrame, kind: str) -> DataFrame:
    """The pages of each sorted range: ``text`` of those with all their
    neighbours; and, packed and with their place, the ``2 * REACH`` rows at either
    end, of which the outer half is open, without text."""
    typed = StructType.fromDDL(
        f"page_id {kind}, url string, text string, edge boolean, open boolean, packed binary, size int, host string, "
        "path string, part int, pos long, n long"
    )
    out_schema = to_arrow_schema(typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def give(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        window: deque[Page] = deque(maxlen=2 * REACH + 1)
        head: list[tuple] = []
        tail: deque[tuple] = deque(maxlen=2 * REACH)
        n = 0
        for batch in batches:
            done = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                window.append(_page(*row))
                tail.append((n, row))
                if n < 2 * REACH:
                    head.append((n, row))
                n += 1
                if len(window) == 2 * REACH + 1:
                    page = window[REACH]
                    text = main_text(page, [p for p in window if p is not page])
                    done.append((page.page_id, page.url, text, False, False, None, None, None, None, part, None, None))
            yield give(done)
        edges = dict(head) | dict(tail)
        yield give(
            [
                (page_id, url, None, True, pos < REACH or pos >= n - REACH, packed, size, host, path, part, pos, n)
                for pos, (page_id, url, packed, size, host, path) in sorted(edges.items())
            ]
        )

    return ordered.mapInArrow(run, typed)


def _settled_edges(edges: DataFrame, kind: str) -> DataFrame:
    """page_id, url, text of the open pages: the edge rows are numbered along all
    ranges and cut into blocks, each with the rows that stand next to it."""
    along = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = edges.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # one row for each range
    starts = sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("start"))
    ends = 4 * REACH
    inner = F.when((F.col("n") <= ends) | (F.col("pos") < 2 * REACH), F.col("pos")).otherwise(F.col("pos") - F.col("n") + ends)
    placed = edges.join(F.broadcast(starts), F.col("part") == F.col("of")).withColumn("place", F.col("start") + inner)
    blocks = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (0, -REACH, REACH)]), lambda d: F.floor((F.col("place") + d) / BLOCK)))
    dealt = placed.withColumn("block", F.explode(blocks)).select(
        "block", "place", "open", F.col("page_id").cast("string").alias("page_id"), "url", "packed", "size", "host", "path"
    )

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(frame.to_dict("records"), key=lambda r: r["place"])
        whole = [_page(*(r[c] for c in ("page_id", "url", "packed", "size", "host", "path"))) for r in rows]
        found = []
        for i, (row, page) in enumerate(zip(rows, whole)):
            if row["open"] and row["place"] // BLOCK == row["block"]:
                found.append((page.page_id, page.url, main_text(page, whole[max(0, i - REACH) : i] + whole[i + 1 : i + REACH + 1])))
        columns = list(zip(*found)) if found else [()] * 3
        return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(("page_id", "url", "text"), columns)})

    found = dealt.groupBy("block").applyInPandas(settle, "page_id string, url string, text string")
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    order = ["host", "path", "page_id", "hash"]
    ranged = _packed(pages, kind).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(_ranges(ranged.drop("hash"), kind), "pages", **TABLE_OPTIONS)
    settled = parts.where("not edge").select("page_id", "url", "text")
    found = settled.unionAll(_settled_edges(parts.where("edge"), kind))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
