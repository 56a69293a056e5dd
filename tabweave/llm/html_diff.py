"""HTML extraction by differencing pages against their nearest URL.

A page is read into lines, one per block of text.  Within a host, pages are
ordered by URL path, so the page with the longest common path prefix is a
neighbour; each page is paired with the nearer of its two.  Pages of a host with
the same lines count as one and pages without lines are passed over, so a
neighbour is another page, however many copies lie between.  The lines of both
are aligned by a longest common subsequence, and lines that are shared belong to
the template of the site and go.

Differencing alone cannot find everything: menus and adverts may change from
page to page, and an article may be published twice.  So marks in the HTML
decide where they are clear: elements that are by name, role or class no part of
an article go at once.  All other pages and lines are differenced, and marks are
the check that follows: a line of a marked article is not deleted, and where the
marked article is the larger part of what is left, nothing else is kept.  Where
it is the smaller part (teasers in ``article`` elements beside the text), the
unmarked lines are the text.

Pages move as keys and hashes of lines only: pairs are found in a range-sorted
stream, so a host with a third of all pages is spread over many tasks.  Pages at
the ends of a range meet their neighbours in a small second step, four rows per
task.  What is to be deleted comes back as line numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from itertools import chain
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.session import cut_lineage

# HTML element names by what they are.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
# Elements without an end tag that a block ends; all others end a paragraph only.
_ENDED_BY = {"li": "p li", "dt": "p dt dd", "dd": "p dt dd", "td": "p td th", "th": "p td th", "tr": "p td th tr", "option": "option"}
_HEADINGS = frozenset("p h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_OUT = frozenset(
    "head nav footer aside form button select textarea script style noscript template svg canvas iframe object "
    "dialog menu xmp noembed noframes title datalist".split()
)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Class or id names of what is no article, alone or with up to two words for a part of a page behind them.
_PARTS = (
    "list|box|bar|wrap|wrapper|container|section|area|block|panel|links?|form|buttons?|icons?|items?|group|row|inner|outer|slot|unit|left|right|"
    "top|bottom|main|primary|secondary|header|footer|menu|nav|notice|banner|modal|popup|overlay|message|thread|posts?|articles?|stories|content|"
    "body|text|title|heading|author|meta|reply|respond|widgets?|toggle|[0-9]+"
)
_OUT_NAMES = re.compile(
    r"(?:site|page|top|main|global|cookie|newsletter|post|article|user|reader)?[-_]?(?:"
    r"nav|navbar|navigation|menu|submenu|breadcrumbs?|masthead|footer|sidebar|ads?|adverts?|advertisement|advertising|"
    r"banner|promo|promotion|sponsor|sponsored|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|share|sharing|social|comments?|commentlist|disqus|respond|replies|reply|related|recommended|"
    rf"recommendations|pagination|pager|widget|toolbar|skip-?link|copyright)(?:[-_](?:{_PARTS})){{0,2}}"
)
_HEADER_NAMES = re.compile(rf"(?:site|page|top|main|global)?[-_]?header(?:[-_](?:{_PARTS})){{0,2}}")
_MAIN_NAMES = re.compile(r"(?:post|entry|article|story|main|page)[-_]?(?:content|body|text)")

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")

#: What a line is: no article, undecided, or of the marked article.
OTHER, MAIN = 0, 1


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), a or b or c)
    return found


def _role(tag: str, source: str, in_main: bool, first: bool) -> str:
    """``out``, ``main`` or nothing special; names say nothing about the ``first`` marked article."""
    if tag in _OUT:
        return "out"
    if tag in ("article", "main"):
        kind = "main"
    elif tag == "header" and not in_main:
        return "out"
    else:
        kind = ""
    if not source or tag in ("html", "body"):
        return kind
    attributes = _attributes(source)
    role = attributes.get("role", "").lower()
    if role in _OUT_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return "out"
    if kind and first:
        return kind
    names = [n.lower() for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    if any(_OUT_NAMES.fullmatch(n) for n in names) or not in_main and any(_HEADER_NAMES.fullmatch(n) for n in names):
        return "out"
    if role in ("main", "article") or any(_MAIN_NAMES.fullmatch(n) for n in names):
        return "main"
    return kind


Tag = tuple[int, int, bool, str, str]  # start, end, whether it closes, name, attributes


def _tags(html: str) -> list[Tag]:
    """The tags of a page; an element of raw text is one opening tag that ends where the element does."""
    tags, at = [], 0
    while m := _MARKUP.search(html, at):
        at = m.end()
        closing, tag, source = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = (tag or "").lower()
        if tag in _RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        tags.append((m.start(), at, bool(closing), tag, source or ""))  # no name: a comment
    return tags


def _stands_alone(tag: str, source: str) -> bool:
    """Whether an opening tag is a whole element."""
    return not tag or tag in _VOID or tag in _RAW or source.endswith("/") and tag not in _BLOCK


def _element_ends(tags: Sequence[Tag]) -> tuple[list[int], list[bool]]:
    """For each opening tag the tag that ends its element, and whether that is its own end tag.

    An end tag also ends what is open inside its element; that of an inline
    element does not reach past a block.  A paragraph ends at any block, list
    items and cells at the next.  What nothing ends goes to the end of the page.
    """
    ends, own = [len(tags)] * len(tags), [False] * len(tags)
    open_: list[int] = []
    places: dict[str, list[int]] = {}  # of the open elements of a name, as positions in ``open_``
    blocks: list[int] = []  # positions of open blocks

    def end(place: int, at: int) -> None:
        while len(open_) > place:
            i = open_.pop()
            ends[i] = at
            places[tags[i][3]].pop()
        while blocks and blocks[-1] >= place:
            blocks.pop()

    for i, (_, _, closing, tag, source) in enumerate(tags):
        if closing:
            if (at := places.get(tag)) and (tag in _BLOCK or not blocks or at[-1] > blocks[-1]):
                own[open_[at[-1]]] = True
                end(at[-1], i)
        elif not _stands_alone(tag, source):
            if tag in _BLOCK:
                over = _ENDED_BY.get(tag, "p").split()
                while blocks and tags[open_[blocks[-1]]][3] in over:
                    end(blocks[-1], i)
                blocks.append(len(open_))
            places.setdefault(tag, []).append(len(open_))
            open_.append(i)
    return ends, own


def page_lines(html: str) -> list[tuple[int, str]]:
    """``(OTHER or MAIN, text)`` of each block that is not marked as something else.

    Character references are decoded and white space, ``br`` included, becomes
    one space.  An element that is left out ends with its end tag.  Without one
    it ends with the element around it, or before if an article begins; a menu, a
    header or an element left out by its class also at a paragraph or heading.
    """
    lines: list[tuple[int, str]] = []
    chunk: list[str] = []
    main: list[str] = []  # open tags since the article began, its own first
    kind, first = OTHER, True

    def flush() -> None:
        if chunk:
            text = " ".join(unescape("".join(chunk)).split())
            if text:
                lines.append((kind, text))
            chunk.clear()

    tags = _tags(html)
    ends, own = _element_ends(tags)
    at = i = 0
    while i < len(tags):
        start, stop, closing, tag, source = tags[i]
        chunk.append(html[at:start])
        at, here, i = stop, i, i + 1
        if tag == "br":
            chunk.append("\n")
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            if main and tag == main[0]:
                main.pop()
                if not main:
                    flush()
                    kind = OTHER
            continue
        if _stands_alone(tag, source):
            continue
        role = _role(tag, source, bool(main), first)
        if role == "out":
            i = ends[here]
            if own[here]:
                at, i = tags[i][1], i + 1
            else:
                stops = {"main", "article"} if tag in _OUT and tag != "nav" else {"main", "article"} | _HEADINGS
                i = next((j for j in range(here + 1, i) if not tags[j][2] and tags[j][3] in stops), i)
                at = tags[i][0] if i < len(tags) else len(html)
        elif main:
            if tag == main[0]:
                main.append(tag)
        elif role == "main":
            flush()
            main, kind, first = [tag], MAIN, False
    chunk.append(html[at:])
    flush()
    return lines


def common_lines(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    One bit per line of ``a`` and one step per line of ``b``.  Only every k-th
    state is kept, k about the root of the number of steps, and the steps
    between two of them are run again on the way back.
    """
    n = len(a)
    full = (1 << n) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    b = [x for x in b if x in where]
    if not b:
        return []

    def step(v: int, x: int) -> int:
        u = v & where[x]
        return (v + u | v - u) & full

    gap = isqrt(len(b)) + 1
    kept, v = [full], full
    for j, x in enumerate(b, 1):
        v = step(v, x)
        if j % gap == 0:
            kept.append(v)
    # A zero bit i says that the LCS with a[: i + 1] is one longer than with a[:i].
    found: list[int] = []
    i, j = n, len(b)
    while j > 0 and i > 0:
        start = (j - 1) // gap * gap
        rows = [kept[start // gap]]
        for x in b[start:j]:
            rows.append(step(rows[-1], x))
        while j > start and i > 0:
            zeros = ~rows[j - start] & ((1 << i) - 1)
            if not zeros:
                return found[::-1]
            i = zeros.bit_length()  # lines after the last zero do not lengthen it
            if _length(rows[j - start - 1], i) < _length(rows[j - start], i):
                # The step made it longer, so it matched line i - 1.
                found.append(i - 1)
                i -= 1
            j -= 1
    return found[::-1]


def _length(row: int, i: int) -> int:
    return i - (row & ((1 << i) - 1)).bit_count()


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


Page = tuple[str, str, list[int], list[int]]  # host, path, hashes of lines, kinds of lines


def template_lines(page: Page, neighbours: Sequence[Page]) -> list[int]:
    """Unmarked lines that the page shares with its nearest neighbour on the host.

    A neighbour that shares all lines is a copy of the page and says nothing
    about a template, nor does one that shares no unmarked line; then the other
    neighbour is asked.
    """
    host, path, hashes, kinds = page
    if OTHER not in kinds:
        return []
    near = [p for p in neighbours if p[0] == host]
    for other in sorted(near, key=lambda p: -common_prefix(path, p[1])):
        shared = common_lines(hashes, other[2])
        template = [i for i in shared if kinds[i] == OTHER]
        if template and len(shared) < len(hashes):
            return template
    return []


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-cased host and the path with its query; both empty without ``://``."""
    m = re.match(r"[^/?#]*?://([^/?#]*)([^#]*)", url or "", re.S)
    return (m[1].lower(), m[2]) if m else ("", "")


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _page(host: str, hashes: Sequence[int], kinds: Sequence[int]) -> int:
    """The same for pages of a host that have the same lines."""
    return _hash(host, *map(str, chain(kinds, hashes)))


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)``: the main text of each page, blocks joined by an empty line.

    * A null or empty page has an empty text.  A page without a URL, or whose
      URL has no host, pairs with other such pages.
    * Pages of any length are read whole.  Repeated rows give rows of their
      own.  Pages of a host with the same lines count as one for the pairing,
      at the smallest path, and have the same text.
    * Of pages that share nothing, only those without lines are passed over: a
      page with nothing but such neighbours on both sides keeps its template.
    * A null key is passed on.  Other columns of ``df`` are not read, whatever
      their names.  An empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = rows.schema["key"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages as keys and hashes of lines."""
        for batch in batches:
            out = []
            for link, source in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                html_ = source.as_py() or ""
                lines = page_lines(html_)
                if lines:
                    host, path = host_and_path(link)
                    hashes, kinds = [_hash(t) for _, t in lines], [k for k, _ in lines]
                    out.append((_page(host, hashes, kinds), host, path, hashes, kinds))
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page", "host", "path", "hashes", "kinds"])

    slim = rows.mapInArrow(fold, "page bigint, host string, path string, hashes array<bigint>, kinds array<int>")
    order = ["host", "path", "page"]
    # Pages of a host with the same lines are one.
    once = slim.groupBy("page").agg(F.first("host").alias("host"), F.min("path").alias("path"), *(F.first(c).alias(c) for c in ("hashes", "kinds")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = once.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deletions of pages inside a partition; its first and last two pages as they are."""
        names = ["page", "shared", "part", "seq", "host", "path", "hashes", "kinds"]
        types = (pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        part, seq, last, out = TaskContext.get().partitionId(), 0, [], []

        def edge(i: int, p: tuple) -> tuple:
            return (p[0], None, part, i, *p[1:])

        for batch in chain(batches, [None]):
            for p in zip(*(batch.column(c).to_pylist() for c in ("page", "host", "path", "hashes", "kinds")), strict=True) if batch is not None else ():
                last.append(p)
                if seq < 2:
                    out.append(edge(seq, p))
                if len(last) == 3:
                    if shared := template_lines(last[1][1:], [last[0][1:], last[2][1:]]):
                        out.append((last[1][0], shared, None, None, None, None, None, None))
                    del last[0]
                seq += 1
            if batch is None:
                # The first two are there already if the partition is that short.
                out += [edge(i, p) for i, p in zip(range(seq - len(last), seq), last, strict=True) if i >= 2]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []

    schema = "page bigint, shared array<int>, part int, seq bigint, host string, path string, hashes array<bigint>, kinds array<int>"
    paired = cut_lineage(sorted_.mapInArrow(pair, schema))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deletions of the first and last page of each partition, four rows per partition in order."""
        table = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)]
        out = []
        for i, (page, part, seq, *fields) in enumerate(table):
            before = table[i - 1] if i else None
            after = table[i + 1] if i + 1 < len(table) else None
            first = before is None or before[1] != part
            final = after is None or after[1] != part
            if first or final:
                if shared := template_lines(tuple(fields), [tuple(r[3:]) for r in (before, after) if r is not None]):
                    out.append((page, shared))
        columns = list(zip(*out, strict=True)) if out else [(), ()]
        yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int32()))], ["page", "shared"])

    edges = paired.where("shared IS NULL").select("page", "part", "seq", "host", "path", "hashes", "kinds")
    met = edges.repartition(1).sortWithinPartitions("part", "seq").mapInArrow(meet, "page bigint, shared array<int>")
    shared = paired.where("shared IS NOT NULL").select("page", "shared").unionByName(met)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of each page and whether they are marked."""
        for batch in batches:
            pages, lists, marks = [], [], []
            for link, source in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                lines = page_lines(source.as_py() or "")
                lists.append([t for _, t in lines])
                marks.append([k for k, _ in lines])
                pages.append(_page(host_and_path(link)[0], [_hash(t) for t in lists[-1]], marks[-1]))
            columns = [batch.column(0), batch.column(1), pa.array(pages, pa.int64()), pa.array(lists, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int32()))]
            yield pa.record_batch(columns, ["key", "url", "page", "lines", "marks"])

    read_rows = rows.mapInArrow(read, f"key {kind}, url string, page bigint, lines array<string>, marks array<int>")
    joined = read_rows.join(shared.withColumnRenamed("page", "__page"), F.col("page") == F.col("__page"), "left")
    gone = F.coalesce("shared", F.array().cast("array<int>"))
    rest = F.filter("lines", lambda _, i: (F.get("marks", i) == OTHER) & ~F.array_contains(gone, i))
    marked = F.filter("lines", lambda _, i: F.get("marks", i) == MAIN)
    rest, marked = (F.array_join(c, "\n\n") for c in (rest, marked))
    text = F.when(F.length(marked) >= F.length(rest), marked).otherwise(rest)
    return joined.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
