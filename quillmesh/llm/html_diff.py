"""Main text of web pages by nearest-URL page differencing.

A page becomes text lines, one for each block. Pages are ordered by host and URL path, and
each is paired with its nearest pages on the host, up to ``near`` before and after it. The
lines of a pair are aligned by longest common subsequence, and shared lines are deleted as
the site's own. Running text inside an article or main element is never deleted that way, so
quoted passages stay whole. Pages of equal or nearly equal content are mirrors and no pair,
as nothing in them tells the site's own from the text.

A line that no paired page shares may still be a menu, a header, a footer, a sidebar, an
advert, a notice or a reader comment; elements and whole class names that say so are dropped
then. Inside an article a heading, a paragraph or the like is never dropped by its class.

Pages are dealt into blocks of neighbours in the whole order. The edges of the blocks are
found from the ordered keys alone (no html), and the ``near`` pages on each side of an edge
are sent to both blocks, so every page meets all of its neighbours and the result does not
depend on the number of tasks. A task holds 2 * near + 1 pages at a time, and the html is
parsed before the one shuffle, which carries lines only.

Defined results: null or empty html gives the empty text; an unparsable or missing url is the
empty host, whose pages are not paired; repeated rows are pages of their own and each other's
mirrors; ties in the order are broken by the page's id and its url; a page whose neighbours
are all mirrors keeps the lines that structure does not drop; unclosed elements end with the
page, except that an article or main element ends an unclosed menu, header or advert; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as html_entities
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .common import pieces

# Elements and the words in class, id and role that mark what is not main text.
UNREAD = frozenset("script style noscript template head title form button select option textarea input iframe object embed svg canvas audio video dialog datalist fieldset".split())
DROPPED = frozenset("menu nav aside footer".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login popup modal overlay sidebar menu navbar nav navigation navigational breadcrumb breadcrumbs pagination pager "
    "header masthead topbar footer comment comments commentlist reply replies disqus respond share sharing social related recommended recommendations widget "
    "skip toolbar search complementary contentinfo".split()
)
#: What marks a box inside an article, where headers, notices and the like are its own.
MARKS_INSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsored promo newsletter subscribe cookies gdpr popup navbar nav navigation breadcrumb breadcrumbs "
    "pagination pager comments commentlist disqus respond share sharing social sidebar toolbar masthead topbar".split()
)
#: Words that may stand beside those in a name, as in ad-slot and site-header.
BESIDE = frozenset("site global box slot unit bar list links buttons".split())
ARTICLE = frozenset(("article", "main"))
#: The share of both pages' characters that lies in shared lines if they are mirrors.
MIRROR = 0.95

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


@dataclass
class Line:
    text: str
    article: bool
    prose: bool
    dropped: bool = False  # by structure


@dataclass
class Page:
    host: str
    path: str
    lines: list[Line] = field(default_factory=list)


def _hidden(attributes: str) -> bool:
    return ("=" in attributes or "hidden" in attributes) and bool(_HIDDEN.search(attributes))


def _marked(attributes: str, marks: frozenset[str] = MARKS) -> bool:
    """Whether a whole name in class, id or role, or a whole label, is made of marks.

    A name with other words in it (has-sidebar, article-header, comments-open) says something
    about an element that holds more than that.
    """
    if "=" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        for name in [value] if m[1].lower() == "aria-label" else value.split():
            words = [w for w in _PART.findall(name) if len(w) > 1]
            if not marks.isdisjoint(words) and all(w in marks or w in BESIDE for w in words):
                return True
    return False


def _unread(name: str, attributes: str) -> bool:
    """Elements whose text is no line of the page at all: forms, controls, hidden parts."""
    return name in UNREAD or _hidden(attributes)


def _dropped(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's lines go by structure; body, main and article never do."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if name in ("body", "html", *ARTICLE) or not attributes or (inside and name in PROSE):
        return False
    return _marked(attributes, MARKS_INSIDE if inside else MARKS)


def lines_of(html: str) -> list[Line]:
    """The page's text lines, in order, each with what encloses it."""
    out: list[Line] = []
    parts: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # elements in force; whether unread, whether dropped
    named: Counter[str] = Counter()
    unread = dropped = articles = 0
    prose = False
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html_entities.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, articles > 0, prose, dropped > 0))
            parts = []

    def close() -> str:
        nonlocal unread, dropped, articles
        name, hid, drop = open_.pop()
        named[name] -= 1
        unread -= hid
        dropped -= drop
        articles -= name in ARTICLE
        return name

    for_token = _TOKEN.search
    while at < n:
        m = for_token(html, at)
        if m is None:
            if not unread:
                parts.append(html[at:])
            break
        if m.start() > at and not unread:
            parts.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not unread:
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if name in BLOCK:
            flush()
        if m[1]:
            if named[name]:
                while close() != name:
                    pass
            if name in BLOCK:
                prose = any(x in PROSE for x, _, _ in open_[-3:])
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in ARTICLE and dropped and not articles and not _hidden(m[3]) and (name == "main" or not _marked(m[3])):
            flush()
            while dropped:
                close()
        if name == "p" and open_ and open_[-1][0] == "p":
            close()
        hid, drop = _unread(name, m[3]), _dropped(name, m[3], articles > 0)
        if (hid and not unread) or (drop and not dropped):
            flush()
        if not m[3].rstrip().endswith("/"):
            open_.append((name, hid, drop))
            named[name] += 1
            unread += hid
            dropped += drop
            articles += name in ARTICLE
        if name in BLOCK:
            prose = name in PROSE or (prose and name not in ("div", "section", "ul", "ol"))
    flush()
    return out


def host_and_path(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of the two lists of lines.

    Only lines that both lists hold are aligned. A row of the length table is a bit set (one
    long integer); long alignments are halved until their rows fit in ``_CELLS`` bits.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    xs = [i for i in range(head, len(a) - tail) if a[i] in both]
    ys = [b[j] for j in range(head, len(b) - tail) if b[j] in both]
    todo = [(xs, ys)]
    while todo:
        xs, ys = todo.pop()
        if not xs or not ys:
            continue
        if len(xs) == 1 or len(xs) * len(ys) <= _CELLS:
            found.update(_aligned(a, xs, ys))
            continue
        half = len(xs) // 2
        before = _lengths([a[i] for i in xs[:half]], ys)
        after = _lengths([a[i] for i in reversed(xs[half:])], ys[::-1])[::-1]
        cut = int((before + after).argmax())
        todo += [(xs[:half], ys[:cut]), (xs[half:], ys[cut:])]
    return found


#: So many bits of length table are kept at once.
_CELLS = 1 << 24


def _rows(xs: list[str], ys: list[str]) -> Iterator[int]:
    """The length table's rows; a zero bit at k says that the best length grows at column k."""
    where: dict[str, int] = {}
    for k, y in enumerate(ys):
        where[y] = where.get(y, 0) | 1 << k
    full = (1 << len(ys)) - 1
    row = full
    yield row
    for x in xs:
        match = where.get(x, 0)
        row = ((row + (row & match)) | (row & ~match)) & full
        yield row


def _lengths(xs: list[str], ys: list[str]) -> np.ndarray:
    """Best lengths of xs against every prefix of ys."""
    row = 0
    for row in _rows(xs, ys):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(ys) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(ys)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(a: list[str], xs: list[int], ys: list[str]) -> set[int]:
    rows = list(_rows([a[i] for i in xs], ys))
    found, k = set(), len(ys)
    for i in range(len(xs), 0, -1):
        below = (1 << k) - 1
        grown = ~rows[i] & below
        if grown.bit_count() == (~rows[i - 1] & below).bit_count():
            continue
        k = grown.bit_length() - 1
        found.add(xs[i - 1])
    return found


def mirrors(a: Page, b: Page) -> bool:
    """Whether two pages of a host have equal or nearly equal lines."""
    x, y = [v.text for v in a.lines], [v.text for v in b.lines]
    if x == y:
        return True
    least = MIRROR * max(sum(map(len, x)), sum(map(len, y)))
    if min(sum(map(len, x)), sum(map(len, y))) < least:
        return False
    return sum(len(t) * n for t, n in (Counter(x) & Counter(y)).items()) >= least


def shared_lines(page: Page, others: list[Page]) -> set[int]:
    """The positions of the page's lines that a paired page shares."""
    texts, out = [x.text for x in page.lines], set()
    for other in others:
        if other.host == page.host and page.host and not mirrors(page, other):
            out |= common_lines(texts, [x.text for x in other.lines])
    return out


def main_text(page: Page, others: list[Page]) -> str:
    """The lines that differencing and then structure leave."""
    shared = shared_lines(page, others)
    return " ".join(x.text for i, x in enumerate(page.lines) if not x.dropped and (i not in shared or (x.article and x.prose)))


# ---------------------------------------------------------------- operator

_KEY = ("host", "path", "no_id", "page_id", "tie")


def _edges(keys: DataFrame, near: int, blocks: int, block_pages: int) -> list[tuple]:
    """For each edge between blocks: the keys ``near`` places before it, at it, and ``near`` after it.

    The number of edges is bounded by ``blocks``; only they reach the driver.
    """
    ordered = numbered(keys, "number", *_KEY)
    n = ordered.count()
    size = max(block_pages, 4 * near, -(-n // blocks))
    place = (F.col("number") - 1) % size
    first = F.col("number") - 1 >= size - near  # the first block has no edge before it
    wanted = ordered.where(first & place.isin(0, near, size - near))
    at: dict[int, tuple] = {r["number"] - 1: tuple(r[c] for c in _KEY) for r in wanted.collect()}  # 3 rows for each edge
    return [(at[e - near], at[e], at.get(e + near)) for e in range(size, n, size)]


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", near: int = 4, blocks: int = 20_000, block_pages: int = 128) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#][\s\S]*$", "")
    identity = F.col(f"`{key}`").cast("long")
    rows = pages.select(host.alias("host"), path.alias("path"), identity.isNull().alias("no_id"), F.coalesce(identity, F.lit(0)).alias("page_id"), F.xxhash64(F.col(f"`{url}`")).alias("tie"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    edges = _edges(rows.select(*_KEY), near, blocks, block_pages)
    low, mid = [e[0] for e in edges], [e[1] for e in edges]
    high = [e[2] for e in edges]
    names = [*_KEY, "url"]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    sent = pa.schema([("block", pa.int32()), ("own", pa.bool_()), *zip(names, kinds, strict=True), ("lines", pa.list_(pa.string())), ("marks", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for *own, h in zip(*columns, strict=True):
                k = tuple(own[:5])
                b = bisect_right(mid, k)
                lines = lines_of(h or "")
                page = (*own, [x.text for x in lines], bytes(x.article + 2 * x.prose + 4 * x.dropped for x in lines))
                out.append((b, True, *page))
                if b < len(mid) and k >= low[b]:
                    out.append((b + 1, False, *page))
                if b and (high[b - 1] is None or k < high[b - 1]):
                    out.append((b - 1, False, *page))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(sent)], schema=sent)

    parsed = rows.mapInArrow(parse, "block int, own boolean, host string, path string, no_id boolean, page_id long, tie long, url string, lines array<string>, marks binary")
    dealt = parsed.repartition("block").sortWithinPartitions("block", *_KEY, "lines", "own")
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: deque[tuple] = deque()  # up to ``near`` settled pages, then those that wait
        done: list[tuple] = []
        settled, last = 0, None

        def settle() -> None:
            nonlocal settled
            own, k, u, page = window[settled]
            if own:
                others = [x[3] for i, x in enumerate(window) if i != settled and abs(i - settled) <= near]
                text = main_text(page, others)
                done.append((k, u, text, len(text)))
            settled += 1
            if settled > near:
                window.popleft()
                settled -= 1

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for block, own, h, path_, no_id, k, _, u, lines, marks in zip(*columns, strict=True):
                if block != last:
                    while settled < len(window):
                        settle()
                    window.clear()
                    settled, last = 0, block
                page = Page(h, path_, [Line(t, bool(m & 1), bool(m & 2), bool(m & 4)) for t, m in zip(lines, marks, strict=True)])
                window.append((own, None if no_id else k, u, page))
                if len(window) - settled > near:
                    settle()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], fields.field(i).type) for i in range(4)], schema=fields)
                done = []
        while settled < len(window):
            settle()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], fields.field(i).type) for i in range(4)], schema=fields)

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")
