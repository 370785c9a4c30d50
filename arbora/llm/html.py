"""Main text of web pages by differencing each page with the page of the nearest URL on its host."""

from __future__ import annotations

import html as references
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby, takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import save, shuffle_partitions, small_batches, table

ARTICLE = {"article", "main"}
BOILERPLATE = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "noscript", "template", "head", "title"}
#: What names boilerplate in a class, id or role.
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "footer", "form",
    "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}
#: What may stand beside such a name in a compound: of "site-footer" or "share-buttons" all parts are known, of "share-price" not.
PLACES = {
    "area", "bar", "block", "blog", "bottom", "box", "btn", "button", "buttons", "container", "content", "form", "global", "inner", "item", "items", "left", "links", "list", "main", "mobile", "outer", "page", "primary",
    "right", "secondary", "section", "site", "slot", "sticky", "thread", "top", "unit", "wrap", "wrapper",
}
#: Names that the article's own parts may bear, too.
OWN = {"header", "masthead", "search"}
BREAKS = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "title", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: Where a line stands: in boilerplate by its markup, nowhere in particular, in an article; those of the page's k-th marked
#: article, from 0, stand in IN + k.
OUT, LOOSE, IN = 0, 1, 2
#: Articles of a page that are told apart; the rest counts as one.
ARTICLES = 1_000_000
#: A page is a copy of another if less than this share of its body's characters is not shared.
COPY = 0.1


def marked(name: str, attributes: str, within: bool) -> bool:
    if name in BOILERPLATE or name == "header" and not within:
        return True
    if name in ("html", "body"):
        return False
    marks = MARKS - OWN if within else MARKS
    for m in NAMED.finditer(attributes):
        for token in m[1].strip("\"'").lower().split():
            parts = {w for w in re.split(r"[^a-z0-9]+", token) if w and not w.isdigit()}
            if parts & marks and parts <= marks | PLACES:
                return True
    return False


def lines(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order. Unclosed elements end with what holds them."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    held: list[str] = []
    html, at, articles = html or "", 0, 0

    def flush() -> None:
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((stack[-1][1] if stack else LOOSE, text))

    for m in MARKUP.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in BREAKS:
            flush()
        elif name in ("br", "td", "th", "img"):
            held.append(" ")
        if m[2]:
            where = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if where is not None:
                if any(stack[k][0] in BREAKS for k in range(where, len(stack))):
                    flush()
                del stack[where:]
        elif name not in VOID and not m[4].endswith("/"):
            if name == "p":  # a paragraph ends the one before, and what is open in it
                where = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), None)
                if where is not None and not any(n in BREAKS for n, _ in stack[where + 1 :]):
                    del stack[where:]
            zone = stack[-1][1] if stack else LOOSE
            if zone != OUT:
                if marked(name, m[4], zone >= IN):
                    if name not in BREAKS:
                        flush()
                    zone = OUT
                elif name in ARTICLE and zone == LOOSE:
                    zone, articles = IN + min(articles, ARTICLES), articles + 1
            stack.append((name, zone))
    held.append(html[at:])
    flush()
    return out


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of lines, as pairs of positions: the matches' longest increasing run."""
    head = sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))
    rest = min(len(a), len(b)) - head
    tail = sum(1 for _ in takewhile(lambda k: a[-k - 1] == b[-k - 1], range(rest)))
    where: dict[str, list[int]] = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple[int, int, tuple | None]] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            node = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            else:
                ends[k], links[k] = j, node
    out, node = [], links[-1] if links else None
    while node:
        out.append(node[:2])
        node = node[2]
    return [(k, k) for k in range(head)] + out[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def body(page: list[tuple[int, str]]) -> list[int]:
    """The lines that differencing decides about: those of marked articles, or all loose ones where no article is marked."""
    return [i for i, (z, _) in enumerate(page) if z >= IN] or [i for i, (z, _) in enumerate(page) if z == LOOSE]


def main_text(page: list[tuple[int, str]], other: list[tuple[int, str]] | None) -> str:
    """Deletes the lines shared with the other page, in the same order, then what the markup calls boilerplate, and joins the rest.

    If less than COPY of the body's characters would stay, the page is a copy of the other, and no line counts as shared. Where
    articles are marked, their markup checks the lines: an article of which a line stays is whole again, as articles may quote each
    other; one that stands in the other page as a whole, such as a teaser that all pages show, goes; and lines elsewhere are
    in no article.
    """
    shared = {i for i, _ in common([t for _, t in page], [t for _, t in other])} if other else set()
    if copied(page, shared):
        shared = set()
    own = {page[i][0] for i in body(page) if i not in shared} - {LOOSE}
    return "\n\n".join(page[i][1] for i in body(page) if i not in shared or page[i][0] in own)


def copied(page: list[tuple[int, str]], shared: set[int]) -> bool:
    """Is a page whose lines ``shared`` stand in another one, too, a copy of that?"""
    lines = body(page)
    return sum(len(page[i][1]) for i in lines if i not in shared) < COPY * sum(len(page[i][1]) for i in lines)


def nearest(pages: list[tuple], step: int) -> list[int | None]:
    """For each of a host's pages (path, page_id, url, packed lines), in order, the nearest before (step -1) or after (1) that
    has lines and of which it is no copy.

    Where a page is a copy of another, the search goes on at that one's own find, so a large group of copies costs few
    comparisons a page. Pages without a body have none.
    """
    out: list[int | None] = [None] * len(pages)
    onward = [k + step for k in range(len(pages))]
    known: tuple[bytes, list] = (b"", [])
    for k in range(len(pages)) if step < 0 else range(len(pages) - 1, -1, -1):
        page = known[1] if known[0] == pages[k][3] else unpack(pages[k][3])
        if body(page):
            at = k + step
            while 0 <= at < len(pages):
                if pages[at][3] != pages[k][3]:
                    other = known[1] if known[0] == pages[at][3] else unpack(pages[at][3])
                    if other:
                        shared = {i for i, _ in common([t for _, t in page], [t for _, t in other])}
                        if not copied(page, shared):
                            out[k] = at
                            break
                at = onward[at]
            onward[k] = at
        known = (pages[k][3], page)
    return out


def unpack(x: bytes) -> list[tuple[int, str]]:
    text = zlib.decompress(x).decode("utf-8", "surrogatepass")
    return [(ord(t[0]) - 48, t[1:]) for t in text.split("\n")] if text else []


def url_key(url: Column) -> list[Column]:
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return [F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0)).alias("host"), F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1).alias("path")]


def closeness(a: tuple, b: tuple | None) -> int:
    """Characters that the paths of two pages of one host share; -1 if the hosts differ."""
    return -1 if b is None or a[0] != b[0] else sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a[1], b[1], strict=False)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars).

    Pages are parsed where they lie; their lines, compressed, are sorted by host and path over range partitions, so a host
    of any size spreads over many. Each page is paired with the nearest page before or after it in that order of which it is
    no copy (``nearest``), by which path shares more with its own (the one before at a tie); a page without such a page of
    its host in its partition is only cleaned by markup.
    Null and empty html give an empty text; null urls are a host of their own; rows are ordered by page_id at ties, and
    repeated rows each give a row; other columns are not read.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                packed = [zlib.compress("\n".join(chr(48 + z) + t for z, t in lines(h)).encode("utf-8", "surrogatepass"), 3) for h in batch.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(packed, pa.binary())], ["page_id", "url", "host", "path", "lines"])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "page_id", "url", "lines")), strict=True))
        out = []
        for host, same in groupby(rows, key=lambda r: r[0]):
            own = [r[1:] for r in same]  # compressed, and no more than a partition
            for page, a, b in zip(own, nearest(own, -1), nearest(own, 1), strict=True):
                ends = [-1 if k is None else closeness((host, page[0]), (host, own[k][0])) for k in (a, b)]
                other = None if max(ends) < 0 else own[a if ends[0] >= ends[1] else b]
                text = main_text(unpack(page[3]), other and unpack(other[3]))
                out.append({"page_id": page[1], "url": page[2], "text": text, "n_chars": len(text)})
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    small_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", *url_key(F.col("url")), "html")
    parsed = save(rows.mapInArrow(parse, "page_id long, url string, host string, path string, lines binary"), "lines")
    order = ["host", "path", "page_id"]
    spread = parsed.repartitionByRange(shuffle_partitions(pages.sparkSession), *order).sortWithinPartitions(*order)
    return spread.mapInArrow(difference, "page_id long, url string, text string, n_chars long")


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
