"""Main text of web pages by nearest-URL page differencing.

Pages stand in order of host and URL path. Each is aligned with the page before and the one after
it of the same host by a longest common subsequence of their text lines (digits count as alike);
lines that are aligned are shared. Differencing decides twice:

1. Summed over a host, what pages do *not* share shows where its articles stand: the deepest
   container (path of block elements) that holds over half of the host's unshared text. Hosts of
   which few pages could be compared take the container of the whole corpus; on pages that have
   neither, all shared lines are deleted and all others stay. What stands outside
   it - menus, headers, footers, sidebars, adverts - is deleted, whether or not it varies by page.
2. Inside it, shared lines are deleted where a container's text is mostly shared by the host's
   pages. A line that two articles happen to have in common stays.

A neighbour that shares nearly all of a page is a copy and tells nothing. Only what markup itself
says is dropped without comparison: scripts, styles and form controls, and inside the container of
the articles elements for menus, sidebars and footers or named as adverts, notices or comments.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm._chunks import with_neighbours
from rivulet.llm._scratch import save, ship, shuffle_partitions
from rivulet.llm._tables import table

_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_STOP = re.compile(r"[<>\"']")
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_RAW = frozenset("script style textarea noscript template iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_TEXT = frozenset("head title form button select svg dialog object canvas".split()) | _RAW
_ASIDE = frozenset("nav aside footer menu".split())
_NAMED = frozenset("ad ads advert adverts advertisement sponsored notice notices sidebar comment comments".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
_ROOT = frozenset("html body".split())
_ENDS_OTHERS = frozenset("body main article".split())  # whatever was left open before them ends here
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption center".split())
_SELF_ENDING = frozenset("p li dt dd tr td th".split())
_COPY = 0.8  # share of lines and characters from which a neighbour is a copy
_LEAST_PAGES = 5  # compared pages of a host, below which the corpus tells where its articles stand
_BROADCAST_HOSTS = 100_000


@dataclass(slots=True)
class Line:
    text: str
    at: str  # its container: block elements from the body down, without those of running text
    aside: bool  # menus, sidebars, adverts and the like by their own markup

    @property
    def key(self) -> int:
        return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", self.text).encode("utf-8", "surrogatepass"))


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    containers: set[str] = field(default_factory=lambda: {""})


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that begins before ``at`` ends (its ``>``): quotes are skipped if they close inside the tag."""
    x = at
    while m := _STOP.search(page, x):
        c = m.group()
        if c == ">":
            return m.start()
        if c == "<":
            break
        if last[c] <= m.start():
            break
        x = page.index(c, m.end()) + 1
    return page.find(">", at) if last[">"] >= at else -1


def parse(page: str | None) -> Page:
    """Block texts of a page in order, with white space as single spaces and references decoded; linear in its length."""
    page = page or ""
    out = Page()
    stack: list[tuple[str, str, bool, bool]] = []  # tag, name in a path, without text, aside
    held: list[str] = []
    hidden = aside = at = 0
    last = {c: page.rfind(c) for c in "\"'>"}

    def path() -> str:
        names = [x for x in stack if x[1]]
        while names and names[-1][0] in _TEXT_BLOCKS:
            names.pop()
        return ">".join(x[1] for x in names)

    def flush() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            if text and not hidden:
                out.lines.append(Line(text, path(), aside > 0))
            held.clear()

    def close(n: int) -> None:
        nonlocal hidden, aside
        for _, _, h, a in stack[n:]:
            hidden, aside = hidden - h, aside - a
        del stack[n:]

    while (begin := page.find("<", at)) >= 0:
        if begin > at:
            held.append(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        shut = page.startswith("/", begin + 1)
        m = _NAME.match(page, begin + 1 + shut)
        if not m and page[begin + 1 : begin + 2] not in ("!", "?", "/"):
            held.append("<")
            at = begin + 1
            continue
        end = _tag_end(page, m.end() if m else begin + 1, last)
        if end < 0:
            held.append(page[begin:])
            at = len(page)
            break
        at = end + 1
        if not m:
            continue
        tag, attributes = m.group().lower(), page[m.end() : end]
        if tag not in _INLINE:
            flush()
        if shut:
            n = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if n is not None and not (tag in _INLINE and any(x[0] not in _INLINE for x in stack[n + 1 :])):
                if any(h or a for _, _, h, a in stack[n:]):
                    flush()
                close(n)
        elif tag in _RAW:
            flush()
            ended = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            end = page.find(">", ended.end()) if ended else -1
            at = end + 1 if end >= 0 else len(page)
        elif tag not in _VOID:
            if tag in _ENDS_OTHERS:
                close(next((i + 1 for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _ROOT), 0))
            elif tag not in _INLINE:  # a paragraph ends where a block begins, an item where the next one begins
                n = len(stack)
                while n and stack[n - 1][0] in _INLINE:
                    n -= 1
                if n and (stack[n - 1][0] == "p" or stack[n - 1][0] == tag and tag in _SELF_ENDING):
                    close(n - 1)
            names = [_WORDS.findall(v.lower()) for v in _CLASS.findall(attributes)] if "=" in attributes else []
            hides, named = tag in _NO_TEXT, tag in _ASIDE or any(_NAMED & set(w) for w in names)
            if tag in _INLINE and named:
                flush()
            shown = "" if tag in _ROOT or tag in _INLINE else ".".join([tag, *sorted({w for ws in names for w in ws})])
            stack.append((tag, shown, hides, named and tag not in _ROOT))
            hidden, aside = hidden + hides, aside + (named and tag not in _ROOT)
            if shown and tag not in _TEXT_BLOCKS:
                out.containers.add(path())
    held.append(page[at:])
    flush()
    return out


def aligned(a: list, b: list) -> set[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``.

    Bit-parallel, with a trace back. Of the rows of the table only one in so many is kept (about
    the root of them all), so that memory grows with the lines and not with their square.
    """
    common = set(a) & set(b)
    if not common:
        return set()
    rows = [i for i, x in enumerate(a) if x in common]
    other = [x for x in b if x in common]
    masks: dict = defaultdict(int)
    for k, i in enumerate(rows):
        masks[a[i]] |= 1 << k
    full = (1 << len(rows)) - 1

    def after(v: int, x) -> int:
        u = v & masks[x]
        return ((v + u) | (v - u)) & full

    step = max(1, int(len(other) ** 0.5))
    kept, v = [full], full
    for j, x in enumerate(other, 1):
        v = after(v, x)
        if j % step == 0:
            kept.append(v)
    out, i, j = set(), len(rows) - 1, len(other)
    while i >= 0 and j > 0:
        first = (j - 1) // step * step
        states = [kept[first // step]]
        for x in other[first:j]:
            states.append(after(states[-1], x))
        while i >= 0 and j > first:
            if states[j - first] >> i & 1:
                i -= 1
            elif not states[j - first - 1] >> i & 1:
                j -= 1
            else:
                out.add(rows[i])
                i, j = i - 1, j - 1
    return out


def shared_lines(keys: list[int], sizes: list[int], neighbours: list[list[int]]) -> tuple[set[int], bool]:
    """Lines that some neighbour shares, and whether any neighbour is no copy and could tell."""
    out: set[int] = set()
    told = False
    for other in neighbours:
        found = aligned(keys, other)
        if len(found) >= _COPY * len(keys) and sum(sizes[i] for i in found) >= _COPY * sum(sizes):
            continue
        told = True
        out |= found
    return out, told


def _compared(rows: Iterator[tuple], of: int) -> Iterator[tuple[tuple, list]]:
    """Rows (chunk, host, lent, ...) of sorted ranges with item ``of`` of the rows of one host next to them."""
    before = now = None

    def near(following: tuple | None) -> list:
        return [x[of] for x in (before, following) if x is not None and x[:2] == now[:2]]

    for row in rows:
        if now is not None and not now[2]:
            yield now, near(row)
        before, now = now, row
    if now is not None and not now[2]:
        yield now, near(None)


def _dealt(pages: DataFrame) -> DataFrame:
    n = 4 * shuffle_partitions(pages.sparkSession)
    dealt = with_neighbours(pages, "key", "string", n, before=True, after=True)
    return dealt.sortWithinPartitions("chunk", "key", "lent", *[c for c in ("keys", "html") if c in pages.columns])


def _outlines(pages: DataFrame) -> DataFrame:
    """host, key, and of each line a key, its size and its container: what differencing needs of a page."""

    def outlined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [parse(x).lines for x in batch.column("html").to_pylist()]
            types = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()))
            columns = ([[x.key - (1 << 63) for x in p] for p in found], [[len(x.text) for x in p] for p in found], [[x.at for x in p] for p in found])
            yield pa.record_batch(
                [batch.column("host"), batch.column("key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["host", "key", "keys", "sizes", "ats"]
            )

    return pages.select("host", "key", "html").mapInArrow(outlined, "host string, key string, keys array<long>, sizes array<int>, ats array<string>")


def _measured(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By page that could be compared and container: characters of unshared and of all lines."""

    def flat() -> Iterator[tuple]:
        for batch in rows:
            yield from zip(*(batch.column(c).to_pylist() for c in ("chunk", "host", "lent", "keys", "sizes", "ats")), strict=True)

    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    for (_, host, _, keys, sizes, ats), near in _compared(flat(), 3):
        shared, told = shared_lines(keys, sizes, near)
        if told:
            by: dict = defaultdict(lambda: [0, 0])
            for i, (n, at) in enumerate(zip(sizes, ats, strict=True)):
                by[at][0] += n * (i not in shared)
                by[at][1] += n
            for k, (at, (unshared, total)) in enumerate(by.items()):
                for column, x in zip(out, (host, at, unshared, total, int(k == 0)), strict=True):
                    column.append(x)
        if len(out[0]) >= 20_000:
            yield _sums(out)
            out = ([], [], [], [], [])
    if out[0]:
        yield _sums(out)


def _sums(out: tuple) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["host", "at", "unshared", "total", "pages"])


def _article_of(sums: DataFrame, keys: list[str]) -> DataFrame:
    """By ``keys``: the deepest container with over half of all unshared text, and how many pages told."""
    steps = F.split("at", ">", -1)
    upto = F.concat(F.array(F.lit("")), F.when(F.col("at") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), ">"))
    ))
    each = sums.select(*keys, "unshared", "pages", F.col("at").alias("own"), F.explode(upto).alias("at"))
    held = each.groupBy(*keys, "at").agg(F.sum("unshared").alias("unshared"), F.sum("pages").alias("pages"))
    whole = held.where(F.col("at") == "").select(*keys, F.col("unshared").alias("all"), F.col("pages").alias("told"))
    both = held.join(whole, keys) if keys else held.crossJoin(F.broadcast(whole))  # one row
    depth = F.when(F.col("at") == "", 0).otherwise(F.size(F.split("at", ">", -1)))
    return both.where(F.col("unshared") * 2 > F.col("all")).groupBy(*keys).agg(F.max_by("at", depth).alias("article"), F.max("told").alias("told"))


def learn(pages: DataFrame) -> tuple[DataFrame, str | None]:
    """By host: the container of its articles (null where too few pages could be compared) and its
    template containers, whose text is mostly shared; and the container of the whole corpus.

    ``pages`` has host, key (which orders pages by URL) and html. Only hashes and sizes of lines are dealt out.
    """
    outlines = save(_outlines(pages), "page-outlines")
    sums = _dealt(outlines).select("chunk", "host", "lent", "keys", "sizes", "ats").mapInArrow(
        _measured, "host string, at string, unshared long, total long, pages long"
    )
    sums = save(sums.groupBy("host", "at").agg(*[F.sum(c).alias(c) for c in ("unshared", "total", "pages")]), "page-sums")
    corpus = _article_of(sums, []).first()
    template = sums.where(F.col("unshared") * 2 < F.col("total")).groupBy("host").agg(F.collect_set("at").alias("templates"))
    article = _article_of(sums, ["host"]).select("host", F.when(F.col("told") >= _LEAST_PAGES, F.col("article")).alias("article"))
    return article.join(template, "host", "full"), corpus["article"] if corpus else None


def _inside(at: str, container: str) -> bool:
    return not container or at == container or at.startswith(container + ">")


def main_text(page: Page, neighbours: list[Page], articles: list[str | None] = (), templates: list[str] = ()) -> str:
    """The lines inside the first of ``articles`` that the page has, without those that a neighbour
    shares in containers that are ``templates``.

    Where the page has none of them, or none is known, all lines stay but those that a neighbour
    shares: nothing then tells an advert from a paragraph.
    """
    container = next((c for c in articles if c is not None and c in page.containers), None)
    keys = [x.key for x in page.lines]
    shared, _ = shared_lines(keys, [len(x.text) for x in page.lines], [[x.key for x in p.lines] for p in neighbours])
    gone = {i for i in shared if not container or page.lines[i].at in templates}  # the body as a whole singles nothing out
    return " ".join(x.text for i, x in enumerate(page.lines) if i not in gone and (container is None or _inside(x.at, container) and not x.aside))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; scheme, query and fragment do not count."""
    low = F.coalesce(url, F.lit(""))
    return F.lower(F.regexp_extract(low, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.regexp_extract(low, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Null html is empty and gives empty text; pages with null urls are neighbours of each other.
    Equal urls stand in order of page_id; repeated rows give repeated results. Empty tables give
    no rows; further columns are ignored. Pages are dealt out by their URL, however many pages
    their host has; only those at the borders of a range go to two tasks.
    """
    spark = ship(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"), host.alias("host"),
        F.concat_ws("\x01", host, path, F.format_string("%020d", F.coalesce(F.col("page_id").cast("long"), F.lit(0)))).alias("key"),
    )
    hosts, corpus = learn(slim)
    hosts = save(hosts, "page-hosts")
    if hosts.count() <= _BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    known = _dealt(slim.join(hosts, "host", "left"))

    def extracted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in rows:
                for *row, page in zip(*(batch.column(c).to_pylist() for c in ("chunk", "host", "lent", "page_id", "url", "article", "templates", "html")), strict=True):
                    yield (*row, parse(page))

        out: list[tuple] = []
        size = 0
        for (_, _, _, page_id, url, article, templates, page), near in _compared(flat(), 7):
            text = main_text(page, near, [article, corpus], templates or [])
            out.append((page_id, url, text, len(text)))
            size += len(text) + 100
            if size > 4 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return known.select("chunk", "host", "lent", "page_id", "url", "article", "templates", "html").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")


def _batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["page_id", "url", "text", "n_chars"])


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
