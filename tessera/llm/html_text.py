"""HTML extraction by nearest-URL page differencing.

Pages are ordered by (host, path) and each is compared with its neighbours on the host, the pages of nearest URL: their text
lines (blocks) are aligned by longest common subsequence. What a page shares with every neighbour is the host's template and is
deleted; with two neighbours, a near copy on one side doesn't pass for a template, and a neighbour with the very same
lines says nothing and isn't asked. Markup settles what differencing can't. Lines in menus, headers, footers, sidebars,
forms, adverts, notices and comments go even if no other page has them: sites fill these in page by page. Lines in an article or main
element stay even if near copies of the page share them, unless a container in it is of a class that is surely no text of the article (``SURE_WORDS``); classes that may be (a
related list, a notice) leave their lines to the comparison. Any other line stays unless it is shared.

Pages are dealt out by (host, path) ranges, so a host with a third of all rows lies in many partitions; each
range also gets the last page of the range before and the first of the range after it. The ranges' bounds are a hash sample
whose size follows the number of pages up to ``MAX_BOUNDS``; they and as many edge keys reach the driver. Ranges stream through a
task in order and it holds three pages at a time. The result doesn't depend on the ranges.

Defined cases: null html has no text; a null or bad url has empty host and path; a page alone on its host has
nothing shared; ties in (host, path) are ordered by page_id; repeated rows are neighbours like any others; other
columns are passed over, whatever their names. A script, style, title, textarea or iframe that is never closed takes the rest
of the page, as in a browser; of other elements without text of their own (buttons, drawings, players, choices) only the text up to
the next tag is dropped then.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.url_filter import host_of, path_of

MAX_BOUNDS, PAGES_PER_RANGE = 16_384, 500

# Element names and class words by what they mean for extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
MUTE = frozenset("head noscript template svg math object select option button canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
BOILER_TAGS = frozenset("nav aside footer form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
#: Elements whose class tells of the page or site, not of a part.
WHOLE_TAGS = MAIN_TAGS | {"html", "body"}
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar "
    "aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply "
    "replies share sharing social related recommended newsletter subscribe subscription signup login breadcrumb breadcrumbs toolbar widget "
    "pagination pager search".split()
)
#: Of these words, those that inside an article settle a container by themselves; the others leave it to the comparison with other pages there.
SURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar navigation menu sidebar cookie cookies consent gdpr popup modal comments commentlist "
    "disqus newsletter breadcrumb breadcrumbs pagination pager share sharing".split()
)
#: Words for a part of a page, which a sure word may be joined to (``share-bar``).
PART_WORDS = frozenset("area bar block bottom box button buttons container inline item items left links list panel right section slot top unit wrap wrapper".split())
CONTAINERS = frozenset("div section ul ol dl table details fieldset figure".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

MAIN, BODY, BOILER = 2, 1, 0


def _zone(tag: str, attrs: str, zone: int) -> int:
    """Zone inside an element that stands in ``zone``; what is boilerplate stays so.

    Outside articles a word of a class or id is enough. Inside one only whole names of containers count, as they are or joined to a word for a part: headings,
    paragraphs and names that merely contain a word (``search-tips``) say nothing about an article's own text.
    """
    if zone == BOILER or tag in BOILER_TAGS:
        return BOILER
    if tag == "header" and zone != MAIN:
        return BOILER
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            value = "".join(values)
            if name.lower() == "role":
                if value.lower() in BOILER_ROLES:
                    return BOILER
            elif zone == MAIN:
                if tag in CONTAINERS:
                    whole = value.lower().split()
                    for parts in (set(re.split("[-_]+", w)) for w in whole):
                        if parts & SURE_WORDS and parts <= SURE_WORDS | PART_WORDS:
                            return BOILER
                    zone = BODY if BOILER_WORDS.intersection(whole) else zone
            elif tag not in WHOLE_TAGS and {w.lower() for w in _WORD.findall(value)} & BOILER_WORDS:
                return BOILER
    return MAIN if tag in MAIN_TAGS else zone


def _after(page: str, tag: str, at: int) -> int:
    """Where an element without text of its own ends, others of its name inside it counted; unclosed: the next tag, or here for a head."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b[^>]*?(/?)>", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if m[2] else 1
        if not depth:
            return m.end()
    if tag == "head":
        return at
    end = page.find("<", at)
    return end if end >= 0 else len(page)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of each text block in page order; character references decoded, white space collapsed."""
    out: list[tuple[str, int]] = []
    if not page:
        return out
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, at, n = BODY, 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, zone))
            parts.clear()

    def close(k: int) -> None:
        nonlocal zone
        if any(t in BLOCK for t, _ in stack[k:]) or (stack[k][1] == BOILER) != (zone_at(k) == BOILER):
            flush()
        zone = zone_at(k)
        del stack[k:]

    def zone_at(k: int) -> int:
        return stack[k - 1][1] if k else BODY

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m[3]
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in MUTE:
            if not attrs.endswith("/"):
                at = _after(page, tag, at)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag == "br" else "")
            continue
        if tag in ("td", "th"):
            parts.append(" ")
        if tag in BLOCK:
            flush()
            # a block ends an open paragraph; an item or row ends the one before it
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t == "p" or (t == tag and tag in ("li", "tr", "dt", "dd")):
                    close(k)
                    break
                if t in BLOCK:
                    break
        inner = _zone(tag, attrs, zone)
        if inner != zone:
            flush()
        if not attrs.endswith("/") or tag in BLOCK:
            stack.append((tag, inner))
            zone = inner
    flush()
    return out


def _row(a: list, b: list) -> int:
    """Bit j of the complement of the result is set where the LCS with b's first j+1 lines grows."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return ~v & full


def _lengths(bits: int, n: int) -> list[int]:
    out, k = [0], 0
    for c in reversed(bin(bits)[2:].zfill(n)) if n else "":
        k += c == "1"
        out.append(k)
    return out


def shared(a: list, b: list) -> list[int]:
    """Places in a of one longest common subsequence of a and b (Hirschberg over bit rows: linear memory)."""
    out: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, n, j, m = work.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            out.append(n - 1)
            n, m = n - 1, m - 1
        if i >= n or j >= m:
            continue
        if n - i == 1:
            if a[i] in b[j:m]:
                out.append(i)
            continue
        mid = (i + n) // 2
        left = _lengths(_row(a[i:mid], b[j:m]), m - j)
        right = _lengths(_row(a[mid:n][::-1], b[j:m][::-1]), m - j)
        cut = max(range(m - j + 1), key=lambda k: left[k] + right[m - j - k])
        work += [(i, mid, j, j + cut), (mid, n, j + cut, m)]
    return sorted(out)


def template(lines: list[tuple[str, int]], others: list[list[tuple[str, int]]]) -> set[int]:
    """Places of the lines that are shared with every other page in turn; pages with the very same lines say nothing."""
    gone: set[int] | None = None
    for other in others:
        if other == lines:
            continue
        common = {t for t, _ in lines} & {t for t, _ in other}
        at = [k for k, (t, _) in enumerate(lines) if t in common]
        mine = {at[k] for k in shared([lines[k][0] for k in at], [t for t, _ in other if t in common])}
        gone = mine if gone is None else gone & mine
    return gone or set()


def main_text(lines: list[tuple[str, int]], others: list[list[tuple[str, int]]]) -> str:
    """What is left of a page's blocks beside its neighbours'."""
    gone = template(lines, others)
    return "\n\n".join(t for k, (t, z) in enumerate(lines) if z == MAIN or (z == BODY and k not in gone))


def extract(pages: DataFrame, max_bounds: int = MAX_BOUNDS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    spark = pages.sparkSession
    keys = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    place = ["host", "path", "page_id"]
    # any bounds give the same result: these only deal rows out evenly. About as many rows as bounds are wanted
    n = pages.count()
    some = min(max_bounds, 1 + n // PAGES_PER_RANGE) / max(n, 1)
    spread = keys.select(*place).where(F.shiftrightunsigned(F.xxhash64("page_id", "url"), 11) < F.lit(int(some * 2**53))).collect()
    order = lambda r: (r[0].encode("utf-8", "surrogatepass"), r[1].encode("utf-8", "surrogatepass"), r[2] is not None, r[2] or 0)
    bounds = sorted({order(r) for r in spread})
    hosts = [(b[0].decode("utf-8", "surrogatepass"), b[1].decode("utf-8", "surrogatepass"), b[3] if b[2] else None) for b in bounds]
    ranked = _range_of(keys, hosts)
    edges = ranked.groupBy("range").agg(F.min(F.struct(*place)).alias("first"), F.max(F.struct(*place)).alias("last")).collect()
    edges.sort(key=lambda r: r.range)
    # the edge pages of a range go to its neighbours too: at most 2 * max_bounds keys
    extra = []
    for before, after in zip(edges, edges[1:]):
        if before.last.host == after.first.host:
            extra += [(*after.first, before.range), (*before.last, after.range)]
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = _parsed(_range_of(keyed, hosts)).withColumn("own", F.lit(True))
    if extra:
        also = spark.createDataFrame(extra, f"host string, path string, page_id {pages.schema['page_id'].dataType.simpleString()}, range long").alias("e")
        same = (F.col("f.host") == F.col("e.host")) & (F.col("f.path") == F.col("e.path")) & F.col("f.page_id").eqNullSafe(F.col("e.page_id"))
        copies = keyed.alias("f").join(F.broadcast(also), same).select("f.page_id", "f.url", "f.html", "f.host", "f.path", "e.range")
        out = out.unionByName(_parsed(copies).withColumn("own", F.lit(False)))
    out = out.repartition("range").sortWithinPartitions("range", "host", "path", "page_id", "own")

    def run(batches):
        def judged(before, page, after):
            return main_text(page[3], [side[3] for side in (before, after) if side and side[:2] == page[:2]])

        before = page = None
        rows: list[tuple] = []

        def emit(after) -> None:
            if page and page[4]:
                text = judged(before, page, after)
                rows.append((page[5], page[6], text, len(text)))

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("range", "host", "path", "lines", "own", "page_id", "url")]
            for where, host, path, lines, own, page_id, url in zip(*cols):
                new = (where, host, path, [(t, z) for t, z in json.loads(zlib.decompress(lines))], own, page_id, url)
                emit(new)
                before, page = page, new
            yield _out(rows, b)
            rows.clear()
        emit(None)
        if page:
            yield _out(rows, b)

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return out.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def _out(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    types = (like.schema.field("page_id").type, like.schema.field("url").type, pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["page_id", "url", "text", "n_chars"])


def _parsed(ranged: DataFrame) -> DataFrame:
    """Pages with their text blocks, compressed, in place of their html: what travels is smaller than the pages."""

    def run(batches):
        for b in batches:
            lines = [zlib.compress(json.dumps(blocks(t), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 6) for t in b.column("html").to_pylist()]
            names = ["page_id", "url", "host", "path", "range"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(lines, pa.binary())], names=[*names, "lines"])

    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    return ranged.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, path string, range long, lines binary")


def _range_of(keyed: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Number of the range of (host, path, page_id): how many bounds are at or below it."""
    if not bounds:
        return keyed.withColumn("range", F.lit(0).cast("long"))
    spark = keyed.sparkSession
    sent = spark.sparkContext.broadcast([(h.encode("utf-8", "surrogatepass"), p.encode("utf-8", "surrogatepass"), i is not None, i or 0) for h, p, i in bounds])

    def run(batches):
        held = sent.value
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("host", "path", "page_id")]
            at = [bisect_right(held, (h.encode("utf-8", "surrogatepass"), p.encode("utf-8", "surrogatepass"), i is not None, i or 0)) for h, p, i in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "range"])

    return keyed.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields), "range long"]))
