"""Operator 4: main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one a block element, in page order.  Pages of a host are
ordered by URL path and each is paired with the nearest three pages of other lines on each
side there, so copies are passed over, however many.  The longest common subsequence of
two pages' lines is the template, and those lines are deleted.

A neighbour may be a changed copy of the page instead of a page of the same template, told
by what remains on both sides: edits of each other (``reworded``) are a copy.  One that
shares more than half of the page's text is a page of the template only if both keep
lines; then a shared line is deleted if a second neighbour shares it, or there is none.  What can't be
told: three or more pages in a row that differ in a few words only count as pages of a
template, and among seven or more edited copies in a row the inner ones delete nothing.

Markup decides before the difference where it can: scripts, styles, forms, navigation,
footers, asides and blocks whose class, id or role names them as adverts, notices,
menus, comments and the like are never text, and with an ``article`` or ``main`` element
the rest of the page is not text.  The lines that are left, in or out of an article, are
compared with those that are left of the neighbours.  Markup also is evidence in the
difference: a line of an article is deleted only if three quarters of the neighbours, two
at least, share it, as the template of a host's articles does and a passage that some
texts have in common doesn't; any other line if one neighbour does.

Pages lie in ranges of (host, path), of about max(``per``, sqrt n) rows, so that a host
with a third of all pages is no single group.  Runs of pages with equal lines count as
one.  Pages at the end of a range get the runs beyond it from a walk over the outer runs
of all ranges (a few for each), so the text does not depend on where ranges end.

Nulls: null html is empty text; a null or odd URL counts as host '' and path ''; null
ids are kept.  Repeated rows are copies of each other and have the same text.
Broken markup: unclosed elements end with their parents, unclosed comments and scripts
with the page.  Whole pages are read and nothing is cut.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.base import read, stage, tune

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|iframe|object)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][\w:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^<>]*\Z",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_DROP = frozenset("head title nav footer aside form button select option dialog menu fieldset label audio video canvas".split())
_MAIN = frozenset(("article", "main"))
_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|banners?|promos?|sponsor(?:ed|s)?|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebars?|footers?|cookies?|consent|notices?|newsletter|subscribe|signup|login|comments?|replies|disqus|shares?|sharing|social|related|recommended|popups?|modals?|widgets?|masthead|copyright|toolbar|pagination|pager)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_ATTRIBUTE = re.compile(r"""([a-z:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _hinted(tag: str, rest: str) -> bool:
    if not rest or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in _MAIN and _HINT.search(value) or name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def lines(page: str | None) -> list[tuple[str, bool]]:
    """(line, is it in an article or main element), in page order, without what markup rules out."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, main
    drop = main = False

    def flush() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append((text, main))
            held.clear()

    at, page = 0, page or ""
    for m in _TOKEN.finditer(page):
        if not drop and m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["raw"]:
                held.append(" ")
            continue
        tag = tag.lower()
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not drop:
                held.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            flush()
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is None:
                continue
            if not block and any(t in _BLOCK for t, _, _ in stack[k + 1 :]):  # a late inline end closes only itself
                del stack[k]
            else:
                del stack[k:]
        else:
            if block and stack:  # a block ends an open paragraph; items and cells end their like
                like = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] in like:
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCK:
                        break
            if tag == "body":  # an unclosed head ends here
                stack = [s for s in stack if s[0] == "html"]
            above = stack[-1] if stack else ("", False, False)
            inside = above[2] or tag in _MAIN
            if not m["rest"].endswith("/"):
                out_of_place = tag in _DROP or tag == "header" and not inside or _hinted(tag, m["rest"])
                stack.append((tag, above[1] or out_of_place, inside))
        drop, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    if not drop and at < len(page):
        held.append(page[at:])
    flush()
    return out


def common(a: list, b: list) -> list[int]:
    """Positions in a of a longest common subsequence with b (Hunt and Szymanski)."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    links: list = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k] = j
                links[k] = link
    found, link = [], links[-1] if links else None
    while link:
        found.append(link[0])
        link = link[1]
    return found[::-1]


def differenced(own: list[str], neighbours: list[list[str] | None], marked: bool = False) -> list[str]:
    """Lines of a page without those it shares with neighbours of the same template: see the module; marked: lines of an article."""
    pages = [x for x in neighbours if x and x != own]
    whole = sum(map(len, own))
    gone: set[int] = set()
    doubtful: Counter[int] = Counter()
    template: set[int] = set()
    votes: Counter[int] = Counter()
    asked = 0
    for other in pages:
        if distinct(tuple(own)).isdisjoint(distinct(tuple(other))):
            shared, mine, theirs = [], own, other
        else:
            shared = common(own, other)
            both = Counter(own[i] for i in shared)
            mine, theirs = list((Counter(own) - both).elements()), list((Counter(other) - both).elements())
        copy = reworded(mine, theirs)
        long = 2 * sum(len(own[i]) for i in shared) > whole
        if not copy and (not long or mine and theirs):
            votes.update(shared)
            asked += 1
        if not long and not copy:
            gone.update(shared)
            continue
        doubtful.update(shared)
        if mine and theirs and not copy:
            template.update(shared)
    gone.update(i for i in template if doubtful[i] > 1 or i in gone or len(pages) == 1)
    if marked:
        gone = {i for i, n in votes.items() if n >= 2 and 4 * n >= 3 * asked}
    return [x for i, x in enumerate(own) if i not in gone]


#: A page meets its neighbours and theirs within a few pages: what is told of its lines is kept so long.
@lru_cache(maxsize=8)
def distinct(own: tuple) -> frozenset:
    return frozenset(own)


@lru_cache(maxsize=8)
def word_pairs(side: tuple) -> Counter:
    words = " ".join(side).split()
    return Counter(zip(words, words[1:], strict=False)) if len(words) >= EDITED else Counter()


def reworded(a: list[str], b: list[str]) -> bool:
    """Whether lines look like edits of each other: of ``EDITED`` words or more, at least half of the word pairs in common."""
    x, y = word_pairs(tuple(a)), word_pairs(tuple(b))
    if not x or not y:
        return False
    return 2 * sum(min(x[k], y[k]) for k in x.keys() & y.keys()) >= min(x.total(), y.total())


#: Pages of other lines that are looked at on each side.
NEAR = 3
#: Remains of fewer words are too short to tell an edit from another text.
EDITED = 8


def runs(rows: list[tuple]) -> list[list[int]]:
    """Positions of rows (host, lines, ..), in order, by runs of one host and equal lines; pages without lines are left out."""
    out: list[list[int]] = []
    for k, row in enumerate(rows):
        if row[1]:
            if out and rows[out[-1][0]][:2] == row[:2]:
                out[-1].append(k)
            else:
                out.append([k])
    return out


def packed(own: list[str], marked: bool) -> bytes:
    """Lines, which hold no line ends, compressed for the exchange, behind their size and whether an article holds them."""
    raw = "\n".join(own).encode("utf-8", "surrogatepass")
    return bytes([marked]) + len(raw).to_bytes(8, "big") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(held: bytes) -> list[str]:
    n, held = int.from_bytes(held[1:9], "big"), held[1:]
    return pa.decompress(held[8:], n, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n") if n else []


def extract(pages: DataFrame, per: int = 256) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html); ``per``: rows of a range, which the result does not depend on."""
    spark = pages.sparkSession
    tune(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    order = F.struct(host.alias("host"), path.alias("path"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), F.coalesce("url", F.lit("")).alias("u"), F.col("page_id").isNotNull().alias("known"), F.xxhash64("html").alias("tie"))
    n = pages.count()
    wanted = -(-n // max(per, isqrt(n)))
    chance = F.pmod(F.xxhash64(F.lit("range"), "page_id", "url"), F.lit(1 << 30)) / float(1 << 30)
    seen = sorted(tuple(r[0]) for r in rows.where(chance < 40 * wanted / max(n, 1)).select(order).limit(80 * wanted).collect()) if wanted > 1 else []
    bounds = sorted({seen[k * len(seen) // wanted] for k in range(1, wanted)}) if seen else []
    keyed = rows.withColumn("o", order)

    def parse(batches):
        for batch in batches:
            part, kept = [], []
            for key, page in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = lines(page)
                inside = [x for x, own in found if own]
                kept.append(packed(inside or [x for x, _ in found], bool(inside)))
                part.append(bisect_right(bounds, tuple(key.values())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(part, pa.int32()), pa.array(kept, pa.binary())], ["page_id", "url", "o", "part", "packed"])

    def within(batches):
        """Each range: the text of the pages whose neighbours are in it; the others keep their lines, and what is known of their neighbours."""

        def settled(part, held):
            found = runs([(r[2], r[3]) for r in held])
            where = {k: i for i, run in enumerate(found) for k in run}
            done: dict = {}
            for k, (page, url, host_, own, marked) in enumerate(held):
                i = where.get(k)
                if i is None:
                    yield page, url, host_, "", None, None, None, part, -1, False, marked
                    continue
                # A side is known if enough runs of the range, or a run of another host, lie on it.
                sides, known = [], True
                for step in (-1, 1):
                    near, j = [], i + step
                    while 0 <= j < len(found) and len(near) < NEAR and held[found[j][0]][2] == host_:
                        near.append(held[found[j][-1 if step < 0 else 0]][3])
                        j += step
                    known &= len(near) == NEAR or 0 <= j < len(found)
                    sides.append(near)
                edge = k == found[i][0] and (i < NEAR + 1 or i >= len(found) - NEAR - 1)
                text = None
                if known:
                    if (i, marked) not in done:
                        done = {(i, marked): "\n".join(differenced(own, sides[0] + sides[1], marked))}
                    text = done[i, marked]
                yield page, url, host_, text, own if edge or not known else None, None if known else sides[0], None if known else sides[1], part, i, edge, marked

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _WITHIN.types, strict=True)], _WITHIN.names)

        at, held = None, []
        for batch in batches:
            for page, url, key, part, own in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if part != at and held:
                    yield batch_of(list(settled(at, held)))
                    held = []
                at = part
                held.append((page, url, key["host"], unpacked(own), own[0] == 1))
        if held:
            yield batch_of(list(settled(at, held)))

    def beyond(step):
        """For each range, in order, the nearest runs of the ranges passed (the nearest first): (part, host, near)."""

        def walk(batches):
            at, passed, held = None, [], []  # the nearest last; of one host
            for batch in batches:
                out = []
                for part, host_, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if part != at:
                        passed = held[-NEAR - 1 :]
                        if passed:
                            out.append((part, passed[-1][0], [x for _, x in reversed(passed)]))
                        at = part
                    if held and held[-1][0] != host_:
                        held = []
                    if not held or held[-1][1] != own:
                        held = [*held[-NEAR:], (host_, own)]
                names = ["part", "host", "near"]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.list_(pa.list_(pa.string()))))], names)

        ends = passed_on.where("edge").select("part", "host", "lines", "run").coalesce(1).sortWithinPartitions(F.col("part") * step, F.col("run") * step)
        return ends.select("part", "host", "lines").mapInArrow(walk, "part int, host string, near array<array<string>>")

    def across(batches):
        for batch in batches:
            text = []
            for own, before, after, far, further, marked in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
                near = [[*side, *[x for x in other or () if x != (side[-1] if side else own)]][:NEAR] for side, other in ((before, far), (after, further))]
                text.append("\n".join(differenced(own, near[0] + near[1], marked)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    ranged = keyed.mapInArrow(parse, f"page_id long, url string, o {keyed.schema['o'].dataType.simpleString()}, part int, packed binary")
    ranged = ranged.repartition(max(1, len(bounds) + 1), "part").sortWithinPartitions("part", "o")
    passed_on = stage(ranged.mapInArrow(within, "page_id long, url string, host string, text string, lines array<string>, before array<array<string>>, after array<array<string>>, part int, run int, edge boolean, marked boolean"), "pages", "zstd")
    left = passed_on.where("text is null").drop("text")
    left = left.join(beyond(1).withColumnRenamed("near", "far"), ["part", "host"], "left").join(beyond(-1).withColumnRenamed("near", "further"), ["part", "host"], "left")
    rest = left.select("page_id", "url", "lines", "before", "after", "far", "further", "marked").mapInArrow(across, "page_id long, url string, text string")
    return passed_on.where("text is not null").select("page_id", "url", "text").unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))


_WITHIN = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("text", pa.string()), ("lines", pa.list_(pa.string())), ("before", pa.list_(pa.list_(pa.string()))), ("after", pa.list_(pa.list_(pa.string()))), ("part", pa.int32()), ("run", pa.int32()), ("edge", pa.bool_()), ("marked", pa.bool_())])


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages``."""
    return extract(read(spark, sf_dir, "pages"))
