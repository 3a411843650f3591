"""Main-text extraction by nearest-URL page differencing, with the page's own structure.

A page is read once into lines (blocks), each with its zone: main (inside an article or main element), wrapped (such an element inside a form or
an element that only its name marks as chrome), free, or chrome (menus, headers, footers, sidebars, notices, adverts, forms, comments). Pages
are sorted by host and URL path; each is paired with its two neighbours of the host, the one with the longer common path prefix first. The lines
of the page and of the nearest are aligned by a longest common subsequence, and shared lines are deleted where the structure leaves open what
they are, in free zones: what two pages of a site have in common there is its template. Inside a marked article a shared line is a quoted or
copied passage that belongs to the text, and stays. Then chrome is dropped, and free lines too if the page marks a main part (a wrapped one, if
it has at least as many characters as the free lines).

If nearly all of a page's free text is shared with its nearest page (COPY), the two may be copies of one text; then only what the page on the
other side shares as well is deleted.

Names: outside of the main part each word of class and id names counts, inside it only whole class names that mark adverts or reader comments.

At scale: pages are sorted by host and path through a range exchange, so a host of a third of all pages is spread over many tasks; what
crosses the exchanges are URLs and 8-byte hashes of lines. Texts cross none unless the shared places are too many to be sent to all tasks.

Defined cases: null html gives an empty text; a null or relative URL has no pair; a host with one page has none either; repeated rows get the
same text; unclosed elements end with the page, a tag that the page's end cuts off is dropped, a quote that never closes is an ordinary
character; an empty table gives an empty result; ids have any type; other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Collection, Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, scratch, written

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math canvas object video audio select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_ITSELF = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

CHROME_TAGS = frozenset("nav footer aside form button menu dialog search fieldset label datalist".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class and id names that mark chrome.
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies respond related recommended pagination pager widget toolbar skip".split()
)
#: These mark chrome outside of the main part only: inside it they hold its title.
HEADER_NAMES = frozenset("header head".split())
#: Whole class names that mark adverts and reader comments inside the main part.
INNER_CLASSES = frozenset("ad ads advert adverts advertisement sponsored comments comment-list commentlist comment-form share-buttons newsletter-signup".split())

CHROME, FREE, WRAPPED, MAIN = 0, 1, 2, 3
COPY = 0.8
#: Pages that are given on at once.
READ_ROWS = 256

_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[\s\xa0]+")


def tag_rest(html: str, at: int, unclosed: set[str]) -> tuple[dict[str, str], int] | None:
    """(attributes, place after >) of a tag whose name ends at `at`; None if the page ends first. unclosed: quotes that don't occur any more."""
    attrs: dict[str, str] = {}
    while True:
        at = _GAP.match(html, at).end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return attrs, at + 1
        m = _ATTRIBUTE.match(html, at)
        name, value, at = m[0].lower(), "", m.end()
        if m := _EQUALS.match(html, at):
            at = m.end()
            quote = html[at : at + 1]
            end = html.find(quote, at + 1) if quote in ('"', "'") and quote not in unclosed else -1
            if end >= 0:
                value, at = html[at + 1 : end], end + 1
            else:
                if quote in ('"', "'"):
                    unclosed.add(quote)
                m = _UNQUOTED.match(html, at)
                value, at = m[0], m.end()
        attrs.setdefault(name, unescape(value))


def is_chrome(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    """Chrome by tag or attribute."""
    if tag in CHROME_TAGS or (tag == "header" and not inside_main):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    return attrs.get("role", "").lower() in CHROME_ROLES


def named_chrome(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    """Chrome by class or id."""
    if tag in ("html", "body", "main") or not ("class" in attrs or "id" in attrs):
        return False
    if inside_main:
        return bool(set(attrs.get("class", "").lower().split()) & INNER_CLASSES)
    names = {x.lower() for x in _NAME.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
    return bool(names & (CHROME_NAMES | HEADER_NAMES))


def is_main(tag: str, attrs: dict[str, str]) -> bool:
    return tag in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody"


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """(text, zone) of each block in page order; text without markup, its references decoded, its white space single."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    marks: list[tuple[str, int, int]] = []  # (tag, zone before, how many of this tag are open inside) of elements that set a zone
    zone, at, html = FREE, 0, html or ""

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            out.append((text, zone))
        parts.clear()

    soft = False  # the open chrome may hold a wrapped main part
    unclosed: set[str] = set()
    lost: set[str] = set()  # raw elements that aren't closed any more
    while m := _TOKEN.search(html, at):
        parts.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            mark = "-->" if m[0] == "<!--" else ">"
            end = html.find(mark, at)
            at = len(html) if end < 0 else end + len(mark)
            continue
        tag, closing = m[2].lower(), bool(m[1])
        rest = tag_rest(html, at, unclosed)
        if rest is None:
            at = len(html)
            break
        attrs, end = rest
        empty, at = html[end - 2] == "/", end
        if not closing and tag in RAW:
            if not empty:
                found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at) if tag not in lost else None
                if not found:
                    lost.add(tag)
                at = found.end() if found else len(html)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if not closing:
            while marks and tag in CLOSES_ITSELF.get(marks[-1][0], ()) and not marks[-1][2]:
                flush()
                zone = marks.pop()[1]
            if tag in VOID:
                continue
            if marks and tag == marks[-1][0]:
                marks[-1] = (tag, marks[-1][1], marks[-1][2] + 1)
            new = zone
            if zone != CHROME:
                inside = zone >= WRAPPED
                if is_chrome(tag, attrs, inside):
                    new, soft = CHROME, tag == "form"
                elif named_chrome(tag, attrs, inside):
                    new, soft = CHROME, not inside
                elif is_main(tag, attrs):
                    new = max(zone, MAIN if zone != WRAPPED else WRAPPED)
            elif soft and is_main(tag, attrs) and not (is_chrome(tag, attrs, True) or named_chrome(tag, attrs, True)):
                new = WRAPPED
            if new != zone:
                flush()
                marks.append((tag, zone, 0))
                zone = new
        elif any(tag == x[0] for x in marks):
            if marks[-1][0] == tag and marks[-1][2]:
                marks[-1] = (tag, marks[-1][1], marks[-1][2] - 1)
            elif marks[-1][0] == tag or tag in ("article", "main", "body", "html"):
                flush()
                while marks:
                    name, zone, _ = marks.pop()
                    if name == tag:
                        break
    parts.append(html[at:])
    flush()
    return out


def hashes(lines: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh64_intdigest(text) - (1 << 63) for text, _ in lines]


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in a of one longest common subsequence of a and b (bit-parallel: a row of the table is one integer)."""
    both = set(a) & set(b)
    at, b = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    if not at:
        return set()
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [full], full
    for i in at:
        u = v & where[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    out, i, j = set(), len(at), len(b)
    while i and j:
        n = length(i, j)
        if length(i - 1, j) == n:
            i -= 1
        elif length(i, j - 1) == n:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(at[i])
    return out


def template_places(lines: list[int], zones: bytes, chars: list[int], nearest: list[int] | None, other: list[int] | None) -> list[int]:
    """Places of the free lines that differencing deletes. lines: hashes, with their zones and lengths; nearest, other: hashes of the neighbours' lines."""
    free = [i for i, zone in enumerate(zones) if zone == FREE]
    if not free or not nearest:
        return []
    shared = common_lines(lines, nearest)
    if sum(chars[i] for i in free if i in shared) > COPY * sum(chars[i] for i in free):
        shared &= common_lines(lines, other) if other else set()
    return [i for i in free if i in shared]


def main_text(lines: list[tuple[str, int]], template: Collection[int] = ()) -> str:
    """The text of the main part, or of what is free without the template's places."""
    gone = set(template)
    chars = {zone: sum(len(text) for i, (text, z) in enumerate(lines) if z == zone and i not in gone) for zone in (FREE, WRAPPED, MAIN)}
    if chars[MAIN]:
        taken = MAIN
    else:
        taken = WRAPPED if chars[WRAPPED] and chars[WRAPPED] >= chars[FREE] else FREE
    return "\n".join(text for i, (text, zone) in enumerate(lines) if zone == taken and i not in gone)


def place(url: str | None) -> tuple[str, str]:
    """(host, path); an empty host for a URL that names none."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "", ""
    return parts.netloc.lower(), parts.path


def _with_key(pages: DataFrame) -> DataFrame:
    null = F.lit("\x01")
    key = F.md5(F.concat_ws("\x00", F.coalesce(F.col("page_id").cast("string"), null), F.coalesce("url", null), F.coalesce("html", null)))
    return pages.select(key.alias("k"), "page_id", "url", "html")


def neighbours(keys: DataFrame) -> DataFrame:
    """k, near, other: for each row of keys(k, host, path) the keys of its neighbours of the host, the nearest first; other may be missing."""
    order = ["host", "path", "k"]
    s = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    s = written(s.select("k", "host", "path", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("pos")), "html-order")
    me = F.struct("pos", "k", "host", "path")
    # One row for each partition of the exchange: its ends, for the rows whose neighbour is in the next or the last partition.
    ends = s.groupBy("pid").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    parts = Window.orderBy("pid")
    ends = ends.select("pid", F.lag("last").over(parts).alias("before"), F.lead("first").over(parts).alias("after"))
    inside = Window.partitionBy("pid").orderBy("pos")
    s = s.withColumns({"prev": F.lag(me).over(inside), "next": F.lead(me).over(inside)}).join(F.broadcast(ends), "pid")
    s = s.select("k", "host", "path", F.coalesce("prev", "before").alias("a"), F.coalesce("next", "after").alias("b"))
    pick = lambda x, c: F.when(F.col(f"{x}.host") == F.col("host"), F.col(f"{x}.{c}"))
    s = s.select("k", "path", *(pick(x, c).alias(f"{x}_{c}") for x in "ab" for c in ("k", "path"))).filter("a_k is not null or b_k is not null")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, other = [], []
            for path, a, pa_, b, pb in zip(*(batch[c].to_pylist() for c in ("path", "a_k", "a_path", "b_k", "b_path")), strict=True):
                both = a is not None and b is not None
                if a is None or (both and len(os.path.commonprefix([path, pb])) > len(os.path.commonprefix([path, pa_]))):
                    a, b = b, a
                near.append(a)
                other.append(b)
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(near, pa.string()), pa.array(other, pa.string())], ["k", "near", "other"])

    return s.mapInArrow(nearest, "k string, near string, other string")


#: Shared places of so many pages and with so many places in all are sent to every task; beyond, lines meet them by an exchange.
MOST_PAGES, MOST_PLACES = 200_000, 2_000_000


def templates(lines: DataFrame) -> DataFrame:
    """k, places: the lines that differencing deletes, of the pages that have such. lines: k, host, path, hashes, zones, chars."""
    own = lines.dropDuplicates(["k"])
    own = written(own, "html-outlines")
    pairs = neighbours(own.filter("host <> ''").select("k", "host", "path"))
    hashed = lambda name: own.select(F.col("k").alias(name), F.col("hashes").alias(f"{name}_hashes"))
    # A page without free lines has nothing to delete.
    asking = own.filter(F.expr(f"exists(zones, z -> z = {FREE})")).select("k", "hashes", "zones", "chars")
    met = asking.join(pairs, "k").join(hashed("near"), "near").join(hashed("other"), "other", "left")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [template_places(*row) for row in zip(*(batch[c].to_pylist() for c in ("hashes", "zones", "chars", "near_hashes", "other_hashes")), strict=True)]
            out = pa.RecordBatch.from_arrays([batch["k"], pa.array(found, pa.list_(pa.int32()))], ["k", "places"])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return met.select("k", "hashes", "zones", "chars", "near_hashes", "other_hashes").mapInArrow(places, "k string, places array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row of pages(page_id, url, html)."""
    rows = _with_key(pages)
    id_type = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "page_id", "url", "host", "path", "lines", "hashes", "zones", "chars"]
        for batch in batches:
            for low in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(low, READ_ROWS)
                places = [place(u) for u in part["url"].to_pylist()]
                found = [lines_of(h.as_py()) for h in part["html"]]
                columns = [pa.array([p[i] for p in places], pa.string()) for i in (0, 1)]
                columns += [pa.array([[x[0] for x in own] for own in found], pa.list_(pa.string())), pa.array([hashes(own) for own in found], pa.list_(pa.int64()))]
                columns += [pa.array([[x[1] for x in own] for own in found], pa.list_(pa.int8())), pa.array([[len(x[0]) for x in own] for own in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part["k"], part["page_id"], part["url"], *columns], names)
            give_back()

    schema = f"k string, page_id {id_type}, url string, host string, path string, lines array<string>, hashes array<long>, zones array<tinyint>, chars array<int>"
    parsed = written(rows.mapInArrow(read, schema), "html-lines")
    with scratch(pages.sparkSession):
        found = written(templates(parsed.select("k", "host", "path", "hashes", "zones", "chars")), "html-templates", result=True)
    size = found.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("places")).first()
    if size["pages"] <= MOST_PAGES and size["places"] <= MOST_PLACES:
        found = F.broadcast(found)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(list(zip(lines.as_py(), zones.as_py(), strict=True)), places.as_py() or ()) for lines, zones, places in zip(batch["lines"], batch["zones"], batch["places"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])
            give_back()

    met = parsed.select("k", "page_id", "url", "lines", "zones").join(found, "k", "left")
    return met.mapInArrow(difference, f"page_id {id_type}, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
