"""HTML extraction with nearest-URL page differencing.

A page becomes blocks (its lines of text) in page order: scripts, styles, comments and hidden parts go, character references are decoded, white space
inside a block becomes one space. All lines take part in the differencing: of each host, pages with other lines are sorted by path, a page is paired with the neighbour
whose path has the longer beginning in common (the one before where equal), the lines of both are aligned by longest common subsequence, and shared lines are
deleted. Pages of a host with the same lines are copies: they count as one page, at the least of their paths, so a copy doesn't delete its twin's text.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments also go by element, role and the words of class and id. Where a
page declares its article (article, main, role=main, itemprop=articleBody or a well-known content id or class), only what is inside counts, and of that only
loose lines (not in a paragraph, heading, list, table, quote or preformatted text) are deleted: pages of a host do share passages of their
articles, and a shared paragraph of a declared article is text, not furniture.

Pages are range-partitioned by host and path, so that one large host is spread over many tasks; only hashes of lines are moved, texts aren't.
A task's first and last page wait for the neighbouring tasks' (two rows a task). Tags are found in one pass, lines are aligned with bits of long integers.

Defined results: null or empty html gives an empty text; a null url counts as empty (host and path empty); repeated rows are extracted each and are copies of
each other; an unclosed element ends with the page, but list items, table parts and paragraphs where HTML lets their end tag be left out, and an unclosed button, object,
select, sound, picture or film only loses its tag; a < that begins no tag is text; a tag that the page's end cuts off isn't; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.llm.common import cut, steps, table, text_column

#: Elements whose content isn't text; script and style end with the page where they aren't closed, of the others only the tag goes then.
_RAW = frozenset("script style noscript template svg math iframe object title select textarea button datalist audio video canvas".split())
#: Attributes: a quote opens a value only after an equals sign. Possessive, so that a tag that isn't closed is read once.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
_MARK = re.compile(r"<(?=[a-zA-Z!?/])")
_ATTR = re.compile(r"([^\s=/>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav footer aside form menu dialog fieldset head".split())
_FIRM = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre blockquote dd dt figcaption caption".split())
_PARTS = frozenset("tr tbody thead tfoot".split())
#: Elements whose end tag may be missing: the start tags that end them (a paragraph ends at any block), and what holds others of their kind inside them.
_OPEN_ENDED = {
    "p": (frozenset(), ()),
    "li": (frozenset({"li"}), ("ul", "ol", "menu")),
    **{x: (frozenset({"dt", "dd"}), ("dl",)) for x in ("dt", "dd")},
    **{x: (_PARTS | {"td", "th"}, ("table",)) for x in ("td", "th")},
    "tr": (_PARTS, ("table",)),
    **{x: (_PARTS - {"tr"}, ("table",)) for x in ("tbody", "thead", "tfoot")},
}
#: End tags that end an open cell, row or part of a table.
_OUTER = {**{x: _PARTS | {"table"} for x in ("td", "th")}, "tr": _PARTS - {"tr"} | {"table"}, **{x: frozenset({"table"}) for x in ("tbody", "thead", "tfoot")}}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip status".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
    "signup sidebar sidenav menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus discussion reply replies respond responses share sharing social related recommended recommendations "
    "widget widgets toolbar pagination pager copyright login signin search skip alert disclaimer paywall".split()
)
_NOT_WORDS = frozenset("content main article body post entry story wrapper wrap container page layout has with no without text".split())
_MAIN_NAMES = frozenset("content main main-content maincontent content-main post-content article-content entry-content page-content article-body articlebody post-body entry-body story-body article-text".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag in one pass; elements without text, comments and declarations come as one tag without a name, with
    the space that stands for them in place of attributes.

    A tag that the page's end cuts off is a tag without a name too. A < before anything but a letter, !, ? or / is text."""
    at, missing = 0, set()
    while m := _MARK.search(page, at):
        start = m.start()
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        kind = page[start + 1]
        if kind in "!?" or kind == "/" and not page[start + 2 : start + 3].isalpha():
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        tag = _TAG.match(page, start)
        if tag is None:
            yield start, len(page), "", False, ""
            return
        name, at = tag[2].lower(), tag.end()
        if name in _RAW and not tag[1]:
            over = None if name in missing else re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            if over is None:
                missing.add(name)
            at = over.end() if over else len(page) if name in ("script", "style") else at
            yield start, at, "", False, "" if name == "svg" else " "
            continue
        yield start, at, name, tag[1] == "/", tag[3]


def _role(name: str, attrs: dict[str, str], inside: bool) -> str:
    """'drop' for furniture, 'main' for a declared article, else ''."""
    if name in ("html", "body"):
        return ""
    role = attrs.get("role", "").lower()
    if name in ("article", "main") or role in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower():
        return "main"
    if name in _FURNITURE or role in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return "drop"
    if name == "header" and not inside:
        return "drop"
    if "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"], re.IGNORECASE):
        return "drop"
    for value in (*attrs.get("class", "").split(), attrs.get("id", "")):
        if value.lower() in _MAIN_NAMES:
            return "main"
        words = {w.lower() for w in _PART.findall(value)}
        if words & _WORDS and not words & _NOT_WORDS or not inside and "header" in words and not words & _NOT_WORDS:
            return "drop"
    return ""


def _over(drop: str, name: str, close: bool, inner: Counter) -> bool:
    """Whether an element whose end tag may be missing is over at this tag, which isn't its own end tag. inner: what is open inside it."""
    siblings, holders = _OPEN_ENDED[drop]
    held = any(inner[h] for h in holders)
    if not close:
        if not held and (name in siblings or drop == "p" and name not in _INLINE):
            return True
        inner[name] += name not in _VOID
    elif inner[name]:
        inner[name] -= 1
    elif not held:
        return name in _OUTER[drop] if drop in _OUTER else name not in _INLINE and name not in _FIRM and not inner["table"]
    return False


def blocks(page: str | None) -> tuple[list[tuple[str, bool, bool]], bool]:
    """(lines in page order, each with whether it may be deleted and whether it is kept; whether the page declares its article).

    A line isn't kept if it is furniture by element, role or name, or outside the declared article. Of a declared article's lines only loose ones may be deleted."""
    lines: list[tuple[str, bool, bool, bool]] = []
    text: list[str] = []
    drop, drop_depth = "", 0  # the element whose end ends the furniture
    inner: Counter = Counter()
    mains: list[str] = []  # open elements named as a declared article, or of the same name inside one
    depth_main = 0
    firm: list[str] = []
    at, page = 0, page or ""

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                lines.append((line, not firm, depth_main > 0, not drop))
            text.clear()

    for start, end, name, close, raw in _tags(page):
        if at < start:
            text.append(page[at:start])
        at = end
        if not name:
            text.append(raw)
            continue
        if drop:
            if name not in _INLINE:
                flush()
            if drop in _OPEN_ENDED:
                if close and name == drop and not any(inner[h] for h in _OPEN_ENDED[drop][1]):
                    flush()
                    drop = ""
                    continue
                if _over(drop, name, close, inner):
                    flush()
                    drop = ""
            elif name == drop and not raw.endswith("/"):
                drop_depth += -1 if close else 1
                if not drop_depth:
                    flush()
                    drop = ""
                    continue
            if drop:
                continue
        if name == "br":
            text.append(" ")
            continue
        if close:
            if name not in _INLINE:
                flush()
            if mains and name == mains[-1].lstrip("*"):
                depth_main -= mains.pop().startswith("*")
            if name in firm:
                del firm[len(firm) - 1 - firm[::-1].index(name) :]
            continue
        attrs = _attributes(raw) if "=" in raw or "hidden" in raw else {}
        role = _role(name, attrs, depth_main > 0) if attrs or name not in _INLINE else ""
        if name not in _INLINE or role:
            flush()
        if name in _VOID:
            continue
        if role == "drop":
            drop, drop_depth = name, 1
            inner.clear()
            continue
        if role == "main" or mains and name == mains[-1].lstrip("*"):
            mains.append("*" + name if role == "main" else name)
            depth_main += role == "main"
            firm.clear()
        elif name in _FIRM:
            if name == "p" or name[0] == "h":
                firm = [x for x in firm if x != "p"]
            firm.append(name)
    text.append(page[at:])
    flush()
    declared = any(inside and kept for _, _, inside, kept in lines)
    return [(line, loose or not inside or not kept, kept and (inside or not declared)) for line, loose, inside, kept in lines], declared


def _lcs_rows(a: list[int], b: list[int]) -> list[int]:
    """Of each beginning of a, the bits of a longest common subsequence's length with b: bit j is 0 where b[: j + 1] has one more than b[:j]."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    rows = [row]
    for x in a:
        met = row & masks.get(x, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of a with each beginning of b."""
    full = row = (1 << len(b)) - 1
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    for x in a:
        met = row & masks.get(x, 0)
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


#: Bits of rows that one alignment keeps at once.
LCS_BITS = 1 << 26


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b: bit-parallel rows, halved (Hirschberg) where they would take more than LCS_BITS."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    most = min(len(a), len(b)) - head
    tail = next((i for i in range(most) if a[-1 - i] != b[-1 - i]), most)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out = list(range(head))
    if x and y:
        if len(x) > 1 and len(x) * len(y) > LCS_BITS:
            half = len(x) // 2
            j = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
            out += [head + k for k in common_lines(x[:half], y[:j])] + [head + half + k for k in common_lines(x[half:], y[j:])]
        else:
            rows, i, j, found = _lcs_rows(x, y), len(x), len(y), []
            while i and j:
                if rows[i] >> (j - 1) & 1:
                    j -= 1
                elif i > 1 and not rows[i - 1] >> (j - 1) & 1:
                    i -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append(head + i)
            out += found[::-1]
    return out + list(range(len(a) - tail, len(a)))


def _alike(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def shared_lines(page: dict, others: list[dict | None]) -> list[int]:
    """Places of the page's lines that its nearest neighbour on the host has as well, in the same order. others: the page before and the page after."""
    near = [o for o in others if o is not None and o["host"] == page["host"]]
    return common_lines(page["lines"], max(near, key=lambda o: _alike(o["path"], page["path"]))["lines"]) if near else []


_PAGE = pa.struct([("host", pa.string()), ("path", pa.string()), ("sig", pa.int64()), ("lines", pa.list_(pa.int64()))])
_SHAPE = "struct<host: string, path: string, sig: bigint, lines: array<bigint>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url) to (id, url, text, blocks, places, lines, sig, free): text where no kept line may be deleted, else the kept lines with their places among all (-1: stays)."""
    for part in steps(batches, "html"):
        texts, kept_lines, places, hashes, sigs, free_lines = [], [], [], [], [], []
        for page in part.column("html").to_pylist():
            found, _ = blocks(page)
            hashes.append([xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63) for line, _, _ in found])
            sigs.append(xxhash.xxh64_intdigest(np.array(hashes[-1], np.int64).tobytes()) - (1 << 63))
            free_lines.append([free for _, free, _ in found])
            own = [(line, k if free else -1) for k, (line, free, kept) in enumerate(found) if kept]
            open_ = any(k >= 0 for _, k in own)
            texts.append(None if open_ else " ".join(line for line, _ in own))
            kept_lines.append([line for line, _ in own] if open_ else None)
            places.append([k for _, k in own] if open_ else None)
        columns = [pa.array(texts, pa.string()), pa.array(kept_lines, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(sigs, pa.int64())]
        columns.append(pa.array(free_lines, pa.list_(pa.bool_())))
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), *columns], ["id", "url", "text", "blocks", "places", "lines", "sig", "free"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order of host and path to (host, sig, gone) of those that share lines; a task's first and last page come as (part, place, own, inner), to be compared later."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        host, sig, gone, part, place, own, inner = zip(*rows, strict=True)
        arrays = [pa.array(host, pa.string()), pa.array(sig, pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(part, pa.int32()), pa.array(place, pa.int32()), pa.array(own, _PAGE), pa.array(inner, _PAGE)]
        return pa.RecordBatch.from_arrays(arrays, ["host", "sig", "gone", "part", "place", "own", "inner"])

    before = now = None
    first, task = True, TaskContext.get().partitionId()
    for batch in batches:
        out = []
        for after in batch.to_pylist():
            if now is not None:
                if first:
                    out.append((None, None, None, task, 0, now, after))
                    first = False
                elif gone := shared_lines(now, [before, after]):
                    out.append((now["host"], now["sig"], gone, None, None, None, None))
            before, now = now, after
        if out:
            yield made(out)
    if now is not None:
        yield made([(None, None, None, task, 0 if first else 1, now, before)])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last pages of tasks with what comes before and after them to (host, sig, gone)."""
    for batch in batches:
        found = []
        for x in batch.to_pylist():
            others = [x["before"], x["after"]]
            if x["inner"] is not None:
                others[1 - x["place"]] = x["inner"]
            if gone := shared_lines(x["own"], others):
                found.append((x["own"]["host"], x["own"]["sig"], gone))
        if found:
            host, sig, gone = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(sig, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["host", "sig", "gone"])


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, blocks, places, lines, sig, free, host, path) of every row, written to the shared folder."""
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_column(pages, html_col).alias("html"))
    parsed = source.mapInArrow(_parse, f"id {kind}, url string, text string, blocks array<string>, places array<int>, lines array<bigint>, sig bigint, free array<boolean>")
    address = F.coalesce("url", F.lit(""))
    rest = F.when(F.locate("://", address) > 0, F.substring_index(F.substring_index(F.expr("substring(url, locate('://', url) + 3)"), "#", 1), "?", 1)).otherwise("")
    parsed = parsed.withColumn("rest", rest).withColumns({"host": F.lower(F.substring_index("rest", "/", 1)), "path": F.expr("substring(rest, length(substring_index(rest, '/', 1)) + 1)")})
    return cut(parsed.drop("rest"))


def differences(parsed: DataFrame) -> DataFrame:
    """(host, sig, gone): the places of the lines that pages of a host with these lines share with their nearest neighbour."""
    single = parsed.groupBy("host", "sig").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))
    ordered = single.select("host", "path", "sig", "lines").repartitionByRange("host", "path", "sig").sortWithinPartitions("host", "path", "sig")
    compared = cut(ordered.mapInArrow(_compare, f"host string, sig bigint, gone array<int>, part int, place int, own {_SHAPE}, inner {_SHAPE}"), gathered=True)
    ends = compared.where("part IS NOT NULL").select("part", "place", "own", "inner")
    order = Window.orderBy("part", "place")  # two rows of two numbers for each task
    at = F.struct("part", "place")
    numbered = ends.select("part", "place", F.lag(at).over(order).alias("b"), F.lead(at).over(order).alias("a"))
    sides = ends.select(at.alias("at"), "own")
    joined = ends.join(numbered, ["part", "place"]).join(sides.select(F.col("at").alias("b"), F.col("own").alias("before")), "b", "left").join(sides.select(F.col("at").alias("a"), F.col("own").alias("after")), "a", "left")
    at_ends = joined.select("place", "own", "inner", "before", "after").mapInArrow(_edges, "host string, sig bigint, gone array<int>")
    return compared.where("part IS NULL").select("host", "sig", "gone").unionByName(at_ends)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text) of every row."""
    parsed = parse(pages, id_col, url_col, html_col)
    left = parsed.where("text IS NULL").select("id", "url", "blocks", "places", "host", "sig").join(differences(parsed), ["host", "sig"], "left")
    stays = F.filter(F.arrays_zip("blocks", "places"), lambda x: ~F.array_contains("gone", x["places"]))
    kept = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.transform(stays, lambda x: x["blocks"]))
    changed = left.select("id", "url", F.array_join(kept, " ").alias("text"))
    return parsed.where("text IS NOT NULL").select("id", "url", "text").unionByName(changed).withColumnsRenamed({"id": id_col, "url": url_col})


def deletions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(n_pages, n_lines, n_shared, n_deleted, n_only): all lines of the pages, those that differencing finds shared, those of them that it deletes (the rest is in the firm parts of
    declared articles), and of these the ones that no element, role or name tells for furniture."""
    parsed = parse(pages, id_col, url_col, html_col)
    rows = parsed.select("host", "sig", F.size("lines").alias("n"), "free", "places").join(differences(parsed), ["host", "sig"], "left")
    found, only = F.filter("gone", lambda k: F.get("free", k)), F.array_intersect("gone", "places")
    return rows.agg(F.count("*").alias("n_pages"), *(F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in (("n_lines", F.col("n")), ("n_shared", F.size("gone")), ("n_deleted", F.size(found)), ("n_only", F.size(only)))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
