"""Main text of web pages by template deduction over the pages of a host.

Tokens (tags with their path, and text blocks) whose occurrence vectors over a host's pages are equal form a class. A
vector is never held: its fingerprint, the sums of two halves of hash(page, count) over the pages, is aggregated instead,
so a host with a third of all pages is summed up like any other. Classes with enough support whose elements stand once on
a page are the host's template, whatever other pages it has; texts of such a class are template text, and an element whose
one text comes and goes with it is a fixed block. What remains between the template's tokens are slots, and the innermost
template element around all slots with unlinked text is the article. Fixed lists of tags and class names (OUTSIDE, MARKED)
take out what varies and is not article.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.llm.common import bound_batches, cut, stored

#: Fixed values of HTML: elements that break lines, that have no end tag, whose content is no markup, and that end
#: an open element of the given kinds.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|textarea|noscript|template|iframe|svg|math|object|noframes"
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements, and words of class or id, that mark what is not article.
OUTSIDE = set("head nav footer aside form button select dialog menu search audio video canvas".split())
MARKED = set(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related"
    " respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
HOLDERS = {"html", "body", "main", "article"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Tokens that a task holds before it sends them, and tokens of all hosts' templates that are broadcast at most.
TOKENS = 1 << 16
TEMPLATE_TOKENS = 500_000

SCAN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-z][^>]*>?|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PAGE = "#page"


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


class Element:
    __slots__ = ("tag", "name", "path", "token", "parent", "marked", "inside", "plain", "chars", "linked", "order")

    def __init__(self, tag: str, attrs: str, parent: Element | None, order: int):
        marks, self.marked, self.plain, self.name = [], tag in OUTSIDE, True, tag
        for name, a, b, c, hidden in ATTR.findall(attrs) if attrs else ():
            value = a or b or c
            marks.append(f"{name.lower()}={re.sub(r'[0-9]+', '0', value)}")
            self.plain = False
            if tag not in HOLDERS and tag not in HEADINGS:
                words = {w.lower() for w in WORD.findall(value)} if name.lower() != "itemprop" else set()
                self.marked |= bool(hidden) or not words.isdisjoint(MARKED)
            if name.lower() == "role" and value in ("main", "article"):
                tag = value
        self.tag, self.parent, self.order, self.chars, self.linked = tag, parent, order, 0, 0
        self.inside = not self.marked and (parent is None or parent.inside)
        self.path = f"{parent.path if parent else ''}/{tag}" + (f"[{' '.join(sorted(marks))}]" if marks else "")
        if len(self.path) > 2000:  # of very deep nesting its hash is enough
            self.path = f"/{_hash(self.path)}/{tag}"
        self.token = _hash(self.path)


class _Open:
    """The open elements, with the places of each kind, so that no search goes down the stack."""

    def __init__(self):
        self.all: list[Element] = []
        self.by_name: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.links = 0

    def push(self, e: Element) -> None:
        self.by_name.setdefault(e.name, []).append(len(self.all))
        if e.name in BLOCKS:
            self.blocks.append(len(self.all))
        self.links += e.name == "a"
        self.all.append(e)

    def close(self, k: int) -> None:
        """Closes the element at place k, and those inside it."""
        while len(self.all) > k:
            e = self.all.pop()
            self.by_name[e.name].pop()
            if e.name in BLOCKS:
                self.blocks.pop()
            self.links -= e.name == "a"

    def last(self, name: str) -> int | None:
        places = self.by_name.get(name)
        return places[-1] if places else None

    def block(self) -> Element | None:
        return self.all[self.blocks[-1]] if self.blocks else None


class Page:
    """Elements and text blocks of a page, from markup that may lack end tags or be cut off anywhere. The time is in
    proportion to the markup's length, however deep it is nested."""

    def __init__(self, text: str):
        self.elements: list[Element] = []
        self.blocks: list[tuple[str, Element | None]] = []
        now, held = _Open(), []

        def flush() -> None:
            line = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if line:
                self.blocks.append((line, now.all[-1] if now.all else None))

        for m in SCAN.finditer(text):
            if (piece := m["text"]) is not None:
                held.append(piece)
                if now.all:
                    n = len(piece) - piece.count(" ")
                    now.all[-1].chars += n
                    now.all[-1].linked += n if now.links else 0
                continue
            tag = (m["tag"] or "").lower()
            if not tag:
                if (m["raw"] or "").lower() in BLOCKS:
                    flush()
                continue
            if tag == "br":
                held.append(" ")
                continue
            if m["end"]:
                k = now.last(tag)
                if tag in BLOCKS:
                    flush()
                if k is not None and (tag in BLOCKS or not now.blocks or now.blocks[-1] < k):
                    now.close(k)
                continue
            if tag in BLOCKS:
                flush()
                if tag not in ("html", "body"):
                    if (e := now.block()) and e.name == "p":
                        now.close(now.blocks[-1])
                    if tag in ENDS and (e := now.block()) and e.name in ENDS[tag]:
                        now.close(now.blocks[-1])
                if tag == "body" and (k := now.last("head")) is not None:
                    now.close(k)
            if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCKS:
                continue
            e = Element(tag, m["attrs"], now.all[-1] if now.all else None, len(self.elements))
            self.elements.append(e)
            now.push(e)
        flush()
        for e in reversed(self.elements):
            if e.parent:
                e.parent.chars += e.chars
                e.parent.linked += e.linked

    def tokens(self) -> dict[int, list]:
        """Token: count, path if it is an element; a block's token has its element's."""
        out: dict[int, list] = {_hash(PAGE): [1, PAGE, None]} if self.elements else {}
        for e in self.elements:
            out.setdefault(e.token, [0, e.path if e.inside else "", None])[0] += 1
        for line, e in self.blocks:
            if e is not None:
                out.setdefault(_hash(f"{e.path}\n{line}"), [0, None, e.token if not e.plain else None])[0] += 1
        return out

    def article(self, frame: set[int], fixed: set[int]) -> str:
        """Blocks under the template's article or main element, or the page's own, or the innermost template element
        around all unlinked text that is no template; without any, of its body. Not those that are template themselves,
        unless the whole page is."""
        mine: list[bool] = []  # template elements: their class has support, and so has that of what they are nested in
        for e in self.elements:
            mine.append(e.token in frame and (e.parent is None or e.parent.token not in frame or mine[e.parent.order]))
        named = [e for e in self.elements if e.tag in ("article", "main") and e.inside]
        top = max((e for e in named if mine[e.order]), key=lambda e: e.chars, default=None)
        for kind in ("article", "main"):
            own = [e for e in named if e.tag == kind]
            if top is None and own and (len(own) == 1 or not any(mine)):
                top = max(own, key=lambda e: e.chars)
        free = [(x, e) for x, e in self.blocks if not (fixed and e is not None and _hash(f"{e.path}\n{x}") in fixed)]
        if top is None and any(mine):
            top = self._around([e for _, e in free], mine, fixed)
        return "\n".join(self._under(free, top, fixed) or self._under(self.blocks, top, fixed))

    def _around(self, held: list[Element | None], mine: list[bool], fixed: set[int]) -> Element | None:
        """The innermost template element that holds all of these that count: not marked, fixed, or linked only."""
        out: list[bool] = []
        for e in self.elements:
            here = e.marked or e.token in fixed or e.tag == "header" and not fixed
            out.append(here or e.parent is not None and out[e.parent.order])
        wanted = {e.order for e in held if e is not None and e.chars != e.linked and not out[e.order]}
        inside = [int(k in wanted) for k in range(len(self.elements))]
        for e in reversed(self.elements):
            if e.parent is not None:
                inside[e.parent.order] += inside[e.order]
        whole = [e for e in self.elements if wanted and inside[e.order] == len(wanted) and mine[e.order]]
        return whole[-1] if whole else None  # those that hold all lie in one another, in page order

    def _under(self, blocks: list[tuple[str, Element | None]], top: Element | None, fixed: set[int]) -> list[str]:
        under: list[bool] = []
        for e in self.elements:
            above = under[e.parent.order] if e.parent is not None else top is None
            gone = e.marked or e.token in fixed or e.tag == "header" and top is None
            under.append(e is top or above and not gone)
        return [x for x, e in blocks if (top is None if e is None else under[e.order])]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """For each host and token its vector, pages, greatest count on a page, path and element."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    names = ["host", "page", "token", "n", "path", "around"]

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            for host, key, text in zip(b.column("host"), b.column("page"), b.column("html"), strict=True):
                host, key = host.as_py(), key.as_py()
                rows += [(host, key, t, n, path, around) for t, (n, path, around) in Page(text.as_py()).tokens().items()]
                if len(rows) >= TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "host string, page bigint, token bigint, n bigint, path string, around bigint"
    keyed = pages.select("host", F.xxhash64("host", "page_id", "url", "html").alias("page"), "html")
    seen = keyed.mapInArrow(run, schema).withColumn("h", F.xxhash64("page", "n")).groupBy("host", "token").agg(
        F.struct(F.expr("sum(h & 4294967295L)"), F.expr("sum(shiftrightunsigned(h, 32))")).alias("vector"), F.count("*").alias("pages"), F.max("path").alias("path"),
        F.max("n").alias("most"), F.max("around").alias("around"),
    )
    return stored(seen, "tokens")  # it is read several times, and pages are parsed once for it


def classes(seen: DataFrame) -> DataFrame:
    """host, frame, fixed: the tokens of each host's template elements, and of its fixed blocks and template texts.

    Tokens that stand once on a page are grouped by their vector. A class is valid if it has elements and support: all pages
    with elements, half of them (two or more), or a tenth (three or more). Its elements are the template's, nested by their
    paths (Page.article() leaves out those whose parent is in no valid class); its texts are template text."""
    root = seen.where(F.col("path") == PAGE).select("host", F.col("pages").alias("total"))
    element, token = F.col("path").isNotNull(), F.col("token")
    each = seen.where((F.col("most") == 1) & ~F.col("path").eqNullSafe(PAGE)).groupBy("host", "vector").agg(
        F.max("pages").alias("pages"), F.count_if(element).alias("elements"), F.collect_set(F.when(element & (F.col("path") != ""), token)).alias("frame"),
        F.collect_set(F.when(~element & (F.col("pages") >= 2), token)).alias("texts"),  # one page's own texts are no template
    )
    valid = each.where("elements > 0").join(root, "host")
    valid = valid.where("pages = total or pages >= 2 and pages * 2 >= total or pages >= 3 and pages * 10 >= total")
    # an element with attributes and a text that come and go together on three pages or more
    around = seen.where("path is null and around is not null and pages >= 3").select("host", F.col("around").alias("token"), F.col("vector").alias("same"))
    blocks = seen.where(element).join(around, ["host", "token"]).where(~F.col("path").rlike(r"/(html|body|main|article)(\[[^\]]*\])?$")).where("vector = same")
    none = F.array().cast("array<bigint>")
    both = valid.select("host", "frame", F.col("texts").alias("fixed")).unionByName(blocks.select("host", none.alias("frame"), F.array("token").alias("fixed")))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return both.groupBy("host").agg(merged("frame"), merged("fixed"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row: the article's blocks in page order, joined by line feeds.

    Character references are decoded and white space inside a block becomes one space. Null html counts as empty
    and has the empty text; pages of null url share the host "". Repeated rows are one page of the template and
    each get a row, and so do pages of null page_id. A host of one page is its own template. Pages of any length and depth
    are read whole, in time that grows with their length. An empty table gives no rows; other columns are left out.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))
    found = cut(classes(templates(rows)))
    tokens = found.agg(F.sum(F.size("frame") + F.size("fixed"))).first()[0] or 0
    found = F.broadcast(found) if tokens <= TEMPLATE_TOKENS else found
    joined = rows.join(found, "host", "left").select("page_id", "url", "host", "html", "frame", "fixed")

    def run(batches):
        for b in batches:
            held: dict = {}
            texts = []
            for k, (host, text) in enumerate(zip(b.column("host").to_pylist(), b.column("html"), strict=True)):
                if host not in held:
                    held[host] = set(b.column("frame")[k].as_py() or ()), set(b.column("fixed")[k].as_py() or ())
                texts.append(Page(text.as_py()).article(*held[host]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
