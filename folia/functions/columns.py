"""Column builders: scalar rules on pages, boxes, budgets, tokens and tags. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's strip() and \\s take it.
SPACE = r"(?U)\s"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


# -- boxes on the 0-1000 page grid --------------------------------------------------------------------------------


def envelope_of_quad(quad: Column) -> Column:
    """[x0, y0, x1, y1] around four corners; null unless there are four finite pairs."""
    ok = (F.size(quad) == 4) & F.forall(quad, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v)))
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    return F.when(ok, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def quad_of_flat(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners, from the top left clockwise."""
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def clamped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(1000))


def crop_pixels(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column, least: float = 0.015) -> Column:
    """struct(left, upper, right, lower) in pixels, cut towards zero; null for an empty box or one under the share."""
    a, b, c, d = (clamped(v) for v in (x0, y0, x1, y1))
    whole = (c > a) & (d > b) & ((c - a) * (d - b) / F.lit(1_000_000.0) >= least)
    px = lambda v, n: F.floor(v / F.lit(1000.0) * n).cast("int")
    return F.when(whole, F.struct(px(a, w).alias("l"), px(b, h).alias("u"), px(c, w).alias("r"), px(d, h).alias("b")))


def padded(x0: Column, y0: Column, x1: Column, y1: Column, by: int = 40) -> list[Column]:
    return [F.greatest(x0 - by, F.lit(0)), F.greatest(y0 - by, F.lit(0)), F.least(x1 + by, F.lit(1000)), F.least(y1 + by, F.lit(1000))]


def flipped(top: Column, height: Column) -> Column:
    """A y measured from the bottom, from the top."""
    return height - top


def point_pixels(v: Column, dpi: Column) -> Column:
    return (v * dpi / 72).cast("int")


def clamped_scale(w: Column, h: Column, dpi: Column, longest: int = 6000) -> Column:
    """Pixels a point at the resolution, or fewer so that the long edge stays within the limit."""
    return F.least(dpi / 72, F.lit(float(longest)) / F.greatest(w, h))


# -- tile budgets of an image model -------------------------------------------------------------------------------

#: Grids (height, width) that an image is fitted to, a tile's side and cells, and the order of buckets.
PINPOINTS = [(1536, 1152), (2304, 1536), (3072, 2304), (1152, 1152)]
TILE, GRID = 384, 12
BUCKETS = [("B1", 1152, 1536), ("B2", 1536, 2304), ("B3", 2304, 3072)]
GLYPH = 10.0
OUTPUT_CUT = {"B0": 6500, "B1": 25500, "B2": 29500, "B3": 26500, "text": 7000}
BUCKET_IMAGE_TOKENS = {"B0": 1476, "B1": 1920, "B2": 3672, "B3": 7152}
TOKEN_BUDGET = 30_000


def best_grid(w: Column, h: Column) -> Column:
    """struct(eff, waste, ph, pw) of the grid that keeps most pixels, then wastes fewest, then comes first."""
    options = []
    for k, (ph, pw) in enumerate(PINPOINTS):
        scale = F.least(F.lit(float(pw)) / w, F.lit(float(ph)) / h)
        eff = F.least(F.floor(w * scale) * F.floor(h * scale), w * h)
        options.append(F.struct((-eff).alias("eff"), (ph * pw - eff).alias("waste"), F.lit(k).alias("k"), F.lit(ph).alias("ph"), F.lit(pw).alias("pw")))
    return F.array_min(F.array(*options))


def image_tokens(w: Column, h: Column, grid: Column | None = None) -> Column:
    """Tokens that an image of this size takes: the fitted part of the grid, a token a row, and the overview tile. grid is best_grid()
    of a select before this one, so that it is worked out once and not for each of its fields."""
    grid = best_grid(w, h) if grid is None else grid
    rows, cols = GRID * F.floor(grid["ph"] / TILE), GRID * F.floor(grid["pw"] / TILE)
    wide = w / h > cols / rows
    new_rows = F.floor(F.round(h * (cols / w), 7))
    new_cols = F.floor(F.round(w * (rows / h), 7))
    r = F.when(wide, rows - F.floor((rows - new_rows) / 2) * 2).otherwise(rows)
    c = F.when(wide, cols).otherwise(cols - F.floor((cols - new_cols) / 2) * 2)
    return (r * c + r + GRID * GRID).cast("int")


def bucket(w: Column, h: Column, glyph: Column, target: float = GLYPH) -> Column:
    """B0 for near-square pages, B2 where glyphs can't be measured, else the first in which glyphs are large enough."""
    out = F.when((w / h >= 0.9) & (w / h <= 1.15), "B0").when(glyph.isNull() | (glyph == 0), "B2")
    for name, bw, bh in BUCKETS:
        out = out.when(glyph * F.least(bw / w, bh / h) >= target * 0.95, name)
    return out.otherwise(BUCKETS[-1][0])


def output_cut(kind: Column, tokens: Column) -> Column:
    """Output tokens past which a page in this bucket is a runaway; the larger of its own and its cost's bucket."""
    own = F.create_map(*[F.lit(x) for kv in OUTPUT_CUT.items() for x in kv])
    by_cost = F.lit(OUTPUT_CUT["B3"])
    for b in ("B2", "B1", "B0"):
        by_cost = F.when(tokens <= BUCKET_IMAGE_TOKENS[b], OUTPUT_CUT[b]).otherwise(by_cost)
    return F.greatest(own[kind], by_cost)


# -- text ---------------------------------------------------------------------------------------------------------

CJK = r"[　-ヿ㐀-鿿가-힯豈-﫿＀-￯]"


def approx_tokens(text: Column) -> Column:
    """A token for each CJK character, and for each four others."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return (cjk + F.floor((F.length(text) - cjk) / 4)).cast("int")


def demoted(text: Column) -> Column:
    """Headings of levels 1 to 5, one level down."""
    return F.regexp_replace(text, r"(?m)^(#{1,5})([ \t\n\x0B\f\r])", r"#$1$2")


#: A data URI's payload of 200 characters or more.
DATA_URI = r"(data:[A-Za-z0-9.+/;=-]*;base64,)[A-Za-z0-9+/=]{200,}"
PAYLOAD = "[payload removed]"


def without_payloads(text: Column) -> Column:
    return F.regexp_replace(text, DATA_URI, "$1" + PAYLOAD.replace("[", r"\[").replace("]", r"\]").replace("\\", ""))


def cleaned_references(text: Column) -> Column:
    return F.regexp_replace(text, r"(\d)\s*-\s*-\s*-\s*(\d)", "$1-$2")


def caption_key(text: Column) -> Column:
    """Lower-cased, white space collapsed, dots at the end dropped."""
    low = F.lower(stripped(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, r"(?U)\s+", " "), r"\.+$", "")


def token_class(t: Column) -> Column:
    """ident, code, acronym, or null for prose."""
    ident = (F.length(t) >= 6) & (t.contains("_") | t.rlike("[a-z][A-Z]"))
    upper = t.rlike("[A-Z]") & ~t.rlike("[a-z]")
    return F.when(ident, "ident").when(t.rlike("[0-9]"), "code").when((F.length(t) >= 3) & upper, "acronym")


TOKEN = r"[A-Za-z0-9](?:[A-Za-z0-9._\-]*[A-Za-z0-9])?"


def precision_tokens(text: Column) -> Column:
    """Distinct tokens of a precision class in a text."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), 0)), lambda t: token_class(t).isNotNull())


def edit_budget(t: Column) -> Column:
    return F.when(F.length(t) >= 7, 2).otherwise(1)


# -- tags ---------------------------------------------------------------------------------------------------------

#: The section types, and the rules that fold other tags into them, in order.
SECTION_TYPES = (
    "abstract introduction methodology results discussion conclusion appendix technical_content body table_text list news_article"
    " news_brief news_analysis feature_article opinion commentary editorial preview preview_list headline header masthead title"
    " footer index photo_caption photo_feature stat_box sidebar advertisement legal_notice official_document obituary weather_box"
    " other"
).split()
SECTION_RULES = [
    (r"(^|_)(preview|teaser|refer)s?($|_)", "preview"),
    (r"(^|_)briefs?($|_)|briefing", "news_brief"),
    (r"headline|kicker|subhead|banner", "headline"),
    (r"caption", "photo_caption"),
    (r"masthead|nameplate|dateline|cover", "masthead"),
    (r"(^|_)(toc|index|contents|navigation|links?)($|_)", "index"),
    (r"advert|(^|_)ads?($|_)|classified|promo|listing", "advertisement"),
    (r"notice|announcement", "legal_notice"),
    (r"law|regulation|policy|official|statement|declaration|document|speech|whitepaper", "official_document"),
    (r"obituar", "obituary"),
    (r"weather", "weather_box"),
    (r"stat|chart|graphic|infograph|data|table|diagram|timeline", "stat_box"),
    (r"photo|gallery|picture|image", "photo_feature"),
    (r"illustration|cartoon|comic|artwork|drawing|map", "other"),
    (r"sidebar|box|guide|tips?|service|qa|question|summary|quote|supplement", "sidebar"),
    (r"letter", "opinion"),
    (r"review|critic", "opinion"),
    (r"poem|poetry|novel|literar|fiction|excerpt|diary", "feature_article"),
    (r"editorial", "editorial"),
    (r"opinion|commentary|column|essay|forum|debate", "opinion"),
    (r"analysis|investigat|report", "news_analysis"),
    (r"feature|profile|interview|biograph|memoir|travel|history|cultural|story", "feature_article"),
    (r"footer|colophon|imprint|credit|byline|folio|meta|furniture", "footer"),
    (r"header|title|heading", "header"),
    (r"news|article|dispatch|sports|business|science|health|financ", "news_article"),
    (r"abstract", "abstract"),
    (r"intro|preface|background|motivation|related", "introduction"),
    (r"method|material|procedure", "methodology"),
    (r"result|finding", "results"),
    (r"discussion", "discussion"),
    (r"conclusion|recommend|future", "conclusion"),
    (r"appendix|reference|bibliograph", "appendix"),
    (r"footnote|endnote", "appendix"),
    (r"(^|_)list($|_)", "list"),
    (r"body|entry|text|paragraph|content", "body"),
]


def section_type(tag: Column, folds: dict[str, str] | None = None) -> Column:
    """The tag itself if it is a section type; else what folds (legacy tags, a parameter) says of its normalised and
    then of its raw form; else the first rule that matches; else other. A null tag is other."""
    norm = F.translate(F.lower(stripped(tag)), "- ", "__")
    out = F.when(tag.isNull(), "other").when(norm.isin(SECTION_TYPES), norm)
    if folds:
        known = F.create_map(*[F.lit(x) for kv in folds.items() for x in kv])
        out = out.when(known[norm].isNotNull(), known[norm]).when(known[tag].isNotNull(), known[tag])
    for rule, kind in SECTION_RULES:
        out = out.when(norm.rlike(rule), kind)
    return out.otherwise("other")


# -- ids and seeds ------------------------------------------------------------------------------------------------


def doc_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def seed_for(key: Column, attempt: Column) -> Column:
    """The first four bytes of a sha-256, below 2^31."""
    digest = F.sha2(F.concat(key, F.lit(":"), attempt.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 2147483648).cast("bigint")


def file_class(path: Column) -> Column:
    """pdf, image, office, spreadsheet, text or csv by the extension; null if it is none that is read."""
    ext = F.regexp_extract(F.lower(path), r"\.([^./\\]+)$", 1)
    kinds = {
        "pdf": "pdf", "csv": "csv",
        **dict.fromkeys("png jpg jpeg tif tiff bmp gif webp".split(), "image"),
        **dict.fromkeys("doc docx ppt pptx odt odp".split(), "office"),
        **dict.fromkeys("xls xlsx xlsm ods".split(), "spreadsheet"),
        **dict.fromkeys("txt md markdown rtf html htm eml msg".split(), "text"),
    }
    out = F.lit(None).cast("string")
    for kind in ("pdf", "csv", "image", "office", "spreadsheet", "text"):
        out = F.when(ext.isin([e for e, k in kinds.items() if k == kind]), kind).otherwise(out)
    return out


def error_class(message: Column) -> Column:
    """A category for a failure's message."""
    low = F.lower(message)
    return (
        F.when(low.rlike("out of memory|oom|memoryerror"), "oom").when(low.rlike("timed? ?out"), "timeout")
        .when(low.rlike("connection|refused|reset by peer|unreachable"), "connection").when(low.rlike("json|parse|decode"), "parse")
        .when(low.rlike("no space left|disk full"), "disk_full").when(low.rlike("too many open files"), "fd_exhausted")
        .when(low.rlike("cancel"), "cancelled").when(low.rlike("oserror|permission|errno"), "os").otherwise("other")
    )


def citation_style(text: Column) -> Column:
    """footnote, raised or caret: the style that the text has most of, the first of equal ones; keep under two."""
    f, s, c = (F.regexp_count(text, F.lit(p)) for p in (r"\[\^\d+\](?!:)", r"<sup>\d[\d,\s]*</sup>", r"\^\d+\^"))
    return F.when(f + s + c < 2, "keep").when((f >= s) & (f >= c), "footnote").when(s >= c, "raised").otherwise("caret")


def last_part(text: Column, most: int = 4000) -> Column:
    """The whole text, or an ellipsis and its end."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(most - 1))))


def chunk_cap(text: Column, most: int, least: int = 2048) -> Column:
    """Output tokens for a chunk: two and a half times its own, within bounds."""
    return F.greatest(F.lit(least), F.least((F.floor(F.length(text) / 4) * 2.5).cast("int"), F.lit(most)))


def row_count(html: Column) -> Column:
    """Rows of a table's markup."""
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit("<tr"))


def refined(new: Column, first: Column, second: Column, joined: Column) -> Column:
    """A model's reading of a table over two pages, if it has at least the rows of the larger part; else the parts joined."""
    enough = new.contains("<table") & (row_count(new) >= F.greatest(row_count(first), row_count(second)))
    return F.when(F.coalesce(enough, F.lit(False)), new).otherwise(joined)


def checkable(figure_id: Column, crop_path: Column, bbox: Column) -> Column:
    """Figures that a model may judge: with a crop and a box, and no stand-in for a failed page nor a picture of a workbook."""
    own = ~figure_id.endswith("_pagefail") & ~figure_id.contains("_embedded_")
    return F.coalesce((crop_path != "") & bbox.isNotNull() & own, F.lit(False))


def detected(label: Column, score: Column, area: Column, page_area: Column, picture: str = "Picture", least: float = 0.5, most: float = 0.9) -> Column:
    """Detections that count as figures: pictures, sure enough, and not nearly the whole page."""
    return (label == picture) & (score >= least) & (area / page_area <= most)


def figure_verdict(reply: Column) -> Column:
    """figure or artifact, if that word with dots around it is all that a model replied; else null."""
    word = F.lower(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?U)^\s*\.*\s*|\s*\.*\s*$", ""))
    return F.when(word.isin("figure", "artifact"), word)
