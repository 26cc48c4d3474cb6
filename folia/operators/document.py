"""The document record: keyed chunks, tables and figures from page extractions, and what joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.operators import assembly
from folia.operators.pages import heading_lines, packed

#: A page extraction; boxes are flat or quads in the text, and both become [x0, y0, x1, y1].
EXTRACTION = """struct<metadata struct<title string, authors array<string>, organization string, year string, doc_type string>, summary string,
semantic_chunks array<struct<title string, content string, keywords array<string>, section_type string>>,
figures array<struct<bbox string, caption string, description string>>,
tables array<struct<bbox string, caption string, html string, description string>>>"""


def parsed(text: Column) -> Column:
    """A page's JSON by its schema; null if it does not parse. Boxes stay JSON text here."""
    return F.from_json(text, EXTRACTION.replace("\n", " "))


def box_of(text: Column) -> Column:
    """[x0, y0, x1, y1] of a box given as JSON text, flat or as four corners."""
    quad, flat = F.from_json(text, "array<array<double>>"), F.from_json(text, "array<double>")
    corner = lambda k, f: f(F.transform(quad, lambda p: F.get(p, F.lit(k))))
    env = F.array(corner(0, F.array_min), corner(1, F.array_min), corner(0, F.array_max), corner(1, F.array_max))
    is_quad = (F.size(quad) == 4) & F.forall(quad, lambda p: F.size(p) == 2)
    is_flat = (F.size(flat) == 4) & F.forall(flat, lambda v: v.isNotNull())
    return F.when(F.coalesce(is_quad, F.lit(False)), env).when(F.coalesce(is_flat, F.lit(False)), flat)


def units(pages: DataFrame, kind: str) -> DataFrame:
    """doc_id, page, nth (from 1) and the fields of each chunk, figure or table of the pages' extractions (column data)."""
    return pages.select("doc_id", "page", F.posexplode(f"data.{kind}").alias("k", "u")).select("doc_id", "page", (F.col("k") + 1).alias("nth"), "u.*")


def chunk_key(page: Column, nth: Column) -> Column:
    return F.concat(F.lit("p"), page.cast("string"), F.lit("_c"), nth.cast("string"))


def unit_key(doc: Column, page: Column, nth: Column, letter: str) -> Column:
    return F.concat(doc.cast("string"), F.lit("_p"), page.cast("string"), F.lit(f"_{letter}"), nth.cast("string"))


def stitched_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, page, pages, content, keywords: chunks of a document, joined over page breaks."""
    listed = chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", (F.col("nth") - 1).alias("nth"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")))).alias("c")
    )
    made = listed.select("doc_id", F.posexplode(assembly.stitched(F.col("c"))).alias("k", "c"))
    return made.select("doc_id", F.col("k").alias("nth"), F.col("c.page").alias("page"), F.col("c.pages").alias("pages"), F.col("c.content").alias("content"), F.col("c.keywords").alias("keywords"))


def page_failures(pages: DataFrame) -> DataFrame:
    """A figure in place of each page without an extraction: figure_id, caption."""
    note = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit(": transcription unavailable ("), F.coalesce("status", F.lit("failed")), F.lit(")]"))
    key = F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.col("page").cast("string"), F.lit("_pagefail"))
    return pages.where("data is null").select("doc_id", "page", key.alias("figure_id"), note.alias("caption"))


def metadata(pages: DataFrame) -> DataFrame:
    """One row a document: the first title, authors, organization and year that say something, and the type that most
    pages name. Two slim aggregates over the same key."""
    m = pages.where("data is not null").select("doc_id", "page", "data.metadata.*")
    first = m.groupBy("doc_id").agg(
        *[assembly.first_value(F.col(c)).alias(c) for c in ("title", "organization", "year")],
        F.min_by(F.when(F.size("authors") > 0, F.col("authors")), F.when(F.size("authors") > 0, F.col("page"))).alias("authors"),
    )
    return first.join(assembly.majority(m, "doc_type"), "doc_id", "left")


def markdown_units(chunks: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """What assembly.rendered() takes: chunks with their headings, tables as they are, figures as links or notes."""
    head = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.lit("## "), "title", F.lit("\n\n"))).otherwise("")
    c = chunks.select("doc_id", "page", F.lit(0).alias("kind"), "nth", F.concat(head, F.coalesce("content", F.lit(""))).alias("text"))
    t = tables.select("doc_id", "page", F.lit(1).alias("kind"), "nth", F.col("html").alias("text"))
    cap = F.coalesce(F.col("caption"), F.lit(""))
    link = F.concat(F.lit("!["), cap, F.lit("](img:"), F.col("index").cast("string"), F.lit(")"))
    note = F.concat(F.lit("[Figure: "), F.when(cap == "", "untitled").otherwise(cap), F.lit("]"))
    f = figures.select("doc_id", "page", F.lit(2).alias("kind"), "nth", F.when(F.col("crop_path").isNotNull(), link).otherwise(note).alias("text"))
    return c.unionByName(t).unionByName(f)


def orphans(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """Figures whose page the document does not have; a null page is none."""
    return figures.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def pages_tagged(chunks: DataFrame, kinds: list[str]) -> DataFrame:
    """(doc_id, page) of pages that a chunk of one of the section types touches."""
    hit = chunks.where(F.col("section_type").isin(kinds))
    return hit.select("doc_id", F.explode("pages").alias("page")).distinct()


def global_numbers(counts: DataFrame) -> DataFrame:
    """counts: doc_id, page, n. first: the number that the page's first image has in its document, from 1."""
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1)


def merged_cells(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """cells: sheet, r, c, v; ranges: sheet, r1, c1, r2, c2. Every cell of a merged range gets its first cell's value.

    A range is opened into its cells, which meet the others by equality, instead of a join on BETWEEN."""
    own = ranges.join(cells, (ranges["sheet"] == cells["sheet"]) & (ranges["r1"] == cells["r"]) & (ranges["c1"] == cells["c"])).select(ranges["*"], "v")
    grid = own.withColumn("r", F.explode(F.sequence("r1", "r2"))).withColumn("c", F.explode(F.sequence("c1", "c2")))
    filled = grid.select("sheet", "r", "c", F.col("v").alias("filled"))
    return cells.join(filled, ["sheet", "r", "c"], "full").select("sheet", "r", "c", F.coalesce("filled", "v").alias("v"))


def fixed_headings(sent: Column, reply: Column) -> Column:
    """The reply's lines if they are the sent headings with other levels, 1 to 6; else null."""
    out = F.split(F.regexp_replace(reply, r"^\n+|\n+$", ""), "\n")
    text = lambda x: F.trim(F.regexp_replace(x, r"^#+", ""))
    same = F.forall(F.zip_with(sent, out, lambda a, b: (text(a) == text(b)) & b.rlike(r"^#{1,6} ")), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.when((F.size(sent) == F.size(out)) & same, out)


def levels_by_text(headings: DataFrame, fixes: DataFrame) -> DataFrame:
    """headings: doc_id, chunk, at, line; fixes: doc_id, nth, line. Headings with the level that the first fix of the same
    text gives, where it gives one of 1 to 6; others keep theirs."""
    bare = F.trim(F.regexp_replace("line", r"^#+", ""))
    level = F.length(F.regexp_extract("line", r"^(#*)", 1))
    first = fixes.select("doc_id", "nth", bare.alias("text"), level.alias("level")).groupBy("doc_id", "text").agg(F.min_by("level", "nth").alias("level"))
    told = headings.withColumn("text", bare).join(first, ["doc_id", "text"], "left")
    new = F.when(F.col("level").between(1, 6), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).otherwise(F.col("line"))
    return told.select("doc_id", "chunk", "at", new.alias("line"))


def with_lines(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """chunks: doc_id, chunk, content; lines: doc_id, chunk, at, line. Contents with those lines in their places."""
    listed = lines.groupBy("doc_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("at", "line"))).alias("new"))
    parts = F.transform(F.split("content", "\n"), lambda x, k: F.coalesce(F.try_element_at("new", k), x))
    both = chunks.join(listed, ["doc_id", "chunk"], "left")
    return both.select("doc_id", "chunk", F.when(F.col("new").isNull(), F.col("content")).otherwise(F.array_join(parts, "\n")).alias("content"))


def figure_defects(figures: DataFrame) -> DataFrame:
    """doc_id, figure_id, n: ids that are missing or that several figures of a document have; a sound document has none."""
    held = figures.groupBy("doc_id", F.when(F.col("figure_id") != "", F.col("figure_id")).alias("figure_id")).agg(F.count("*").alias("n"))
    return held.where("figure_id is null or n > 1")


def validated(figures: DataFrame) -> DataFrame:
    """The figures, or an error that names the first defect: rendering relies on unique ids."""
    if bad := figure_defects(figures).orderBy("doc_id", "figure_id").first():
        raise ValueError(f"document {bad.doc_id}: {f'figure id {bad.figure_id!r} stands {bad.n} times' if bad.figure_id else 'a figure has no id'}")
    return figures


#: What of a processing log a response shows.
LOG_KEYS = "modality gates failed_pages decode table_stitch doc_summary figure_check heading_fix latex_wrap pages text_pagination".split()


def response(documents: DataFrame, skip_structured: bool = False) -> DataFrame:
    """doc_id, json of each document's response. documents: doc_id, markdown, total_pages, total_figures, total_time_seconds; any of
    LOG_KEYS; structured (JSON of metadata, summary, semantic_chunks, tables, images; null in raw mode, whose response
    leaves these keys out, so that "no model ran" is not "nothing found"). Other columns are never shown."""
    has = set(documents.columns)
    totals = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total_pages", "total_figures", "total_time_seconds")]
    log = F.struct(*totals, *[F.col(c) for c in LOG_KEYS if c in has])
    part = lambda k, none: F.coalesce(F.get_json_object("structured", f"$.{k}"), F.lit(none))
    text = F.when(F.get_json_object("structured", "$.summary").isNull(), "null").otherwise(F.to_json(F.array(F.get_json_object("structured", "$.summary"))))
    keys = {"metadata": part("metadata", "{}"), "summary": F.regexp_replace(text, r"^\[|\]$", ""), "semantic_chunks": part("semantic_chunks", "[]"), "tables": part("tables", "[]")}
    told = F.concat(*[x for k, v in keys.items() for x in (F.lit(f',"{k}":'), v)])
    shown = F.lit("") if skip_structured else F.when(F.col("structured").isNull(), "").otherwise(told)
    head = F.concat(F.lit('{"markdown":'), F.regexp_replace(F.to_json(F.array("markdown")), r"^\[|\]$", ""), F.lit(',"images":'), part("images", "[]"))
    return documents.select("doc_id", F.concat(head, F.lit(',"processing_log":'), F.to_json(log), shown, F.lit("}")).alias("json"))


def raw_documents(files: DataFrame) -> DataFrame:
    """What response() takes, for files whose text is the document as it is (sources.mail.read_files()): one page, no model."""
    return files.where("text is not null").select(
        "doc_id", F.col("text").alias("markdown"), F.lit(1).alias("total_pages"), F.lit(0).alias("total_figures"), F.lit(0.0).alias("total_time_seconds"),
        F.lit(0).alias("failed_pages"), F.lit("deterministic").alias("modality"), F.lit(None).cast("string").alias("structured"),
    )


def media_captions(pictures: DataFrame, pages: DataFrame) -> DataFrame:
    """pictures: doc_id, figure_id; pages: figure_id and data (the extraction of the picture as a page). A picture's caption is that
    of its first figure that has one, else its summary."""
    own = F.get(F.filter("data.figures", lambda f: f["caption"] != ""), F.lit(0))["caption"]
    told = pages.select("figure_id", F.coalesce(own, F.col("data.summary")).alias("caption"))
    return pictures.join(told, "figure_id", "left").select("doc_id", "figure_id", F.coalesce("caption", F.lit("")).alias("caption"))


#: Headings, and their characters, of a window that is sent for other levels.
WINDOW_LINES, WINDOW_CHARS = 24, 1700


def heading_windows(chunks: DataFrame) -> DataFrame:
    """doc_id, window, heads (chunk, at, line of each heading), in the order of chunks (doc_id, chunk, nth, content): what is
    sent for other levels."""
    found = heading_lines(F.split("content", "\n"))
    heads = F.transform(found, lambda h: F.struct(F.col("nth").alias("nth"), h["at"].alias("at"), F.col("chunk").alias("chunk"), h["line"].alias("line")))
    listed = chunks.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list(heads))).alias("heads"))
    groups = packed(F.transform("heads", lambda h: h["line"]), WINDOW_LINES, WINDOW_CHARS)
    cut = listed.where(F.size("heads") > 0).withColumn("sizes", F.transform(groups, lambda g: F.size(g)))
    cut = cut.select("doc_id", "heads", "sizes", F.posexplode("sizes").alias("window", "n"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("window")), F.lit(0), lambda a, n: a + n)
    return cut.select("doc_id", "window", F.slice("heads", before + 1, F.col("n")).alias("heads"))


def heading_fix(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """doc_id, chunk, content with the heading levels that replies (doc_id, window, text) give. A window's reply counts as a whole
    or, if it drops, adds or rewrites a heading, not at all."""
    told = heading_windows(chunks).join(replies.select("doc_id", "window", "text"), ["doc_id", "window"])
    new = told.withColumn("lines", fixed_headings(F.transform("heads", lambda h: h["line"]), F.col("text"))).where("lines is not null")
    pairs = new.select("doc_id", F.explode(F.arrays_zip("heads", "lines")).alias("p"))
    lines = pairs.select("doc_id", F.col("p.heads.chunk").alias("chunk"), F.col("p.heads.at").alias("at"), F.col("p.lines").alias("line"))
    return with_lines(chunks.select("doc_id", "chunk", "content"), lines)


def text_fields(documents: DataFrame, chunks: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, where, text: every text of a document's record that a source can check, one row a field, blank ones left out.

    documents: doc_id, title, summary; units: doc_id, key and their texts (title, content; caption, html; caption, description)."""

    def of(df: DataFrame, kind: str, *names: str) -> DataFrame:
        key = F.concat(F.lit(f"{kind}:"), F.col("key")) if "key" in df.columns else F.lit(kind)
        each = F.array(*[F.struct(F.concat(key, F.lit(f".{n}")).alias("where"), F.col(n).alias("text")) for n in names if n in df.columns])
        return df.select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.where", "f.text")

    parts = [of(documents, "document", "title", "summary"), of(chunks, "chunk", "title", "content"), of(tables, "table", "caption", "html", "description"), of(figures, "figure", "caption", "description")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("text").rlike(r"(?U)\S"))


def with_fields(units: DataFrame, kind: str, fields: DataFrame, *names: str) -> DataFrame:
    """Units (doc_id, key, ...) whose named texts are those of fields (see text_fields()), where these have them: one join."""
    own = fields.where(F.col("where").startswith(f"{kind}:")).select("doc_id", F.regexp_extract("where", rf"^{kind}:(.*)\.(\w+)$", 1).alias("key"), F.regexp_extract("where", r"\.(\w+)$", 1).alias("name"), "text")
    new = own.groupBy("doc_id", "key").agg(*[F.max(F.when(F.col("name") == n, F.col("text"))).alias(f"new_{n}") for n in names])
    both = units.join(new, ["doc_id", "key"], "left")
    return both.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in names else F.col(c) for c in units.columns])
