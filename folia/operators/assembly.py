"""From pages to a document: votes, stitching across page breaks, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.columns import demoted, stripped


def in_page_order(value: Column, *by: str) -> Column:
    """The values of a group as an array, sorted by the named columns."""
    rows = F.array_sort(F.collect_list(F.struct(*by, value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def first_value(value: Column, page: str = "page") -> Column:
    """The value of the first page whose value is neither null nor empty."""
    return F.min_by(F.when(value != "", value), F.when(value != "", F.col(page)))


def majority(pages: DataFrame, value: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The most frequent value of each document; of equally frequent ones, that of the earliest page.

    The vote counts by (document, value) first, so a long document's rows meet pre-aggregated."""
    counted = pages.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(
        F.count("*").alias("n"), F.min("page").alias("first")
    )
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value))


def union_in_order(words: Column) -> Column:
    """Distinct members of a group's arrays, in the order of their first page."""
    return F.array_distinct(F.flatten(words))


#: A page's text that ends a sentence, and one that starts in the middle of one; lines of a list.
ENDS = r"[.!?:;。！？][\"')\]]*$"
CONTINUES = r"^[\p{javaLowerCase}\p{Nd}]"
LIST_LINE = r"(?m)^\s*(?:[-*•]|\d+[.)])\s+"
#: Captions that number a new table, and those that say a table goes on.
NEW_TABLE = r"\s*tab(?:le|\.)?\s*[A-Za-z0-9][\w.-]*\s*[.:)–—-]"
CONTINUED = r"\bcont(?:inued|'d|\.)?\b"


def prose(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LIST_LINE)) < 2


def stitched(chunks: Column) -> Column:
    """Chunks (page, nth, content, keywords) in page order; a page's first chunk joins the chunk before it if that
    ends on the page before, both are prose, and the sentence goes on. A joined chunk has all its pages, and is
    judged as a whole when the next page comes."""
    kind = "array<struct<page:bigint,pages:array<bigint>,content:string,keywords:array<string>>>"
    start = F.array().cast(kind)

    def step(out, c):
        last = F.element_at(out, -1)
        own = F.struct(
            c["page"].cast("bigint").alias("page"), F.array(c["page"].cast("bigint")).alias("pages"), c["content"].alias("content"),
            c["keywords"].alias("keywords"),
        )
        goes_on = (
            (F.size(out) > 0) & (c["nth"] == 0) & (F.element_at(last["pages"], -1) == c["page"] - 1) & prose(last["content"])
            & prose(c["content"]) & ~stripped(last["content"]).rlike(ENDS) & stripped(c["content"]).rlike(CONTINUES)
        )
        right = F.regexp_replace(last["content"], r"(?U)\s+$", "")
        left = F.regexp_replace(c["content"], r"(?U)^\s+", "")
        both = F.struct(
            last["page"].alias("page"), F.concat(last["pages"], F.array(c["page"].cast("bigint"))).alias("pages"),
            F.concat(right, F.lit(" "), left).alias("content"), F.array_union(last["keywords"], c["keywords"]).alias("keywords"),
        )
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(both))).otherwise(
            F.concat(out, F.array(own))
        )

    # element_at of an empty array is an error that `when` does not always shield
    rest = F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0)))
    one = F.get(chunks, F.lit(0))
    first = F.array(F.struct(
        one["page"].cast("bigint").alias("page"), F.array(one["page"].cast("bigint")).alias("pages"), one["content"].alias("content"),
        one["keywords"].alias("keywords"),
    )).cast(kind)
    return F.when(F.size(chunks) == 0, start).otherwise(F.aggregate(rest, first, step))


def table_goes_on(y1: Column, y0: Column, cols: Column, next_cols: Column, caption: Column) -> Column:
    """Whether the first table of a page continues the last one of the page before: that reaches the foot, this
    starts at the head, their widest rows are alike, and the caption does not number a new table."""
    fresh, told = caption.rlike("(?i)^" + NEW_TABLE), caption.rlike("(?i)" + CONTINUED)
    new = F.coalesce((caption != "") & fresh & ~told, F.lit(False))
    return (y1 >= 930) & (y0 <= 100) & (cols > 0) & (next_cols > 0) & (F.abs(cols - next_cols) <= 1) & ~new


def markdown_page(page: Column, parts: Column) -> Column:
    n = page.cast("string")
    return F.concat(F.lit("<page "), n, F.lit(">\n"), F.array_join(parts, "\n\n"), F.lit("\n</page "), n, F.lit(">"))


def rendered(pages: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, markdown. units: doc_id, page, kind (0 chunk, 1 table, 2 figure), nth, text of what each page holds.

    One shuffle: pages enter the sort as empty units of their own instead of being joined. Units of a page that the
    document does not have come last, on a page after the largest."""
    marks = pages.select("doc_id", "page", F.lit(-1).alias("kind"), F.lit(0).cast("bigint").alias("nth"), F.lit(None).cast("string").alias("text"))
    rows = marks.unionByName(units.select("doc_id", "page", "kind", F.col("nth").cast("bigint").alias("nth"), "text"))
    held = rows.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, F.struct("kind", "nth", "text")))).alias("units"), (F.min("kind") == -1).alias("known"),
    )
    both = held.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "known", "units"))).alias("pages"))
    texts = lambda p: F.transform(F.filter(p["units"], lambda u: u["text"] != ""), lambda u: u["text"])
    known = F.transform(F.filter("pages", lambda p: p["known"]), lambda p: markdown_page(p["page"], texts(p)))
    stray = F.flatten(F.transform(F.filter("pages", lambda p: ~p["known"]), texts))
    after = F.coalesce(F.array_max(F.transform(F.filter("pages", lambda p: p["known"]), lambda p: p["page"])), F.lit(0)) + 1
    blocks = F.when(F.size(stray) > 0, F.concat(known, F.array(markdown_page(after, stray)))).otherwise(known)
    return both.select("doc_id", stripped(F.array_join(blocks, "\n\n")).alias("markdown"))


def raw_sections(sections: dict[str, Column]) -> Column:
    """Fixed sections in order, each with a heading; an empty one says so."""
    body = lambda c: F.when(stripped(F.coalesce(c, F.lit(""))) == "", "(none)").otherwise(stripped(c))
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"# {name}\n\n"), body(c)) for name, c in sections.items()])


def raw_page(page: Column, texts: Column) -> Column:
    return markdown_page(page, F.transform(texts, demoted))
