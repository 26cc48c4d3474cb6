"""Pagination, page ranges and line passes, as folds over arrays: no row leaves its document's partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.columns import blank, stripped


def packed_lines(lines: Column, limit: int) -> Column:
    """Lines packed in order into pages of at most `limit` characters; a longer line is a page of its own."""
    start = F.struct(F.array().cast("array<string>").alias("pages"), F.lit("").alias("cur"))

    def step(a, x):
        both = F.when(a["cur"] == "", x).otherwise(F.concat(a["cur"], F.lit("\n"), x))
        closed = F.when(a["cur"] == "", a["pages"]).otherwise(F.concat(a["pages"], F.array(a["cur"])))
        fits = F.length(both) <= limit
        alone = F.length(x) <= limit
        return F.struct(
            F.when(fits, a["pages"]).when(alone, closed).otherwise(F.concat(closed, F.array(x))).alias("pages"),
            F.when(fits, both).when(alone, x).otherwise("").alias("cur"),
        )

    done = lambda a: F.when(a["cur"] == "", a["pages"]).otherwise(F.concat(a["pages"], F.array(a["cur"])))
    return F.filter(F.aggregate(lines, start, step, done), lambda p: ~blank(p))


def line_pages(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, pages (texts) of each text without blank lines: the fold, before its pages become rows."""
    text = stripped(F.col("text"))
    one = F.when(F.length(text) <= limit, F.array(text)).otherwise(packed_lines(F.split(text, "\n"), limit))
    return docs.where(~blank(F.col("text"))).select("doc_id", one.alias("pages"))


def paginate_lines(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, page, n_chars, text of each page of a text without blank lines."""
    return page_range(line_pages(docs, limit), None, None).drop("total_pages")


def page_range(listed: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Pages first..last of each document of line_pages(), with their own numbers, and total_pages, which counts all of
    them: an array knows its size, so nothing is counted or shuffled."""
    low = max(1, first or 1)
    total = F.size("pages")
    high = total if last is None else F.least(total, F.lit(last))
    kept = F.slice("pages", low, F.greatest(high - (low - 1), F.lit(0)))
    rows = listed.withColumn("total_pages", total.cast("bigint")).select("doc_id", "total_pages", F.posexplode(kept).alias("k", "text"))
    return rows.select("doc_id", (F.col("k") + low).alias("page"), F.length("text").alias("n_chars"), "text", "total_pages")


def without_repeated_lines(lines: Column) -> Column:
    """Lines that are not blank and equal the one before go."""
    return F.filter(lines, lambda x, i: (i == 0) | blank(x) | (x != F.get(lines, i - 1)))


def running_headers(docs: DataFrame) -> DataFrame:
    """doc_id, line, n: short lines that a document has three times or more."""
    lines = docs.select("doc_id", F.explode(F.transform("lines", stripped)).alias("line"))
    short = lines.where((F.length("line") > 5) & (F.length("line") < 60))
    return short.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 3")


def heading_lines(lines: Column) -> Column:
    """Heading lines outside of code fences, with their places."""
    start = F.struct(F.lit(False).alias("fence"), F.array().cast("array<struct<at:int,line:string>>").alias("out"), F.lit(0).alias("i"))

    def step(a, x):
        fence = x.rlike(r"^\s*(```|~~~)")
        head = ~a["fence"] & ~fence & x.rlike(r"^#{1,6}\s")
        return F.struct(
            (a["fence"] != fence).alias("fence"),
            F.when(head, F.concat(a["out"], F.array(F.struct(a["i"].alias("at"), x.alias("line"))))).otherwise(a["out"]).alias("out"),
            (a["i"] + 1).alias("i"),
        )

    return F.aggregate(lines, start, step, lambda a: a["out"])


def oversize(pages: DataFrame, chars: int, tokens: int | None = None, chars_per_token: float = 3.5) -> DataFrame:
    """pages (with the column text) with status and error: "oversize" where a page has more characters or, counted as bytes,
    more tokens than a page may have. Such pages are rejected whole, never cut; where("status is null") goes on."""
    n, size = F.length("text"), F.octet_length("text")
    long = F.concat(n.cast("string"), F.lit(" chars (~"), F.floor(n / chars_per_token).cast("string"), F.lit(f" tok) exceeds the {chars}-char text-page bound"))
    why = F.when(n > chars, long)
    if tokens:
        why = why.when(size > tokens, F.concat(size.cast("string"), F.lit(f" tokens exceeds the {tokens}-token text-page bound")))
    return pages.withColumn("error", why).withColumn("status", F.when(F.col("error").isNotNull(), "oversize"))


def packed(items: Column, most: int, chars: int, joiner: int = 1, cut: bool = False) -> Column:
    """Greedy groups in order: at most `most` items and `chars` characters, a joiner between items; one item at least. cut: an
    item of more characters is cut to them."""
    items = F.transform(items, lambda x: F.left(x, F.lit(chars))) if cut else items
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), none.alias("cur"), F.lit(0).alias("used"))

    def step(a, x):
        add = F.length(x) + F.when(F.size(a["cur"]) > 0, joiner).otherwise(0)
        over = (F.size(a["cur"]) > 0) & ((F.size(a["cur"]) >= most) | (a["used"] + add > chars))
        return F.struct(
            F.when(over, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"),
            F.when(over, F.array(x)).otherwise(F.concat(a["cur"], F.array(x))).alias("cur"),
            F.when(over, F.length(x)).otherwise(a["used"] + add).alias("used"),
        )

    return F.aggregate(items, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))


def sections(paragraphs: Column, limit: int, overlap: int) -> Column:
    """Greedy sections of about `limit` tokens; each starts with the last paragraphs of the one before, up to
    `overlap` tokens. A token is four characters."""
    tokens = lambda p: F.floor(F.length(p) / 4)
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), none.alias("cur"), F.lit(0).cast("bigint").alias("used"))

    def tail(cur):
        # of the reversed list, the longest prefix within the overlap
        first = F.struct(none.alias("kept"), F.lit(0).cast("bigint").alias("used"), F.lit(True).alias("open"))

        def take(a, p):
            fits = a["open"] & (a["used"] + tokens(p) <= overlap)
            return F.struct(
                F.when(fits, F.concat(F.array(p), a["kept"])).otherwise(a["kept"]).alias("kept"),
                F.when(fits, a["used"] + tokens(p)).otherwise(a["used"]).alias("used"), fits.alias("open"),
            )

        return F.aggregate(F.reverse(cur), first, take)

    def step(a, x):
        over = (a["used"] + tokens(x) > limit) & (F.size(a["cur"]) > 0)
        kept = tail(a["cur"])
        return F.struct(
            F.when(over, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"),
            F.when(over, F.concat(kept["kept"], F.array(x))).otherwise(F.concat(a["cur"], F.array(x))).alias("cur"),
            F.when(over, kept["used"] + tokens(x)).otherwise(a["used"] + tokens(x)).alias("used"),
        )

    return F.aggregate(paragraphs, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))
