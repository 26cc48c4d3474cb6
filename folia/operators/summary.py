"""Bounded document summaries from page summaries, without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.columns import stripped
from folia.operators.pages import packed

#: Fixed value: words that say nothing new.
STOPWORDS = (
    "a an the of in on and or to for with by at from as is are was were be been this that these those it its their which while even"
    " into across over under than more most such not no do does also has have had"
).split()
NEW_SHARE = 0.5


def sentences(text: Column) -> Column:
    """Split after each sentence mark, as zero-width as that is; blank parts go."""
    parts = F.split(F.regexp_replace(text, r"([.!?。！？])\s*", "$1\x01"), "\x01")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def content_tokens(sentence: Column) -> Column:
    """Words of three characters or more that are no stop words, and pairs of CJK characters."""
    words = F.filter(F.regexp_extract_all(F.lower(sentence), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))
    runs = F.regexp_extract_all(sentence, F.lit("[㐀-鿿가-힯぀-ヿ]+"), 0)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def within_budget(text: Column, budget: int) -> Column:
    """The whole text, or as many of its first sentences as fit; null if none does."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def step(a, s):
        size = a["used"] + F.length(s) + F.when(F.size(a["out"]) > 0, 1).otherwise(0)
        fits = a["open"] & (size <= budget)
        return F.struct(
            F.when(fits, F.concat(a["out"], F.array(s))).otherwise(a["out"]).alias("out"), F.when(fits, size).otherwise(a["used"]).alias("used"), fits.alias("open")
        )

    cut = F.aggregate(sentences(text), start, step, lambda a: F.when(F.size(a["out"]) > 0, F.array_join(a["out"], " ")))
    return F.when(F.length(text) <= budget, text).otherwise(cut)


def composed(texts: Column, budget: int) -> Column:
    """Sentences of the texts in order, each kept if at least half of its tokens are new, until one exceeds the budget.

    Returns struct(summary, dropped): the joined sentences (null without any) and how many were not new."""
    sents = F.flatten(F.transform(F.array_distinct(texts), sentences))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("known"), F.lit(0).alias("used"), F.lit(0).alias("dropped"), F.lit(True).alias("open"))

    def step(a, s):
        toks = content_tokens(s)
        new = F.size(F.array_except(toks, a["known"]))
        stale = (F.size(a["out"]) > 0) & ((F.size(toks) == 0) | (new / F.size(toks) < NEW_SHARE))
        size = a["used"] + F.length(s) + F.when(F.size(a["out"]) > 0, 1).otherwise(0)
        fits = a["open"] & ~stale & (size <= budget)
        return F.struct(
            F.when(fits, F.concat(a["out"], F.array(s))).otherwise(a["out"]).alias("out"),
            F.when(fits, F.array_union(a["known"], toks)).otherwise(a["known"]).alias("known"),
            F.when(fits, size).otherwise(a["used"]).alias("used"),
            (a["dropped"] + F.when(a["open"] & stale, 1).otherwise(0)).alias("dropped"), (a["open"] & (stale | fits)).alias("open"),
        )

    return F.aggregate(
        sents, start, step,
        lambda a: F.struct(F.when(F.size(a["out"]) > 0, F.array_join(a["out"], " ")).alias("summary"), a["dropped"].alias("dropped")),
    )


def document_summaries(pages: DataFrame, budget: int = 4000, long_doc: int = 30) -> DataFrame:
    """doc_id, summary, dropped. pages: doc_id, page, summary, types (array of section types of the page's chunks).

    The first page with a summary, then pages with an abstract, an introduction and a conclusion, in that order; of
    documents of more than long_doc pages the abstract only."""
    listed = pages.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("page", stripped(F.coalesce("summary", F.lit(""))).alias("summary"), "types"))).alias("all")
    )
    filled = F.filter("all", lambda p: p["summary"] != "")
    of = lambda kind: F.filter(filled, lambda p: F.array_contains(p["types"], kind))
    none = F.slice(filled, 1, 0)
    short = F.col("n") <= long_doc
    chosen = F.concat(F.slice(filled, 1, 1), of("abstract"), F.when(short, of("introduction")).otherwise(none), F.when(short, of("conclusion")).otherwise(none))
    done = composed(F.transform(chosen, lambda p: p["summary"]), budget)
    return listed.select("doc_id", done.alias("s")).select("doc_id", "s.summary", "s.dropped")


def without_similar_neighbours(chunks: Column, threshold: float = 0.6) -> Column:
    """Chunk texts of which each is compared with the last kept: too alike in words, the one with more words stays."""
    words = lambda t: F.array_distinct(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"))

    def step(a, t):
        x, y = words(a["last"]), words(t)
        alike = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) > threshold
        drop = (F.size(a["out"]) > 0) & (F.size(x) > 0) & (F.size(y) > 0) & F.coalesce(alike, F.lit(False))
        swap = drop & (F.size(y) > F.size(x))
        return F.struct(
            F.when(swap, F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(t))).when(drop, a["out"])
            .otherwise(F.concat(a["out"], F.array(t))).alias("out"),
            F.when(drop & ~swap, a["last"]).otherwise(t).alias("last"),
        )

    return F.aggregate(chunks, start, step, lambda a: a["out"])


#: Characters of a block of summaries, and levels after which a tree of them counts as endless.
BLOCK, LEVELS = 11_000, 7


def blocks(items: DataFrame, chars: int = BLOCK) -> DataFrame:
    """doc_id, block, n_blocks, n_items, text: a document's items (doc_id, nth, text) packed in order into blocks for one call each."""
    listed = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("items"))
    groups = packed(F.transform("items", lambda x: x["text"]), 1 << 30, chars, cut=True)
    made = listed.select("doc_id", F.size("items").alias("n_items"), F.size(groups).alias("n_blocks"), F.posexplode(groups).alias("block", "lines"))
    return made.select("doc_id", "block", "n_blocks", "n_items", F.array_join("lines", "\n").alias("text"))


def tree_summaries(items: DataFrame, answers: DataFrame, chars: int = BLOCK, budget: int = 4000, levels: int = LEVELS) -> DataFrame:
    """doc_id, summary, calls, levels, error of each document: its items are packed into blocks, each block's answer (answers: doc_id, level,
    block, text; null or missing: the call failed) is an item of the next level, until one block is left, whose answer,
    cut to the budget at a sentence's end, is the summary.

    A level is one aggregate and one join; a block whose call failed is dropped, a level without any answer, or a
    failed last call, ends in an error. The loop goes on while a document has several blocks, which their sizes say."""
    now = items.select("doc_id", F.col("nth").cast("int").alias("nth"), stripped("text").alias("text")).where("text != ''").withColumn("calls", F.lit(0))
    done = None
    for level in range(levels):
        told = answers.where(F.col("level") == level).select("doc_id", "block", F.col("text").alias("answer"))
        before = now.groupBy("doc_id").agg(F.max("calls").alias("before"))
        got = blocks(now, chars).join(told, ["doc_id", "block"], "left").join(before, "doc_id").withColumn("calls", (F.col("before") + F.col("n_blocks")).cast("int"))
        ends = got.groupBy("doc_id").agg(F.max("n_blocks").alias("n"), F.max("calls").alias("calls"), F.count("answer").alias("ok"), F.max("answer").alias("answer"))
        cut = within_budget(F.col("answer"), budget)
        why = F.when((F.col("n") == 1) & (F.col("ok") == 0), "the last call failed").when(F.col("ok") == 0, f"every call of level {level} failed")
        last = level == levels - 1
        why = why.when(F.col("n") > 1, "the summaries do not come down to one") if last else why
        why = why.when(cut.isNull(), "no sentence fits the budget")
        over = ends if last else ends.where("n = 1 or ok = 0")
        over = over.select("doc_id", why.alias("error"), F.when(F.col("n") == 1, cut).alias("summary"), "calls", F.lit(level + 1).alias("levels"))
        done = over if done is None else done.unionByName(over)
        now = got.where("n_blocks > 1 and answer is not null").select("doc_id", F.col("block").alias("nth"), F.col("answer").alias("text"), "calls")
        if last or now.isEmpty():
            break
    return done.select("doc_id", "summary", "calls", "levels", "error")


def summaries_by_mode(pages: DataFrame, mode: str, answers: DataFrame | None = None, budget: int = 4000, contract: str = "v0.5") -> DataFrame:
    """doc_id, summary, mode_used of each document of pages (see document_summaries(); pages that were extracted).

    A document of one page keeps that page's summary. off: none. deterministic: composed. contract_sos: by a tree of model
    calls over the answers, and composed where that fails; under v0.5 the modes with a prompt of their own are that as well."""
    told = pages.select("doc_id", "page", stripped(F.coalesce("summary", F.lit(""))).alias("summary"), "types")
    own = told.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("summary").alias("one"))
    mode = "contract_sos" if contract == "v0.5" and mode in ("model", "summary_of_summaries") else mode
    none = F.lit(None).cast("string")
    if mode == "off":
        rest = own.select("doc_id", none.alias("summary"), F.lit("off").alias("used"))
    elif mode in ("deterministic", "contract_sos"):
        rest = document_summaries(told, budget).select("doc_id", "summary", F.when(F.col("summary").isNotNull(), "deterministic").otherwise("none").alias("used"))
        if mode == "contract_sos":
            lines = told.select("doc_id", "page", F.posexplode(F.split("summary", "\n")).alias("k", "text"))
            items = lines.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "k")).alias("nth"), "text")
            tree = tree_summaries(items, answers, budget=budget).select("doc_id", F.col("summary").alias("tree"))
            both = rest.join(tree, "doc_id", "left")
            fell = F.when(F.col("summary").isNotNull(), "deterministic_fallback").otherwise("none")
            rest = both.select("doc_id", F.coalesce("tree", "summary").alias("summary"), F.when(F.col("tree").isNotNull(), "contract_sos").otherwise(fell).alias("used"))
    else:
        raise ValueError(f"mode {mode} needs a model call for each document")
    one = F.col("n") <= 1
    return own.join(rest, "doc_id", "left").select("doc_id", F.when(one, F.col("one")).otherwise(F.col("summary")).alias("summary"), F.when(one, "single_page").otherwise(F.col("used")).alias("mode_used"))
