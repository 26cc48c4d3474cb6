"""Health of page results: rates, histograms, streaks of errors, token checks against a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.columns import edit_budget, token_class

RESCUED = ["none", "reroll", "retry_enforced", "retry_unenforced", "fallback"]


#: Statuses of pages that went to the retry tier and failed there.
FAILED = ["failed", "degenerate", "overlong_failed", "empty_completion"]


def gate_metrics(results: DataFrame) -> DataFrame:
    """Counts and rates of each document's page results, in aggregates that tasks pre-aggregate: by bucket first, so that the
    buckets' histogram is a map of few entries.

    results: doc_id, status; optionally schema_coerced, degenerate, repetition_abort, json_close (what a page's attempts
    were) and bucket; without them the status says what it can."""
    has = set(results.columns)
    status = F.col("status")

    def flag(name, else_):
        return F.coalesce(F.col(name), F.lit(False)) if name in has else else_

    coerced = flag("schema_coerced", status.isin("ok_coerced", "coerced_empty"))
    rows = results.select(
        "doc_id", (F.col("bucket") if "bucket" in has else F.lit(None).cast("string")).alias("bucket"), status.alias("status"), coerced.alias("coerced"),
        flag("degenerate", status == "degenerate").alias("looped"), flag("repetition_abort", F.lit(False)).alias("aborted"), flag("json_close", F.lit(False)).alias("closed"),
    )
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = {
        "pages": F.count("*"), "first_pass_ok": of("ok"), "schema_coerced": F.count_if("coerced"), "degenerate": F.count_if("looped"),
        "repetition_aborted": F.count_if("aborted"), "oversize_filtered": of("oversize"), "wall_clock_aborts": of("wall_clock_abort"),
        "coerced_empty": of("coerced_empty"), "fallback_pages": of("fallback_ok"), "empty_completions": of("empty_completion"),
        "json_close_stops": F.count_if("closed"), "overlong_failed": of("overlong_failed"), "retried": F.count_if(F.col("coerced") | F.col("status").isin(FAILED)),
    }
    by_bucket = rows.groupBy("doc_id", "bucket").agg(*[c.alias(n) for n, c in counts.items()])
    named = F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", F.col("pages").alias("n")))))
    whole = by_bucket.groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in counts], F.map_from_entries(named).alias("buckets"))
    rate = lambda k, n: F.bround(k / F.col(n), 4)
    return whole.select(
        "doc_id", *[n for n in counts if n != "retried"], "buckets", rate(F.col("pages") - F.col("first_pass_ok"), "pages").alias("first_pass_fail_rate"),
        rate(F.col("degenerate"), "pages").alias("degeneration_rate"), F.when(F.col("retried") > 0, rate(F.col("schema_coerced"), "retried")).alias("coerce_success_rate"),
    )


def histogram(results: DataFrame, value: str) -> DataFrame:
    return results.where(F.col(value).isNotNull()).groupBy("doc_id", value).agg(F.count("*").alias("n"))


def streaks(results: DataFrame, bad: str, least: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Runs of at least `least` results of one status in a row, by order of ts and seq."""
    line = Window.partitionBy(*keys).orderBy("ts", "seq")
    marked = results.withColumn("good", F.sum(F.when(F.col("status") == bad, 0).otherwise(1)).over(line))
    runs = marked.where(F.col("status") == bad).groupBy(*keys, "good").agg(
        F.count("*").alias("length"), F.min("seq").alias("first_seq"), F.min("ts").alias("since"), F.max("ts").alias("until")
    )
    return runs.where(F.col("length") >= least).drop("good")


def recent_errors(results: DataFrame, bad: str, seconds: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each result, the results of that status of its document in the seconds up to it."""
    line = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return results.withColumn("recent", F.count_if(F.col("status") == bad).over(line))


def first_ok(attempts: DataFrame, least_chars: int = 300, least_share: float = 0.02, ink: float = 0.0048) -> DataFrame:
    """One result for each page of attempts: doc_id, page, attempt, rung, verdict, text; optionally finish, chars (the content
    of a parsed attempt) and ink (the share of dark pixels of its page).

    Rungs are "first", "reroll" (the same request again after a loop was stopped) and "retry_enforced" or
    "retry_unenforced". An ok of the first two is ok; of a retry ok_coerced, or coerced_empty if it says hardly anything
    after a long text of the same request, unless the page is nearly blank. A first attempt that ran out of wall
    clock is not retried. Else the last attempt of the same request names the failure. max_by and min_by keep
    this an aggregate without a sort.

    Returns doc_id, page, status, rescued_by, attempts (2 for all that was retried), model_calls, schema_coerced, degenerate,
    repetition_abort, text (of pages that are ok).
    """
    has = set(attempts.columns)
    or_null = lambda n, kind: (F.col(n) if n in has else F.lit(None)).cast(kind).alias(n)
    a = attempts.select(
        "doc_id", "page", "attempt", "rung", "verdict", "text", F.length("text").alias("n"), or_null("finish", "string"), or_null("chars", "bigint"), or_null("ink", "double"),
    )
    retry, ok, row = F.col("rung").startswith("retry"), F.col("verdict") == "ok", F.struct("attempt", "rung", "verdict", "finish", "text", "n", "chars")
    pick = lambda f, when: f(F.when(when, row), F.when(when, F.col("attempt")))
    got = a.groupBy("doc_id", "page").agg(
        pick(F.min_by, ~retry & ok).alias("good"), pick(F.max_by, ~retry).alias("same"), pick(F.min_by, ~retry).alias("first"), pick(F.max_by, retry).alias("retry"),
        F.count("*").alias("model_calls"), F.max("ink").alias("ink"),
    )
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    good, clock, rescued = F.col("good").isNotNull(), is_("first.finish", "wall_clock_abort"), is_("retry.verdict", "ok")
    hardly = (F.col("retry.chars") < least_chars) & (F.col("retry.chars") < least_share * F.col("same.n")) & ~F.coalesce(F.col("ink") < ink, F.lit(False))
    status = (
        F.when(good, "ok").when(clock, "wall_clock_abort").when(rescued & F.coalesce(hardly, F.lit(False)), "coerced_empty").when(rescued, "ok_coerced")
        .when(is_("same.verdict", "length"), "overlong_failed").when(is_("same.verdict", "degenerate"), "degenerate").when(is_("same.verdict", "empty"), "empty_completion")
        .otherwise("failed")
    )
    s, retried = F.col("status"), ~F.col("status").isin("ok", "wall_clock_abort")
    return got.withColumn("status", status).select(
        "doc_id", "page", "status",
        F.when((s == "ok") & is_("good.rung", "reroll"), "reroll").when(s == "ok_coerced", F.col("retry.rung")).otherwise("none").alias("rescued_by"),
        F.when(s == "ok", F.col("good.attempt")).when(retried, 2).otherwise(1).cast("int").alias("attempts"), "model_calls",
        s.isin("ok_coerced", "coerced_empty").alias("schema_coerced"),
        (retried & (is_("same.verdict", "degenerate") | ~rescued & is_("retry.verdict", "degenerate"))).alias("degenerate"),
        (retried & (is_("same.finish", "repetition_abort") | is_("retry.finish", "repetition_abort"))).alias("repetition_abort"),
        F.when(s == "ok", F.col("good.text")).when(s == "ok_coerced", F.col("retry.text")).alias("text"),
    )


def with_fallback(results: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Results in which a fallback model's page stands for a failed one. fallbacks: doc_id, page, text (null where the model did not
    rescue it: see completions.fallback_page()). Pages that are ok stay as they are, whatever it says."""
    known = fallbacks.where("text is not null").select("doc_id", "page", F.col("text").alias("other"))
    both = results.join(known, ["doc_id", "page"], "left")
    use = F.col("other").isNotNull() & ~F.col("status").isin("ok", "ok_coerced")
    swap = {"status": F.lit("fallback_ok"), "rescued_by": F.lit("fallback"), "model_calls": F.col("model_calls") + 1, "text": F.col("other")}
    return both.select(*[F.when(use, swap[c]).otherwise(F.col(c)).alias(c) if c in swap else F.col(c) for c in results.columns])


def wall_clock(pieces: DataFrame, seconds: float, keys: tuple[str, ...] = ("doc_id", "page", "attempt")) -> DataFrame:
    """Streams that go on for longer than so many seconds after their first piece: keys, stopped (time of the piece that is too
    late), chars (of the pieces before it). pieces: keys, ts, piece. One window by stream without an order."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    began = pieces.withColumn("late", at - F.min(at).over(Window.partitionBy(*keys)) > int(seconds * 1_000_000))
    ended = began.groupBy(*keys).agg(F.min(F.when(F.col("late"), F.col("ts"))).alias("stopped"), F.sum(F.when(~F.col("late"), F.length("piece")).otherwise(0)).alias("chars"))
    return ended.where("stopped is not null")


#: Limits before a document has been seen, the margin over what was seen, documents until that counts in full.
START_SECONDS, START_CHARS, MARGIN, RAMP = 600.0, 10_000, 1.5, 10


def page_limits(documents: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each document (order, seconds, chars: the largest of its pages) the limits that held when it came: timeout and
    char_limit go from generous ones to those learned from the documents before it, and whether it exceeded them.

    keys split the line of documents (by server, say); without them one task goes through all."""
    line = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    seen = documents.withColumn("docs", F.count("*").over(line)).withColumn("t", F.coalesce(F.max("seconds").over(line), F.lit(0.0))).withColumn(
        "c", F.coalesce(F.max("chars").over(line), F.lit(0))
    )
    part = F.least(F.col("docs"), F.lit(RAMP)) / RAMP
    between = lambda start, learned: F.when(part >= 1, learned).otherwise(F.lit(float(start)) + (learned - start) * part)
    chars = F.floor(F.col("c") * MARGIN)
    timeout = F.when(F.col("t") <= 0, START_SECONDS).otherwise(F.greatest(F.lit(30.0), between(START_SECONDS, F.col("t") * MARGIN)))
    limit = F.when(F.col("c") <= 0, START_CHARS).otherwise(F.greatest(F.lit(5000), F.floor(between(START_CHARS, chars)).cast("int")))
    limited = seen.withColumn("timeout", timeout).withColumn("char_limit", limit.cast("int"))
    late = (F.col("t") > 0) & (F.col("seconds") > F.col("t") * MARGIN)
    return limited.select(*documents.columns, "timeout", "char_limit", (F.col("chars") > F.col("char_limit")).alias("long"), late.alias("slow"))


def stream_counters(streams: DataFrame) -> DataFrame:
    """One row over all streams (usage: whether the server told token counts; guard: what stopped it): how many had counts,
    which cut stopped them, and which cut the streams had: tokens, chars, mixed or unknown."""
    n = streams.agg(
        F.count("*").alias("streams"), F.count_if("usage").alias("with_usage"), F.count_if(~F.col("usage")).alias("without_usage"),
        F.count_if(F.col("guard") == "token_cap").alias("token_cuts"), F.count_if(F.col("guard") == "length_cap").alias("char_cuts"),
    )
    had = F.when((F.col("with_usage") > 0) & (F.col("without_usage") > 0), "mixed").when(F.col("with_usage") > 0, "tokens").when(F.col("without_usage") > 0, "chars")
    return n.withColumn("observed", had.otherwise("unknown"))


def progress(done: Column, total: Column) -> Column:
    """Percent of a document's pages: 5 before the first, 85 after the last."""
    return (F.lit(5) + F.floor(F.lit(80) * done / total)).cast("int")


def rescued_by(results: DataFrame, value: str = "rung", kinds: list[str] = RESCUED) -> DataFrame:
    """A column for each kind, zeros included."""
    return results.groupBy("doc_id").agg(*[F.count_if(F.col(value) == k).alias(k) for k in kinds])


def telemetry(results: DataFrame) -> DataFrame:
    """doc_id, pages: a document's results in order, as one array of structs."""
    return results.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "status", "attempts"))).alias("pages"))


def trails(attempts: DataFrame) -> DataFrame:
    """doc_id, page, trail: a page's calls in order: rung, verdict, finish, chars emitted."""
    call = F.struct("attempt", "rung", "verdict", "finish", F.length("text").alias("chars"))
    return attempts.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(call)).alias("trail"))


def health(results: DataFrame) -> DataFrame:
    """One row over all results: pages, documents, shares of failed pages and of pages that a fallback rescued, and documents
    whose last result (by ts) is a transport error."""
    bad = F.col("status").isin(*FAILED, "transport_error", "wall_clock_abort", "coerced_empty")
    per_doc = results.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(F.col("status") == "fallback_ok").alias("rescued"), F.max_by(F.struct("ts", "seq", "status"), F.struct("ts", "seq")).alias("last")
    )
    return per_doc.agg(
        F.sum("n").alias("pages"), F.count("*").alias("documents"), F.bround(F.sum("bad") / F.sum("n"), 4).alias("failed_share"), F.bround(F.sum("rescued") / F.sum("n"), 4).alias("rescued_share"),
        F.count_if(F.col("last.status") == "transport_error").alias("documents_down"),
    )


def flags(tokens: DataFrame, most: int = 100) -> DataFrame:
    """tokens: doc_id, seq, where, token. Each distinct token with its number of fields and its first one; per document
    the first `most` by order of appearance."""
    merged = tokens.groupBy("doc_id", "token").agg(F.count_distinct("where").alias("fields"), F.min_by("where", "seq").alias("first_in"), F.min("seq").alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "token"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= most).drop("at")


def running_most(results: DataFrame, value: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The largest value that each key has had up to each result."""
    line = Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("most", F.max(value).over(line))


def without_artifacts(figures: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Figures less those that a verdict calls artifacts; an error or a missing verdict keeps them."""
    return figures.join(verdicts.where("verdict = 'artifact'").select("figure_id"), "figure_id", "left_anti")


def verdict(finish, text_blank, ratio, parsed, schema_ok, gate: float = 7.0):
    """The gates over one completion, in their order: abort, cut off, empty, compressible, unparsable, off schema."""
    return (
        F.when(finish == "repetition_abort", "degenerate").when(finish == "length", "length").when(text_blank, "empty")
        .when(ratio > gate, "degenerate").when(~parsed, "parse").when(~schema_ok, "schema").otherwise("ok")
    )


def unknown_tokens(output: DataFrame, source: DataFrame) -> DataFrame:
    """(doc_id, token) of the output that its document's source does not have."""
    return output.join(source, ["doc_id", "token"], "left_anti")


def case_matches(unknown: DataFrame, source: DataFrame) -> DataFrame:
    """Unknown tokens that equal exactly one source token but for case: doc_id, token, closest."""
    alike = source.groupBy("doc_id", F.lower("token").alias("low")).agg(F.count_distinct("token").alias("n"), F.min("token").alias("closest"))
    return unknown.withColumn("low", F.lower("token")).join(alike.where("n = 1"), ["doc_id", "low"]).select("doc_id", "token", "closest")


def nearest_tokens(unknown: DataFrame, source: DataFrame) -> DataFrame:
    """doc_id, token, closest, distance, ambiguous: the source token of the same class within the edit budget; of
    several at the least distance the first in order, marked ambiguous.

    Candidates meet by deletion neighbourhoods instead of all pairs: two words at most d edits apart share a word
    that each gives by deleting at most d characters, so this is an equi-join on short keys."""

    def keyed(df, name):
        t = F.col("token")
        once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        one = F.array_distinct(F.concat(F.array(t), once(t)))
        two = F.array_distinct(F.concat(one, F.flatten(F.transform(F.filter(one, lambda w: F.length(w) > 0), once))))
        # a word of 6 to 8 letters may meet one of another budget, so all of up to two deletions are made from 5 on
        keys = F.when(F.length(t) >= 5, two).otherwise(one)
        return df.select("doc_id", t.alias(name), token_class(t).alias("cls"), F.explode(keys).alias("key"))

    pairs = keyed(unknown, "token_").join(keyed(source, "cand"), ["doc_id", "cls", "key"]).select("doc_id", "cls", F.col("token_").alias("token"), "cand").distinct()
    near = pairs.withColumn("distance", F.levenshtein("token", "cand")).where(F.col("distance") <= edit_budget(F.col("token")))
    best = near.groupBy("doc_id", "token").agg(F.min("distance").alias("distance"), F.min(F.struct("distance", "cand")).alias("b"), F.collect_set(F.struct("distance", "cand")).alias("all"))
    ties = F.size(F.filter("all", lambda x: x["distance"] == F.col("distance"))) > 1
    return best.select("doc_id", "token", F.col("b.cand").alias("closest"), "distance", ties.alias("ambiguous"))


def guard_report(compared: DataFrame) -> DataFrame:
    """compared: label, old, new (which guard stopped a text, null for none). label, old, new, n, and of each label in all how many
    only one of the two stopped. A text that is labelled clean and stopped is a false alarm, a loop that is not is a miss."""
    none = lambda c: F.coalesce(F.col(c), F.lit("-")).alias(c)
    n = compared.select("label", none("old"), none("new")).groupBy("label", "old", "new").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("label")
    only = lambda a, b: F.sum(F.when((F.col(a) != "-") & (F.col(b) == "-"), F.col("n")).otherwise(0)).over(whole)
    return n.withColumn("old_only", only("old", "new")).withColumn("new_only", only("new", "old"))
