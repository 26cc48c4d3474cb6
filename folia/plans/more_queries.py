"""Further queries with SQL: joins and aggregates that the document loops are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import columns as C
from folia.operators import document, quality
from folia.plans import convert
from folia.plans.native_queries import _tokens, TOKENS_SQL
from folia.sources.tables import FRAGMENTS_SQL, PAGE_RESULTS_SQL, fragments, page_results, table, turn_pages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RUNGS = "(CASE attempts WHEN 1 THEN 'none' WHEN 2 THEN 'reroll' ELSE 'fallback' END)"


@query(f"""SELECT doc_id, count_if(r = 'none') AS "none", count_if(r = 'reroll') AS reroll, count_if(r = 'retry_enforced') AS retry_enforced,
  count_if(r = 'retry_unenforced') AS retry_unenforced, count_if(r = 'fallback') AS fallback FROM (SELECT doc_id, {RUNGS} AS r FROM {PAGE_RESULTS_SQL}) GROUP BY doc_id""")
def rescue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = page_results(spark, sf_dir).withColumn("rung", F.when(F.col("attempts") == 1, "none").when(F.col("attempts") == 2, "reroll").otherwise("fallback"))
    return quality.rescued_by(r)


@query(f"SELECT doc_id, string_agg(seq || ':' || status, ',' ORDER BY seq) AS trail, sum(model_calls) AS calls FROM {PAGE_RESULTS_SQL} GROUP BY doc_id")
def page_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = quality.telemetry(page_results(spark, sf_dir))
    line = F.array_join(F.transform("pages", lambda p: F.concat(p["seq"].cast("string"), F.lit(":"), p["status"])), ",")
    return t.select("doc_id", line.alias("trail"), F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, p: a + p["attempts"]).alias("calls"))


@query(f"SELECT doc_id, seq, max(value) OVER (PARTITION BY doc_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS most FROM {PAGE_RESULTS_SQL}")
def running_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.running_most(page_results(spark, sf_dir), "value").select("doc_id", "seq", "most")


ATTEMPTS_SQL = f"""(SELECT doc_id, seq // 3 AS page, seq % 3 + 1 AS attempt, ['first', CASE WHEN doc_id % 2 = 0 THEN 'reroll' ELSE 'first' END, 'retry_enforced'][seq % 3 + 1] AS rung,
  CASE status WHEN 'ok' THEN 'ok' WHEN 'ok_coerced' THEN 'ok' WHEN 'degenerate' THEN 'degenerate' WHEN 'failed' THEN 'length' ELSE 'parse' END AS verdict,
  CASE WHEN status = 'degenerate' THEN 'repetition_abort' WHEN status = 'transport_error' THEN 'wall_clock_abort' WHEN status = 'failed' THEN 'length' ELSE 'stop' END AS finish,
  CAST(trunc(value) AS BIGINT) AS chars FROM {PAGE_RESULTS_SQL})"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three events of a user as a page's attempts: a first one, the same again, and a retry."""
    r = page_results(spark, sf_dir)
    s, at = F.col("status"), F.col("seq") % 3
    verdict = F.when(s.isin("ok", "ok_coerced"), "ok").when(s == "degenerate", "degenerate").when(s == "failed", "length").otherwise("parse")
    finish = F.when(s == "degenerate", "repetition_abort").when(s == "transport_error", "wall_clock_abort").when(s == "failed", "length").otherwise("stop")
    rung = F.when(at == 0, "first").when(at == 2, "retry_enforced").when(F.col("doc_id") % 2 == 0, "reroll").otherwise("first")
    chars = F.col("value").cast("bigint")
    return r.select(
        "doc_id", F.floor(F.col("seq") / 3).alias("page"), (at + 1).alias("attempt"), rung.alias("rung"), verdict.alias("verdict"), finish.alias("finish"),
        F.repeat(F.lit("c"), (chars * 100).cast("int")).alias("text"), chars.alias("chars"),
    )


@query(f"""
WITH a AS {ATTEMPTS_SQL}, same AS (SELECT * FROM a WHERE rung <> 'retry_enforced'), again AS (SELECT * FROM a WHERE rung = 'retry_enforced'),
g AS (SELECT doc_id, page, count(*) AS model_calls FROM a GROUP BY ALL),
good AS (SELECT doc_id, page, min(attempt) AS n, arg_min(rung, attempt) AS rung FROM same WHERE verdict = 'ok' GROUP BY ALL),
ends AS (SELECT doc_id, page, arg_min(finish, attempt) AS first_finish, arg_max(verdict, attempt) AS v, arg_max(finish, attempt) AS finish, arg_max(chars * 100, attempt) AS n FROM same GROUP BY ALL),
j AS (SELECT g.*, good.n AS good, good.rung AS good_rung, first_finish, ends.v, ends.finish AS same_finish, ends.n AS same_n, again.verdict AS rv, again.finish AS rf, again.chars AS rc
  FROM g LEFT JOIN good USING (doc_id, page) LEFT JOIN ends USING (doc_id, page) LEFT JOIN again USING (doc_id, page)),
s AS (SELECT *, CASE WHEN good IS NOT NULL THEN 'ok' WHEN first_finish = 'wall_clock_abort' THEN 'wall_clock_abort' WHEN rv = 'ok' AND rc < 300 AND rc < 0.02 * same_n THEN 'coerced_empty'
  WHEN rv = 'ok' THEN 'ok_coerced' WHEN v = 'length' THEN 'overlong_failed' WHEN v = 'degenerate' THEN 'degenerate' ELSE 'failed' END AS status FROM j)
SELECT doc_id, page, status, model_calls, CASE WHEN status = 'ok' AND good_rung = 'reroll' THEN 'reroll' WHEN status = 'ok_coerced' THEN 'retry_enforced' ELSE 'none' END AS rescued_by,
  CAST(CASE status WHEN 'ok' THEN good WHEN 'wall_clock_abort' THEN 1 ELSE 2 END AS INT) AS attempts, status IN ('ok_coerced', 'coerced_empty') AS schema_coerced,
  status NOT IN ('ok', 'wall_clock_abort') AND (coalesce(v = 'degenerate', false) OR coalesce(rv = 'degenerate', false)) AS degenerate,
  status NOT IN ('ok', 'wall_clock_abort') AND (coalesce(same_finish = 'repetition_abort', false) OR coalesce(rf = 'repetition_abort', false)) AS repetition_abort FROM s
""")
def attempt_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_ok(_attempts(spark, sf_dir)).drop("text")


@query(f"""
WITH a AS {ATTEMPTS_SQL}, p AS (SELECT doc_id, page, arg_min(verdict, attempt) AS v, count(*) AS n FROM a GROUP BY ALL)
SELECT doc_id, page, CASE WHEN v = 'ok' THEN 'ok' WHEN page % 3 = 0 THEN 'fallback_ok' ELSE 'failed' END AS status,
  CASE WHEN v <> 'ok' AND page % 3 = 0 THEN 'fallback' ELSE 'none' END AS rescued_by, n + CASE WHEN v <> 'ok' AND page % 3 = 0 THEN 1 ELSE 0 END AS model_calls FROM p
""")
def fallback_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _attempts(spark, sf_dir).groupBy("doc_id", "page").agg(F.min_by("verdict", "attempt").alias("v"), F.count("*").alias("model_calls"))
    results = a.select("doc_id", "page", F.when(F.col("v") == "ok", "ok").otherwise("failed").alias("status"), F.lit("none").alias("rescued_by"), "model_calls", F.lit(None).cast("string").alias("text"))
    others = a.select("doc_id", "page", F.when(F.col("page") % 3 == 0, "{}").alias("text"))
    return quality.with_fallback(results, others).drop("text")


@query(f"""
WITH p AS (SELECT doc_id, seq % 5 AS page, ts, seq, value FROM {PAGE_RESULTS_SQL}), f AS (SELECT *, min(ts) OVER (PARTITION BY doc_id, page) AS began FROM p),
l AS (SELECT *, epoch_us(ts) - epoch_us(began) > 86400000000 AS late FROM f)
SELECT doc_id, page, min(ts) FILTER (WHERE late) AS stopped, CAST(sum(CASE WHEN late THEN 0 ELSE CAST(trunc(value) AS INT) % 50 END) AS BIGINT) AS chars FROM l GROUP BY ALL HAVING count_if(late) > 0
""")
def wall_clock_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_results(spark, sf_dir).select("doc_id", (F.col("seq") % 5).alias("page"), "ts", F.repeat(F.lit("x"), F.col("value").cast("int") % 50).alias("piece"))
    return quality.wall_clock(p, 86_400, ("doc_id", "page"))


@query("""
WITH d AS (SELECT source, doc_id AS pos, length(text) AS chars, length(text) / 100.0::DOUBLE AS seconds FROM documents),
s AS (SELECT *, count(*) OVER w AS docs, coalesce(max(seconds) OVER w, 0) AS t, coalesce(max(chars) OVER w, 0) AS c FROM d
  WINDOW w AS (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, least(docs, 10) / 10.0::DOUBLE AS part, t * 1.5::DOUBLE AS lt, floor(c * 1.5::DOUBLE) AS lc FROM s),
x AS (SELECT *, CASE WHEN t <= 0 THEN 600 ELSE greatest(30, CASE WHEN part >= 1 THEN lt ELSE 600.0::DOUBLE + (lt - 600) * part END) END AS timeout,
  CAST(CASE WHEN c <= 0 THEN 10000 ELSE greatest(5000, floor(CASE WHEN part >= 1 THEN lc ELSE 10000.0::DOUBLE + (lc - 10000) * part END)) END AS INT) AS char_limit FROM l)
SELECT source, pos, CAST(timeout AS DOUBLE) AS timeout, char_limit, chars > char_limit AS "long", t > 0 AND seconds > t * 1.5::DOUBLE AS slow FROM x
""")
def page_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("order"), n.alias("chars"), (n / 100).alias("seconds"))
    return quality.page_limits(d, ("source",)).select("source", F.col("order").alias("pos"), "timeout", "char_limit", "long", "slow")


@query(f"""SELECT count(*) AS streams, count_if(u) AS with_usage, count_if(NOT u) AS without_usage, count_if(g = 'token_cap') AS token_cuts, count_if(g = 'length_cap') AS char_cuts,
  CASE WHEN count_if(u) > 0 AND count_if(NOT u) > 0 THEN 'mixed' WHEN count_if(u) > 0 THEN 'tokens' WHEN count_if(NOT u) > 0 THEN 'chars' ELSE 'unknown' END AS observed
FROM (SELECT attempts > 1 AS u, CASE status WHEN 'degenerate' THEN 'token_cap' WHEN 'failed' THEN 'length_cap' END AS g FROM {PAGE_RESULTS_SQL})""")
def runaway_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    guard = F.when(F.col("status") == "degenerate", "token_cap").when(F.col("status") == "failed", "length_cap")
    return quality.stream_counters(page_results(spark, sf_dir).select((F.col("attempts") > 1).alias("usage"), guard.alias("guard")))


@query(f"""SELECT doc_id, seq, CAST(5 + floor(80.0::DOUBLE * done / total) AS INT) AS percent FROM (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY ts, seq) AS done,
  count(*) OVER (PARTITION BY doc_id) AS total FROM {PAGE_RESULTS_SQL})""")
def page_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    line = Window.partitionBy("doc_id")
    r = page_results(spark, sf_dir).withColumn("done", F.row_number().over(line.orderBy("ts", "seq"))).withColumn("total", F.count("*").over(line))
    return r.select("doc_id", "seq", quality.progress(F.col("done"), F.col("total")).alias("percent"))


@query(f"""WITH {TOKENS_SQL}, f AS (SELECT doc_id, token, CASE WHEN length(token) % 2 = 0 THEN 'title' ELSE 'content' END AS w, length(token) AS seq FROM out_),
m AS (SELECT doc_id, token, count(DISTINCT w) AS fields, arg_min(w, seq) AS first_in, min(seq) AS pos FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, token) AS rank FROM m)
SELECT doc_id, token, fields, first_in, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def fidelity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _tokens(spark, sf_dir)[1]
    t = out.withColumn("where", F.when(F.length("token") % 2 == 0, "title").otherwise("content")).withColumn("seq", F.length("token"))
    return quality.flags(t, 5)


@query(f"SELECT doc_id, seq FROM {PAGE_RESULTS_SQL} WHERE NOT (status = 'degenerate' AND attempts = 1)")
def figure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = page_results(spark, sf_dir).withColumn("figure_id", F.col("seq"))
    verdicts = r.select("figure_id", F.when((F.col("status") == "degenerate") & (F.col("attempts") == 1), "artifact").otherwise("figure").alias("verdict"))
    return quality.without_artifacts(r.select("figure_id", "doc_id", "seq"), verdicts).select("doc_id", "seq")


@query("""SELECT f.conv_id AS doc_id, f.turn FROM conversations f WHERE NOT EXISTS
  (SELECT 1 FROM conversations p WHERE p.conv_id = f.conv_id AND p.turn + 1 = CASE WHEN f.turn % 5 = 4 THEN NULL ELSE f.turn * 2 END)""")
def orphan_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turn_pages(spark, sf_dir)
    turn = F.col("page") - 1
    f = t.select("doc_id", turn.alias("turn"), F.when(turn % 5 != 4, turn * 2).alias("page"))
    return document.orphans(f, t).select("doc_id", "turn")


@query("""SELECT DISTINCT conv_id AS doc_id, p AS page FROM (SELECT conv_id, unnest([turn + 1, turn + 2]) AS p FROM conversations WHERE role = 'user')""")
def overview_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turn_pages(spark, sf_dir)
    chunks = t.select("doc_id", F.array(F.col("page"), F.col("page") + 1).alias("pages"), F.when(F.col("role") == "user", "introduction").otherwise("body").alias("section_type"))
    return document.pages_tagged(chunks, ["abstract", "introduction", "conclusion"])


@query("""SELECT conv_id AS doc_id, turn + 1 AS page, CAST(coalesce(sum(length(text) % 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first
FROM conversations""")
def image_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turn_pages(spark, sf_dir).select("doc_id", "page", (F.length("text") % 4).cast("bigint").alias("n"))
    return document.global_numbers(t).select("doc_id", "page", "first")


CELLS_SQL = "(SELECT s_nationkey AS sheet, CAST(s_suppkey % 30 AS INT) AS r, CAST(s_suppkey // 30 AS INT) AS c, s_suppkey AS v FROM supplier)"


@query(f"""
WITH cells AS (SELECT sheet, r, c, min(v) AS v FROM {CELLS_SQL} GROUP BY ALL), m AS (SELECT sheet, r AS r1, c AS c1, r + 1 AS r2, c + 1 AS c2, v FROM cells WHERE v % 7 = 0),
o AS (SELECT sheet, r1 + dr AS r, c1 + dc AS c, min(v) AS v FROM m, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc) GROUP BY ALL)
SELECT coalesce(o.sheet, cells.sheet) AS sheet, coalesce(o.r, cells.r) AS r, coalesce(o.c, cells.c) AS c, coalesce(o.v, cells.v) AS v FROM cells FULL JOIN o ON cells.sheet = o.sheet AND cells.r = o.r AND cells.c = o.c
""")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    cells = s.groupBy(F.col("s_nationkey").alias("sheet"), (F.col("s_suppkey") % 30).cast("int").alias("r"), F.floor(F.col("s_suppkey") / 30).cast("int").alias("c")).agg(F.min("s_suppkey").alias("v"))
    ranges = cells.where("v % 7 = 0").select("sheet", F.col("r").alias("r1"), F.col("c").alias("c1"), (F.col("r") + 1).alias("r2"), (F.col("c") + 1).alias("c2"))
    return document.merged_cells(cells, ranges).groupBy("sheet", "r", "c").agg(F.min("v").alias("v"))


@query("SELECT l_returnflag AS flag, median(l_quantity) AS median, quantile_disc(l_quantity, 0.5) AS low FROM lineitem GROUP BY l_returnflag")
def glyph_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    return g.agg(F.median("l_quantity").alias("median"), F.expr("percentile_disc(0.5) within group (order by l_quantity)").alias("low"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS example FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c)
SELECT source, lang, n, example FROM r WHERE k <= 2
""")
def replay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang"))
    return c.withColumn("k", k).where("k <= 2").drop("k")


@query(r"""SELECT doc_id, CASE WHEN f + s + c < 2 THEN 'keep' WHEN f >= s AND f >= c THEN 'footnote' WHEN s >= c THEN 'raised' ELSE 'caret' END AS style FROM
(SELECT doc_id, len(regexp_extract_all(t, '\[\^\d+\]')) - len(regexp_extract_all(t, '\[\^\d+\]:')) AS f, len(regexp_extract_all(t, '<sup>\d[\d,\s]*</sup>')) AS s, len(regexp_extract_all(t, '\^\d+\^')) AS c
FROM (SELECT doc_id, concat(repeat('a[^1] ', CAST(doc_id % 3 AS INT)), repeat('b<sup>1,2</sup> ', CAST(doc_id % 4 AS INT)), repeat('c^3^ ', CAST(doc_id % 5 AS INT)), '[^9]: x ', text) AS t FROM documents))""")
def citation_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda s, k: F.repeat(F.lit(s), (F.col("doc_id") % k).cast("int"))
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(part("a[^1] ", 3), part("b<sup>1,2</sup> ", 4), part("c^3^ ", 5), F.lit("[^9]: x "), "text").alias("t"))
    return t.select("doc_id", C.citation_style(F.col("t")).alias("style"))


@query(f"""SELECT doc_id, page, greatest(x0 - 40, 0) AS l, greatest(y0 - 40, 0) AS u, least(x1 + 40, 1000) AS r, least(y1 + 40, 1000) AS b, h - y0 AS flipped, CAST(trunc(x0 * 200 / 72) AS INT) AS px,
least(200 / 72, 6000.0::DOUBLE / greatest(w, h)) AS scale FROM {FRAGMENTS_SQL}""")
def box_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir)
    pad = C.padded(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return f.select(
        "doc_id", "page", *[c.alias(n) for c, n in zip(pad, "lurb", strict=True)], C.flipped(F.col("y0"), F.col("h")).alias("flipped"),
        C.point_pixels(F.col("x0"), F.lit(200)).alias("px"), C.clamped_scale(F.col("w"), F.col("h"), F.lit(200)).alias("scale"),
    )


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE '…' || right(text, 299) END AS tail, CAST(greatest(2048, least(CAST(trunc(length(text) // 4 * 2.5) AS INT), 5000)) AS INT) AS cap FROM documents""")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.last_part(F.col("text"), 300).alias("tail"), C.chunk_cap(F.col("text"), 5000).alias("cap"))


@query("SELECT doc_id, left(sha256(encode(CAST(strlen(text) AS VARCHAR)) || CAST(array_slice(encode(text), 1, 65536) AS BLOB)), 16) AS run_id FROM documents")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    named = F.concat(F.encode(F.length(raw).cast("string"), "UTF-8"), F.substring(raw, 1, 65536))
    return table(spark, sf_dir, "documents").select("doc_id", C.doc_hash(named).alias("run_id"))


@query()
def convert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of model completions, through gate, ladder, assembly, summary and rendering."""
    t = turn_pages(spark, sf_dir)
    kind = F.when(F.col("role") == "user", "introduction").otherwise("body")
    body = F.to_json(F.struct(
        F.struct(
            F.when(F.col("page") > 1, F.substring("text", 1, 20)).alias("title"), F.array().cast("array<string>").alias("authors"), F.lit(None).cast("string").alias("organization"),
            F.lit(None).cast("string").alias("year"), F.col("role").alias("doc_type"),
        ).alias("metadata"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("summary"), F.array(F.struct(F.col("text").alias("content"), F.col("role").alias("title"), kind.alias("section_type"))).alias("semantic_chunks"),
        F.expr("array() as figures"), F.expr("array(named_struct('bbox', array(0, 10, 500, 900), 'caption', null, 'html', '<table></table>', 'description', null)) as tables"),
    ), {"ignoreNullFields": "false"})
    c = t.select("doc_id", "page", body.alias("text")).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    broken = (F.col("attempt") == 1) & (F.col("page") % 2 == 0)
    c = c.select(
        "doc_id", "page", "attempt", F.when(F.col("attempt") == 1, "first").otherwise("retry_enforced").alias("rung"),
        F.when(broken, F.expr("left(text, 40)")).otherwise(F.col("text")).alias("text"), F.lit("stop").alias("finish_reason"),
    )
    return convert.documents(convert.page_results(c), 1000)
