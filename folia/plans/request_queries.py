"""Requests, rejects, figures, responses and summary trees over the driver's tables; each stands under its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import arrow, prompts
from folia.functions import columns as C
from folia.operators import assembly, document, pages, quality, summary, tables
from folia.plans.python_queries import _pieces
from folia.sources.tables import FRAGMENTS_SQL, PAGE_RESULTS_SQL, fragments, page_results, table, turn_pages
from folia.streaming import stateful
from folia.streaming.guards import Limits

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PROMPT_SQL = """octet_length(encode('<|start_of_role|>system<|end_of_role|>structured_extraction<|end_of_text|>' || chr(10) || '<|start_of_role|>user<|end_of_role|>        ' || text
  || '<|end_of_text|>' || chr(10) || '<|start_of_role|>assistant<|end_of_role|>'))"""


@query(f"SELECT doc_id, tokens, CAST(CASE WHEN 30000 - tokens >= 1 THEN least(30000 - tokens, 20000) END AS INT) AS max_tokens FROM (SELECT doc_id, {PROMPT_SQL} AS tokens FROM documents)")
def prompt_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", prompts.text_prompt_tokens(prompts.EXTRACT, F.col("text")).cast("bigint").alias("tokens"))
    return d.select("doc_id", "tokens", prompts.plan(F.col("tokens"), 20_000).alias("max_tokens"))


TAGS = {"te": "Read the tables.", "re": "Read it again."}


@query("""SELECT doc_id, CASE WHEN contains(t, '<te>') THEN 'te' WHEN contains(t, '<re>') THEN 're' END AS tag,
  md5(CASE WHEN contains(t, '<te>') THEN CASE WHEN NOT contains(t, '<image>') THEN 'Read the tables.' WHEN instr(t, '<image>') < instr(t, '<te>') THEN '<image>' || chr(10) || 'Read the tables.' ELSE 'Read the tables.<image>' || chr(10) END
    WHEN contains(t, '<re>') THEN CASE WHEN NOT contains(t, '<image>') THEN 'Read it again.' WHEN instr(t, '<image>') < instr(t, '<re>') THEN '<image>' || chr(10) || 'Read it again.' ELSE 'Read it again.<image>' || chr(10) END ELSE t END) AS md5
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<image>' ELSE '' END || replace(text, ' re', ' <re>') || CASE doc_id % 3 WHEN 0 THEN '<te>' ELSE '' END || CASE doc_id % 7 WHEN 0 THEN '<image>' ELSE '' END AS t FROM documents)""")
def template_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = lambda s, k: F.when(F.col("doc_id") % k == 0, s).otherwise("")
    t = F.concat(put("<image>", 5), F.replace("text", F.lit(" re"), F.lit(" <re>")), put("<te>", 3), put("<image>", 7))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", prompts.template_tag(F.col("t"), list(TAGS)).alias("tag"), F.md5(prompts.expanded(F.col("t"), TAGS)).alias("md5"))


@query("""SELECT conv_id, turn, '[{"role":"system","content":"structured_extraction"},{"role":"user","content":[' || CAST(json_object('type', 'text', 'text', text) AS VARCHAR) || ']}]' AS messages FROM conversations""")
def text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.text_messages(F.col("text")).alias("messages"))


@query()
def input_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of requests and the seeds of two attempts with them."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.input_key(prompts.text_messages(F.col("text"))).alias("key"))
    return d.select("conv_id", "turn", "key", *[prompts.seed(F.col("key"), F.lit(k), 0.4).alias(f"seed{k}") for k in (0, 1)])


@query("""SELECT * FROM (VALUES ('plain', 'transcribe', 0.7::DOUBLE, '{"presence_penalty": 1.5, "top_k": 20, "top_p": 0.8}'), ('plain', 'classify_figure', 0.7, '{"presence_penalty": 1.5, "top_k": 20, "top_p": 0.8}'),
  ('plain', 'structured', 0.7, '{"presence_penalty": 1.5, "top_k": 20, "top_p": 0.8}'), ('plain', 'structured_page', 0.0, '{"presence_penalty": 0.3}'),
  ('qwen3.5-2b', 'transcribe', 0.7, '{"chat_template_kwargs": {"enable_thinking": false}, "presence_penalty": 1.5, "reasoning": {"enabled": false}, "top_k": 20, "top_p": 0.8}'),
  ('qwen3.5-2b', 'classify_figure', 0.7, '{"chat_template_kwargs": {"enable_thinking": false}, "presence_penalty": 1.5, "reasoning": {"enabled": false}, "top_k": 20, "top_p": 0.8}'),
  ('qwen3.5-2b', 'structured', 0.7, '{"chat_template_kwargs": {"enable_thinking": false}, "presence_penalty": 1.5, "reasoning": {"enabled": false}, "top_k": 20, "top_p": 0.8}'),
  ('qwen3.5-2b', 'structured_page', 0.0, '{"presence_penalty": 0.3}')) t(model, stage, temperature, extra)""")
def stage_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.parameter_table(spark, ["plain", "qwen3.5-2b"])


@query("""SELECT doc_id, CASE WHEN n > 1500 THEN n || ' chars (~' || CAST(floor(n / 3.5::DOUBLE) AS BIGINT) || ' tok) exceeds the 1500-char text-page bound' WHEN b > 1520 THEN b || ' tokens exceeds the 1520-token text-page bound' END AS error,
  CASE WHEN n > 1500 OR b > 1520 THEN 'oversize' END AS status FROM (SELECT doc_id, length(text) AS n, octet_length(encode(text)) AS b FROM documents)""")
def oversize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.oversize(table(spark, sf_dir, "documents"), 1500, 1520).select("doc_id", "error", "status")


@query(f"""SELECT doc_id, page, count(*) AS figures, count_if(cols > 0 AND x1 % 3 > 0 AND page <> 2 AND page <> 3) AS checkable,
  count_if(cols <> 1 AND h % 100 / 100.0::DOUBLE >= 0.5 AND (x1 - x0) * y1 / 400000.0::DOUBLE <= 0.9) AS detected FROM {FRAGMENTS_SQL} GROUP BY ALL""")
def figure_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir)
    key = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("page") == 2, "_pagefail").when(F.col("page") == 3, "_embedded_1").otherwise("_p"))
    ok = C.checkable(key, F.when(F.col("cols") > 0, "crop.png"), F.when(F.col("x1") % 3 > 0, F.array(F.lit(0))))
    seen = C.detected(F.when(F.col("cols") != 1, "Picture").otherwise("Text"), F.col("h") % 100 / 100, (F.col("x1") - F.col("x0")) * F.col("y1"), F.lit(400_000))
    return f.groupBy("doc_id", "page").agg(F.count("*").alias("figures"), F.count_if(ok).alias("checkable"), F.count_if(seen).alias("detected"))


@query("""SELECT page_id, n, CASE WHEN a >= greatest(b, c) AND n > 0 THEN 'new' ELSE 'joined' END AS taken FROM (SELECT page_id, page_id % 4 AS n, page_id % 4 AS a, page_id % 3 AS b, page_id % 2 AS c FROM pages)""")
def refined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda k: F.repeat(F.lit("<tr><td>x</td></tr>"), (F.col("page_id") % k).cast("int"))
    made = F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("<table>"), rows(4), F.lit("</table>"))).otherwise("")
    p = table(spark, sf_dir, "pages").select("page_id", made.alias("new"), rows(3).alias("a"), rows(2).alias("b"))
    took = C.refined(F.col("new"), F.col("a"), F.col("b"), F.lit("joined"))
    return p.select("page_id", C.row_count(F.col("new")).cast("bigint").alias("n"), F.when(took == "joined", "joined").otherwise("new").alias("taken"))


@query("""SELECT source AS doc_id, key AS figure_id, count(*) AS n FROM (SELECT source, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE 'f' || (doc_id // 2 + doc_id % 3) END AS key FROM documents) GROUP BY ALL HAVING key IS NULL OR count(*) > 1""")
def figure_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("doc_id") % 50 == 0, F.lit("")).otherwise(F.concat(F.lit("f"), (F.floor(F.col("doc_id") / 2) + F.col("doc_id") % 3).cast("string")))
    return document.figure_defects(table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), key.alias("figure_id")))


@query("""WITH k AS (SELECT conv_id, turn, rtrim(regexp_replace(lower(trim(text, E' \\n\\t')), '\\s+', ' ', 'g'), '.') AS key FROM conversations WHERE turn % 2 = 0)
SELECT conv_id AS doc_id, 'c' || turn AS chunk_id FROM k WHERE key <> ''""")
def caption_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks; every second turn, with a dot, is a caption, and the others' contents are far from any."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    even = F.col("turn") % 2 == 0
    chunks = c.select("doc_id", F.concat(F.lit("c"), "turn").alias("chunk_id"), F.when(even, F.col("text")).otherwise(F.concat(F.lit("#" * 400), F.repeat("text", 3))).alias("content"), F.lit(None).cast("string").alias("title"))
    return tables.caption_chunks(c.where(even).select("doc_id", F.concat("text", F.lit(".")).alias("caption")), chunks)


@query("""WITH n AS (SELECT conv_id AS doc_id, count(*) AS pages, min(text) AS text FROM conversations GROUP BY ALL)
SELECT doc_id, CAST(json_object('markdown', text, 'images', json('[]'), 'processing_log', json_object('total_pages', pages, 'total_figures', 0, 'total_time_seconds', 0.5::DOUBLE, 'modality', 'image')) AS VARCHAR) AS json
FROM n WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, CAST(json_object('markdown', text, 'images', json('[]'), 'processing_log', json_object('total_pages', pages, 'total_figures', 0, 'total_time_seconds', 0.5::DOUBLE, 'modality', 'image'),
  'metadata', json_object('id', doc_id), 'summary', text, 'semantic_chunks', json('[]'), 'tables', json('[]')) AS VARCHAR) FROM n WHERE doc_id % 2 = 1""")
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("total_pages"), F.min("text").alias("markdown"))
    own = F.to_json(F.struct(F.struct(F.col("doc_id").alias("id")).alias("metadata"), F.col("markdown").alias("summary"), F.expr("array() as semantic_chunks"), F.expr("array() as tables")))
    d = n.select("*", F.lit(0).alias("total_figures"), F.lit(0.5).alias("total_time_seconds"), F.lit("image").alias("modality"), F.lit("secret").alias("fidelity"), F.when(F.col("doc_id") % 2 == 1, own).alias("structured"))
    return document.response(d)


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "text"))


@query()
def summary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as page summaries in blocks of 400 characters; a block's answer says its number, and every seventh call fails."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    n = F.greatest(F.ceil(F.length("text") / 100).cast("int"), F.lit(1))
    level = d.select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("level"), n.alias("n"))
    a = level.select("doc_id", "level", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("block"))
    said = F.concat(F.lit("Block "), F.col("block").cast("string"), F.lit(" of level "), F.col("level").cast("string"), F.lit("."))
    return summary.tree_summaries(_line_items(spark, sf_dir), a.withColumn("text", F.when((F.col("block") + F.col("level")) % 7 != 6, said)), 400, 60)


@query("""WITH n AS (SELECT conv_id AS doc_id, count(*) AS n, arg_min(trim(text, E' \\n\\t'), turn) AS one FROM conversations WHERE turn < 1 + conv_id % 3 GROUP BY ALL)
SELECT doc_id, CASE WHEN n <= 1 THEN one END AS summary, CASE WHEN n <= 1 THEN 'single_page' ELSE 'off' END AS mode_used FROM n""")
def summary_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turn_pages(spark, sf_dir).where(F.col("page") < 2 + F.col("doc_id") % 3).withColumnRenamed("text", "summary").withColumn("types", F.array().cast("array<string>"))
    return summary.summaries_by_mode(t, "off")


@query()
def summary_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of one call a document, of which every third fails and is composed instead."""
    t = turn_pages(spark, sf_dir).withColumnRenamed("text", "summary").withColumn("types", F.array(F.lit("abstract")))
    docs = t.select("doc_id").distinct()
    answers = docs.select("doc_id", F.lit(0).alias("level"), F.lit(0).alias("block"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("About "), F.col("doc_id").cast("string"), F.lit("."))).alias("text"))
    return summary.summaries_by_mode(t, "model", answers, 600)


@query(r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, E'\n')) AS line, unnest(range(0, len(string_split(text, E'\n')))) AS k FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, k, CASE WHEN k % 3 = 0 THEN '## ' || line ELSE line END AS line, CASE WHEN k % 3 = 0 THEN k // 3 END AS nth FROM l),
w AS (SELECT doc_id, list('## ' || line ORDER BY k) AS heads FROM l WHERE k % 3 = 0 GROUP BY doc_id),
r AS (SELECT doc_id, list_reduce(heads, lambda a, x: CASE
    WHEN a.n > 0 AND (a.n >= 24 OR a.used + length(x) + 1 > 1700) THEN {'out': list_append(a.out, a.w + 1), 'n': 1, 'used': length(x), 'w': a.w + 1}
    ELSE {'out': list_append(a.out, a.w), 'n': a.n + 1, 'used': a.used + length(x) + (CASE WHEN a.n > 0 THEN 1 ELSE 0 END), 'w': a.w} END,
  {'out': []::INTEGER[], 'n': 0, 'used': 0::BIGINT, 'w': 0}) AS a FROM w)
SELECT h.doc_id, md5(string_agg(CASE WHEN nth IS NOT NULL AND r.a.out[nth + 1] % 3 < 2 THEN '#' || h.line ELSE h.line END, E'\n' ORDER BY k)) AS md5 FROM h JOIN r ON h.doc_id = r.doc_id GROUP BY ALL
""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line as a heading; replies send them one level down, but every third window's reply drops its last line."""
    heads = F.transform(F.split("text", "\n"), lambda x, k: F.when(k % 3 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lit("c").alias("chunk"), F.lit(0).alias("nth"), F.array_join(heads, "\n").alias("content"))
    w = document.heading_windows(d)
    lines = F.transform("heads", lambda h: F.concat(F.lit("#"), h["line"]))
    sent = F.when(F.col("window") % 3 < 2, lines).otherwise(F.slice(lines, F.lit(1), F.size(lines) - 1))
    return document.heading_fix(d, w.select("doc_id", "window", F.array_join(sent, "\n").alias("text"))).select("doc_id", F.md5("content").alias("md5"))


@query(f"""SELECT doc_id, seq // 3 AS page, string_agg(CAST(seq % 3 + 1 AS VARCHAR) || ':' || status || ':' || CAST(trunc(value) AS INT), ' ' ORDER BY seq) AS trail FROM {PAGE_RESULTS_SQL} GROUP BY ALL""")
def attempt_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = page_results(spark, sf_dir).select(
        "doc_id", F.floor(F.col("seq") / 3).alias("page"), (F.col("seq") % 3 + 1).alias("attempt"), F.lit("first").alias("rung"), F.col("status").alias("verdict"), F.lit("stop").alias("finish"),
        F.repeat(F.lit("x"), F.col("value").cast("int")).alias("text"),
    )
    line = F.transform("trail", lambda c: F.concat(c["attempt"].cast("string"), F.lit(":"), c["verdict"], F.lit(":"), c["chars"].cast("string")))
    return quality.trails(a).select("doc_id", "page", F.array_join(line, " ").alias("trail"))


@query(f"""WITH r AS (SELECT doc_id, ts, seq, CASE WHEN status = 'failed' AND seq % 2 = 0 THEN 'fallback_ok' ELSE status END AS status FROM {PAGE_RESULTS_SQL}),
d AS (SELECT doc_id, count(*) AS n, count_if(status IN ('failed', 'degenerate', 'transport_error')) AS bad, count_if(status = 'fallback_ok') AS rescued, arg_max(status, (ts, seq)) AS last FROM r GROUP BY doc_id)
SELECT sum(n)::BIGINT AS pages, count(*) AS documents, round_even(sum(bad) / sum(n), 4) AS failed_share, round_even(sum(rescued) / sum(n), 4) AS rescued_share, count_if(last = 'transport_error') AS documents_down FROM d""")
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when((F.col("status") == "failed") & (F.col("seq") % 2 == 0), "fallback_ok").otherwise(F.col("status"))
    return quality.health(page_results(spark, sf_dir).withColumn("status", status))


@query()
def fallback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a foreign model's pages: with wrong types, stray tags, cut off, or empty."""
    t = turn_pages(spark, sf_dir)
    body = F.to_json(F.struct(
        F.lit("no object").alias("metadata"), F.col("text").alias("summary"),
        F.array(F.struct(F.lit(7).alias("chunk_id"), F.col("text").alias("content"), F.lit("Lead Article").alias("section_type"))).alias("semantic_chunks"),
        F.array(F.struct(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("bbox"), F.lit(5).alias("caption"))).alias("figures"),
    ))
    text = F.when(F.col("page") % 5 == 0, "").otherwise(body)
    made = t.select("doc_id", "page", arrow.fallback_page(text, F.when(F.col("page") % 4 == 0, "length").otherwise("stop")).alias("p"))
    return made.select("doc_id", "page", F.md5("p.text").alias("md5"), "p.error")


@query()
def guard_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streams, under the windows of old and under those that measure periods and repeats."""
    new = Limits(window=1000, every=400, ratio=8.0, periodic=3000, counter=6000, numeric=600, repeated=4000)
    return stateful.compared(_pieces(spark, sf_dir), Limits(window=1000, every=400, ratio=8.0), new).drop("page", "attempt")


@query(f"""SELECT coalesce(lang, '?') AS label, "old", "new", n, sum(CASE WHEN "old" <> '-' AND "new" = '-' THEN n ELSE 0 END) OVER (PARTITION BY label)::BIGINT AS old_only,
  sum(CASE WHEN "new" <> '-' AND "old" = '-' THEN n ELSE 0 END) OVER (PARTITION BY label)::BIGINT AS new_only FROM (SELECT lang, label, "old", "new", count(*) AS n FROM (SELECT coalesce(lang, '?') AS lang, coalesce(lang, '?') AS label,
  CASE WHEN length(text) % 7 = 0 THEN 'window' ELSE '-' END AS "old", CASE WHEN length(text) % 5 = 0 THEN 'periodic' ELSE '-' END AS "new" FROM documents) GROUP BY ALL)""")
def guard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    d = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("?")).alias("label"), F.when(n % 7 == 0, "window").alias("old"), F.when(n % 5 == 0, "periodic").alias("new"))
    return quality.guard_report(d)


@query("""SELECT event_type, message, CASE WHEN message LIKE '%memory%' THEN 'oom' WHEN message LIKE '%timed out%' THEN 'timeout' WHEN message LIKE '%refused%' THEN 'connection' WHEN message LIKE '%JSON%' THEN 'parse'
  WHEN message LIKE '%disk full%' THEN 'disk_full' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT event_type, ['CUDA Out Of memory', 'read timed out', 'Connection refused', 'JSON is not closed', 'disk full', 'unlikely'][event_id % 6 + 1] AS message FROM events) GROUP BY ALL""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ["CUDA Out Of memory", "read timed out", "Connection refused", "JSON is not closed", "disk full", "unlikely"])), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_type", said.alias("message"))
    return e.select("event_type", "message", C.error_class(F.col("message")).alias("kind")).groupBy("event_type", "message", "kind").agg(F.count("*").alias("n"))


def _record(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Turns as pages with a chunk each, a table on every third, and a figure on every second, whose page may not exist."""
    t = turn_pages(spark, sf_dir).withColumn("nth", F.lit(1))
    chunks = t.select("doc_id", "page", "nth", F.when(F.col("page") % 4 != 0, F.col("role")).alias("title"), F.col("text").alias("content"))
    held = t.where("page % 3 = 0").select("doc_id", "page", "nth", F.concat(F.lit("<table><tr><td>"), F.length("text").cast("string"), F.lit("</td></tr></table>")).alias("html"), F.lit("Table").alias("caption"))
    figures = t.where("page % 2 = 0").select(
        "doc_id", F.when(F.col("page") % 8 == 0, F.col("page") + 1000).otherwise(F.col("page")).alias("page"), "nth", F.col("page").alias("index"),
        F.when(F.col("page") % 4 == 0, F.lit("c.png")).alias("crop_path"), F.when(F.col("page") % 6 != 0, F.col("role")).alias("caption"),
    )
    return t.select("doc_id", "page"), chunks, held, figures


@query(r"""
WITH t AS (SELECT conv_id AS doc_id, turn + 1 AS page, role, text FROM conversations), top AS (SELECT doc_id, max(page) + 1 AS after FROM t GROUP BY ALL),
u AS (SELECT doc_id, page, 0 AS kind, page AS home, CASE WHEN page % 4 <> 0 AND role <> '' THEN '## ' || role || E'\n\n' ELSE '' END || text AS s FROM t
  UNION ALL SELECT doc_id, page, 1, page, '<table><tr><td>' || length(text) || '</td></tr></table>' FROM t WHERE page % 3 = 0
  UNION ALL SELECT doc_id, page, 2, CASE WHEN page % 8 = 0 THEN page + 1000 ELSE page END, CASE WHEN page % 4 = 0 THEN '![' || CASE WHEN page % 6 <> 0 THEN role ELSE '' END || '](img:' || page || ')'
    ELSE '[Figure: ' || CASE WHEN page % 6 <> 0 THEN role ELSE 'untitled' END || ']' END FROM t WHERE page % 2 = 0),
p AS (SELECT t.doc_id, t.page, coalesce(string_agg(s, E'\n\n' ORDER BY kind) FILTER (WHERE s <> ''), '') AS body FROM t LEFT JOIN u ON t.doc_id = u.doc_id AND t.page = u.home GROUP BY ALL
  UNION ALL SELECT u.doc_id, after, string_agg(s, E'\n\n' ORDER BY home, kind) FROM u JOIN top ON u.doc_id = top.doc_id WHERE home > 1000 GROUP BY ALL)
SELECT doc_id, string_agg('<page ' || page || E'>\n' || body || E'\n</page ' || page || '>', E'\n\n' ORDER BY page) AS markdown FROM p GROUP BY doc_id
""")
def render_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with chunks, tables and figures, and figures of pages that the document does not have behind them."""
    known, chunks, held, figures = _record(spark, sf_dir)
    return assembly.rendered(known, document.markdown_units(chunks, held, figures))


@query("""
WITH t AS (SELECT conv_id AS doc_id, turn + 1 AS page, role, text FROM conversations),
f AS (SELECT doc_id, 'chunk:p' || page || '.title' AS "where", CASE WHEN page % 4 <> 0 THEN role END AS text FROM t UNION ALL SELECT doc_id, 'chunk:p' || page || '.content', text FROM t
  UNION ALL SELECT doc_id, 'table:p' || page || '.caption', 'Table' FROM t WHERE page % 3 = 0 UNION ALL SELECT doc_id, 'table:p' || page || '.html', '<table><tr><td>' || length(text) || '</td></tr></table>' FROM t WHERE page % 3 = 0
  UNION ALL SELECT doc_id, 'figure:p' || CASE WHEN page % 8 = 0 THEN page + 1000 ELSE page END || '.caption', CASE WHEN page % 6 <> 0 THEN role END FROM t WHERE page % 2 = 0
  UNION ALL SELECT doc_id, 'document.title', min(role) FROM t GROUP BY doc_id)
SELECT doc_id, "where", text FROM f WHERE regexp_matches(text, '\\S')
""")
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, *units = _record(spark, sf_dir)
    keyed = [u.withColumn("key", F.concat(F.lit("p"), F.col("page").cast("string"))) for u in units]
    titles = turn_pages(spark, sf_dir).groupBy("doc_id").agg(F.min("role").alias("title")).withColumn("summary", F.lit(None).cast("string"))
    return document.text_fields(titles, *keyed)


@query()
def postprocess_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean-up with the passes that compare lines and paragraphs: the first lines of a text stand behind it again."""
    head = F.slice(F.split("text", "\n"), 1, 12)
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", F.array_join(head, "\n")).alias("text"))
    made = d.withColumn("clean", arrow.deduplicated("text"))
    return made.select("doc_id", F.length("text").alias("n_before"), F.length("clean").alias("n_after"), F.md5("clean").alias("md5"))
