"""Queries over the driver's tables that SQL can express as well; each stands above its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import columns as C
from folia.operators import assembly, pages, quality, summary
from folia.sources.tables import FRAGMENTS_SQL, PAGE_RESULTS_SQL, doc_lines, fragments, page_results, table, turn_pages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAGES_SQL = """
page_lists AS (
  SELECT doc_id, CASE WHEN length(trim(text, E' \\t\\n\\r')) <= 1000 THEN [trim(text, E' \\t\\n\\r')] ELSE
    (SELECT CASE WHEN s.cur = '' THEN s.pages ELSE list_append(s.pages, s.cur) END FROM (SELECT list_reduce(
      string_split(trim(text, E' \\t\\n\\r'), E'\\n'),
      lambda a, x: CASE
        WHEN length(CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || E'\\n' || x.cur END) <= 1000
          THEN {'pages': a.pages, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || E'\\n' || x.cur END}
        WHEN length(x.cur) <= 1000 THEN {'pages': CASE WHEN a.cur = '' THEN a.pages ELSE list_append(a.pages, a.cur) END, 'cur': x.cur}
        ELSE {'pages': list_append(CASE WHEN a.cur = '' THEN a.pages ELSE list_append(a.pages, a.cur) END, x.cur), 'cur': ''} END,
      {'pages': []::VARCHAR[], 'cur': ''}) AS s)) END AS ps
  FROM documents WHERE regexp_matches(text, '\\S')),
pages_of AS (
  SELECT doc_id, unnest(range(1, len(ps) + 1)) AS page, unnest(ps) AS text
  FROM (SELECT doc_id, list_filter(ps, lambda p: regexp_matches(p, '\\S')) AS ps FROM page_lists))
""".replace("x.cur", "x")


@query("WITH " + PAGES_SQL + "SELECT doc_id, CAST(page AS INT) AS page, length(text) AS n_chars, text FROM pages_of")
def paginate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.paginate_lines(table(spark, sf_dir, "documents"), 1000)


@query(
    "WITH " + PAGES_SQL + "SELECT doc_id, CAST(page AS INT) AS page, n_chars, total_pages FROM (SELECT doc_id, page, length(text) AS n_chars,"
    " count(*) OVER (PARTITION BY doc_id) AS total_pages FROM pages_of) WHERE page BETWEEN 2 AND 4"
)
def page_range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pages.line_pages(table(spark, sf_dir, "documents"), 1000)
    return pages.page_range(made, 2, 4).select("doc_id", "page", "n_chars", "total_pages")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, unnest(range(0, len(string_split(text, E'\n')))) AS i FROM documents),
k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM l)
SELECT doc_id, string_agg(line, E'\n' ORDER BY i) AS text FROM k WHERE prev IS NULL OR NOT regexp_matches(line, '\S') OR line <> prev GROUP BY doc_id
""")
def dedup_consecutive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select("doc_id", F.array_join(pages.without_repeated_lines(F.col("lines")), "\n").alias("text"))


@query(r"""
SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, E'\n')), E' \t\r\n') AS line FROM documents)
WHERE length(line) > 5 AND length(line) < 60 GROUP BY ALL HAVING count(*) >= 3
""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.running_headers(doc_lines(spark, sf_dir))


HEADED = "concat('# ', replace(text, E'\\n', E'\\n## '))"


@query(f"SELECT doc_id, regexp_replace({HEADED}, '(?m)^(#{{1,5}})(\\s)', '#\\1\\2', 'g') AS text FROM documents")
def demote_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return table(spark, sf_dir, "documents").select("doc_id", C.demoted(headed).alias("text"))


@query("""
SELECT doc_id, regexp_replace(t, '(data:[A-Za-z0-9.+/;=-]*;base64,)[A-Za-z0-9+/=]{200,}', '\\1[payload removed]', 'g') AS text,
  len(regexp_extract_all(t, 'data:[A-Za-z0-9.+/;=-]*;base64,[A-Za-z0-9+/=]{200,}')) AS removed
FROM (SELECT doc_id, 'data:image/png;base64,' || repeat(left(md5(text), 8), CAST(doc_id % 60 AS INT)) || ' ' || text AS t FROM documents)
""")
def strip_data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.repeat(F.substring(F.md5("text"), 1, 8), (F.col("doc_id") % 60).cast("int"))
    t = F.concat(F.lit("data:image/png;base64,"), payload, F.lit(" "), "text")
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", C.without_payloads(F.col("t")).alias("text"), F.regexp_count("t", F.lit(C.DATA_URI)).cast("bigint").alias("removed"))


@query("""
SELECT conv_id AS doc_id, arg_min(title, turn) FILTER (WHERE title <> '') AS title, arg_min(org, turn) FILTER (WHERE org <> '') AS org
FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN split_part(text, '.', 1) ELSE '' END AS title,
  CASE WHEN turn >= 2 THEN split_part(text, ' ', 2) END AS org FROM conversations) GROUP BY conv_id
""")
def metadata_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turn_pages(spark, sf_dir)
    t = t.withColumn("title", F.when(F.col("role") == "user", F.split_part("text", F.lit("."), F.lit(1))).otherwise(""))
    t = t.withColumn("org", F.when(F.col("page") >= 3, F.split_part("text", F.lit(" "), F.lit(2))))
    return t.groupBy("doc_id").agg(assembly.first_value(F.col("title")).alias("title"), assembly.first_value(F.col("org")).alias("org"))


@query("""
SELECT doc_id, arg_max(role, n * 1000000 - first) AS role FROM
(SELECT conv_id AS doc_id, role, count(*) AS n, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY doc_id
""")
def doctype_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.majority(turn_pages(spark, sf_dir), "role")


@query(r"""
WITH w AS (SELECT conv_id AS doc_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS k FROM conversations),
f AS (SELECT doc_id, word, min(turn * 1000000 + k) AS pos FROM w WHERE word IS NOT NULL GROUP BY ALL)
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS keywords FROM f GROUP BY doc_id
""")
def keyword_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turn_pages(spark, sf_dir).withColumn("keywords", F.split("text", " "))
    listed = t.groupBy("doc_id").agg(assembly.in_page_order(F.col("keywords"), "page").alias("k"))
    return listed.select("doc_id", F.array_join(assembly.union_in_order(F.col("k")), " ").alias("keywords"))


@query(r"SELECT conv_id AS doc_id, string_agg(text, E'\n' ORDER BY turn) FILTER (WHERE text <> '') AS summary FROM conversations GROUP BY conv_id")
def page_summary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turn_pages(spark, sf_dir).where("text != ''")
    return t.groupBy("doc_id").agg(F.array_join(assembly.in_page_order(F.col("text"), "page"), "\n").alias("summary"))


SENTENCES_SQL = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s*', E'\\1\x01', 'g'), E'\x01'),
  lambda s: trim(s, E' \t\n\r')), lambda s: s <> '')"""


@query(rf"""
WITH s AS (SELECT conv_id AS doc_id, turn + 1 AS page, length(text) AS n, text, unnest({SENTENCES_SQL}) AS sent, unnest(range(0, len({SENTENCES_SQL}))) AS i FROM conversations),
r AS (SELECT *, sum(length(sent) + 1) OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS upto FROM s),
c AS (SELECT doc_id, page, string_agg(sent, ' ' ORDER BY i) FILTER (WHERE upto <= 200) AS cut FROM r GROUP BY ALL)
SELECT p.conv_id AS doc_id, p.turn + 1 AS page, CASE WHEN length(p.text) <= 200 THEN p.text ELSE c.cut END AS summary
FROM conversations p LEFT JOIN c ON c.doc_id = p.conv_id AND c.page = p.turn + 1
""")
def summary_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pages(spark, sf_dir).select("doc_id", "page", summary.within_budget(F.col("text"), 200).alias("summary"))


STOP_SQL = ", ".join(f"'{w}'" for w in summary.STOPWORDS)


@query(rf"""
WITH p AS (SELECT conv_id AS doc_id, turn, trim(text, E' \n\t\r') AS s, role FROM conversations), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY ALL),
f AS (SELECT * FROM p WHERE s <> ''),
u AS (SELECT doc_id, 0 AS part, min(turn) AS turn, arg_min(s, turn) AS s FROM f GROUP BY doc_id UNION ALL SELECT doc_id, 1, turn, s FROM f WHERE role = 'system'
  UNION ALL SELECT f.doc_id, CASE role WHEN 'user' THEN 2 ELSE 3 END, turn, s FROM f JOIN n ON f.doc_id = n.doc_id WHERE role <> 'system' AND n.n <= 30),
d AS (SELECT doc_id, s, min(part * 1000000 + turn) AS pos FROM u GROUP BY ALL),
l AS (SELECT doc_id, flatten(list({SENTENCES_SQL.replace('(text,', '(s,')} ORDER BY pos)) AS ss FROM d GROUP BY doc_id),
k AS (SELECT doc_id, list_transform(ss, lambda s: {{'s': s, 'w': list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([{STOP_SQL}], w)))}}) AS ss FROM l),
r AS (SELECT doc_id, list_reduce(ss, lambda a, x: CASE
    WHEN NOT a.go THEN a
    WHEN len(a.out) > 0 AND (len(x.w) = 0 OR len(list_filter(x.w, lambda t: NOT list_contains(a.known, t))) / len(x.w) < 0.5)
      THEN {{'out': a.out, 'known': a.known, 'used': a.used, 'dropped': a.dropped + 1, 'go': true}}
    WHEN a.used + length(x.s) + (CASE WHEN len(a.out) > 0 THEN 1 ELSE 0 END) <= 600
      THEN {{'out': list_append(a.out, x.s), 'known': list_concat(a.known, x.w), 'used': a.used + length(x.s) + (CASE WHEN len(a.out) > 0 THEN 1 ELSE 0 END), 'dropped': a.dropped, 'go': true}}
    ELSE {{'out': a.out, 'known': a.known, 'used': a.used, 'dropped': a.dropped, 'go': false}} END,
  {{'out': []::VARCHAR[], 'known': []::VARCHAR[], 'used': 0::BIGINT, 'dropped': 0, 'go': true}}) AS a FROM k)
SELECT n.doc_id, CASE WHEN len(r.a.out) > 0 THEN array_to_string(r.a.out, ' ') END AS summary, coalesce(r.a.dropped, 0) AS dropped FROM n LEFT JOIN r ON n.doc_id = r.doc_id
""")
def summary_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.when(F.col("role") == "system", F.array(F.lit("abstract"))).when(F.col("role") == "user", F.array(F.lit("introduction")))
    t = turn_pages(spark, sf_dir).withColumnRenamed("text", "summary")
    return summary.document_summaries(t.withColumn("types", types.otherwise(F.array(F.lit("conclusion")))), 600)


def _page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose last full stop is cut off, and that start in lower case, where the turn's length is even."""
    t = turn_pages(spark, sf_dir)
    even = F.length("text") % 2 == 0
    body = F.when(even, F.concat(F.lower(F.substring("text", 1, 1)), F.substring(F.col("text"), F.lit(2), F.length("text") - 2))).otherwise(F.col("text"))
    return t.withColumn("content", body)


@query(r"""
WITH c AS (SELECT conv_id AS doc_id, turn + 1 AS page, CASE WHEN length(text) % 2 = 0 THEN lower(left(text, 1)) || substr(text, 2, length(text) - 2) ELSE text END AS content FROM conversations),
l AS (SELECT *, lag(content) OVER w AS prev, lag(page) OVER w AS prev_page FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
j AS (SELECT *, CASE WHEN prev_page = page - 1 AND NOT regexp_matches(rtrim(prev, E' \n\t'), '[.!?:;]["'')\]]*$')
  AND regexp_matches(ltrim(content, E' \n\t'), '^[\p{Ll}0-9]') THEN 0 ELSE 1 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS grp FROM j)
SELECT doc_id, min(page) AS page, count(*) AS n_pages,
  string_agg(CASE WHEN new = 1 THEN content ELSE ltrim(content, E' \n\t') END, ' ' ORDER BY page) AS content
FROM (SELECT *, lead(new) OVER (PARTITION BY doc_id ORDER BY page) AS nn FROM g) GROUP BY doc_id, grp
""")
def stitch_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = F.array_sort(F.collect_list(F.struct("page", F.lit(0).alias("nth"), "content", F.array().cast("array<string>").alias("keywords"))))
    made = _page_chunks(spark, sf_dir).groupBy("doc_id").agg(chunks.alias("chunks"))
    out = made.select("doc_id", F.explode(assembly.stitched(F.col("chunks"))).alias("c"))
    return out.select("doc_id", F.col("c.page").alias("page"), F.size("c.pages").cast("bigint").alias("n_pages"), F.col("c.content").alias("content"))


@query(rf"""
WITH f AS {FRAGMENTS_SQL},
l AS (SELECT doc_id, page, y0, cols, caption, lag(y1) OVER w AS prev_y1, lag(cols) OVER w AS prev_cols, lag(page) OVER w AS prev_page
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY page, y0, x0, x1, y1, cols, w, h))
SELECT doc_id, page, count(*) AS n FROM l WHERE prev_page = page - 1 AND prev_y1 >= 930 AND y0 <= 100 AND cols > 0 AND prev_cols > 0 AND abs(cols - prev_cols) <= 1
  AND NOT coalesce(regexp_matches(caption, '(?i)^\s*tab(?:le|\.)?\s*[A-Za-z0-9][\w.-]*\s*[.:)–—-]') AND NOT regexp_matches(caption, '(?i)\bcont(?:inued|''d|\.)?\b'), false)
GROUP BY ALL
""")
def table_stitch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "x1", "y1", "cols", "w", "h")
    f = fragments(spark, sf_dir)
    f = f.select("*", F.lag("y1").over(w).alias("py1"), F.lag("cols").over(w).alias("pcols"), F.lag("page").over(w).alias("ppage"))
    go = assembly.table_goes_on(F.col("py1"), F.col("y0"), F.col("pcols"), F.col("cols"), F.col("caption"))
    return f.where((F.col("ppage") == F.col("page") - 1) & go).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


ROUND = "CASE WHEN {n} = 0 THEN NULL ELSE round_even(CAST({k} AS DOUBLE) / {n}, 4) END"


FLAGGED_SQL = f"""(SELECT doc_id, CASE WHEN attempts = 3 AND status = 'ok_coerced' THEN 'coerced_empty' WHEN attempts = 3 AND status = 'failed' THEN 'overlong_failed'
  WHEN attempts = 2 AND status = 'failed' THEN 'empty_completion' WHEN attempts = 3 AND status = 'transport_error' THEN 'wall_clock_abort' WHEN attempts = 2 AND status = 'transport_error' THEN 'oversize'
  WHEN attempts = 3 AND status = 'degenerate' THEN 'fallback_ok' ELSE status END AS status, attempts > 1 AND status = 'degenerate' AS repetition_abort, status = 'degenerate' AS degenerate,
  status = 'ok_coerced' AS schema_coerced, attempts = 2 AND status = 'ok' AS json_close, CASE WHEN seq % 4 > 0 THEN 'B' || (seq % 4) END AS bucket FROM {PAGE_RESULTS_SQL})"""


@query(f"""
WITH r AS {FLAGGED_SQL}, c AS (SELECT doc_id, count(*) AS pages, count_if(status = 'ok') AS first_pass_ok, count_if(schema_coerced) AS schema_coerced, count_if(degenerate) AS degenerate,
  count_if(repetition_abort) AS repetition_aborted, count_if(status = 'oversize') AS oversize_filtered, count_if(status = 'wall_clock_abort') AS wall_clock_aborts, count_if(status = 'coerced_empty') AS coerced_empty,
  count_if(status = 'fallback_ok') AS fallback_pages, count_if(status = 'empty_completion') AS empty_completions, count_if(json_close) AS json_close_stops, count_if(status = 'overlong_failed') AS overlong_failed,
  count_if(schema_coerced OR status IN ('failed', 'degenerate', 'overlong_failed', 'empty_completion')) AS retried FROM r GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(bucket || ':' || n, ',' ORDER BY bucket) AS buckets FROM (SELECT doc_id, bucket, count(*) AS n FROM r WHERE bucket IS NOT NULL GROUP BY ALL) GROUP BY doc_id)
SELECT c.* EXCLUDE (retried), coalesce(buckets, '') AS buckets, {ROUND.format(k='(pages - first_pass_ok)', n='pages')} AS first_pass_fail_rate, {ROUND.format(k='degenerate', n='pages')} AS degeneration_rate,
  {ROUND.format(k='schema_coerced', n='retried')} AS coerce_success_rate FROM c LEFT JOIN b ON c.doc_id = b.doc_id
""")
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, n = page_results(spark, sf_dir), F.col("status"), F.col("attempts")
    status = (
        F.when((n == 3) & (s == "ok_coerced"), "coerced_empty").when((n == 3) & (s == "failed"), "overlong_failed").when((n == 2) & (s == "failed"), "empty_completion")
        .when((n == 3) & (s == "transport_error"), "wall_clock_abort").when((n == 2) & (s == "transport_error"), "oversize").when((n == 3) & (s == "degenerate"), "fallback_ok").otherwise(s)
    )
    flagged = r.select(
        "doc_id", status.alias("status"), ((n > 1) & (s == "degenerate")).alias("repetition_abort"), (s == "degenerate").alias("degenerate"), (s == "ok_coerced").alias("schema_coerced"),
        ((n == 2) & (s == "ok")).alias("json_close"), F.when(F.col("seq") % 4 > 0, F.concat(F.lit("B"), (F.col("seq") % 4).cast("string"))).alias("bucket"),
    )
    entries = F.transform(F.map_entries("buckets"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return quality.gate_metrics(flagged).withColumn("buckets", F.array_join(F.array_sort(entries), ","))


@query(f"SELECT doc_id, attempts, count(*) AS n FROM {PAGE_RESULTS_SQL} WHERE attempts IS NOT NULL GROUP BY ALL")
def attempt_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.histogram(page_results(spark, sf_dir), "attempts")


@query(f"SELECT doc_id, status, count(*) AS n FROM {PAGE_RESULTS_SQL} GROUP BY ALL")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.histogram(page_results(spark, sf_dir), "status")


@query(f"""
WITH r AS {PAGE_RESULTS_SQL}, g AS (SELECT *, sum(CASE WHEN status = 'transport_error' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ts, seq) AS good FROM r)
SELECT doc_id, count(*) AS length, min(seq) AS first_seq, min(ts) AS since, max(ts) AS until FROM g WHERE status = 'transport_error' GROUP BY doc_id, good HAVING count(*) >= 2
""")
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.streaks(page_results(spark, sf_dir), "transport_error", 2)


@query(f"""
WITH r AS {PAGE_RESULTS_SQL} SELECT doc_id, seq, status, count_if(status = 'transport_error') OVER
  (PARTITION BY doc_id ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM r
""")
def transport_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.recent_errors(page_results(spark, sf_dir), "transport_error", 7200).select("doc_id", "seq", "status", "recent")


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, token) of items as sources and as outputs. Words get a camel-case tail; every third loses a letter."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.regexp_replace("text", r"([a-z]{4}) ", "$1Xy7 ").alias("t"))
    source = b.select("doc_id", F.explode(C.precision_tokens(F.col("t"))).alias("token"))
    bad = F.when(F.length("token") % 3 == 0, F.concat(F.substring("token", 1, 2), F.substring(F.col("token"), F.lit(4), F.length("token"))))
    bad = bad.when(F.length("token") % 3 == 1, F.upper("token")).otherwise(F.col("token"))
    return source, source.select("doc_id", bad.alias("token")).distinct()


CLASS_SQL = """CASE WHEN length({t}) >= 6 AND (contains({t}, '_') OR regexp_matches({t}, '[a-z][A-Z]')) THEN 'ident' WHEN regexp_matches({t}, '[0-9]') THEN 'code'
  WHEN length({t}) >= 3 AND regexp_matches({t}, '[A-Z]') AND NOT regexp_matches({t}, '[a-z]') THEN 'acronym' END"""
TOKENS_SQL = f"""
src AS (SELECT DISTINCT doc_id, token FROM (SELECT item_id AS doc_id, unnest(regexp_extract_all(regexp_replace(text, '([a-z]{{4}}) ', '\\1Xy7 ', 'g'),
  '[A-Za-z0-9](?:[A-Za-z0-9._\\-]*[A-Za-z0-9])?')) AS token FROM benchmark) WHERE {CLASS_SQL.format(t='token')} IS NOT NULL),
out_ AS (SELECT DISTINCT doc_id, CASE length(token) % 3 WHEN 0 THEN left(token, 2) || substr(token, 4) WHEN 1 THEN upper(token) ELSE token END AS token FROM src),
unk AS (SELECT * FROM out_ ANTI JOIN src USING (doc_id, token))
"""


@query(f"WITH {TOKENS_SQL} SELECT doc_id, token, {CLASS_SQL.format(t='token')} AS cls FROM src")
def vocab_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir)[0].withColumn("cls", C.token_class(F.col("token")))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, token FROM unk")
def fidelity_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, output = _tokens(spark, sf_dir)
    return quality.unknown_tokens(output, source)


@query(f"""WITH {TOKENS_SQL}, low AS (SELECT doc_id, lower(token) AS l, count(*) AS n, min(token) AS closest FROM src GROUP BY ALL)
SELECT unk.doc_id, unk.token, closest FROM unk JOIN low ON unk.doc_id = low.doc_id AND lower(unk.token) = l WHERE n = 1""")
def fidelity_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, output = _tokens(spark, sf_dir)
    return quality.case_matches(quality.unknown_tokens(output, source), source)


@query(f"""WITH {TOKENS_SQL}, d AS (SELECT unk.doc_id, unk.token, src.token AS cand, levenshtein(unk.token, src.token) AS distance FROM unk JOIN src USING (doc_id)
  WHERE {CLASS_SQL.format(t='unk.token')} = {CLASS_SQL.format(t='src.token')}),
n AS (SELECT * FROM d WHERE distance <= CASE WHEN length(token) >= 7 THEN 2 ELSE 1 END),
b AS (SELECT doc_id, token, min(distance) AS best FROM n GROUP BY ALL)
SELECT n.doc_id, n.token, min(cand) AS closest, CAST(min(distance) AS INT) AS distance, count(*) > 1 AS ambiguous FROM n JOIN b ON n.doc_id = b.doc_id AND n.token = b.token
WHERE distance = best GROUP BY ALL""")
def fidelity_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, output = _tokens(spark, sf_dir)
    return quality.nearest_tokens(quality.unknown_tokens(output, source), source)


TAGS = "user assistant system view click purchase signup error News-Brief photo_essay Table_of_Contents legal text_block obituaries footnotes".split()


def _rules_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(v, '{r}') THEN '{k}'" for r, k in C.SECTION_RULES)
    known = ", ".join(f"'{t}'" for t in C.SECTION_TYPES)
    tags = ", ".join(f"('{t}')" for t in TAGS)
    return f"""WITH t(tag) AS (SELECT * FROM (VALUES {tags}) UNION SELECT DISTINCT role FROM conversations UNION SELECT DISTINCT event_type FROM events),
      n AS (SELECT tag, translate(lower(trim(tag)), '- ', '__') AS v FROM t)
      SELECT tag, CASE WHEN v IN ({known}) THEN v {whens} ELSE 'other' END AS kind FROM n"""


@query(_rules_sql())
def section_type_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    tags = tags.union(table(spark, sf_dir, "conversations").select("role")).union(table(spark, sf_dir, "events").select("event_type")).distinct()
    return tags.select("tag", C.section_type(F.col("tag")).alias("kind"))


@query(f"SELECT doc_id, page, least(x0, x1) AS left_, least(y0, y1) AS top_, greatest(x0, x1) AS right_, greatest(y0, y1) AS bottom_ FROM {FRAGMENTS_SQL}")
def bbox_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir)
    quad = C.quad_of_flat(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])
    e = f.select("doc_id", "page", C.envelope_of_quad(quad).alias("e"))
    return e.select("doc_id", "page", *[F.col("e")[k].cast("int").alias(n) for k, n in enumerate(("left_", "top_", "right_", "bottom_"))])


@query(f"""
SELECT doc_id, page, CAST(floor(a / 1000.0::DOUBLE * w) AS INT) AS l, CAST(floor(b / 1000.0::DOUBLE * h) AS INT) AS u,
  CAST(floor(c / 1000.0::DOUBLE * w) AS INT) AS r, CAST(floor(d / 1000.0::DOUBLE * h) AS INT) AS b
FROM (SELECT doc_id, page, w, h, greatest(0, least(1000, x0)) AS a, greatest(0, least(1000, y0)) AS b, greatest(0, least(1000, x1)) AS c,
  greatest(0, least(1000, y1)) AS d FROM {FRAGMENTS_SQL}) WHERE c > a AND d > b AND (c - a) * (d - b) / 1000000.0::DOUBLE >= 0.015
""")
def bbox_crop_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir)
    box = C.crop_pixels(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "w", "h")])
    return f.select("doc_id", "page", box.alias("box")).where("box is not null").select("doc_id", "page", "box.*")


def _image_sql() -> str:
    opts = []
    for k, (ph, pw) in enumerate(C.PINPOINTS):
        s = f"least({pw}.0::DOUBLE / w, {ph}.0::DOUBLE / h)"
        eff = f"least(floor(w * {s}) * floor(h * {s}), w * h)"
        opts.append(f"SELECT id, w, h, {eff} AS eff, {ph * pw} - {eff} AS waste, {k} AS k, {ph} AS ph, {pw} AS pw FROM s")
    return f"""WITH s AS (SELECT row_number() OVER () AS id, w, h FROM (SELECT DISTINCT w, h FROM {FRAGMENTS_SQL})), o AS ({' UNION ALL '.join(opts)}),
      b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY eff DESC, waste, k) = 1),
      g AS (SELECT w, h, 12 * (ph // 384) AS rows_, 12 * (pw // 384) AS cols_ FROM b),
      n AS (SELECT *, w / h > cols_ / rows_ AS wide FROM g),
      f AS (SELECT w, h, CASE WHEN wide THEN rows_ - ((rows_ - CAST(floor(round(h * (cols_ / w), 7)) AS INT)) // 2) * 2 ELSE rows_ END AS r,
        CASE WHEN wide THEN cols_ ELSE cols_ - ((cols_ - CAST(floor(round(w * (rows_ / h), 7)) AS INT)) // 2) * 2 END AS c FROM n)
      SELECT w, h, CAST(r * c + r + 144 AS INT) AS tokens FROM f"""


@query(_image_sql())
def image_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = fragments(spark, sf_dir).select("w", "h").distinct()
    sizes = sizes.withColumn("grid", C.best_grid(F.col("w"), F.col("h")))
    return sizes.select("w", "h", C.image_tokens(F.col("w"), F.col("h"), F.col("grid")).alias("tokens"))


BUCKET_SQL = """CASE WHEN w / h >= 0.9 AND w / h <= 1.15 THEN 'B0' WHEN glyph IS NULL THEN 'B2'
  WHEN glyph * least(1152 / w, 1536 / h) >= 9.5 THEN 'B1' WHEN glyph * least(1536 / w, 2304 / h) >= 9.5 THEN 'B2'
  WHEN glyph * least(2304 / w, 3072 / h) >= 9.5 THEN 'B3' ELSE 'B3' END"""


@query(f"SELECT bucket, count(*) AS n, min(w) AS w, max(h) AS h FROM (SELECT *, {BUCKET_SQL} AS bucket FROM {FRAGMENTS_SQL}) GROUP BY bucket")
def bucket_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir).withColumn("bucket", C.bucket(F.col("w"), F.col("h"), F.col("glyph")))
    return f.groupBy("bucket").agg(F.count("*").alias("n"), F.min("w").alias("w"), F.max("h").alias("h"))


@query(f"""
SELECT doc_id, page, bucket, tokens, CAST(greatest(CASE bucket WHEN 'B0' THEN 6500 WHEN 'B1' THEN 25500 WHEN 'B2' THEN 29500 ELSE 26500 END,
  CASE WHEN tokens <= 1476 THEN 6500 WHEN tokens <= 1920 THEN 25500 WHEN tokens <= 3672 THEN 29500 ELSE 26500 END) AS INT) AS cut, 30000 - tokens - 18 AS max_tokens
FROM (SELECT doc_id, page, {BUCKET_SQL} AS bucket, CAST(w * h // 700 AS INT) AS tokens FROM {FRAGMENTS_SQL})
""")
def output_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir).withColumn("bucket", C.bucket(F.col("w"), F.col("h"), F.col("glyph")))
    f = f.withColumn("tokens", F.floor(F.col("w") * F.col("h") / 700).cast("int"))
    return f.select("doc_id", "page", "bucket", "tokens", C.output_cut(F.col("bucket"), F.col("tokens")).alias("cut"), (C.TOKEN_BUDGET - F.col("tokens") - 18).alias("max_tokens"))


@query("SELECT doc_id, CAST(cjk + (n - cjk) // 4 AS INT) AS tokens FROM (SELECT doc_id, len(regexp_extract_all(text, '[\u3000-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]')) AS cjk, length(text) AS n FROM documents)")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, left(sha256(text), 16) AS hash FROM documents")
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.doc_hash(F.col("text").cast("binary")).alias("hash"))


@query("""SELECT doc_id, CAST(a AS INT) AS attempt, CAST(('0x' || left(sha256(left(sha256(text), 16) || ':' || a), 8)) AS BIGINT) % 2147483648 AS seed
FROM documents, (VALUES (1), (2)) v(a)""")
def seed_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", C.doc_hash(F.col("text").cast("binary")).alias("key"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    return d.select("doc_id", "attempt", C.seed_for(F.col("key"), F.col("attempt")).alias("seed"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(r"""
SELECT doc_id, CASE WHEN tail = '' THEN 0 ELSE CAST((length(text) - length(replace(text, tail, ''))) // length(tail) AS BIGINT) END AS times
FROM (SELECT doc_id, text, right(text, 40) AS tail FROM documents WHERE text IS NOT NULL)
""")
def loop_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("tail", F.expr("right(text, 40)"))
    times = (F.length("text") - F.length(F.replace("text", F.col("tail"), F.lit("")))) / F.length("tail")
    return d.select("doc_id", F.when(F.col("tail") == "", 0).otherwise(F.floor(times)).cast("bigint").alias("times"))


@query(r"""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations)
SELECT doc_id, string_agg('<page ' || page || E'>\n' || CASE WHEN text = '' THEN '' ELSE text END || E'\n</page ' || page || '>', E'\n\n' ORDER BY page) AS markdown FROM p GROUP BY doc_id
""")
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turn_pages(spark, sf_dir)
    units = t.select("doc_id", "page", F.lit(0).alias("kind"), F.lit(0).alias("nth"), "text")
    return assembly.rendered(t.select("doc_id", "page"), units)


@query(r"""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations)
SELECT doc_id, E'# Metadata\n\nPages: ' || count(*) || E'\n\n# Summary\n\n' || trim(arg_min(text, page), E' \n\t\r') || E'\n\n# Content\n\n'
  || string_agg('<page ' || page || E'>\n' || text || E'\n</page ' || page || '>', E'\n\n' ORDER BY page) || E'\n\n# Tables\n\n(none)\n\n# Figures\n\n(none)' AS raw FROM p GROUP BY doc_id
""")
def render_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turn_pages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    content = F.array_join(F.transform("p", lambda x: assembly.raw_page(x["page"], F.array(x["text"]))), "\n\n")
    meta = F.concat(F.lit("Pages: "), F.size("p").cast("string"))
    sections = {"Metadata": meta, "Summary": F.col("p")[0]["text"], "Content": content, "Tables": F.lit(""), "Figures": F.lit("")}
    return t.select("doc_id", assembly.raw_sections(sections).alias("raw"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, E'\n') AS lines FROM documents),
k AS (SELECT doc_id, len(lines) AS n, list_transform(lines, lambda t: list_distinct(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))) AS ws FROM l),
r AS (SELECT doc_id, n, list_reduce(ws, lambda a, y: CASE
    WHEN a.n > 0 AND len(a.last) > 0 AND len(y) > 0 AND len(list_intersect(a.last, y)) / (len(a.last) + len(y) - len(list_intersect(a.last, y))) > 0.6
      THEN {'n': a.n, 'last': CASE WHEN len(y) > len(a.last) THEN y ELSE a.last END}
    ELSE {'n': a.n + 1, 'last': y} END, {'n': 0, 'last': []::VARCHAR[]}) AS a FROM k)
SELECT doc_id, CAST(n AS INT) AS n, r.a.n AS n_kept FROM r
""")
def chunk_jaccard_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = doc_lines(spark, sf_dir).select("doc_id", F.size("lines").alias("n"), summary.without_similar_neighbours(F.col("lines")).alias("kept"))
    return lines.select("doc_id", "n", F.size("kept").alias("n_kept"))


#: Lists of lines packed greedily, as counts and characters of the groups.
PACKED_SQL = r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, E'\n'), lambda x: {item}) AS items FROM documents),
r AS (SELECT doc_id, list_reduce(items, lambda a, x: CASE
    WHEN a.n > 0 AND (a.n >= {most} OR a.used + length(x) + 1 > {chars}) THEN {{'out': list_append(a.out, {{'n': a.n, 'chars': a.used}}), 'n': 1, 'used': length(x)}}
    ELSE {{'out': a.out, 'n': a.n + 1, 'used': a.used + length(x) + (CASE WHEN a.n > 0 THEN 1 ELSE 0 END)}} END,
  {{'out': []::STRUCT(n INTEGER, chars BIGINT)[], 'n': 0, 'used': 0::BIGINT}}) AS a FROM l),
g AS (SELECT doc_id, list_append(r.a.out, {{'n': r.a.n, 'chars': r.a.used}}) AS gs FROM r), o AS (SELECT doc_id, unnest(gs) AS g, unnest(range(0, len(gs))) AS k FROM g)
"""


@query(PACKED_SQL.format(item="'## ' || x", most=24, chars=1700) + "SELECT doc_id, CAST(k AS INT) AS \"window\", g.n AS n FROM o")
def heading_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.transform("lines", lambda x: F.concat(F.lit("## "), x))
    found = doc_lines(spark, sf_dir).select("doc_id", pages.heading_lines(heads).alias("heads"))
    groups = pages.packed(F.transform("heads", lambda h: h["line"]), 24, 1700)
    return found.select("doc_id", F.posexplode(groups).alias("window", "lines")).select("doc_id", "window", F.size("lines").alias("n"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, E'\n') AS ps FROM documents),
r AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE
    WHEN len(a.cur) > 0 AND list_sum(list_transform(a.cur, lambda q: length(q) // 4)) + length(x) // 4 > 200
      THEN {'out': list_append(a.out, a.cur), 'cur': list_append(list_filter(a.cur, lambda p, i: list_sum(list_transform(list_slice(a.cur, i, len(a.cur)), lambda q: length(q) // 4)) <= 40), x)}
    ELSE {'out': a.out, 'cur': list_append(a.cur, x)} END, {'out': []::VARCHAR[][], 'cur': []::VARCHAR[]}) AS a FROM l),
s AS (SELECT doc_id, list_append(r.a.out, r.a.cur) AS ss FROM r), o AS (SELECT doc_id, unnest(ss) AS s, unnest(range(0, len(ss))) AS k FROM s)
SELECT doc_id, CAST(k AS INT) AS section, CAST(len(s) AS INT) AS n, md5(array_to_string(s, E'\n\n')) AS md5 FROM o
""")
def section_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = doc_lines(spark, sf_dir).select("doc_id", F.posexplode(pages.sections(F.col("lines"), 200, 40)).alias("section", "paragraphs"))
    return made.select("doc_id", "section", F.size("paragraphs").alias("n"), F.md5(F.array_join("paragraphs", "\n\n")).alias("md5"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct, sum(length(line)) AS n_chars, max(length(line)) AS longest FROM l GROUP BY doc_id
""")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_lines(spark, sf_dir)
    lengths = F.transform("lines", lambda x: F.length(x))
    return d.select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.size(F.array_distinct("lines")).cast("bigint").alias("n_distinct"),
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_chars"), F.array_max(lengths).cast("bigint").alias("longest"),
    )


@query("""SELECT item_id, cls, cap FROM (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'pdf' WHEN item_id % 4 = 1 THEN 'image' WHEN item_id % 4 = 2 THEN 'csv' END AS cls,
 rtrim(regexp_replace(lower(trim(text, E' \\n\\t')), '\\s+', ' ', 'g'), '.') AS cap FROM benchmark)""")
def caption_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    ext = F.element_at(F.array(F.lit("a/B.PDF"), F.lit("x.y.TIFF"), F.lit("t.csv"), F.lit("noext")), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select("item_id", C.file_class(ext).alias("cls"), C.caption_key(F.col("text")).alias("cap"))
