"""Queries whose operators are Arrow functions; SQL says some of them in closed form, tests/test_query_rules.py the others in
plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import arrow, split
from folia.operators import pages, quality, tables
from folia.plans.native_queries import PACKED_SQL, TOKENS_SQL, _tokens
from folia.sources.tables import FRAGMENTS_SQL, fragments, table
from folia.streaming import stateful
from folia.streaming.guards import Limits


def paginate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under a bound of characters and one of bytes; their texts join to the document again."""
    cut = F.pandas_udf("array<string>")(lambda texts: texts.map(lambda t: split.paginate(t or "", 2000, 1500)))
    made = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut("text")).alias("k", "text"))
    return made.select("doc_id", (F.col("k") + 1).alias("page"), F.octet_length("text").alias("n_bytes"), F.md5("text").alias("md5"))


def postprocess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").withColumn("clean", arrow.postprocessed("text"))
    return made.select("doc_id", F.length("text").alias("n_before"), F.length("clean").alias("n_after"), F.md5("clean").alias("md5"))


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "pages").withColumn("md", arrow.html_markdown("html"))
    return made.select("page_id", F.length("md").alias("n"), F.md5("md").alias("md5"))


def zlib_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second measure only for texts that the first one finds compressible, on a branch of their own."""
    first = table(spark, sf_dir, "documents").select("doc_id", "text", arrow.compression("text").alias("ratio"))
    second = first.where("ratio > 7").select("doc_id", "ratio", (arrow.content_compression("text") > 7).alias("degenerate"))
    return second.unionByName(first.where("not ratio > 7").select("doc_id", "ratio", F.lit(False).alias("degenerate")))


def loop_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", arrow.periodic_score("text").alias("periodic"), arrow.repeated_score("text").alias("repeated"))


LATEX = [r"\alpha + \beta = 1", r"We get \begin{matrix}a\\b\end{matrix} here, as said", "$x$ and \\beta", "plain prose", r"# \alpha"]


def latex_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    bare = F.element_at(F.array(*map(F.lit, LATEX)), (F.col("doc_id") % len(LATEX) + 1).cast("int"))
    text = F.concat_ws("\n", "text", bare)
    return d.select("doc_id", text.alias("text")).select("doc_id", arrow.wrap_if_needed(F.col("text")).alias("wrapped"))


def _table_html(cols) -> F.Column:
    cells = F.concat_ws("", F.transform(F.sequence(F.lit(0), cols), lambda k: F.concat(F.lit("<td>"), k.cast("string"), F.lit(" x</td>"))))
    return F.concat(F.lit("<table><tr><th>a</th><th>b</th></tr><tr>"), cells, F.lit("</tr></table>"))


def table_flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir).select("doc_id", "page", _table_html(F.col("cols")).alias("html"))
    return f.select("doc_id", "page", arrow.flat_table("html").alias("flat"), arrow.widest_row("html").alias("widest"))


def table_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir)
    bbox = F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])
    key = F.concat_ws("_", "doc_id", "page", "x0", "x1", "y1")
    rows = f.select(
        "doc_id", key.alias("table_id"), F.col("page").cast("int").alias("page"), F.xxhash64(*f.columns).alias("nth"), bbox.alias("bbox"), "caption",
        _table_html(F.col("cols")).alias("html"),
    )
    return tables.stitch_tables(rows).select("doc_id", "table_id", "page", F.size("pages").alias("n_pages"), "continues", "continued_by", F.md5("flat_text").alias("md5"))


def json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties in fences, after talk, with junk behind them, or broken."""
    forms = F.element_at(
        F.array(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Here: "), "props"), F.concat("props", F.lit(" {}")), F.lit("{oops")),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    return table(spark, sf_dir, "events").select("event_id", arrow.lenient_json(forms).alias("j")).select("event_id", "j.value", "j.error")


def completion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as completions of a page: each has two attempts, of which the first is cut off for every third."""
    body = F.to_json(F.struct(
        F.expr("named_struct('title', null, 'authors', array(), 'organization', null, 'year', null, 'doc_type', 'paper') as metadata"), F.lit("s").alias("summary"),
        F.array(F.struct(F.col("text").alias("content"), F.lit("body").alias("section_type"))).alias("semantic_chunks"),
        F.expr("array() as figures"), F.expr("array() as tables"),
    ), {"ignoreNullFields": "false"})
    d = table(spark, sf_dir, "documents").select("doc_id", body.alias("text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    finish = F.when((F.col("attempt") == 1) & (F.col("doc_id") % 3 == 0), "length").otherwise("stop")
    judged = d.select("doc_id", "attempt", arrow.gate("text", finish).alias("g"))
    attempts = judged.select(
        "doc_id", F.lit(1).alias("page"), "attempt", F.when(F.col("attempt") == 1, "first").otherwise("retry_unenforced").alias("rung"), F.col("g.verdict").alias("verdict"),
        F.col("g.chars").cast("string").alias("text"),
    )
    return quality.first_ok(attempts)


def fidelity_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, output = _tokens(spark, sf_dir)
    return tables.without_stems(quality.unknown_tokens(output, source), source)


def fidelity_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, output = _tokens(spark, sf_dir)
    unknown = tables.without_stems(quality.unknown_tokens(output, source), source)
    cased = quality.case_matches(unknown, source)
    near = quality.nearest_tokens(unknown.join(cased, ["doc_id", "token"], "left_anti"), source)
    fixes = cased.unionByName(tables.nearest_fixes(near))
    fields = output.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("text")).withColumn("where", F.lit("summary"))
    return tables.correct_fields(fields, fixes)


def figure_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks, and with a dot at their ends as figures' captions."""
    c = table(spark, sf_dir, "conversations")
    chunks = c.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("c"), "turn").alias("chunk_id"), F.col("turn").alias("nth"), F.col("text").alias("content"), F.lit(None).cast("string").alias("title"))
    figures = c.select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("f"), "turn").alias("figure_id"), F.col("turn").alias("nth"), F.concat("text", F.lit(".")).alias("caption"), F.lit("crop").alias("crop_path")
    )
    return tables.place_figures(figures, chunks)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streams of pieces of 200 characters."""
    at = F.sequence(F.lit(1), F.length("text"), F.lit(200))
    d = table(spark, sf_dir, "documents").where("text != ''").select("doc_id", "text", F.posexplode(at).alias("seq", "a"))
    return d.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("attempt"), "seq", F.substring(F.col("text"), F.col("a"), F.lit(200)).alias("piece"))


def stream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.replay(_pieces(spark, sf_dir), Limits(window=1000, every=400, ratio=8.0))


def block_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    made = lines.select("doc_id", F.posexplode(pages.packed(F.col("lines"), 1 << 30, 1000)).alias("block", "items"))
    return made.select("doc_id", "block", F.size("items").alias("n"), F.length(F.array_join("items", "\n")).alias("chars"))


BOUNDARY_SQL = """({k} = 0 OR {k} = length(v) OR contains('._-', substr(v, {k}, 1)) OR contains('._-', substr(v, {k} + 1, 1))
  OR regexp_matches(substr(v, {k}, 2), '^[a-z][A-Z]$') OR regexp_matches(substr(v, {k}, 1), '[0-9]') <> regexp_matches(substr(v, {k} + 1, 1), '[0-9]')
  OR regexp_matches(substr(v, {k}, 3), '^[A-Z][A-Z][a-z]$'))"""

SQL = {
    "table_flat_text": f"""SELECT doc_id, page, 'a | b' || chr(10) || array_to_string(list_transform(range(0, cols + 1), lambda k: k || ' x'), ' | ') AS flat,
      CAST(greatest(2, cols + 1) AS INT) AS widest FROM {FRAGMENTS_SQL}""",
    "json_lenient": """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN '{"k": ' || json_extract_string(props, '$.k') || '}' END AS "value", CASE WHEN event_id % 4 = 3 THEN 'json parse' END AS error FROM events""",
    "fidelity_segment": f"""WITH {TOKENS_SQL}, s AS (SELECT DISTINCT doc_id, t FROM (SELECT unk.doc_id, unk.token AS t, src.token AS v, unnest(range(0, length(src.token) - length(unk.token) + 1)) AS k
      FROM unk JOIN src ON unk.doc_id = src.doc_id AND contains(src.token, unk.token))
      WHERE substr(v, k + 1, length(t)) = t AND {BOUNDARY_SQL.format(k='k')} AND {BOUNDARY_SQL.format(k='(k + length(t))')})
      SELECT doc_id, token FROM unk WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = unk.doc_id AND s.t = unk.token)""",
    "figure_placement": """WITH k AS (SELECT conv_id AS doc_id, turn, rtrim(regexp_replace(lower(trim(text, E' \n\t')), '\\s+', ' ', 'g'), '.') AS key FROM conversations),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY turn) AS nth FROM k WHERE key <> '') SELECT f.doc_id, 'f' || f.turn AS figure_id, 'c' || c.turn AS chunk_id
      FROM r f JOIN r c ON f.doc_id = c.doc_id AND f.key = c.key AND f.nth = c.nth""",
    "block_pack": PACKED_SQL.format(item="x", most=1 << 30, chars=1000) + "SELECT doc_id, CAST(k AS INT) AS block, g.n AS n, CAST(g.chars AS INT) AS chars FROM o",
}

QUERIES = {
    f.__name__: f
    for f in (
        paginate_documents, postprocess_documents, html_markdown, zlib_degenerate, loop_periodic, latex_wrap, table_flat_text, table_stitch, json_lenient,
        completion_gate, fidelity_segment, fidelity_correct, figure_placement, stream_guard, block_pack,
    )
}
