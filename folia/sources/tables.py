"""Driver tables and the inputs that the document queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines: the lines of each text as an array, so that line passes need no shuffle."""
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))


def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, role, text: each turn of a conversation is a page of a document."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "role", "text")


#: Page statuses that the event types stand for.
EVENT_STATUS = {"view": "ok", "click": "ok_coerced", "purchase": "failed", "signup": "degenerate", "error": "transport_error"}


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, ts, status, attempts, model_calls: events as page results of a user's document."""
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for kv in EVENT_STATUS.items() for x in kv])[F.col("event_type")]
    attempts = (F.get_json_object("props", "$.k").cast("int") % 3 + 1)
    return e.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"),
        attempts.alias("attempts"), attempts.alias("model_calls"), "value",
    )


#: The same in SQL.
PAGE_RESULTS_SQL = """(SELECT user_id AS doc_id, event_id AS seq, ts, value,
  CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'ok_coerced' WHEN 'purchase' THEN 'failed'
    WHEN 'signup' THEN 'degenerate' WHEN 'error' THEN 'transport_error' END AS status,
  CAST(json_extract_string(props, '$.k') AS INT) % 3 + 1 AS attempts,
  CAST(json_extract_string(props, '$.k') AS INT) % 3 + 1 AS model_calls FROM events)"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, x0, y0, x1, y1, cols, w, h, glyph, caption: line items as table fragments on a 0-1000 grid."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"),
        (F.col("l_partkey") % 400).cast("int").alias("x0"), (F.col("l_discount") * 2000).cast("int").alias("y0"),
        (F.col("l_partkey") % 400 + F.col("l_suppkey") % 700).cast("int").alias("x1"),
        (F.col("l_quantity") * 20).cast("int").alias("y1"), (F.col("l_suppkey") % 4).cast("int").alias("cols"),
        (600 + F.col("l_partkey") % 2000).cast("int").alias("w"), (600 + F.col("l_suppkey") % 3000).cast("int").alias("h"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 400).alias("glyph"),
        F.when(F.col("l_returnflag") == "A", "Table 8. Rows").when(F.col("l_returnflag") == "R", "Table 8 (continued)").alias("caption"),
    )


FRAGMENTS_SQL = """(SELECT l_orderkey AS doc_id, l_linenumber AS page, CAST(l_partkey % 400 AS INT) AS x0,
  CAST(trunc(l_discount * 2000) AS INT) AS y0, CAST(l_partkey % 400 + l_suppkey % 700 AS INT) AS x1,
  CAST(trunc(l_quantity * 20) AS INT) AS y1, CAST(l_suppkey % 4 AS INT) AS cols,
  CAST(600 + l_partkey % 2000 AS INT) AS w, CAST(600 + l_suppkey % 3000 AS INT) AS h,
  CASE WHEN l_tax > 0 THEN l_tax * 400 END AS glyph,
  CASE l_returnflag WHEN 'A' THEN 'Table 8. Rows' WHEN 'R' THEN 'Table 8 (continued)' END AS caption FROM lineitem)"""
