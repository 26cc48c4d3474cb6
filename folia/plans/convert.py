"""From stored completions to documents: gate, ladder, assembly, summary, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions import arrow
from folia.operators import assembly, document, quality, summary


def once(df: DataFrame) -> DataFrame:
    """The frame worked out once: in the shared folder that spark.checkpoint.dir names, where the loss of an executor does not
    repeat it; without such a folder in the executors' memory and disks."""
    named = df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        return df.persist()
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(named)
    return df.checkpoint()


def page_results(completions: DataFrame) -> DataFrame:
    """completions: doc_id, page, attempt, rung, text, finish_reason -> doc_id, page, status, rescued_by, model_calls, data.

    What the gate has parsed and mended goes on as JSON, which the JVM reads by its schema: a completion is parsed once."""
    judged = completions.withColumn("g", arrow.gate("text", "finish_reason"))
    attempts = judged.select(
        "doc_id", "page", "attempt", "rung", F.col("g.verdict").alias("verdict"), F.col("finish_reason").alias("finish"), F.coalesce("g.page", "text").alias("text"), F.col("g.chars").alias("chars"),
    )
    best = quality.first_ok(attempts)
    return best.select("doc_id", "page", "status", "rescued_by", "model_calls", document.parsed(F.col("text")).alias("data"))


def documents(pages: DataFrame, budget: int = 4000) -> DataFrame:
    """doc_id, title, doc_type, summary, n_pages, markdown of each document of page results."""
    pages = once(pages)  # five aggregates read it; the gate and its Python run once
    chunks = document.units(pages, "semantic_chunks")
    figures = document.units(pages, "figures").withColumn("index", F.col("nth")).withColumn("crop_path", F.lit(None).cast("string"))
    units = document.markdown_units(chunks, document.units(pages, "tables"), figures)
    text = assembly.rendered(pages.select("doc_id", "page"), units)
    kinds = F.transform("data.semantic_chunks", lambda c: c["section_type"])
    told = pages.select("doc_id", "page", F.col("data.summary").alias("summary"), F.coalesce(kinds, F.array().cast("array<string>")).alias("types"))
    sums = summary.document_summaries(told, budget)
    count = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    meta = document.metadata(pages).select("doc_id", "title", "doc_type")
    return count.join(meta, "doc_id", "left").join(sums.select("doc_id", "summary"), "doc_id", "left").join(text, "doc_id", "left")
