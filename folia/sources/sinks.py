"""Sinks: documents as nested JSON, as Markdown files by document, and telemetry as appended JSON lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


#: What of a table and of a picture a document's record shows, in its order.
TABLE_KEYS = "table_id page pages continues continued_by bbox caption html flat_text".split()
IMAGE_KEYS = "caption description page bbox".split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="folia-")
    sc.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def structured(documents: DataFrame, chunks: DataFrame, tables: DataFrame, figures: DataFrame, quads: bool = True) -> DataFrame:
    """doc_id, json: metadata, summary, chunks, tables and images of each document in one object.

    documents has doc_id, n_pages, title, doc_type, summary, optionally authors, organization, year and file_path. Tables and
    figures have page, nth and what TABLE_KEYS and IMAGE_KEYS name, optionally description, chart_data and crop (the bytes
    of its image): data is that as base64, and format says png only where there is one. quads: tables have a
    description, and images chart data where a model gave some. Units are nested by one aggregate each, only here."""

    def shown(df: DataFrame, keys: list[str]) -> list[Column]:
        crop = F.col("crop") if "crop" in df.columns else F.lit(None).cast("binary")
        data = F.regexp_replace(F.base64(crop), "\\s", "")
        own = [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in keys]
        return [*own, F.when(crop.isNotNull(), "png").alias("format"), data.alias("data")]

    def nested(df: DataFrame, name: str, row: Column) -> DataFrame:
        return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "nth", F.to_json(row, FULL).alias("r")))).alias("x")).select(
            "doc_id", F.transform("x", lambda u: u["r"]).alias(name)
        )

    own = F.struct(*[F.col(c) for c in chunks.columns if c not in ("doc_id", "nth")])
    t = F.struct(*shown(tables, TABLE_KEYS + (["description"] if quads else [])))
    chart = [F.when(F.col("chart_data").isNotNull(), F.col("chart_data")).alias("chart_data")] if quads and "chart_data" in figures.columns else []
    i = F.struct(*shown(figures, IMAGE_KEYS), *chart)
    out = documents
    for part in (nested(chunks, "c", own), nested(tables, "t", t), nested(figures, "i", i)):
        out = out.join(part, "doc_id", "left")
    has = set(documents.columns)
    known = [(F.col(c) if c in has else F.lit(None).cast("string")).alias(c) for c in ("title", "authors", "organization", "year", "doc_type")]
    path = F.col("file_path") if "file_path" in has else F.lit(None).cast("string")
    meta = F.struct(
        *known, F.col("doc_type").alias("type"), F.col("doc_id").alias("id"), path.alias("file_path"), F.col("n_pages").alias("source_pages"),
        F.coalesce(F.size("c"), F.lit(0)).alias("num_chunks"),
    )
    listed = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]"))
    # an image says its number in the document, and chart data only where it has some
    images = F.transform("i", lambda x, k: F.concat(F.lit('{"index":'), (k + 1).cast("string"), F.lit(","), F.substr(F.regexp_replace(x, ',"chart_data":null', ""), F.lit(2))))
    text = F.regexp_replace(F.to_json(F.array("summary"), FULL), r"^\[|\]$", "")
    parts = {"metadata": F.to_json(meta, FULL), "summary": text, "semantic_chunks": listed("c"), "tables": listed("t"), "images": listed(images)}
    body = [x for k, v in parts.items() for x in (F.lit(("," if k != "metadata" else "{") + f'"{k}":'), v)]
    return out.select("doc_id", F.concat(*body, F.lit("}")).alias("json"))


#: Nulls are said.
FULL = {"ignoreNullFields": "false"}


def dump(completions: DataFrame, path: str) -> None:
    """One JSON line for each model call, in a folder for each document, for replays of guards."""
    completions.write.mode("append").partitionBy("doc_id").json(path)


def write_markdown(documents: DataFrame, path: str) -> None:
    """A text file a task; each document's Markdown stands between its mark and the next."""
    line = F.concat(F.lit("<!-- document "), F.col("doc_id").cast("string"), F.lit(" -->\n"), "markdown")
    documents.select(line.alias("value")).write.mode("overwrite").text(path)


def telemetry(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream of events as JSON lines, each batch appended once."""
    return events.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
