"""Mail and text files as rows: .eml by the standard library, and the entry points for files of all classes."""

from __future__ import annotations

import csv
import email
import email.policy
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.functions import arrow, html_text
from folia.functions.columns import doc_hash, file_class
from folia.sources import msg, sheets

#: Bytes of a text file that is read, and of a file that is taken at all.
MAX_BYTES, MAX_UPLOAD = 50 << 20, 100 << 20
CSV_ROWS = 10_000


def cell(v) -> str:
    """A cell of a Markdown table: bars escaped, line breaks as spaces."""
    return str("" if v is None else v).replace("|", r"\|").replace("\r\n", " ").replace("\n", " ").replace("\r", " ").strip()


def grid(rows: list[list]) -> str:
    """A Markdown table; the first row is the header, and short rows are filled up."""
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join([cell(v) for v in r] + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def csv_markdown(raw: bytes, most: int = CSV_ROWS) -> str:
    """The first records, header included, as a Markdown table."""
    reader = csv.reader(io.StringIO(raw.decode("utf-8-sig", "replace"), newline=""))
    return grid([r for _, r in zip(range(most), reader, strict=False)])


def preamble(fields: dict[str, str | None], attachments: list[str]) -> str:
    lines = [f"**{k}:** {v}" for k, v in fields.items() if v]
    return "\n".join(lines + ([f"**Attachments:** {', '.join(attachments)}"] if attachments else []))


def eml_markdown(raw: bytes) -> str:
    """Subject, sender, receivers, date and attachments, then the plain body, or else the HTML one."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        text = html_text.markdown(text)
    head = preamble(
        {k: str(m[k]) if m[k] else None for k in ("Subject", "From", "To", "Cc", "Date")}, [a.get_filename() or "unnamed" for a in m.iter_attachments()]
    )
    return f"{head}\n\n{text.strip()}".strip()


def plain(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


READERS = {
    "csv": csv_markdown, "eml": eml_markdown, "msg": msg.msg_markdown, "xlsx": sheets.workbook_markdown, "xlsm": sheets.workbook_markdown,
    **dict.fromkeys(("txt", "md", "markdown"), plain), **dict.fromkeys(("html", "htm"), lambda b: html_text.markdown(plain(b))),
}


def read_one(path: str, raw: bytes) -> str:
    ext = path.rpartition(".")[2].lower()
    if ext not in READERS:
        raise ValueError(f".{ext} files need a converter that is not part of this package")
    return READERS[ext](raw)


@F.pandas_udf(arrow.struct(text=T.StringType(), error=T.StringType()))
def _read(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = []
    for p, raw in zip(path, content, strict=True):
        try:
            rows.append((read_one(p, bytes(raw)), None))
        except Exception as e:  # a file that can't be read is a row with its error, not the end of the job
            rows.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["text", "error"])


def text_of(path: Column, content: Column) -> Column:
    """struct(text, error). Plain text with malformed bytes is read with replacement characters."""
    return _read(path, content)


def read_files(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """path, doc_id, kind, length, text, error of every text, table and mail file in a folder. Files over the limit (of any
    kind MAX_UPLOAD), files that no reader takes and broken ones are rows with an error; the content of those over it is
    never read, since the length is a column of its own in the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("kind", file_class(F.col("path"))).where("kind in ('text', 'csv', 'spreadsheet')")
    most = F.least(F.lit(MAX_UPLOAD), F.when(F.col("kind") == "spreadsheet", F.lit(MAX_UPLOAD)).otherwise(F.lit(most)))
    small = files.where(F.col("length") <= most)
    got = small.select("path", doc_hash(F.col("content")).alias("doc_id"), "kind", "length", text_of(F.col("path"), F.col("content")).alias("t"))
    got = got.select("path", "doc_id", "kind", "length", "t.text", "t.error")
    large = files.where(F.col("length") > most).select(
        "path", F.lit(None).cast("string").alias("doc_id"), "kind", "length", F.lit(None).cast("string").alias("text"), F.lit("over the size limit").alias("error")
    )
    return got.unionByName(large)


PICTURE = T.ArrayType(arrow.struct(sheet=T.StringType(), index=T.IntegerType(), content=T.BinaryType()))


@F.pandas_udf(PICTURE)
def _pictures(content: pd.Series) -> pd.Series:
    def of(raw):
        try:
            return [{"sheet": s, "index": k, "content": c} for s, k, c in sheets.pictures(bytes(raw))]
        except Exception:  # a workbook that can't be read has no pictures, and its text says why
            return []

    return content.map(of)


def workbook_pictures(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id, figure_id, sheet, index, content of each picture in a folder's workbooks, the first of each workbook."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    books = files.where(F.lower("path").rlike(r"\.xls[xm]$") & (F.col("length") <= MAX_UPLOAD))
    got = books.select("path", doc_hash(F.col("content")).alias("doc_id"), F.explode(_pictures("content")).alias("p"))
    key = F.concat("doc_id", F.lit("_embedded_f"), F.col("p.index").cast("string"))
    return got.select("path", "doc_id", key.alias("figure_id"), "p.sheet", "p.index", "p.content")
