"""Plain functions of one text as columns, in Arrow batches. A cheap native test before them keeps rows that they
would not change in the JVM: call them behind a filter or on the branch that needs them."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.functions import completions, html_text, latex, markdown
from folia.functions.columns import CJK

#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session end at BATCH_BYTES, unless it has a lower bound already: a worker holds a batch as Python
    objects, so a bound in rows alone lets long texts pile up."""
    named = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(named)
    if not held.rstrip("b").isdecimal() or int(held.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(named, str(BATCH_BYTES))


def per_text(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A column function that applies f to each row's text, once a batch to equal ones; null stays null."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        known = {None: None}

        def of(t):
            if t not in known:
                known[t] = f(t)
            return known[t]

        return texts.map(of)

    return run


postprocessed = per_text(markdown.postprocess, T.StringType())
deduplicated = per_text(lambda t: markdown.postprocess(t, True), T.StringType())
wrapped_latex = per_text(latex.wrap, T.StringType())
html_markdown = per_text(html_text.markdown, T.StringType())
flat_table = per_text(html_text.flat_table, T.StringType())
widest_row = per_text(html_text.widest_row, T.IntegerType())
compression = per_text(completions.compression, T.DoubleType())
content_compression = per_text(lambda t: completions.compression(completions.unmarked(t)), T.DoubleType())
periodic_score = per_text(lambda t: completions.periodic(t)["score"], T.LongType())
repeated_score = per_text(lambda t: completions.repeated(t)["score"], T.LongType())


def struct(**fields: T.DataType) -> T.StructType:
    """Types as objects, since a schema in text needs a session to parse it."""
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


@F.pandas_udf(struct(verdict=T.StringType(), error=T.StringType(), chars=T.LongType(), page=T.StringType()))
def gate(text: pd.Series, finish: pd.Series) -> pd.DataFrame:
    """The verdict; of an ok completion its content's length and its page, mended, as JSON."""
    rows = []
    for t, f in zip(text, finish, strict=True):
        verdict, why, page = completions.gated(t or "", f)
        ok = verdict == "ok"
        rows.append((verdict, why, completions.content_chars(page) if ok else 0, json.dumps(page, ensure_ascii=False) if ok else None))
    return pd.DataFrame(rows, columns=["verdict", "error", "chars", "page"])


@F.pandas_udf(struct(text=T.StringType(), error=T.StringType()))
def fallback_page(text: pd.Series, finish: pd.Series) -> pd.DataFrame:
    pages = [completions.fallback_page(t, f) for t, f in zip(text, finish, strict=True)]
    return pd.DataFrame({"text": [None if p is None else json.dumps(p, ensure_ascii=False) for p in pages], "error": [None if p else "not rescued" for p in pages]})


@F.pandas_udf(struct(value=T.StringType(), error=T.StringType()))
def lenient_json(text: pd.Series) -> pd.DataFrame:
    found = [completions.lenient(t) for t in text]
    return pd.DataFrame({"value": [None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True) for v, _ in found], "error": [e for _, e in found]})


def wrap_if_needed(text: Column) -> Column:
    """Only texts with a backslash can change, which the JVM sees; the UDF still runs for the batch, so filter first
    where most texts have none."""
    return F.when(text.contains("\\"), wrapped_latex(text)).otherwise(text)


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)
