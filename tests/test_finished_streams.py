"""Streams run to the end of their input: what they put out lies in files, not in the driver."""

import os
import random
from datetime import datetime, timedelta

import pytest
from folia.plans import stream_queries
from folia.streaming import stateful
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def results(spark, n=400):
    rng, base = random.Random(5), datetime(1969, 12, 31, 20)
    odd = [(1, base + timedelta(seconds=s), "transport_error") for s in (0, 59, 60, 299, 300, 301)] + [(2, None, "transport_error"), (3, base, None), (None, base, "ok")]
    more = [(rng.randint(1, 5), base + timedelta(seconds=rng.randint(0, 40_000), microseconds=rng.choice((0, 999_999))), rng.choice(("ok", "transport_error"))) for _ in range(n)]
    return spark.createDataFrame(odd + more, "doc_id bigint, ts timestamp_ntz, status string")


def test_slid(spark):
    """Fifths added up are what sliding windows count."""
    df = results(spark)
    want = stateful.recent_error_counts(df, 300).select("doc_id", F.col("w.start").alias("since"), "errors")
    parts = stateful.recent_error_counts(df, 300, sliding=False).select("doc_id", F.col("w.start").alias("since"), "errors")
    got = stateful.slid(parts, 300)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert parts.count() < want.count() / 3
    with pytest.raises(ValueError):
        stateful.slid(parts, 301)


def test_in_files(spark):
    """No stream's rows are held by the driver."""
    for name in ("stream_error_counts", "stream_page_order"):
        made = stream_queries.QUERIES[name](spark, SF)
        assert made.inputFiles() and made.count() > 0, name


def test_finished(spark, tmp_path):
    """Of complete batches the last counts, also with late files; of others all do; no input gives no rows."""
    own, src = stream_queries.session(spark), str(tmp_path / "in")
    rows = [r for r in results(spark).collect() if r.ts]
    for k, part in enumerate((rows[200:], rows[:100], rows[100:200])):  # in no order of time
        spark.createDataFrame(part, "doc_id bigint, ts timestamp_ntz, status string").coalesce(1).write.mode("append").parquet(src)
    read = lambda path: own.readStream.schema("doc_id bigint, ts timestamp_ntz, status string").option("maxFilesPerTrigger", 1).parquet(path)
    shown = lambda df: sorted(map(str, df.select("doc_id", F.col("w.start").cast("string"), "errors").collect()))
    got = stream_queries.finished(stateful.recent_error_counts(read(src)), "complete")
    assert shown(got) == shown(stateful.recent_error_counts(own.read.parquet(src)))
    assert stream_queries.finished(read(src).select("doc_id"), "append").count() == len(rows)
    os.makedirs(tmp_path / "none")
    assert stream_queries.finished(read(str(tmp_path / "none")).select("doc_id"), "append").count() == 0
