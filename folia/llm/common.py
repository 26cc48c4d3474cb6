"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions.arrow import BATCH_BYTES as BATCH_BYTES
from folia.functions.arrow import bound_batches
from folia.sources.sinks import fresh_path as fresh_path
from folia.sources.sinks import shared_dir

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The same, and every ASCII byte that is no letter or digit becomes a space.
ALNUM = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in LOWER)

#: The most rows that broadcast_if_small() broadcasts.
BROADCAST_ROWS = 200_000


def plain_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than x20 and x09-x0D, which is what bytes.split() parts at."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters of the text with A-Z lowered."""
    return text.translate(ALNUM).split()


def cut(df: DataFrame) -> DataFrame:
    """The frame read back from reliable storage: no later loss of an executor repeats what made it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The frame written as a table to the shared folder and read back: smaller than cut(), and its columns are read
    one by one."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the rows, which must be a few fixed-width columns, are at most so many; beyond that
    the frame as it is, which Spark joins by shuffling (and splits where skewed)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) as UTF-8 bytes, and the named columns. Other columns, whatever their names, go."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"), *more)


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Tells rows of equal id and different text apart; equal rows share it, and so do a null and an empty text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
