"""Exact duplicates: a 128-bit hash makes the groups, their bytes are compared before they count as equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.common import broadcast_if_small, cut, row_key, stored


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, keep: str = "min", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, row_key (see common), keep_id, group_size, kept, text_sha256 for each row; keep is "min" or "max": which doc_id stays.

    A null text counts as empty, and equals an empty one. Rows of equal doc_id and text are all kept or all dropped,
    and each counts in group_size. A null doc_id stays only in a group that has no other; keep_id is null there. An
    empty table gives no rows.

    Every row's hash is stored once, without its text. Texts of repeated hashes are grouped by their bytes, which each
    task does first for its own rows, so of a text one row a task moves. Rows then meet the slim groups by hash
    alone; only where a hash has several texts (a collision) do they meet by the bytes.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", row_key().alias("row_key"), "text", hashed(F.col("text")).alias("h"))
    slim = stored(rows.select("doc_id", "row_key", "h", F.sha2("text", 256).alias("text_sha256")), "hashes")
    repeated = cut(slim.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    members = rows.select("doc_id", "h", "text").join(broadcast_if_small(repeated), "h", "left_semi")
    texts = members.groupBy("h", "text").agg(F.count("*").alias("group_size"), pick("doc_id").alias("keep_id"))
    groups = cut(texts.groupBy("h").agg(F.count("*").alias("texts"), F.first("group_size").alias("group_size"), F.first("keep_id").alias("keep_id")))
    own = ["doc_id", "row_key", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    collided = groups.where("texts > 1").select("h")
    both = slim.join(broadcast_if_small(groups), "h", "left")
    alone = F.col("texts").isNull()
    single = both.where(alone | (F.col("texts") == 1)).select(
        "doc_id", "row_key", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), "text_sha256",
    ).select(*own)
    if collided.isEmpty():
        return single
    same = cut(texts.join(broadcast_if_small(collided), "h", "left_semi"))
    apart = rows.join(same, ["h", "text"]).withColumn("text_sha256", F.sha2("text", 256)).select(*own)
    return single.unionByName(apart)
