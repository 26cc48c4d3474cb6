"""A training corpus from the table documents, in stages that each call one operator of folia.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from folia.llm.common import broadcast_if_small, cut, fresh_path, row_key

#: SimHash of the near-duplicate stage: sets of five-word shingles, fingerprints of 256 bits, and a similarity, the
#: share of equal bits, of 0.8 or more (51 bits may differ). Sets of a Jaccard similarity J differ in about
#: arccos(2 J / (1 + J)) / pi of the bits, so 0.8 there is 39 bits and the radius leaves room for chance. Candidates
#: share 14 chosen bits: 8 in one of 88 tables, and 6 further ones in one of 8 choices inside each bucket. A pair at the
#: radius shares none in one case of a million (simhash.nested_miss()), a closer one in fewer.
NEAR = {"words": 5, "bits": 256, "radius": 51, "tables": 88, "width": 14, "inner": 8, "repeats": False}


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows that gone (doc_id, row_key) names; its columns stay as they are."""
    key, d, k = (fresh(docs, n) for n in ("__key", "__d", "__k"))
    named = gone.select(F.col("doc_id").alias(d), F.col("row_key").alias(k)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k))
    return docs.withColumn(key, row_key()).join(broadcast_if_small(cut(named)), same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5. Null and empty texts score the share of toxic labels, repeated rows alike; of no
    documents none are left."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keyed = docs.withColumn("row_key", row_key())
    scored = cut(toxicity.score_toxicity(keyed, model, "row_key").where("score >= 0.5").select("doc_id", "row_key"))
    return without(docs, scored)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that of the smallest doc_id; of wholly repeated rows any one. Null and empty texts are one text,
    and a null doc_id stays only where no other has the text."""
    groups = cut(exact_dedup.exact_groups(docs).select("doc_id", "row_key", "kept"))
    left = without(docs, groups.where(~F.col("kept")))
    twice = groups.where("kept").groupBy("doc_id", "row_key").count().where("count > 1").drop("count")
    if twice.isEmpty():
        return left
    key, d, k = (fresh(docs, n) for n in ("__key", "__d", "__k"))
    named = broadcast_if_small(cut(twice.select(F.col("doc_id").alias(d), F.col("row_key").alias(k))))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k))
    repeated = left.withColumn(key, row_key()).join(named, same, "left_semi").dropDuplicates(["doc_id", key])
    return without(left, twice).unionByName(repeated.select(*(F.col(f"`{c}`") for c in docs.columns)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id. Rows of null doc_id stay. Documents without
    words are one group; those of fewer than five words have one shingle."""
    keyed = docs.withColumn("row_key", row_key())
    found = cut(simhash.simhash_components(keyed, **NEAR, carry=("row_key",)).where("component_id is not null").select("doc_id", "row_key", "component"))
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("kept"), F.count("*").alias("n"))
    kept = broadcast_if_small(cut(kept.where("n > 1").drop("n")))  # groups of one lose nothing
    gone = found.where("doc_id is not null").join(kept, "component").where("struct(doc_id, row_key) != kept")
    return without(docs, gone)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null texts have none, and an empty benchmark has none either."""
    keyed = docs.withColumn("row_key", row_key())
    found = decontaminate.contaminations(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("row_key",))
    return without(docs, cut(found.where("n_hit > 0").select("doc_id", "row_key")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens; every row is a document, null texts are empty."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash", near), ("decontaminate", clean), ("packing", packed)]

#: Toxicity, SimHash, decontamination and packing have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one keeps is written for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
