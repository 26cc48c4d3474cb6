"""License notices in texts, by DataFrame operations only: rolling word k-gram hashes are joined to the positions of
templates, matches vote for their diagonal (place in the text less place in the template), neighbouring diagonals are
merged, and the spans that come out are verified against the template's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.llm.common import broadcast_if_small, cut, row_key

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Words of a k-gram; diagonals this close are one; share of the template's words that a span must match.
GRAM = 3
NEAR = 2
VERIFIED = 0.8
#: Spans that are broadcast at most, four values each; more meet their texts in a shuffle.
BROADCAST_SPANS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words, lower-cased in A-Z, each after one space."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), low), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def words_of(text: Column) -> Column:
    """The words; of a text without any, an empty array."""
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")


def grams(words: str, k: int) -> Column:
    """(place, hash) of each run of k words."""
    run = ", ".join(f"get({words}, i + {j})" for j in range(k))
    return F.expr(f"if(size({words}) < {k}, array(), transform(sequence(0, size({words}) - {k}), i -> xxhash64({run})))")


def template_grams(spark: SparkSession, k: int) -> DataFrame:
    """template, label, size, notice (its words), at, h: one row a place; as many as the fixed notices have words."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, label string, text string")
    rows = rows.withColumn("notice", words_of(F.col("text"))).withColumn("h", grams("notice", k))
    return rows.select("template", "label", F.size("notice").alias("size"), "notice", F.posexplode("h").alias("at", "h"))


def base_places(words: str, phrases: dict[str, str]) -> Column:
    """(first, label) of every place where a phrase's words stand one after another."""
    found = []
    for phrase, label in phrases.items():
        want = phrase.split()
        same = " and ".join(f"get({words}, i + {j}) = '{w}'" for j, w in enumerate(want))
        places = f"transform(filter(sequence(0, size({words}) - {len(want)}), i -> {same}), i -> struct(i as first, '{label}' as label))"
        none = "cast(array() as array<struct<first:int,label:string>>)"
        found.append(f"if(size({words}) >= {len(want)} and contains(line, ' {phrase}'), {places}, {none})")
    return F.expr(f"concat({', '.join(found)})")


def template_spans(docs: DataFrame, k: int = GRAM, near: int = NEAR, verified: float = VERIFIED) -> DataFrame:
    """doc_id, row_key, template, label, notice, first, last (word after the span), share of every span that may be a notice.

    docs has doc_id, row_key and words. share is the part of the template's words that lie in a k-gram found at the merged
    diagonals; a span counts from `verified` on.
    """
    templates = template_grams(docs.sparkSession, k)
    places = F.broadcast(templates.select("template", "at", "h"))  # one row a word of TEMPLATES
    rolling = docs.select("doc_id", "row_key", F.posexplode(grams("words", k)).alias("place", "h"))
    votes = rolling.join(places, "h").select("doc_id", "row_key", "template", "at", "place", (F.col("place") - F.col("at")).alias("diagonal"))
    tally = votes.groupBy("doc_id", "row_key", "template", "diagonal").agg(
        F.count_distinct("at").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("at").alias("ats")
    )
    line = Window.partitionBy("doc_id", "row_key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > near).cast("int"), F.lit(1))
    merged = tally.withColumn("new", apart).withColumn("band", F.sum("new").over(line))
    spans = merged.groupBy("doc_id", "row_key", "template", "band").agg(
        F.min("low").alias("first"), (F.max("high") + k).alias("last"), F.sum("votes").alias("votes"),
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
    )
    facts = F.broadcast(templates.select("template", "label", "size", "notice").distinct())
    spans = spans.join(facts, "template")
    # words of the template that lie in a matching k-gram
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + k - 1)))))
    spans = spans.withColumn("share", covered / F.col("size")).where(F.col("share") >= verified)
    return spans


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row.

    Base: the places where a phrase's words stand one after another. labels adds those of verified template spans.
    score is the largest likeness of a verified span to its template (one less their edit distance over the longer one's
    length), 1 where a base phrase stands, 0 without any.
    A null text counts as empty; a row without words has zero counts, null places and empty labels. Rows of equal
    doc_id each get theirs.
    """
    phrases = PHRASES if phrases is None else phrases
    rows = docs.select("doc_id", row_key().alias("row_key"), spaced(F.col("text")).alias("line"))
    rows = rows.withColumn("words", F.filter(F.split("line", " "), lambda w: w != ""))
    based = rows.withColumn("base", base_places("words", phrases)).select(
        "doc_id", "row_key", F.size("words").cast("bigint").alias("n_words"), F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["first"])).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))).alias("base"),
    )
    spans = cut(template_spans(rows.select("doc_id", "row_key", "words")))
    # the span's words, less than near more or fewer than the template's, against the template's own
    checked = verify(rows, spans)
    found = checked.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("r")).agg(
        F.collect_set("label").alias("more"), F.max("score").alias("best"),
        F.array_sort(F.collect_set(F.struct("first", "last", "label", "score"))).alias("spans"),
    )
    found = cut(found)  # worked out once, for its size and for the join
    n_spans = found.agg(F.sum(F.size("spans"))).first()[0] or 0
    found = F.broadcast(found) if n_spans <= BROADCAST_SPANS else found
    both = based.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans",
    )


def verify(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans whose words are near enough to the template's: the edit distance of the texts, letter by letter, is at
    most a fifth of the longer text's length."""
    ids = cut(spans.select(F.col("doc_id").alias("d"), F.col("row_key").alias("r")).distinct())
    texts = rows.join(
        broadcast_if_small(ids), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")), "left_semi"
    ).dropDuplicates(["doc_id", "row_key"]).select(F.col("doc_id").alias("d"), F.col("row_key").alias("r"), "words")
    both = spans.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")))
    got = F.array_join(F.expr("slice(words, first + 1, last - first)"), " ")
    want = F.array_join("notice", " ")
    score = 1 - F.levenshtein(got, want) / F.greatest(F.length(got), F.length(want))
    return both.select("doc_id", "row_key", "label", "first", "last", score.alias("score")).where(F.col("score") >= VERIFIED)
