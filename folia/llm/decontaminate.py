"""Benchmark passages in documents, by one Aho-Corasick automaton over the items' words."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import ALNUM, alnum_words, stored, text_only

#: Words of benchmark items in one automaton; a larger benchmark takes several, each in a scan of its own.
AUTOMATON_WORDS = 2_000_000


_BUILT: dict[str, Windows] = {}


def _windows(key: str, shared) -> Windows:
    """The automaton of a broadcast (items, size), built once a worker and not once a task; one is held."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Windows(*shared.value)
    return _BUILT[key]


class Windows:
    """The automaton over windows of the items' words. Its alphabet is word numbers, so that a match starts and ends
    at words, and a window takes as many nodes as words at most."""

    def __init__(self, items: list[tuple[object, bytes]], size: int):
        self.numbers: dict[bytes, int] = {}
        self.size = size
        found: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(text)]
            for k in range(max(1, len(words) - size + 1) if words else 0):
                found[tuple(words[k : k + size])].add(item)
        self.items = [sorted(v, key=str) for v in found.values()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, words in enumerate(found):
            self.automaton.add_word(words, (k, len(words)))
        if found:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """First word, word after the last, and number of the window, of each occurrence."""
        if not self.items or not words:
            return
        numbers = tuple([self.numbers.get(w, 0) for w in words])
        for last, (k, n) in self.automaton.iter(numbers):
            yield last - n + 1, last + 1, k


def word_offsets(text: bytes) -> np.ndarray:
    """Byte offsets (first, after the last) in the original text of each of alnum_words(text)."""
    inside = np.frombuffer(text.translate(ALNUM), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _batches_of(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items, in lists of at most so many words (or of one item), fetched one partition after another."""
    rows = text_only(benchmark.withColumnRenamed("item_id", "doc_id")).orderBy("doc_id", "text")
    held, n = [], 0
    for r in rows.toLocalIterator():
        words = len(alnum_words(bytes(r.text)))
        if held and n + words > most:
            yield held
            held, n = [], 0
        held.append((r.doc_id, bytes(r.text)))
        n += words
    yield held


def contaminations(docs: DataFrame, benchmark: DataFrame, size: int = 10, most: int = AUTOMATON_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in carry, n_words, n_hit, spans and item_ids of every document.

    An item's windows are its runs of `size` words, or all its words if it has fewer; spans are the merged word
    ranges (first, after the last) that occurrences cover, with their byte offsets in the original text; item_ids
    are the items with an occurring window, as strings in order. Null texts and items have no words; null item_ids
    name no item but their windows hit. Rows of equal doc_id each get theirs. An empty benchmark hits nothing.

    The benchmark, not the corpus, decides the automaton's size; beyond `most` words it is taken in parts, each
    scanning all documents (numbered once, in a table) and stored before the next part is fetched; results are merged.
    """
    spark, parts = docs.sparkSession, []
    own = ["doc_id", *carry, "copy"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own[:-1])
    schema = f"{kinds}, copy bigint, n_words bigint, words array<array<bigint>>, bytes array<array<bigint>>, items array<string>"
    rows = text_only(docs.withColumn("copy", F.monotonically_increasing_id()), *carry, "copy")
    fetched = _batches_of(benchmark, most)
    items = next(fetched)
    while items is not None:
        after = next(fetched, None)
        if after is not None and not parts:  # copies must have the same numbers in all scans
            rows = stored(rows, "numbered")
        shared, key = spark.sparkContext.broadcast((items, size)), uuid.uuid4().hex

        def run(batches, shared=shared, key=key):
            windows = _windows(key, shared)
            for b in batches:
                out = []
                for text in b.column("text").to_pylist():
                    words = alnum_words(text)
                    spans, found = [], set()
                    # ends come in ascending order; a longer window can reach back over earlier spans
                    for first, last, k in windows.scan(words):
                        found.update(str(i) for i in windows.items[k] if i is not None)
                        while spans and first <= spans[-1][1]:
                            first = min(first, spans.pop()[0])
                        spans.append([first, last])
                    at = word_offsets(text) if spans else None
                    places = [[int(at[x][0]), int(at[y - 1][1])] for x, y in spans]
                    out.append((len(words), spans, places, sorted(found)))
                cols = list(zip(*out, strict=True)) or [()] * 4
                pairs = pa.list_(pa.list_(pa.int64()))
                kinds = [pa.int64(), pairs, pairs, pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in own), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                    [*own, "n_words", "words", "bytes", "items"],
                )

        part = rows.mapInArrow(run, schema)
        if after is not None or parts:  # done before the next one's items are held
            part = stored(part, "part")
            shared.destroy()
        parts.append(part)
        items = after
    merged = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            merged = merged.unionByName(p)
        lists = {c: F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("words", "bytes")}
        merged = merged.groupBy(*own).agg(
            F.first("n_words").alias("n_words"), *lists.values(), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        for c in ("words", "bytes"):
            merged = merged.withColumn(c, F.expr(
                f"aggregate({c}, cast(array() as array<array<bigint>>), (a, x) -> if(size(a) > 0 and x[0] <= element_at(a, -1)[1],"
                " concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(element_at(a, -1)[1], x[1])))),"
                " concat(a, array(x))))"
            ))
    hit = F.expr("aggregate(words, 0L, (a, x) -> a + x[1] - x[0])")
    return merged.select("doc_id", *carry, "n_words", hit.alias("n_hit"), F.col("words").alias("spans"), F.col("bytes").alias("byte_spans"), F.col("items").alias("item_ids"))
