"""Documents packed into sequences of a fixed length by sum of squares: each piece goes where the squared counts of
open bins, summed over their gaps, become smallest."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import cut, text_only
from folia.llm.tokens import encoder

#: Pieces that one task packs.
SHARD = 1 << 16


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, length: int, ids: bool = False) -> DataFrame:
    """doc_id, copy, piece, start, length, ids_crc32 and, if asked for, the ids (little-endian uint32) of each piece.

    The ids of a whole text (null: empty) and end_id, cut into pieces of exactly `length` and a shorter rest.
    copy tells rows of equal doc_id apart. A text without ids and no end_id gives no piece.
    """

    def run(batches):
        enc = encoder(tokenizer)
        end = np.zeros(0, "<u4") if end_id is None else np.array([end_id], "<u4")
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                all_ids = np.concatenate((enc.encode(text.decode()), end))
                for p, s in enumerate(range(0, len(all_ids), length)):
                    part = all_ids[s : s + length].tobytes()
                    at.append(k)
                    rows.append((p, s, len(part) // 4, zlib.crc32(part), part if ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            out = [b.column("doc_id").take(pa.array(at, pa.int64())), b.column("copy").take(pa.array(at, pa.int64()))]
            out += [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "copy", "piece", "start", "length", "ids_crc32", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, copy bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    made = text_only(docs.withColumn("copy", F.monotonically_increasing_id()), "copy").mapInArrow(run, schema)
    return made if ids else made.drop("ids")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, in the order given. A bin of level h holds h; open bins are those of 0 < h < capacity.
    Moving a bin from h to h + s changes the sum by the difference of two squares, so one vector operation over the
    levels finds the best; of equal ones the fullest bin that fits."""
    count = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    far, bins = np.iinfo(np.int64).max, 0
    for k, s in enumerate(sizes.tolist()):
        best = 0
        if s < capacity:
            here, there = count[1 : capacity - s + 1], count[1 + s :]
            change = np.where(here > 0, 2 * (there - here) + 2, far)
            if here[-1]:
                change[-1] = 1 - 2 * here[-1]  # a bin that becomes full is no longer open
            high = len(change) - 1 - int(change[::-1].argmin())
            if change[high] <= 2 * count[s] + 1:
                best = high + 1
        if best:
            b = waiting[best].pop()
            count[best] -= 1
        else:
            b, bins = bins, bins + 1
        out[k] = b
        if best + s < capacity:
            waiting[best + s].append(b)
            count[best + s] += 1
    return out


def place(pieces: DataFrame, length: int = 4096, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0) to pieces; sizes are in the column length, 1 to `length`.

    Pieces are dealt at random to shards of about `shard` pieces, whatever the number of partitions, and each shard
    is packed on its own, the longest first; only its last few sequences are not nearly full.
    """
    held = cut(pieces)
    shards = max(1, -(-held.count() // shard))

    def run(key: tuple, rows: pa.Table) -> pa.Table:  # Arrow keeps ids whole where others are null
        order = pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        rows = rows.take(order).drop_columns("shard")
        size = rows["length"].to_numpy()
        bins = sum_of_squares(size, length)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(size[order])
        first = np.flatnonzero(np.concatenate(([True], np.diff(bins[order]) > 0)))
        base = np.repeat(ends[first] - size[order][first], np.diff(np.append(first, len(order))))
        offset = np.empty(len(size), np.int64)
        offset[order] = ends - size[order] - base
        number = pa.array((key[0].as_py() << 32) + bins, pa.int64())
        return rows.append_column("sequence_id", number).append_column("offset", pa.array(offset, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    dealt = held.withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, copy, piece), {shards})"))
    return dealt.groupBy("shard").applyInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 1, length: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document lies.

    Null texts are empty, so they have the end id alone. Rows of equal or null doc_id are separate documents, and ids of
    any size stay whole. A text of any length is encoded whole and cut into pieces. An empty table gives no rows; other
    columns are left out. Of equal sizes the smaller doc_id is placed first.
    """
    placed = place(token_pieces(docs, tokenizer, end_id, length), length)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian uint32): the sequences themselves, from token_pieces(ids=True) and place()."""
    parts = placed.select("doc_id", "copy", "piece", "sequence_id", "offset").join(
        pieces.select("doc_id", "copy", "piece", "ids"), ["doc_id", "copy", "piece"]
    )
    listed = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return listed.select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
