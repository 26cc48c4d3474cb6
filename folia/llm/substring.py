"""Passages that repeat across documents, found by their windows of words.

A count-min sketch overestimates how often each window occurs; only windows that it takes for repeated are then
grouped exactly. To keep the sketch small it counts a window under its anchor, the least hash among the shorter word
runs inside the window: equal windows have equal anchors, so a window's estimate is never below its count, and
neighbouring windows mostly share one anchor, which is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import broadcast_if_small, cut, row_key, stored, text_only

#: Rows of the sketch. Its width is the power of two from a cell for TEXT_BYTES of text on, MOST_CELLS at most; a text
#: has an anchor for some 80 bytes. Executors get one bit a cell, 64 MB in all at most.
ROWS = 2
TEXT_BYTES = 16
MOST_CELLS = 1 << 28
LEAST_CELLS = 1 << 16
#: Cells of each row of the bitmap that names places of runs, for each place.
PLACE_CELLS = 16
#: Bytes of text for which a sketch of MOST_CELLS is not too full; beyond them anchors are counted in a shuffle.
SKETCHED = 40 * MOST_CELLS
#: Cells of a part of the sketch: tasks send the touched cells by part, and equal parts are added up.
PART = 1 << 20
#: Windows of one run at most.
RUN = 64
#: Ranges to remove that are broadcast at most, two numbers each; more meet the texts in a shuffle.
BROADCAST_SPANS = 500_000
#: Words that are worked on at a time, and bytes that are hashed at a time.
STEP = 1 << 18
CHUNK = 1 << 17

MIX = np.uint64(0x9E3779B97F4A7C15)
INSIDE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)], np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0, 1, ... modulo 2^64."""
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, base % (1 << 64), np.uint64))))


BYTE, GRAM = 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15  # odd, so that both have an inverse
BYTE_UP, BYTE_DOWN = _powers(BYTE, CHUNK + 1), _powers(pow(BYTE, -1, 1 << 64), CHUNK + 1)
GRAM_UP, GRAM_DOWN = _powers(GRAM, 2 * STEP + 1), _powers(pow(GRAM, -1, 1 << 64), 2 * STEP + 1)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def _chunk_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of at most CHUNK bytes, a polynomial of its bytes, and where the words start."""
    raw = np.frombuffer(text, np.uint8)
    inside = INSIDE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=np.uint8(0), append=np.uint8(0)))
    first, last = edges[0::2], edges[1::2]
    upto = _sums((raw.astype(np.uint64) + np.uint64(1)) * BYTE_UP[: len(raw)])
    return _mixed((upto[last] - upto[first]) * BYTE_DOWN[first]), first


def _giant_hash(word: bytes) -> np.ndarray:
    """The same hash of one word of any length."""
    total, up = 0, 1
    for a in range(0, len(word), CHUNK):
        raw = np.frombuffer(word, np.uint8, min(CHUNK, len(word) - a), a)
        total += up * int(((raw.astype(np.uint64) + np.uint64(1)) * BYTE_UP[: len(raw)]).sum(dtype=np.uint64))
        up = up * pow(BYTE, CHUNK, 1 << 64) % (1 << 64)
    return _mixed(np.array([total % (1 << 64)], np.uint64))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of whole words, of at most CHUNK bytes unless a single word is longer."""
    at = 0
    while len(text) - at > CHUNK:
        piece = text[at : at + CHUNK]
        size = len(piece.rstrip()) if piece[-1:].isspace() else len(piece) - len(piece.split()[-1])
        if not size and not piece.isspace():  # one word fills it
            size = len(text[at:].split(None, 1)[0])
        size = size or CHUNK
        yield text[at : at + size]
        at += size
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    waiting, at, used = [], [], 0

    def flush() -> None:
        nonlocal used
        if waiting:
            h, first = _chunk_hashes(b" ".join(waiting))
            starts = np.cumsum([0, *(len(t) + 1 for t in waiting)])
            counts[at] += np.diff(np.searchsorted(first, starts))
            hashes.append(h)
            waiting.clear()
            at.clear()
            used = 0

    for k, text in enumerate(texts):
        if used + len(text) > CHUNK:
            flush()
        if len(text) <= CHUNK:
            waiting.append(text)
            at.append(k)
            used += len(text) + 1
            continue
        for piece in _pieces(text):
            h = _giant_hash(piece) if len(piece) > CHUNK else _chunk_hashes(piece)[0]
            counts[k] += len(h)
            hashes.append(h)
    flush()
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), counts


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row, by doubling."""
    done = 1
    while done * 2 <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if done < n else x


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window of up to 2 * STEP words in a row, given a hash of each word."""
    gram, n = (window + 1) // 2, len(words)
    upto = _sums(words * GRAM_UP[:n])
    return _least(_mixed((upto[gram:] - upto[:-gram]) * GRAM_DOWN[: n - gram + 1]), window - gram + 1)


def runs(words: np.ndarray, counts: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, number of windows, anchor) of each run of windows of one anchor, in order; words and counts
    are those of word_hashes()."""
    ends = np.cumsum(counts)
    for a in range(0, len(words) - window + 1, STEP):
        least = anchors(words[a : a + STEP + window - 1], window)
        at = np.arange(a, a + len(least))
        text = np.searchsorted(ends, at, "right")
        whole = at + window <= ends[text]
        at, text, least = at[whole], text[whole], least[whole]
        if len(at):
            new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1))))
            yield text[new], at[new] - (ends - counts)[text[new]], np.diff(np.append(new, len(at))), least[new]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in a row in groups of at most STEP words (two bytes a word at least), or of one text: (place, texts)."""
    held, used = [], 0
    for k, text in enumerate(texts):
        if held and used + len(text) > 2 * STEP:
            yield k - len(held), held
            held, used = [], 0
        held.append(text)
        used += len(text) + 1
    if held:
        yield len(texts) - len(held), held


def cells(anchor: np.ndarray, rows: int, width: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch."""
    return [(_mixed(anchor + MIX * np.uint64(r + 1)) & np.uint64(width - 1)).astype(np.int64) for r in range(rows)]


def _marked(touched: DataFrame, rows: int, width: int, least: int) -> list[bytes]:
    """A bit a cell and row, set where all tasks together have touched it so often (one or two times); touched has r, k
    (part), cells (inside the part, in order) and a bit for those that a task has touched twice. Equal parts are added
    up in one task each."""
    part = min(PART, width)

    def bits(now, total):
        return pa.RecordBatch.from_pylist([{"r": now[0], "k": now[1], "often": np.packbits(total >= least).tobytes()}])

    def merge(batches):
        now, total = None, None
        for b in batches:
            for r, k, one, twice in zip(*(b.column(c).to_pylist() for c in ("r", "k", "cells", "twice")), strict=True):
                if now != (r, k):
                    if now:
                        yield bits(now, total)
                    now, total = (r, k), np.zeros(part, np.uint8)
                at = np.frombuffer(one, "<u4")
                total[at] = np.minimum(total[at] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at)), 2)
        if now:
            yield bits(now, total)

    merged = touched.repartition("r", "k").sortWithinPartitions("r", "k").mapInArrow(merge, "r bigint, k bigint, often binary")
    out = [bytearray(width // 8) for _ in range(rows)]
    for x in merged.toLocalIterator():
        out[x.r][x.k * part // 8 : (x.k + 1) * part // 8] = x.often
    return [bytes(x) for x in out]


def _touched(found: np.ndarray, rows: int, width: int) -> Iterator[pa.RecordBatch]:
    """What _marked() takes, for these hashes."""
    part, out = min(PART, width), []
    for r, at in enumerate(cells(found, rows, width)):
        at, n = np.unique(at, return_counts=True)
        new = np.flatnonzero(np.concatenate(([True], at[1:] // part != at[:-1] // part)))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
            one = (at[a:b] % part).astype("<u4").tobytes()
            out.append({"r": r, "k": int(at[a]) // part, "cells": one, "twice": np.packbits(n[a:b] > 1).tobytes()})
    yield pa.RecordBatch.from_pylist(out)


TOUCHED = "r bigint, k bigint, cells binary, twice binary"


def _is_marked(table: list[np.ndarray], hashes: np.ndarray, width: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for row, at in zip(table, cells(hashes, len(table), width), strict=True):
        out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def sketch(docs: DataFrame, window: int, rows: int, width: int) -> list[bytes]:
    """The merged sketch's rows: a bit a cell, set where it counts two or more."""

    def fill(batches):
        found, n = [], 0
        for b in batches:
            for _, texts in _groups(b.column("text").to_pylist()):
                for *_, a in runs(*word_hashes(texts), window):
                    found.append(a)
                    n += len(a)
                if n > 8 * STEP:
                    yield from _touched(np.concatenate(found), rows, width)
                    found, n = [], 0
        if found:
            yield from _touched(np.concatenate(found), rows, width)

    return _marked(text_only(docs).select("text").mapInArrow(fill, TOUCHED), rows, width, 2)


def _word_places(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each starts and ends in that."""
    line = b" ".join(text.split())
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return line, np.append(0, gaps + 1), np.append(gaps, len(line))


def _runs(docs: DataFrame, window: int, often: tuple[list[bytes], int] | None) -> DataFrame:
    """doc_id, row_key, anchor, sig, first, n: all runs, or those whose anchor the given sketch (rows, width) takes for
    repeated. sig is a 128-bit hash of the run's words."""
    shared = docs.sparkSession.sparkContext.broadcast(often) if often else None

    def run(batches):
        table, width = ([np.frombuffer(x, np.uint8) for x in shared.value[0]], shared.value[1]) if shared else ([], 0)
        digest = xxhash.xxh3_128_digest

        for b in batches:
            for place, texts in _groups(b.column("text").to_pylist()):
                out: list[list] = [[], [], [], [], []]
                held, line = -1, b""
                for rows in runs(*word_hashes(texts), window):
                    keep = _is_marked(table, rows[3], width)
                    for k, f, n, a in zip(*(x[keep].tolist() for x in rows[:3]), rows[3][keep].view(np.int64).tolist(), strict=True):
                        if k != held:
                            line, starts, ends = _word_places(texts[k])
                            held, starts, ends = k, starts.tolist(), ends.tolist()
                        for s in range(f, f + n, RUN):
                            m = min(RUN, f + n - s)
                            for c, v in zip(out, (place + k, a, digest(line[starts[s] : ends[s + m + window - 2]]), s, m), strict=True):
                                c.append(v)
                at = pa.array(out[0], pa.int64())
                cols = [b.column("doc_id").take(at), b.column("row_key").take(at)]
                cols += [pa.array(v, t) for v, t in zip(out[1:], (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "anchor", "sig", "first", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = text_only(docs.withColumn("row_key", row_key()), "row_key")
    return keyed.mapInArrow(run, f"doc_id {kind}, row_key bigint, anchor bigint, sig binary, first int, n int")


def repeated_runs(docs: DataFrame, window: int, width: int | None = None, sketched: int = SKETCHED) -> DataFrame:
    """_runs() whose anchor occurs twice, as the sketch says, and beyond `sketched` bytes of text a shuffled count."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > sketched:
        held = stored(_runs(docs, window, None), "runs")
        twice = cut(held.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
        return held.join(twice, "anchor", "left_semi")
    width = width or min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // TEXT_BYTES).bit_length()))
    return stored(_runs(docs, window, (sketch(docs, window, ROWS, width), width)), "runs")


def _place_hash(key, first) -> np.ndarray:
    return _mixed(np.asarray(key, np.int64).view(np.uint64) * MIX + np.asarray(first, np.int64).view(np.uint64))


def _opened(docs: DataFrame, reps: DataFrame, window: int, most: int) -> DataFrame:
    """sig, k, w, low: a 128-bit hash of the words of each window of the runs that start at the places (row_key, first)
    of reps, and of the few whose places share a cell with these.

    The places go to all tasks as a bitmap of PLACE_CELLS or more cells a place. If it takes more than `most` cells, texts and places meet in a
    shuffle first, and each text has its own places."""
    width = max(LEAST_CELLS, 1 << (PLACE_CELLS * reps.count()).bit_length())
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = text_only(docs.withColumn("row_key", row_key()), "row_key")
    if width <= most:

        def fill(batches):
            for b in batches:
                yield from _touched(_place_hash(b.column("row_key").to_numpy(), b.column("first").to_numpy()), ROWS, width)

        marked = _marked(reps.select("row_key", "first").mapInArrow(fill, TOUCHED), ROWS, width, 1)
        shared = docs.sparkSession.sparkContext.broadcast(marked)
    else:
        shared = None
        places = cut(reps.groupBy(F.col("row_key").alias("row")).agg(F.collect_set("first").alias("places")))
        keyed = keyed.join(places, F.col("row_key") == F.col("row")).drop("row")

    def run(batches):
        table, digest = [np.frombuffer(x, np.uint8) for x in shared.value] if shared else None, xxhash.xxh3_128_digest
        for b in batches:
            keys = b.column("row_key").to_numpy()
            own = b.column("places").to_pylist() if shared is None else None
            for place, texts in _groups(b.column("text").to_pylist()):
                at, sig, nth, w = [], [], [], []
                held, line = -1, b""
                for text, first, size, _ in runs(*word_hashes(texts), window):
                    parts = -(-size // RUN)
                    of = np.repeat(np.arange(len(size)), parts)
                    start = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
                    first, text, left = first[of] + start, text[of], size[of] - start
                    if shared:
                        keep = np.flatnonzero(_is_marked(table, _place_hash(keys[place + text], first), width))
                    else:
                        keep = [k for k, (x, f) in enumerate(zip(text.tolist(), first.tolist(), strict=True)) if f in own[place + x]]
                    for k, f, n in zip(text[keep].tolist(), first[keep].tolist(), np.minimum(left[keep], RUN).tolist(), strict=True):
                        if k != held:
                            line, starts, ends = _word_places(texts[k])
                            held, starts, ends = k, starts.tolist(), ends.tolist()
                        at += [place + k] * n
                        sig += [digest(line[starts[f] : ends[f + n + window - 2]])] * n
                        nth += range(n)
                        w += [digest(line[starts[s] : ends[s + window - 1]]) for s in range(f, f + n)]
                cols = [pa.array(sig, pa.binary()), pa.array(nth, pa.int32()), pa.array(w, pa.binary()), b.column("doc_id").take(pa.array(at, pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["sig", "k", "w", "low"])

    return keyed.mapInArrow(run, f"sig binary, k int, w binary, low {kind}")


def repeated_windows(
    docs: DataFrame, window: int = 50, width: int | None = None, sketched: int = SKETCHED, most: int = MOST_CELLS
) -> DataFrame:
    """doc_id, row_key, spans: ranges of the windows of each document that also start in a document of a smaller doc_id,
    as (first window, window after the last).

    A run goes from every document but that of the least doc_id which has it. Under an anchor with several kinds of runs, as
    at the ends of a passage, kinds can share windows: one run of each kind is opened into its windows, these are
    grouped exactly, by 128-bit hashes of their words, and a kind loses those that stand in another one of a smaller
    doc_id. Joins against a common run or window meet stored aggregates, so that Spark can split them where
    they are skewed.
    """
    docs = docs.where("doc_id is not null")
    held = repeated_runs(docs, window, width, sketched)
    kinds = cut(held.groupBy("sig").agg(
        F.min(F.struct("doc_id", "row_key", "first", "n")).alias("rep"), F.first("anchor").alias("anchor"), F.count("*").alias("times")
    ))
    mixed = cut(kinds.groupBy("anchor").agg(F.count("*").alias("n_sigs")).where("n_sigs > 1").select("anchor"))
    slim = held.select("doc_id", "row_key", "sig", "first", "n")
    span = lambda a, n: F.struct(a.alias("a"), (a + n).alias("b"))
    alike = cut(kinds.where("times > 1").select("sig", F.col("rep.doc_id").alias("low")))
    whole = slim.join(alike, "sig").where("doc_id > low").select("doc_id", "row_key", F.array(span(F.col("first"), F.col("n"))).alias("at"))
    reps = cut(kinds.join(broadcast_if_small(mixed), "anchor", "left_semi").select("rep.row_key", "rep.first"))
    opened = stored(_opened(docs, reps, window, most), "windows")
    least = cut(opened.groupBy("w").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most").select("w", "least"))
    # of a kind several runs may be open, where places share a cell; its least doc_id's always is
    lost = opened.join(least, "w").groupBy("sig", "k").agg(F.min("low").alias("low"), F.min("least").alias("least"))
    lost = cut(lost.where("least < low").groupBy("sig").agg(F.collect_set("k").alias("ks")))
    partly = slim.join(lost, "sig").select("doc_id", "row_key", F.transform("ks", lambda k: span(F.col("first") + k, F.lit(1))).alias("at"))
    lists = whole.unionByName(partly).groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("at")).alias("at"))

    def merge(batches):
        for b in batches:
            out = []
            for at in b.column("at").to_pylist():
                spans: list[list[int]] = []
                for x in sorted((x["a"], x["b"]) for x in at):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                out.append(spans)
            cols = [b.column("doc_id"), b.column("row_key"), pa.array(out, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return lists.mapInArrow(merge, f"doc_id {kind}, row_key bigint, spans array<array<int>>")


def without_repeats(docs: DataFrame, window: int = 50, width: int | None = None, sketched: int = SKETCHED, most: int = MOST_CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, removed (word ranges) of each row: its words, without those that lie in
    a window whose words also start in a document of a smaller doc_id. Words are runs without x20 and x09-x0D.

    Kept words are joined by one space. A null text has no words. Repeats inside one document stay. Rows of equal
    doc_id are not smaller than each other; a null doc_id is neither smaller nor larger than any, so nothing goes
    from such a row, nor because of it. Windows are judged on the input alone.
    """
    found = cut(repeated_windows(docs, window, width, sketched, most))
    total = found.agg(F.sum(F.size("spans"))).first()[0] or 0
    named = found.select(F.col("row_key").alias("k"), F.col("doc_id").alias("d"), "spans")
    named = F.broadcast(named) if total <= BROADCAST_SPANS else named
    keyed = text_only(docs.withColumn("row_key", row_key()), "row_key")
    both = keyed.join(named, (F.col("row_key") == F.col("k")) & (F.col("doc_id") == F.col("d")), "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.split()
                gone: list[list[int]] = []
                for first, last in spans or ():  # of windows; of words up to window - 1 further
                    if gone and first <= gone[-1][1]:
                        gone[-1][1] = last + window - 1
                    else:
                        gone.append([first, last + window - 1])
                kept, at = [], 0
                for first, last in gone:
                    kept += words[at:first]
                    at = last
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), gone))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "n_words", "n_removed", "kept_text", "removed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string, removed array<array<bigint>>")
