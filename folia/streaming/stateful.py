"""Stateful operators over streams of completion pieces and of pages, and their batch forms.

State is kept by key in the RocksDB state store; a key's state ends with its stream (a piece marked last). A stream that is
broken off ends idle_ms after its last piece, if that is given; such queries run until they are stopped, since Spark
starts batches for the clock alone."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folia.functions.arrow import bound_batches
from folia.streaming.guards import JsonCloseGuard, Limits, LoopGuard

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["doc_id", "page", "attempt"]
FIRED = "doc_id bigint, page int, attempt int, guard string, at_chars bigint"
_KEYS = [("doc_id", pa.int64()), ("page", pa.int32()), ("attempt", pa.int32())]
FOUND = pa.schema([*_KEYS, ("guard", pa.string()), ("at_chars", pa.int64())])
BOTH = pa.schema([*_KEYS, ("chars", pa.int64()), ("old", pa.string()), ("old_at", pa.int64()), ("new", pa.string()), ("new_at", pa.int64())])


def use_rocks(spark: SparkSession) -> None:
    """transformWithState needs this state store; set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def folds(pieces: Iterable[str], close: JsonCloseGuard, loops: list[LoopGuard]) -> list[tuple[str, int] | None]:
    """What fires first for each loop guard over pieces in order: the close guard looks before the loop guards."""
    found: list[tuple[str, int] | None] = [None] * len(loops)
    if close.fired:
        return found
    going = [k for k, loop in enumerate(loops) if not loop.fired]
    for piece in pieces:
        if not going:
            break
        if close.add(piece):
            for k in going:
                found[k] = "json_close", close.seen
            break
        for k in going:
            if which := loops[k].add(piece):
                found[k] = which, loops[k].at
        going = [k for k in going if not found[k]]
    return found


def _streams(pieces: DataFrame) -> DataFrame:
    """One row a stream, with its pieces in order of seq."""
    from pyspark.sql import functions as F

    bound_batches(pieces.sparkSession)
    held = F.sort_array(F.collect_list(F.struct(F.col("seq").isNull().alias("last"), "seq", "piece")))
    key = [F.col(k).cast(t).alias(k) for k, t in zip(KEY, ("bigint", "int", "int"), strict=True)]
    return pieces.groupBy(*KEY).agg(held["piece"].alias("pieces")).select(*key, "pieces")


def _told(batch: pa.RecordBatch, schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """A batch of KEY and what has been found for its rows; rows without a finding, None, are left out."""
    keys = zip(*(batch.column(k).to_pylist() for k in KEY), strict=True)
    found = [(*key, *row) for key, row in zip(keys, rows, strict=True) if row is not None]
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in found], schema)


def replay(pieces: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The guards over stored pieces: one row for each stream in which one fires."""
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _told(b, FOUND, [folds(x.as_py(), JsonCloseGuard(), [LoopGuard(limits)])[0] for x in b.column("pieces")])

    return _streams(pieces).mapInArrow(run, FIRED)


def compared(pieces: DataFrame, old: Limits, new: Limits) -> DataFrame:
    """Two sets of limits over stored pieces, one row a stream: which guard of each fires and where; null where none does."""

    def one(texts: list[str]) -> tuple:
        a, b = folds(texts, JsonCloseGuard(), [LoopGuard(old), LoopGuard(new)])
        return sum(map(len, texts)), *(a or (None, None)), *(b or (None, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _told(b, BOTH, [one(x.as_py()) for x in b.column("pieces")])

    return _streams(pieces).mapInArrow(run, "doc_id bigint, page int, attempt int, chars bigint, old string, old_at bigint, new string, new_at bigint")


class _Guards(StatefulProcessor):
    def __init__(self, limits: Limits, idle_ms: int | None):
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("guards", "close string, loop string", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        close, loop = JsonCloseGuard(), LoopGuard(self.limits)
        if self.state.exists():
            a, b = self.state.get()
            close, loop = JsonCloseGuard(**json.loads(a)), LoopGuard.load(self.limits, b)
        batch = pd.concat(list(rows))
        found = folds(batch.sort_values("seq")["piece"], close, [loop])[0]
        if batch["last"].any():
            self.state.clear()
        else:
            if loop.fired or close.fired:
                loop.text = ""  # a stream that has been stopped needs no more of its text
            self.state.update((json.dumps(asdict(close)), loop.dump()))
        yield pd.DataFrame([(*key, *found)] if found else [], columns=[*KEY, "guard", "at_chars"])

    def close(self) -> None:
        pass


def _mode(idle_ms: int | None) -> str:
    return "ProcessingTime" if idle_ms else "None"


def guarded(pieces: DataFrame, limits: Limits | None = None, idle_ms: int | None = None) -> DataFrame:
    """The guards over a stream of doc_id, page, attempt, seq, piece, last. Batches must bring a stream's pieces in
    order; within a batch they are sorted."""
    return pieces.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=_Guards(limits or Limits(), idle_ms), outputStructType=FIRED, outputMode="Append", timeMode=_mode(idle_ms)
    )


class _InOrder(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "page int", self.idle_ms)
        self.held = handle.getMapState("held", "page int", "text string", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 1
        for page, text in ((int(p), t) for b in rows for p, t in zip(b["page"], b["text"], strict=True)):
            if page >= at:
                self.held.updateValue((page,), (text,))
        out = []
        while self.held.containsKey((at,)):
            out.append((key[0], at, self.held.getValue((at,))[0]))
            self.held.removeKey((at,))
            at += 1
        self.next.update((at,))
        yield pd.DataFrame(out, columns=["doc_id", "page", "text"])

    def close(self) -> None:
        pass


def in_page_order(pages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Pages of a stream (doc_id, page, text) in order: page k waits until pages 1 to k - 1 have come; repeats of a
    page that has gone out are dropped."""
    return pages.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=_InOrder(idle_ms), outputStructType="doc_id bigint, page int, text string", outputMode="Append", timeMode=_mode(idle_ms)
    )


class _Sections(StatefulProcessor):
    """Sections of a document whose pages come in order: paragraphs up to a number of tokens (four characters each),
    and each section starts with the last paragraphs of the one before."""

    def __init__(self, limit: int, overlap: int, idle_ms: int | None):
        self.limit, self.overlap, self.idle_ms = limit, overlap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n int, paragraphs array<string>", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, held = self.held.get() if self.held.exists() else (0, [])
        held, out, over = list(held), [], False
        for _, text, last in sorted((int(p), t, bool(e)) for b in rows for p, t, e in zip(b["page"], b["text"], b["last"], strict=True)):
            for part in filter(None, map(str.strip, text.split("\n\n"))):
                if held and sum(len(h) // 4 for h in held) + len(part) // 4 > self.limit:
                    out.append((key[0], n, "\n\n".join(held)))
                    n += 1
                    kept, used = [], 0
                    for h in reversed(held):
                        used += len(h) // 4
                        if used > self.overlap:
                            break
                        kept.insert(0, h)
                    held = kept
                held.append(part)
            over |= last
        if over:
            out += [(key[0], n, "\n\n".join(held))] if held else []
            self.held.clear()
        else:
            self.held.update((n, held))
        yield pd.DataFrame(out, columns=["doc_id", "section", "text"])

    def close(self) -> None:
        pass


def sections(pages: DataFrame, limit: int = 6000, overlap: int = 1000, idle_ms: int | None = None) -> DataFrame:
    """A stream of doc_id, page, text, last as sections: doc_id, section, text. What is left comes with the last page."""
    return pages.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=_Sections(limit, overlap, idle_ms), outputStructType="doc_id bigint, section int, text string", outputMode="Append", timeMode=_mode(idle_ms)
    )


#: Parts of a window by which windows slide.
PARTS = 5


def recent_error_counts(results: DataFrame, seconds: int = 300, late: str = "10 minutes", sliding: bool = True) -> DataFrame:
    """Errors of each document in windows of event time that slide by a fifth, with a watermark that bounds the state. Not
    sliding: in the fifths alone, each result in one of them instead of five windows; slid() adds them up."""
    from pyspark.sql import functions as F

    part = f"{seconds // PARTS} seconds"
    windows = F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds" if sliding else part, part)
    dated = results.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return dated.groupBy("doc_id", windows.alias("w")).agg(F.count_if(F.col("status") == "transport_error").alias("errors"))


def slid(parts: DataFrame, seconds: int = 300) -> DataFrame:
    """doc_id, since, errors of the fifths of windows, by their start, as those of the sliding windows that hold any of them."""
    from pyspark.sql import functions as F

    if seconds % PARTS:
        raise ValueError(f"a window of {seconds} seconds is not {PARTS} equal parts")
    starts = F.array(*[F.col("since") - F.make_dt_interval(secs=F.lit(k * (seconds // PARTS))) for k in range(PARTS)])
    return parts.select("doc_id", F.explode(starts).alias("since"), "errors").groupBy("doc_id", "since").agg(F.sum("errors").alias("errors"))
