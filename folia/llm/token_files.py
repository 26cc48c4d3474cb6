"""Token ids in files of fixed-width bit packing.

A file: blocks of BLOCK ids (the last may hold fewer), each id in as few bits as the vocabulary needs, 64 ids in
as many 64-bit words as an id has bits; the offsets of the blocks; the documents' ids and lengths; a footer. Any run
of ids is read from its blocks alone, and unpacked by numpy without a loop over ids.
"""

from __future__ import annotations

import itertools
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import fresh_path, text_only
from folia.llm.tokens import encoder

BLOCK = 1 << 16
FOOTER = struct.Struct("<8sIIQQQQ")  # magic, bits, ids a block, ids, documents, place of the offsets, of the documents
MAGIC = b"IDPACK01"
#: Ids of a document, and documents, that are handled at a time when they are read.
READ_IDS = 1 << 22
READ_DOCS = 1 << 16
#: Documents of a file.
FILE_DOCS = 1 << 14


def bits_for(size: int) -> int:
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids become exactly `bits` words of 64 bits; the tail is filled with zeros to a multiple of 64."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), bits), "<u8")
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.zeros((len(words), 64), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, k] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            out[:, k] |= words[:, word + 1] << np.uint64(64 - shift)
    return (out.reshape(-1)[:n] & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Writes one file to a temporary name and renames it, so that a task's second attempt does no harm."""

    def __init__(self, uri: str, bits: int):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(posixpath.dirname(self.path))
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.bits, self.waiting, self.held = bits, [], 0
        self.offsets, self.ids, self.docs, self.lengths, self.at = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id needs more bits than the vocabulary")
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        a = 0
        while len(ids) - a >= least and a < len(ids):
            data = pack(ids[a : a + BLOCK], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
            a += BLOCK
        self.waiting, self.held = [ids[a:]], max(0, len(ids) - a)

    def close(self) -> tuple[int, int]:
        self._flush(1)
        table = np.array(self.offsets, "<u8").tobytes()
        docs = np.array([0 if d is None else d for d in self.docs], "<i8").tobytes()
        docs += np.array(self.lengths, "<u8").tobytes() + np.array([d is None for d in self.docs], np.uint8).tobytes()
        foot = FOOTER.pack(MAGIC, self.bits, BLOCK, self.ids, len(self.docs), self.at, self.at + len(table))
        self.out.write(table + docs + foot)
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.docs), self.ids


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, uri: str):
        self.held: tuple[int, int, np.ndarray] | None = None
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block, self.ids, n, table, docs = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        self.offsets = np.append(np.frombuffer(self._at(table, docs - table), "<u8"), np.uint64(table))
        raw = self._at(docs, 17 * n)
        none = np.frombuffer(raw, np.uint8, n, 16 * n)
        self.docs = [None if z else d for d, z in zip(np.frombuffer(raw, "<i8", n).tolist(), none, strict=True)]
        self.lengths = np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1] if n else np.zeros(0, np.int64)

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(int(place))
        return self.file.read(int(n))

    def read(self, start: int, n: int) -> np.ndarray:
        """The ids start..start+n of the file."""
        if not n:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        if not self.held or first < self.held[0] or last > self.held[1]:
            data = self._at(self.offsets[first], int(self.offsets[last + 1]) - int(self.offsets[first]))
            # every block but the file's last is full, and full blocks have no filling between them
            ids = unpack(data, self.bits, min((last + 1) * self.block, self.ids) - first * self.block)
            self.held = first, last, ids  # the next document mostly lies in the same blocks
        at = start - self.held[0] * self.block
        return self.held[2][at : at + n]


@dataclass(frozen=True)
class Shard:
    uri: str
    docs: int
    ids: int
    start: int  # ids in all files before it


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None, uri: str | None = None, file_docs: int = FILE_DOCS) -> list[Shard]:
    """Encodes every whole text, appends end_id and writes the ids in ascending doc_id order, about file_docs documents a file.

    Texts move once, compressed, to the task that encodes and writes them: their ids would take as much (521 MB against 559 on
    half a GB), and would have to be stored first, since a range partitioning reads its input twice.

    A null text counts as empty, a null doc_id comes first, rows of equal doc_id follow each other in the order of
    their bytes. doc_id has to be an integer. The list has an entry a file that is not empty. An empty table writes nothing. The folder has to be one that all executors reach.
    """
    spark = docs.sparkSession
    uri = uri or fresh_path(spark, "token-files")

    def run(batches):
        enc, writer = encoder(tokenizer), None
        end = np.zeros(0, "<u4") if end_id is None else np.array([end_id], "<u4")
        name = f"{uri}/{TaskContext.get().partitionId():08d}.ids"
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                writer = writer or Writer(name, bits_for(max(enc.tokens.library.get_vocab_size(), (end_id or 0) + 1)))
                writer.add(doc_id, np.concatenate((enc.encode(text.as_py().decode()), end)))
        if writer:
            n, ids = writer.close()
            yield pa.RecordBatch.from_pylist([{"uri": name, "docs": n, "ids": ids}])

    ordered = text_only(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")))
    files = max(1, -(-docs.count() // file_docs))
    ordered = ordered.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = sorted(ordered.mapInArrow(run, "uri string, docs bigint, ids bigint").collect())
    starts = np.cumsum([0, *(r.ids for r in rows)]).tolist()
    return [Shard(r.uri, r.docs, r.ids, s) for r, s in zip(rows, starts, strict=False)]


def _documents(shard: Shard) -> Iterator[tuple]:
    reader = Reader(shard.uri)
    for doc_id, a, n in zip(reader.docs, reader.starts.tolist(), reader.lengths.tolist(), strict=True):
        crc = 0
        for at in range(a, a + n, READ_IDS):
            crc = zlib.crc32(reader.read(at, min(READ_IDS, a + n - at)), crc)
        yield doc_id, shard.start + a, n, crc


def read_token_files(docs: DataFrame, shards: list[Shard]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files."""
    spark, schema = docs.sparkSession, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                rows = _documents(shards[k])
                while part := list(itertools.islice(rows, READ_DOCS)):
                    cols = [pa.array(c, pa.int64()) for c in zip(*part, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(run, schema)
