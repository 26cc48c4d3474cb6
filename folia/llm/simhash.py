"""Near-duplicates by SimHash. Fingerprints meet in buckets of equal bit blocks and are compared bit-sliced there:
64 of them lie vertically, a bit plane a word, carry-save counters add up 64 distances at once, and a block is
abandoned once all its distances exceed the radius."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from folia.llm.common import LOWER, broadcast_if_small, cut, text_only
from folia.llm.graph import connected_components

SEED = 42
#: Shingles hashed at a time, so that a very long text takes bounded memory.
STEP = 1 << 15
#: A bucket of more fingerprints than this is dealt out to slots, and each pair of slots is a group of its own.
SLOT = 2048
#: The same where buckets are divided further by nested_blocks().
NESTED_SLOT = 1 << 16
#: Buckets of at most this many rows are compared pair by pair, larger ones bit-sliced.
FEW = 128
#: Pairs of a fingerprint and a 64-lane block under comparison at a time.
LANES_AT_ONCE = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of so many words, space-joined, repeats included; fewer words are one shingle."""
    n = len(words) - size + 1
    if words and n < 1:
        n, size = 1, len(words)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends))[:-1]
    hashed = xxhash.xxh64_intdigest
    for a in range(0, max(n, 0), STEP):
        b = min(n, a + STEP)
        spans = zip(starts[a:b].tolist(), (ends[a + size - 1 : b + size - 1] - 1).tolist(), strict=True)
        yield np.fromiter((hashed(joined[x:y], SEED) for x, y in spans), np.uint64, b - a)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash (the finaliser of splitmix64)."""
    z = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, size: int, bits: int, repeats: bool = True) -> bytes:
    """A bit is 1 if it is set in over half of the shingle hashes; the first 64 bits are those of XXH64 itself. Without
    repeats each distinct shingle counts once."""
    ones, n = np.zeros(bits, np.int64), 0
    hashes = shingle_hashes(text.translate(LOWER).split(), size)
    if not repeats:
        whole = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        hashes = (whole[a : a + STEP] for a in range(0, len(whole), STEP))
    for h in hashes:
        n += len(h)
        for k in range(bits // 64):
            part = (_mixed(h, k) if k else h).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones[64 * k : 64 * k + 64] += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(
    docs: DataFrame, size: int = 4, bits: int = 64, carry: tuple[str, ...] = (), repeats: bool = True
) -> DataFrame:
    """doc_id, the columns named in carry, fp (binary, most significant bit first). No words: all bits zero."""
    assert bits % 64 == 0

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, size, bits, repeats) for t in b.column("text").to_pylist()]
            kept = ["doc_id", *carry]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fps, pa.binary())], [*kept, "fp"])

    rows = text_only(docs, *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(run, f"{kinds}, fp binary")


def exact_blocks(bits: int, radius: int, n: int) -> list[np.ndarray]:
    """Bit positions of each key such that any two fingerprints within the radius share at least one key: of m
    blocks, radius blocks can differ, so each choice of m - radius blocks is a key. More fingerprints take more and
    longer keys, which keeps the buckets small; the links found are the same."""
    m = radius + 1
    while bits * (m - radius) // m < min(32, n.bit_length() - 7):
        m += 1
    parts = np.array_split(np.arange(bits), m)
    return [np.concatenate(c) for c in itertools.combinations(parts, m - radius)]


def sampled_blocks(bits: int, width: int, tables: int) -> list[np.ndarray]:
    """So many fixed choices of bit positions, for radii too wide for exact_blocks()."""
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.permutation(bits)[:width]) for _ in range(tables)]


def nested_blocks(bits: int, width: int, tables: int, inner: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Choices of 8 positions, and for each of them so many choices of width - 8 further positions (table, choice,
    position). A fingerprint is sent once a table, and a task applies the further choices to the bucket it holds."""
    rng = np.random.default_rng(SEED)
    order = [rng.permutation(bits) for _ in range(tables)]
    further = [[rng.permutation(o[8:])[: width - 8] for _ in range(inner)] for o in order]
    return [np.sort(o[:8]) for o in order], np.array(further)


def nested_miss(bits: int, width: int, tables: int, inner: int, distance: int) -> float:
    """The chance that two fingerprints that differ in so many bits share no key of nested_blocks()."""
    share = math.comb(bits - distance, 8) / math.comb(bits, 8)
    further = math.comb(bits - 8 - distance, width - 8) / math.comb(bits - 8, width - 8)
    return (1 - share * (1 - (1 - further) ** inner)) ** tables


def _keys(nodes: DataFrame, blocks: list[np.ndarray]) -> DataFrame:
    def run(batches):
        for b in batches:
            fps = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            on = np.unpackbits(fps, axis=1)
            for t, at in enumerate(blocks):
                key = (on[:, at].astype(np.int64) << np.arange(len(at))).sum(1) | (t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("fp"), b.column("node")], ["key", "fp", "node"])

    return nodes.mapInArrow(run, "key bigint, fp binary, node bigint")


def _add(counter: list[np.ndarray], x: list[np.ndarray]) -> None:
    """Eight bit planes into the bit-sliced counter, by carry-save adders."""

    def csa(a, b, c):
        u = a ^ b
        return (a & b) | (u & c), u ^ c

    t0, one = csa(counter[0], x[0], x[1])
    t1, one = csa(one, x[2], x[3])
    f0, two = csa(counter[1], t0, t1)
    t0, one = csa(one, x[4], x[5])
    t1, one = csa(one, x[6], x[7])
    f1, two = csa(two, t0, t1)
    carry, four = csa(counter[2], f0, f1)
    counter[:3] = one, two, four
    for k in range(3, len(counter)):
        counter[k], carry = counter[k] ^ carry, counter[k] & carry


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count exceeds the radius."""
    over, same = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same &= counter[k]
        else:
            over |= same & counter[k]
            same &= ~counter[k]
    return over


def pairs_within(fps: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """fps: uint8 rows, group after group. ends: for each row, where its group ends. Yields index pairs (q < r) of
    the same group that differ in at most radius bits."""
    n, bits = len(fps), fps.shape[1] * 8
    on = np.unpackbits(fps, axis=1)
    padded = np.zeros((-(-n // 64) * 64, bits), np.uint8)
    padded[:n] = on
    planes = np.packbits(padded.reshape(-1, 64, bits), axis=1, bitorder="little")
    planes = np.ascontiguousarray(planes.transpose(2, 0, 1)).view("<u8")[:, :, 0]
    on = np.ascontiguousarray(on.T)
    rows = np.flatnonzero(ends > np.arange(n) + 1)
    blocks = (ends[rows] - 1) // 64 - (rows + 1) // 64 + 1
    at = np.concatenate(([0], np.cumsum(blocks)))
    for first in range(0, int(at[-1]), LANES_AT_ONCE):
        slot = np.arange(first, min(first + LANES_AT_ONCE, int(at[-1])))
        which = np.searchsorted(at, slot, "right") - 1
        q = rows[which]
        tile = (q + 1) // 64 + slot - at[which]
        low = np.maximum(q + 1 - tile * 64, 0).astype(np.uint64)
        high = np.minimum(ends[q] - tile * 64, 64).astype(np.uint64)
        live = (ALL << low) & (ALL >> (np.uint64(64) - high))
        counter = [np.zeros_like(live) for _ in range(bits.bit_length())]
        for b in range(0, bits, 8):
            _add(counter, [planes[k][tile] ^ (np.uint64(0) - on[k][q].astype(np.uint64)) for k in range(b, b + 8)])
            live &= ~_beyond(counter, radius)
            keep = live != 0
            if keep.sum() * 2 < len(keep):
                q, tile, live = q[keep], tile[keep], live[keep]
                counter = [c[keep] for c in counter]
                if not len(q):
                    break
        hit = np.flatnonzero(live)
        lanes = np.unpackbits(live[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, lane = np.nonzero(lanes)
        yield q[hit][a], tile[hit][a] * 64 + lane


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (smallest index) after linking a with b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole groups (equal key, i, j) of rows that come in order: group, fp rows and node of each row."""
    held: list[tuple] = []
    for b in itertools.chain(batches, [None]):
        if b is not None and b.num_rows:
            group = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], axis=1)
            fps = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(-1, width)
            held.append((group, fps, b.column("node").to_numpy(zero_copy_only=False)))
        if not held or b is not None and not b.num_rows:
            continue
        group, fps, node = (np.concatenate(x) for x in zip(*held, strict=True))
        last = len(group)
        if b is not None:
            other = np.flatnonzero((group != group[-1]).any(1))
            last = int(other[-1]) + 1 if len(other) else 0
        held = [(group[last:], fps[last:], node[last:])] if last < len(group) else []
        if last:
            yield group[:last], fps[:last], node[:last]


def pairs_of_few(fps: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What pairs_within() yields, pair by pair: cheaper where groups are far smaller than 64 lanes."""
    words, n = np.ascontiguousarray(fps).view(np.uint64), len(fps)
    partners = ends - np.arange(n) - 1
    upto = np.concatenate(([0], np.cumsum(partners)))
    first = 0
    while first < n:
        last = max(int(np.searchsorted(upto, upto[first] + (LANES_AT_ONCE << 2), "right")) - 1, first + 1)
        q = np.repeat(np.arange(first, last), partners[first:last])
        r = q + 1 + np.arange(len(q)) - (upto[q] - upto[first])
        differ = np.bitwise_count(words[q] ^ words[r]).sum(1, dtype=np.int64)
        hit = np.flatnonzero(differ <= radius)
        yield q[hit], r[hit]
        first = last


def _parts(key: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows in the order of their key, where each one's run of that key ends, and whether the runs are of few rows.
    Runs that are joined already are left out."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    size = np.diff(np.append(first, len(order)))
    apart = np.minimum.reduceat(root[order], first) != np.maximum.reduceat(root[order], first)
    for few in (True, False):
        chosen = apart & ((size <= FEW) == few)
        rows, sizes = order[np.repeat(chosen, size)], size[chosen]
        if len(rows):
            yield rows, np.repeat(np.cumsum(sizes), sizes), few


def links(
    nodes: DataFrame, blocks: list[np.ndarray], bits: int, radius: int, slot: int = SLOT, further: np.ndarray | None = None
) -> DataFrame:
    """(u, v): for the rows of each task, a forest that connects what links of at most radius bits connect.

    further: the second part of nested_blocks(); only rows that also agree in one of its choices are compared."""
    keyed = _keys(nodes, blocks)
    large = keyed.groupBy("key").count().where(F.col("count") > slot)
    large = cut(large.select("key", F.ceil(F.col("count") / slot).cast("int").alias("slots")))
    dealt = keyed.join(broadcast_if_small(large), "key", "left").select(
        "key", "fp", "node", F.coalesce("slots", F.lit(1)).alias("slots")
    )
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(fp), slots) as int)")).withColumn(
        "other", F.explode(F.expr("sequence(0, slots - 1)"))
    )
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "node")

    def run(batches):
        for group, fps, node in _groups(batches, bits // 8):
            new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(1))))
            size = np.diff(np.append(new, len(group)))
            wanted = np.repeat(size > 1, size)
            ends = np.cumsum(size[size > 1])
            if not len(ends):
                continue
            fps, node, table = fps[wanted], node[wanted], group[wanted, 0] >> 40
            ends, root = np.repeat(ends, size[size > 1]), np.arange(len(node))
            if further is None:
                for a, b in pairs_within(fps, ends, radius):
                    root = joined(root, a, b)
            else:
                on = np.unpackbits(fps, axis=1)
                for k in range(further.shape[1]):
                    at = further[table, k]
                    part = (np.take_along_axis(on, at, 1).astype(np.int64) << np.arange(at.shape[1])).sum(1)
                    for rows, stops, few in _parts(ends << at.shape[1] | part, root):
                        for a, b in (pairs_of_few if few else pairs_within)(fps[rows], stops, radius):
                            root = joined(root, rows[a], rows[b])
            off = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[off]), pa.array(node[root[off]])], ["u", "v"])

    return (
        dealt.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(run, "u bigint, v bigint")
        .distinct()
    )


def simhash_components(
    docs: DataFrame,
    words: int = 4,
    bits: int = 64,
    radius: int = 4,
    tables: int | None = None,
    width: int = 16,
    slot: int | None = None,
    carry: tuple[str, ...] = (),
    repeats: bool = True,
    inner: int | None = None,
) -> DataFrame:
    """doc_id, the columns named in carry, fp, component, component_id: the smallest doc_id reachable over fingerprints that differ in at
    most radius bits. component is a number of the component that no other has, even where rows of one doc_id lie in several.

    doc_id has to be an integer: components are found over bigint ids, and another type is an error.

    tables None: candidates by exact_blocks(), which miss nothing. Else by sampled_blocks(), or with inner by
    nested_blocks(), which miss what nested_miss() says. Equal fingerprints are
    compared once. repeats says whether a shingle counts as often as it occurs. A null text has no words. A text of any
    length is read whole, some shingles at a time. Rows of equal doc_id each count; a null doc_id names no component, and
    a component of such rows alone has a null id. An empty table gives no rows. Columns that carry does not name are
    left out, whatever they are called.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be an integer")
    held = cut(fingerprints(docs, words, bits, carry, repeats))
    # a node is a fingerprint: rows of one doc_id may have several
    nodes = cut(held.groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("low")).withColumn("node", F.monotonically_increasing_id()))
    known = nodes.where("low is not null").select("fp", "node")
    further = None
    if tables and inner:
        blocks, further = nested_blocks(bits, width, tables, inner)
    else:
        blocks = sampled_blocks(bits, width, tables) if tables else exact_blocks(bits, radius, known.count())
    slot = slot or (NESTED_SLOT if inner else SLOT)
    found = cut(connected_components(links(known, blocks, bits, radius, slot, further)))
    lows = cut(found.join(nodes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("component_id")))
    named = found.join(broadcast_if_small(lows), "component")
    group = nodes.join(named, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "low").alias("component_id"))
    return held.join(group, "fp").select("doc_id", *carry, "fp", "component", "component_id")
