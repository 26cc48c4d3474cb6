"""Toxicity from subword bags: character n-gram vectors are averaged over a segment of words (by default one) and go into
a linear softmax; vectors and softmax are trained jointly, in numpy. A document is as toxic as its most toxic segment,
so that a few words count in a text of any length; misspellings that no label has shown share n-grams with known words."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folia.llm.common import alnum_words, text_only
from folia.llm.tokens import Remembered, forget

#: Labelled rows that the fit takes at most (a documented bound; up to half of them toxic), chosen by a hash of
#: doc_id over all labelled rows.
FIT_ROWS = 8000
#: n-grams that the fit sums up at a time.
PART = 1 << 19


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18  # n-gram hashes, a power of two
    dim: int = 8
    lengths: tuple[int, ...] = (3, 4, 5)
    segment: int = 1  # words in a bag; in longer ones the neighbours of a toxic word can drown it
    seen: int = 5  # words, each counted once a document, that must have an n-gram before it counts
    known: float = 0.5  # least share of its n-grams that a word's sum is divided by; others that no label has shown don't dilute it
    drop: float = 0.3  # share of n-grams left out of a step, so that each learns to speak for its word
    warm: int = 30  # steps in which every segment has its document's label
    steps: int = 90  # steps in all; later ones look at each document's most toxic segment and at those that count as toxic
    again: int = 6  # steps between two searches for these segments
    rate: float = 0.1
    decay: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # buckets x dim
    softmax: np.ndarray  # dim x 2
    bias: np.ndarray  # 2
    settings: Settings


def lowered(text: bytes) -> list[bytes]:
    return alnum_words(text.decode().lower().encode())


def ngrams(word: bytes, s: Settings) -> list[int]:
    """Buckets of the word's character n-grams, with marks at its ends, and of the word itself."""
    w, mask, crc = b"<%b>" % word, s.buckets - 1, zlib.crc32
    if not word.isascii():
        t = w.decode()
        return [crc(t[k : k + n].encode()) & mask for n in s.lengths for k in range(len(t) - n + 1)] + [crc(w) & mask]
    return [crc(w[k : k + n]) & mask for n in s.lengths for k in range(len(w) - n + 1)] + [crc(w) & mask]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))[:-1]


class _Grams:
    """The n-grams of each word, one after another. They are many, so sums over them go a part at a time."""

    def __init__(self, flat: np.ndarray, held: np.ndarray):
        self.flat, self.held = flat, held
        self.upto = np.concatenate(([0], np.cumsum(held)))

    def _parts(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Words, their n-grams, and how many each has."""
        cuts = np.searchsorted(self.upto, np.arange(0, len(self.flat), PART)).tolist()
        for i, j in pairwise(sorted({0, *cuts, len(self.held)})):
            yield slice(i, j), slice(self.upto[i], self.upto[j]), self.held[i:j]

    def by_word(self, value: np.ndarray, each: bool = False) -> np.ndarray:
        """Sums by word of the values of its n-grams' buckets or, with each, of a value for each n-gram."""
        out = np.zeros(len(self.held))
        for words, grams, n in self._parts():
            out[words] = np.bincount(np.repeat(np.arange(len(n)), n), value[grams] if each else value[self.flat[grams]], len(n))
        return out

    def by_bucket(self, value: np.ndarray, buckets: int) -> np.ndarray:
        """Sums by bucket of the values of words."""
        out = np.zeros(buckets)
        for words, grams, n in self._parts():
            out += np.bincount(self.flat[grams], np.repeat(value[words], n), buckets)
        return out

    def where(self, keep: np.ndarray) -> _Grams:
        return _Grams(self.flat[keep], self.by_word(keep, True).astype(np.int64))


class _Bags:
    """Segments of words, words of n-grams: means over both, and how a change of the means comes back."""

    def __init__(self, grams: _Grams, size: np.ndarray, word: np.ndarray, lengths: np.ndarray):
        self.grams, self.size, self.word, self.lengths = grams, size, word, lengths
        self.first, self.of = _starts(lengths), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)

    def means(self, value: np.ndarray) -> np.ndarray:
        by_type = self.grams.by_word(value) / self.size
        return np.add.reduceat(by_type[self.word], self.first) / self.lengths

    def back(self, error: np.ndarray, buckets: int) -> np.ndarray:
        by_type = np.bincount(self.word, (error / self.lengths)[self.of], len(self.size)) / self.size
        return self.grams.by_bucket(by_type, buckets)

    def thinned(self, keep: np.ndarray) -> _Bags:
        """Some of the n-grams of each word, averaged as if they were all."""
        grams = self.grams.where(keep)
        return _Bags(grams, np.maximum(1, self.size * (grams.held / np.maximum(1, self.grams.held))), self.word, self.lengths)

    def only(self, rows: np.ndarray) -> _Bags:
        """These segments, and the words in them."""
        n = self.lengths[rows]
        at = np.repeat(self.first[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        types, word = np.unique(self.word[at], return_inverse=True)
        keep = np.zeros(len(self.size), bool)
        keep[types] = True
        grams = _Grams(self.grams.flat[np.repeat(keep, self.grams.held)], self.grams.held[types])
        return _Bags(grams, self.size[types], word, n)


def fit(docs: Iterable[list[bytes]], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Gradient steps (Adam) over all given documents; the same input gives the same model.

    Without documents, or with one label only, the model gives the share of toxic labels (0.5 without any) to all.
    """
    rng = np.random.default_rng(s.seed)
    vectors = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (s.dim, 2)).astype(np.float32)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = np.log([1 - share, share]).astype(np.float32)
    types: dict[bytes, int] = {}
    at, full = [], []
    for k, words in enumerate(docs):  # of a document only the numbers of its words are held
        if words:
            own = np.fromiter((types.setdefault(w, len(types)) for w in words), np.int32, len(words))
            at.append(np.unique(own) if s.segment == 1 else own)  # a bag that stands twice says no more
            full.append(k)
    if not full or len(set(labels[full].tolist())) < 2:
        return Model(np.zeros_like(vectors), softmax, bias, s)
    y = labels[full].astype(np.float32)
    grams, size = array("i"), array("i")
    for w in types:
        own = ngrams(w, s)
        grams.extend(own)
        size.append(len(own))
    del types
    every, size = _Grams(np.frombuffer(grams, np.int32), np.frombuffer(size, np.int32)), np.frombuffer(size, np.int32)
    # an n-gram counts once enough documents' words have it
    seen = every.by_bucket(np.bincount(np.concatenate([np.unique(a) for a in at])), s.buckets)
    known = every.where((seen >= s.seen)[every.flat])
    del grams, every
    part = [-(-len(a) // s.segment) for a in at]
    doc = np.repeat(np.arange(len(at)), part)
    lengths = np.concatenate([np.minimum(s.segment, len(a) - np.arange(0, len(a), s.segment)) for a in at])
    word = np.concatenate(at)
    doc_first = _starts(np.array(part))
    bags = _Bags(known, np.maximum(np.maximum(known.held, 1), size * s.known), word, lengths)
    whole, target, weight = bags, y[doc], (1 / np.array(part))[doc] / len(at)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    for step in range(s.steps):
        if step >= s.warm and (step - s.warm) % s.again == 0:
            logit = whole.means(vectors @ (softmax[:, 1] - softmax[:, 0]))
            rows = np.flatnonzero((logit == np.maximum.reduceat(logit, doc_first)[doc]) | (logit + bias[1] - bias[0] > 0))
            # the toxic segments of a toxic document share its weight; in a clean one each is wrong
            shared = np.bincount(doc[rows], minlength=len(at))[doc[rows]]
            bags, target = whole.only(rows), y[doc[rows]]
            weight = np.where(target > 0, 1 / shared, 1.0) / len(at)
            bags = bags.thinned(rng.random(len(bags.grams.flat), np.float32) >= s.drop)
        out = softmax[:, 1] - softmax[:, 0]
        logit = bags.means(vectors @ out) + (bias[1] - bias[0])
        error = (1 / (1 + np.exp(-logit)) - target) * weight
        slope = bags.back(error, s.buckets).astype(np.float32)
        pull = (vectors * slope[:, None]).sum(0)
        total = np.float32(error.sum())
        slopes = (
            slope[:, None] * out[None, :] + s.decay * vectors / len(at),
            np.stack([-pull, pull], axis=1),
            np.array([-total, total], np.float32),
        )
        for p, g, (m, v) in zip((vectors, softmax, bias), slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            fix = np.sqrt(1 - 0.99 ** (step + 1)) / (1 - 0.9 ** (step + 1))
            p -= (s.rate * fix * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    vectors[seen < s.seen] = 0
    return Model(vectors, softmax, bias, s)


class Scorer:
    """Scores of texts. A word's share of the logit is worked out once a worker."""

    def __init__(self, model: Model):
        self.s = model.settings
        value = model.vectors @ (model.softmax[:, 1] - model.softmax[:, 0])
        self.base = float(model.bias[1] - model.bias[0])
        self.share = Remembered(self._share)
        self.value = value.tolist()

    def _share(self, word: bytes) -> float:
        grams = ngrams(word, self.s)
        told = [x for x in map(self.value.__getitem__, grams) if x]
        return sum(told) / max(len(told), len(grams) * self.s.known, 1)

    def score(self, text: bytes) -> float:
        words = lowered(text)
        if not words:
            return 1 / (1 + float(np.exp(-self.base)))
        share = np.fromiter(map(self.share.__getitem__, words), np.float64, len(words))
        first = np.arange(0, len(words), self.s.segment)
        mean = np.add.reduceat(share, first) / np.minimum(self.s.segment, len(words) - first)
        return float(1 / (1 + np.exp(-np.clip(mean.max() + self.base, -500, 500))))


_SCORERS: dict[str, Scorer] = {}


def _scorer(key: str, shared) -> Scorer:
    """The scorer of a broadcast model, made once a worker and not once a task; one is held."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value)
    return _SCORERS[key]


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, s: Settings = Settings()) -> Model:
    """A model from at most `rows` labelled documents; labels has doc_id and toxic (1 or 0; null: not labelled).

    Repeated labels count as the largest, and of rows of equal doc_id the fit takes the least text. The fit runs as one task;
    all tasks scan, and only the chosen texts move to it, whole.
    """
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mixed = (F.xxhash64("doc_id"), F.col("doc_id"))
    toxic = told.where("toxic = 1").orderBy(*mixed).limit(rows // 2)
    clean = told.where("toxic = 0").orderBy(*mixed).limit(rows - rows // 2)
    chosen = F.broadcast(toxic.unionByName(clean))
    texts = text_only(docs).join(chosen, "doc_id").withColumn("toxic", F.col("toxic").cast("bigint")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = texts.select("doc_id", "text", "toxic").repartition(1)

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        forget()
        rows = pa.Table.from_batches(batches, pa.schema([("doc_id", id_type), ("text", pa.binary()), ("toxic", pa.int64())]))
        rows = rows.sort_by("doc_id")
        words, labels = (lowered(t.as_py()) for t in rows["text"]), rows["toxic"].to_numpy().copy()
        del rows  # the fit lets go of the texts once it has numbered their words
        m = fit(words, labels, s)
        used = np.flatnonzero(m.vectors.any(axis=1))
        yield pa.RecordBatch.from_pylist(
            [{"used": used.astype("<i4").tobytes(), "vectors": m.vectors[used].tobytes(), "softmax": m.softmax.tobytes(), "bias": m.bias.tobytes()}]
        )

    made = texts.mapInArrow(run, "used binary, vectors binary, softmax binary, bias binary").collect()
    if not made:
        return fit([], np.zeros(0, np.int64), s)
    r = made[0]
    vectors = np.zeros((s.buckets, s.dim), np.float32)
    vectors[np.frombuffer(r.used, "<i4")] = np.frombuffer(r.vectors, np.float32).reshape(-1, s.dim)
    return Model(vectors, np.frombuffer(r.softmax, np.float32).reshape(-1, 2), np.frombuffer(r.bias, np.float32), s)


def score_toxicity(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, score (0 to 1) of every row's whole text, with the columns named in keep.

    A null or empty text, or one without words, scores what the share of toxic labels says. Only the text is read, whole
    whatever its length; rows of equal or null doc_id each get their score. An empty table gives no rows.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        scorer = _scorer(key, shared)
        for b in batches:
            scores = pa.array([scorer.score(t) for t in b.column("text").to_pylist()], pa.float64())
            kept = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), scores], [*kept, "score"])

    rows = text_only(docs, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(run, f"{schema}, score double")
