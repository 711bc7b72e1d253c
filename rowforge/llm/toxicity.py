"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A word counts as it is and by its first five letters; pairs of words with none, one or two between them count as well.

The model is fitted on the driver from a bounded sample of labelled rows (:class:`Fit`). Per-coordinate
learning rates follow the gradients that each coordinate has seen; the L1 term keeps all but the telling
coordinates at zero, so the weights are a short list whose size is bounded by the number of buckets: a proven
bound for the broadcast. Scoring reads every whole text once, without a shuffle.

Defined results: a null or empty text has the score of the bias alone; repeated rows get equal scores; if the
sample lacks rows of either label, every score is the share of label 1 (0 without rows); a label's repeated
rows count once, as 1 if any says 1; null labels and ids are not learnt from; an empty table gives an empty
result; only doc_id, text and the label are read, so further columns of any name make no difference.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_batches, strings

BITS = 18
#: Letters that a word's stem has; words of as many or more count by their stem too, since many languages inflect.
STEM = 5


@dataclass(frozen=True)
class Fit:
    """What the fit may use and how."""

    #: Labelled rows at most, in order of a hash of their id; this bounds the driver's work.
    rows: int = 12_000
    #: Texts of more bytes are scored like all others but not learnt from.
    most_bytes: int = 16_000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 1.0
    #: Weight of a row of label 1, which is the rarer one.
    positive: float = 4.0


#: Lower-case letters, digits and bytes above ASCII stay, everything else separates words.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_FOLD).split()


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def features(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every unigram, as it is and by its stem, bigram and skip-gram over one or two words."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    every = list(chain.from_iterable(words))
    code = _codes(every)
    owner = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    owners, buckets = [owner], [code * _KEYS[0] >> np.uint64(64 - BITS)]
    stems = [w[:STEM] if w.isascii() else w.decode()[:STEM].encode() for w in every]
    long = np.fromiter((len(w) >= STEM and (w.isascii() or len(w.decode()) >= STEM) for w in every), dtype=bool, count=len(every))
    owners.append(owner[long])
    buckets.append((_codes(stems)[long] + np.uint64(STEM << 32)) * _KEYS[1] >> np.uint64(64 - BITS))
    for gap in (1, 2, 3):
        if len(code) > gap:
            pair = (code[:-gap] * _KEYS[1] + code[gap:] * _KEYS[2] + np.uint64(gap)) * _KEYS[3]
            same = owner[:-gap] == owner[gap:]
            owners.append(owner[:-gap][same])
            buckets.append(pair[same] >> np.uint64(64 - BITS))
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


@dataclass
class Model:
    """Non-zero weights by bucket."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float64)
        out[self.buckets] = self.weights
        return out


def fit(texts: list[str], labels: list[int], how: Fit = Fit()) -> Model:
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), float("-inf") if not len(y) or y[0] == 0 else float("inf"))
    seen = [np.append(np.unique(features([words_of(t)])[1]), 1 << BITS) for t in texts]  # the last bucket is the bias
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    penalty = np.full((1 << BITS) + 1, how.l1)
    penalty[-1] = 0.0

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= penalty[at], 0.0, -(z[at] - np.sign(z[at]) * penalty[at]) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    order = np.random.default_rng(7)
    for _ in range(how.epochs):
        for i in order.permutation(len(y)):
            at = seen[i]
            w = weights(at)
            g = (_sigmoid(w.sum()) - y[i]) * (how.positive if y[i] else 1.0)
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(slice(None))
    buckets = np.flatnonzero(w[:-1])
    return Model(buckets, w[buckets], float(w[-1]))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def scores(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Each feature counts once per text."""
    owner, bucket = features([words_of(t) for t in texts])
    hit = table[bucket] != 0.0
    pairs = np.unique(owner[hit] * np.int64(1 << BITS) + bucket[hit])
    if not np.isfinite(bias):
        return np.full(len(texts), float(bias > 0))
    return _sigmoid(np.bincount(pairs >> BITS, weights=table[pairs & ((1 << BITS) - 1)], minlength=len(texts)) + bias)


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, how) -> tuple[list[str], list[int]]:
    """At most ``how.rows`` labelled texts on the driver: the first in order of a hash of the id."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(how.rows)
    # ``how.rows`` rows at most: a proven bound for the broadcast.
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= how.most_bytes).join(F.broadcast(ids), "doc_id")
    rows = texts.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "text").limit(how.rows).collect()
    return [r["text"] for r in rows], [int(r["label"] != 0) for r in rows]


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(divisor))


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The id of every row with ``score`` and ``predicted``."""
    docs = docs.select(id_column, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tables: dict[int, np.ndarray] = {}

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        if 0 not in tables:
            tables[0] = m.table()
        table = tables[0]
        s = scores(strings(batch.column(1)), table, m.bias)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[id_column, "score", "predicted"])

    return map_batches(docs, score, f"`{id_column}` {docs.dtypes[0][1]}, score double, predicted int", text)


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model that never saw the held-out ones."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(*sample(docs, labels, "toxic", remainder(5) != 0, Fit()))
    return scored(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")
