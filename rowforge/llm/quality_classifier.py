"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document.

Each word, each run of 3 to 5 characters of a word with its edges, and each pair of neighbouring words has a
vector in a hashed table. A document is the average of its vectors; a softmax layer reads it. Tables and layer are
trained together by stochastic gradient descent in numpy, on the driver, from a bounded sample of labelled
rows, a row at a time with a rate that falls to zero. The layer moves by its gradient, its bias by a tenth of it. A vector moves by its gradient
times the number of different buckets of the row, four times as far at most: what is one of a thousand in an
average would else hardly move. Since the layer is linear, a vector's share of the output is one number per bucket, and that table
(bounded by the number of buckets) is what is broadcast.

Defined results: a null or empty text averages nothing and is scored by the layer's bias; repeated rows get
equal scores; if the sample lacks rows of either label, every score is the share of label 1 (0 without
rows); a label's repeated rows count once, as 1 if any says 1; null labels and ids are not learnt from; a document with a null id is scored
like any other; an empty table gives an empty result; only doc_id, text and the label are read, so further columns of any name make no difference.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_batches, strings
from .toxicity import remainder, sample

BITS = 16
DIMENSIONS = 12
GRAMS = (3, 4, 5)


@dataclass(frozen=True)
class Fit:
    """What the fit may use and how."""

    #: Labelled rows at most, in order of a hash of their id; this bounds the driver's work.
    rows: int = 3000
    #: Texts of more bytes are scored like all others but not learnt from.
    most_bytes: int = 20_000
    epochs: int = 4
    rate: float = 0.5


_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x100000001B3, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)
_SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint32)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x51ED270B)) * _MIX
    return ((h ^ h >> np.uint64(29)) * _MIX >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, character n-gram and word pair, over code points."""
    parts = [np.frombuffer((" " + t + " ").encode("utf-32-le"), dtype=np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    code = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    space = (code <= 0x20) & np.isin(code, _SPACES)
    code = np.where(space, np.uint32(0x20), code).astype(np.uint64)
    inner = ~space
    owners, buckets = [], []
    # Words: their characters times powers by place, so one sum per word.
    begins = np.flatnonzero(inner[1:] & space[:-1]) + 1
    if len(begins):
        ends = np.flatnonzero(space[1:] & inner[:-1]) + 1
        place = np.arange(len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code)))).astype(np.int64) if begins[0] == 0 else None
        if place is None:
            place = np.arange(len(code)) - np.concatenate((np.zeros(begins[0], np.int64), np.repeat(begins, np.diff(np.append(begins, len(code))))))
        term = np.where(inner, (code + np.uint64(1)) * _POWERS[place & 63], np.uint64(0))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term)))
        word = total[ends] - total[begins]
        owners.append(owner[begins])
        buckets.append(_bucket(word, 1))
        if len(word) > 1:
            pair = word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[1:]
            pair[word[:-1] == word[1:]] = np.uint64(1)  # a word said twice is one feature, whatever the word
            together = owner[begins[:-1]] == owner[begins[1:]]
            owners.append(owner[begins[:-1]][together])
            buckets.append(_bucket(pair[together], 2))
    for n in GRAMS:
        if len(code) >= n:
            width = len(code) - n + 1
            h, whole = np.zeros(width, np.uint64), np.ones(width, dtype=bool)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + code[k : k + width]
                if 0 < k < n - 1:
                    whole &= inner[k : k + width]
            owners.append(owner[:width][whole])
            buckets.append(_bucket(h[whole], n))
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    """Each bucket's share of the output, and the bias."""

    share: np.ndarray
    bias: float


def fit(texts: list[str], labels: list[int], how: Fit = Fit()) -> Model:
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), float("inf") if len(y) and y[0] else float("-inf"))
    rng = np.random.default_rng(5)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = []
    for t in texts:
        at, count = np.unique(features([t])[1], return_counts=True)
        seen.append((at, (count / max(1, count.sum())).astype(np.float32)))
    steps, done = how.epochs * len(y), 0
    for _ in range(how.epochs):
        for i in rng.permutation(len(y)):
            at, part = seen[i]
            rate = np.float32(how.rate * (1 - done / steps))
            done += 1
            hidden = part @ table[at]
            out = hidden @ layer + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * np.float32(0.1) * p
            # Vectors move as if each stood for a like part of the average: by their part of it times the number of buckets met.
            table[at] -= rate * np.outer(np.minimum(part * len(part), 4.0), back)
    share = (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32)
    return Model(share, float(bias[1] - bias[0]))


def scores(texts: list[str], model: Model) -> np.ndarray:
    owner, bucket = features(texts)
    total = np.bincount(owner, weights=model.share[bucket], minlength=len(texts))
    count = np.bincount(owner, minlength=len(texts))
    out = total / np.maximum(count, 1) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35.0, 35.0))) if np.isfinite(model.bias) else np.full(len(texts), float(model.bias > 0))


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The id of every row with ``score`` and ``predicted``."""
    docs = docs.select(id_column, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scores(strings(batch.column(1)), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[id_column, "score", "predicted"])

    return map_batches(docs, score, f"`{id_column}` {docs.dtypes[0][1]}, score double, predicted int", text)


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model that never saw the held-out ones."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(*sample(docs, labels, "quality", remainder(4) != 2, Fit()))
    return scored(docs, model).select("doc_id", (F.coalesce(remainder(4) == 2, F.lit(False))).alias("held_out"), "score", "predicted")
