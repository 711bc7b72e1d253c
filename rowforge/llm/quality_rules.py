"""Quality rules: plain counts of repetition, then compression bands.

A text that zstandard shrinks far more than prose of its length repeats itself; one that hardly shrinks is
noise or encoded data. The ratio of the whole text is held against limits for its length (short texts
shrink less), and so is the ratio of each fixed chunk, so that a repetitive or random passage inside long
prose counts too.

Defined results: a null or empty text has no words, fails the base rule and is not kept; repeated rows get
equal verdicts; texts of any length are read whole, a piece at a time; an empty table gives an empty result.
The operator reads the id and the text only; the filter passes all columns through as they are.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, strings

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of raw bytes over compressed bytes."""

    #: (bytes below which the row holds, least ratio, most ratio); texts beyond the last row have its limits.
    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 3.0),  # prose and encoded text shrink alike
        (160, 1.0, 3.0),
        (200, 1.06, 3.0),
        (256, 1.11, 3.0),
        (320, 1.15, 3.0),
        (400, 1.18, 3.0),
        (512, 1.22, 3.0),
        (1024, 1.3, 3.5),
        (2048, 1.35, 3.5),
        (8192, 1.4, 4.0),
        (65536, 1.5, 5.0),
        (float("inf"), 1.5, 6.0),
    )
    chunk_bytes: int = 4096
    #: Limits of a chunk; a text fails if more than ``chunk_share`` of its chunks are outside.
    chunk: tuple[float, float] = (1.4, 4.0)
    chunk_share: float = 0.25
    level: int = 3


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text, how many of its words lie in 8-word windows that the text has twice or more.

    Windows of 1, 2, 4 and 8 words get exact numbers by doubling: the number of a window is the rank of
    the pair of its halves' numbers.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    n = int(sizes.sum())
    out = np.zeros(len(words), dtype=np.int64)
    if n < WINDOW:
        return out
    flat = list(chain.from_iterable(words))
    ids = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    code = np.fromiter(map(ids.__getitem__, flat), dtype=np.int64, count=n)
    owner = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    width = 1
    while width < WINDOW:
        pair = code[:-width] * (int(code.max()) + 1) + code[width:]
        code = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2
    inside = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return out
    _, which, count = np.unique(owner[starts] * (int(code.max()) + 1) + code[starts], return_inverse=True, return_counts=True)
    again = starts[count[which] > 1]
    edges = np.bincount(again, minlength=n + 1) - np.bincount(again + WINDOW, minlength=n + 1)
    covered = np.cumsum(edges[:n]) > 0
    return np.bincount(owner[covered], minlength=len(words)).astype(np.int64)


def duplicate_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line.strip():
            if line in seen:
                n += 1
            seen.add(line)
    return n


class Rules:
    """Scores texts; one per task."""

    def __init__(self, bands: Bands):
        self.bands = bands
        self.compress = zstandard.ZstdCompressor(level=bands.level).compress

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.compress(raw))

    def ratios(self, raw: bytes) -> tuple[float, list[float]]:
        """Of the whole and of each chunk; a tail of under half a chunk belongs to the chunk before it."""
        size = self.bands.chunk_bytes
        if len(raw) <= size:
            whole = self.ratio(raw) if raw else 0.0
            return whole, [whole] if raw else []
        cuts = list(range(0, len(raw), size))
        if len(raw) - cuts[-1] < size // 2:
            cuts.pop()
        view = memoryview(raw)
        return self.ratio(raw), [self.ratio(view[a:b]) for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]

    def in_bands(self, n_bytes: int, whole: float, chunks: list[float]) -> bool:
        low, high = next((lo, hi) for below, lo, hi in self.bands.whole if n_bytes < below)
        if not low <= whole <= high:
            return False
        if n_bytes <= self.bands.chunk_bytes:
            return True
        outside = sum(not self.bands.chunk[0] <= r <= self.bands.chunk[1] for r in chunks)
        return outside <= self.bands.chunk_share * len(chunks)

    def score(self, texts: Iterable[str]) -> dict[str, list | np.ndarray]:
        raws = [t.encode() for t in texts]
        # bytes.split() splits at space, tab, LF, VT, FF and CR and nothing else, which is the word rule.
        words = [r.split() for r in raws]
        n_words = np.array([len(w) for w in words], dtype=np.int64)
        repeat = repeated_words(words)
        ratios = [self.ratios(r) for r in raws]
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        banded = np.array([self.in_bands(len(r), whole, chunks) for r, (whole, chunks) in zip(raws, ratios, strict=True)], dtype=bool)
        return {
            "n_words": n_words,
            # Words' bytes that do not continue a code point.
            "word_chars": [sum(map(len, w)) - _continued(r) for w, r in zip(words, raws, strict=True)],
            "n_symbols": [sum(map(r.count, _SYMBOLS)) for r in raws],
            "n_dup_lines": [duplicate_lines(r) for r in raws],
            "n_repeat_words": repeat,
            "base_failed": failed,
            "kept": ~failed & banded,
            "ratio": [whole for whole, _ in ratios],
            "worst_low": [min(chunks, default=0.0) for _, chunks in ratios],
            "worst_high": [max(chunks, default=0.0) for _, chunks in ratios],
        }


_SYMBOLS = [bytes([c]) for c in SYMBOLS]


def _continued(raw: bytes) -> int:
    if raw.isascii():
        return 0
    return int(np.count_nonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) == 0x80))


_TYPES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "worst_low": pa.float64(), "worst_high": pa.float64(),
}
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, worst_low double, worst_high double"


def quality(docs: DataFrame, bands: Bands = Bands(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id of every row with its counts, ratios and verdict."""
    docs = docs.select(id_column, text)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Rules(bands).score(strings(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k], t) for k, t in _TYPES.items())], names=[id_column, *_TYPES])

    return map_batches(docs, score, f"`{id_column}` {docs.dtypes[0][1]}, {_SCHEMA}", text)


def kept_documents(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The rows that the rules keep, all columns untouched."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(Rules(bands).score(strings(batch.column(text)))["kept"], pa.bool_()))

    return map_batches(docs, keep, docs.schema, text)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and verdicts."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
