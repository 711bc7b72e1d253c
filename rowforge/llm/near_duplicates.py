"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.

1. Texts of equal shingle sets become one class; copies are never expanded into pairs.
2. Each class has 160 MinHash values. Classes that share one of 32 bands of five values are candidates: a pair of
   similarity 0.8 is missed with probability 3e-6, one of 0.85 with 7e-9. Instead of the pairs of a band, each
   class is tied to the band's least class, and the ties' connected components hold all candidate pairs. Components of more than a
   block, which documents of one template form by chance, are taken apart by prefixes: linked sets share one of
   the rarest fifth of their shingles, templates do not.
3. A component is compared block against block (one block, for nearly all). MinHash values are compared 32 at a
   time; a pair is dropped when the posterior probability (uniform prior) that its similarity reaches the
   threshold falls below the tolerance. The pairs left are verified exactly on their shingle sets. A block
   returns a row per class with its number of links and one tie, never a row per pair.
4. Connected components of the ties are the groups.

Words are runs of characters other than ASCII white space, as they are. A text of one to four words has one shingle, all its
words. Shingles are 64-bit hashes of their words.

Defined results: a null or empty text, or one without words, has no shingles, links to nothing and is its own
group; repeated rows are copies; a null id is an id like any other, and a group's id is the least id that is
not null; an empty table gives an empty result; the join reads id and text only, the filter passes all
columns through, whatever their names. Rows are told apart by file and row where the input is a Parquet table; any
other input must give the same rows in the same partitions in two passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship
from .common import PLACE, cut, fresh, joined_by, map_batches, pieces, placed, release, strings
from .graph import components

SHINGLE = 5
BANDS, BAND_ROWS = 32, 5
HASHES = BANDS * BAND_ROWS
ROUND = 32
#: Classes and shingles of a block.
BLOCK_CLASSES, BLOCK_SHINGLES = 128, 70_000
#: Shingles are counted in this many buckets, as a power of two: 8 MB that reach the driver and all workers.
COUNT_BITS = 20


@dataclass(frozen=True)
class Threshold:
    """A similarity as a fraction, and the posterior probability below which a pair is dropped."""

    numerator: int = 4
    denominator: int = 5
    tolerance: float = 1e-7


_P = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_RNG = np.random.default_rng(20_240_607)
_FLIP = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _P[1]
    return h ^ h >> np.uint64(29)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [t.encode().split() for t in texts]
    sizes = [len(w) for w in words]
    code = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=sum(sizes))
    h = np.zeros(0, np.uint64)
    if len(code) >= SHINGLE:
        h = code[: len(code) - SHINGLE + 1]
        for k in range(1, SHINGLE):
            h = h * _P[0] + code[k : len(code) - SHINGLE + 1 + k]
        h = _finish(h)
    out, at = [], 0
    for n in sizes:
        if n >= SHINGLE:
            out.append(np.unique(h[at : at + n - SHINGLE + 1]))
        elif n:
            short = np.uint64(n)
            with np.errstate(over="ignore"):
                for c in code[at : at + n]:
                    short = short * _P[2] + c
            out.append(_finish(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(least, ((low[i : i + 2048] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """rows x 160 MinHash values -> rows x 32 keys."""
    rows = least.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    return _finish((rows * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _P[2]).view(np.int64)


def fewest_matches(n: int, t: Threshold) -> int:
    """The fewest equal values of ``n`` at which similarity >= t keeps a posterior probability of the tolerance.

    With a uniform prior, similarity given m of n matches is Beta(m + 1, n - m + 1), and the probability that
    it is at least s equals that of at most m successes in n + 1 trials of chance s.
    """
    s, below = t.numerator / t.denominator, 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        if below >= t.tolerance:
            return m
    return n


def linked(sets: list[np.ndarray], values: np.ndarray, left: np.ndarray, right: np.ndarray, t: Threshold) -> np.ndarray:
    """left x right booleans: which pairs of classes are linked. ``values``: MinHash values by class."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    a, b = size[left][:, None], size[right][None, :]
    alive = (np.minimum(a, b) * t.denominator >= np.maximum(a, b) * t.numerator) & (a > 0) & (b > 0)
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), dtype=np.int16)
    for k in range(0, HASHES, ROUND):
        for at in range(0, len(i), 100_000):
            part = slice(at, at + 100_000)
            matches[part] += (values[left[i[part]], k : k + ROUND] == values[right[j[part]], k : k + ROUND]).sum(axis=1, dtype=np.int16)
        stay = matches >= fewest_matches(k + ROUND, t)
        i, j, matches = i[stay], j[stay], matches[stay]
    out = np.zeros(alive.shape, dtype=bool)
    if not len(i):
        return out
    both = _intersections([sets[k] for k in left], [sets[k] for k in right], i, j)
    union = size[left[i]] + size[right[j]] - both
    good = both * t.denominator >= union * t.numerator
    out[i[good], j[good]] = True
    return out


def _intersections(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs; products of 0/1 matrices where many share their sets."""
    if len(i) <= 2 * (len(left) + len(right)):
        return np.array([np.isin(left[x], right[y], assume_unique=True).sum() for x, y in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    rows, used_left = np.unique(i, return_inverse=True)
    columns, used_right = np.unique(j, return_inverse=True)
    sets = [left[x] for x in rows] + [right[y] for y in columns]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(count), -1)
    number[shared] = np.arange(len(shared))
    which = number[which]
    owner, which = owner[which >= 0], which[which >= 0]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    total = np.zeros((len(rows), len(columns)), dtype=np.float64)
    for at in range(0, len(shared), 2048):
        a, b = np.searchsorted(which, (at, at + 2048))
        matrix = np.zeros((len(sets), 2048), dtype=np.float32)
        matrix[owner[a:b], which[a:b] - at] = 1
        total += matrix[: len(rows)] @ matrix[len(rows) :].T
    return np.rint(total[used_left, used_right]).astype(np.int64)


def _compare(table: pa.Table, t: Threshold) -> pa.Table:
    """A block pair: (cls, root, links) for each class with links in it."""
    cls = table.column("cls").to_pylist()
    sets = shingle_sets(table.column("text").to_pylist())
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), dtype=np.uint16).reshape(len(cls), HASHES)
    copies = np.array(table.column("copies").to_pylist(), dtype=np.int64)
    block = np.array(table.column("block").to_pylist())
    first = block == block.min()
    left = np.flatnonzero(first)
    right = left if table.column("low")[0].as_py() == table.column("high")[0].as_py() else np.flatnonzero(~first)
    found = linked(sets, values, left, right, t)
    if right is left:
        np.fill_diagonal(found, False)
    links = np.zeros(len(cls), dtype=np.int64)
    links[left] += found @ copies[right]
    if right is not left:
        links[right] += copies[left] @ found
    root = list(range(len(cls)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(*(k.tolist() for k in np.nonzero(found)), strict=True):
        p, q = top(int(left[x])), top(int(right[y]))
        if p != q:
            root[max(p, q)] = min(p, q)
    at = np.flatnonzero(links)
    return pa.table(
        {"cls": pa.array([cls[x] for x in at], pa.binary()), "root": pa.array([cls[top(int(x))] for x in at], pa.binary()), "links": pa.array(links[at], pa.int64())}
    )


def hashed(docs: DataFrame, id_column: str, text: str, place: str) -> DataFrame:
    """id, place, class digest, number of shingles, band keys and MinHash values (16 bits each) of every row."""

    def signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(strings(batch.column(1)))
        least = np.stack([min_hashes(s) for s in sets]) if sets else np.zeros((0, HASHES), np.uint32)
        keys = band_keys(least)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel(), pa.int64()))
        values = [v.tobytes() for v in least.astype(np.uint16)]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), bands, pa.array(values, pa.binary())],
            names=["id", "place", "cls", "n", "bands", "values"],
        )

    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(place).alias("place"))
    return map_batches(docs, signatures, f"id {docs.dtypes[0][1]}, place {PLACE}, cls binary, n long, bands array<bigint>, values binary", "text")


def fewest_in_prefix(n: int, t: Threshold) -> int:
    """How many of a set's n shingles, first in any one order of all shingles, must hold one of every set that is linked with it."""
    shared = (n * t.numerator + t.denominator - 1) // t.denominator
    return n - shared + 1


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def prefix_ties(members: DataFrame, t: Threshold) -> DataFrame:
    """``node``, ``text`` of classes -> ties (a, b) whose components hold all linked pairs, and few others.

    Shingles are ordered from rare to frequent by one table of counts, hashed into ``2 ** COUNT_BITS`` buckets whatever the
    corpus; sets that are linked share a shingle among the first of either. What a template gives to all its documents comes last.
    """

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in pieces(batches, "text"):
            every = np.concatenate(shingle_sets(strings(batch.column(1))))
            total += np.bincount(_bucket(every), minlength=1 << COUNT_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counts = np.zeros(1 << COUNT_BITS, np.int64)
    found = members.select("node", "text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches):
        for batch in pieces(batches, "text"):
            nodes, sets = batch.column(0).to_numpy(), shingle_sets(strings(batch.column(1)))
            first = [s[np.argsort(shared.value[_bucket(s)], kind="stable")[: fewest_in_prefix(len(s), t)]] for s in sets]  # sets are sorted: ties go by hash
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, [len(f) for f in first])), pa.array(np.concatenate(first).view(np.int64))], names=["node", "shingle"])

    rows = members.select("node", "text").mapInArrow(prefixes, "node long, shingle long")
    hubs = rows.groupBy("shingle").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    return rows.join(hubs, "shingle").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def groups(docs: DataFrame, t: Threshold = Threshold(), id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Every row's id, place, class, group (null if alone), group's least id, copies and links; and the place's name in ``docs``."""
    ship(docs.sparkSession)
    (place,) = fresh("place")
    docs = placed(docs, place)
    rows = cut(hashed(docs, id_column, text, place))
    classes = rows.where("n > 0").groupBy("cls").agg(
        F.count(F.lit(1)).alias("copies"), F.min("place").alias("place"), F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("values").alias("values")
    )
    classes = cut(classes.withColumn("node", F.xxhash64("cls")))
    # Ties of each band's classes to its least class; two classes of one 64-bit node merely become candidates.
    bands = classes.select("node", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    ties = bands.join(hubs, "band").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    texts = docs.select(F.col(place).alias("place"), F.col(text).alias("text"))
    members = _sized(classes.drop("bands").join(components(ties), "node"))
    members = cut(members.join(texts, "place").drop("place"))  # the one shuffle of texts
    release(docs.sparkSession)
    large = members.where("blocks > 1")
    if not large.isEmpty():
        # A chance of sharing a band is no link: what hangs together by chance alone falls apart again.
        finer = _sized(large.select("node", "n").join(components(prefix_ties(large, t)), "node"))
        members = members.where("blocks = 1").unionByName(large.drop("root", "blocks").join(finer.drop("n"), "node"))
    members = members.withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls", "copies", "values", "text")
    found = cut(members.groupBy("root", "low", "high").applyInArrow(lambda table: _compare(table, t), "cls binary, root binary, links long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    known = classes.select("cls", "copies", "least_id").join(links, "cls", "left").join(group.withColumnRenamed("node", "cls"), "cls", "left")
    known = cut(known.where("copies > 1 OR links > 0").withColumn("root", F.coalesce("root", "cls")))
    least = known.groupBy("root").agg(F.min("least_id").alias("group_id"), F.count(F.lit(1)).alias("classes"))
    known = joined_by(known, least, "root", "classes").select("cls", "copies", "least_id", F.coalesce("links", F.lit(0)).alias("links"), F.col("root").alias("group"), "group_id")
    return joined_by(rows.drop("bands", "values"), cut(known), "cls", "copies", F.col("n") > 0), place


def _sized(members: DataFrame) -> DataFrame:
    """Members of components of two and more, with the number of blocks that theirs is compared in."""
    members = cut(members)
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles")).where("classes > 1")
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    return joined_by(members, cut(sizes.select("root", blocks.alias("blocks"), "classes")), "root", "classes", how="inner").drop("classes")


def joined(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """Every row's doc_id with its group (``class_id``: the group's least doc_id), copies and number of linked rows."""
    rows, _ = groups(docs, t)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.coalesce("group_id", "id").alias("class_id"),
        F.coalesce("least_id", "id").alias("copy_of"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )


def distinct_documents(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """``docs`` with one row of each group: the one of the least doc_id, the first of these."""
    rows, place = groups(docs, t)
    rows = rows.where(F.col("group").isNotNull()).select("group", "place", F.struct(F.col("id").isNull().alias("none"), "id", "place").alias("rank"))
    first = rows.groupBy("group").agg(F.min("rank").alias("rank")).select(F.col("rank.place").alias("place"))
    gone = cut(rows.select("place").join(first, "place", "left_anti").withColumnRenamed("place", place))
    return placed(docs, place).join(gone, place, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate group and number of links."""
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
