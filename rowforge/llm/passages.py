"""Substring dedup by collinear chaining: passages that repeat across documents, exactly or nearly.

1. Texts are classes by hash: a copy is told by its class and takes no further part.
2. Seeds are minimizers: of every 7 neighbouring runs of 5 words the one of least hash. Any 11 words that two texts
   share hold a shared seed.
3. Each seed is tied to one class that has it, the first in an order of classes, so a passage of m texts gives m - 1 ties, not m squared.
   That class may have no more than a part of a longer passage of two other texts. So a seed of more than two texts is also
   tied by the stretches of 14 to 50 words that begin (the longest: or end) with it, each to the first class that has that stretch: the texts that share more are tied
   to one another, whatever others have parts of it.
4. Ties of a pair of texts, a pair of word positions each, are chained: a Fenwick tree over the positions in one
   text gives each tie its best predecessor under a gap cost linear in both distances.
5. Chains, single seeds too, are aligned word by word, between seeds and beyond their ends; a passage is kept if it has
   at least 50 words in both texts and 80 % of them match in order. Its ends are where matches last outweigh edits.

A row is a passage of a document with its counterpart. Copies have one row each, for the whole text, against the class's first
document; the other rows name the first documents of their classes.

Words are runs of characters other than ASCII white space, as they are. Copies are told by 128 bits of hash. Seeds know texts by 64: should
two texts share those, their chains are aligned with either and only what matches is kept.

Defined results: null, empty and short texts have no passages; a repeated row is a copy; a null id is an id like
any other; a document without repeated passages has no row; an empty table gives an empty result; texts of any
length are read whole; only id and text are read, so further columns of any name make no difference. Later passes find texts
by hash and id, not by place, so it does not matter how the input is split into tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain as flatten

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship
from .common import cut, n_words, pieces, release, strings

SEED = 5
WINDOW = 7
#: Words of the stretches that seeds of more than two texts are also compared by. Every 52 words that two texts share hold one of
#: 40, every 62 one of 50.
LEVELS = (14, 28, 40, 50)
#: Stretches of this length on also count backwards from a seed.
BACKWARD = 50
#: Chains that one task cuts from one copy of a text, and texts asked for more often up to which a row each (16 bytes) is broadcast.
ASKED, MOST_HOT = 2_000, 100_000
#: Digests of texts that a task remembers in order to skip copies.
SEEN = 50_000


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    similarity: float = 0.8
    #: Cost of a word of distance between chained seeds, in either text; a seed earns its length.
    gap_cost: float = 0.1
    #: A chain is cut where its seeds are further apart.
    most_gap: int = 40
    #: Words beyond a chain's ends that may belong to its passage: one seed may stand at either end of the least passage.
    margin: int = 60


_P = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_INVERSE = np.uint64(pow(int(_P[0]), -1, 1 << 64))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours."""
    pick, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def seeds(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position, hash, whether the text's first seed of that hash, words until it stops recurring)"""
    words = [t.encode().split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    code = word_codes(list(flatten.from_iterable(words)))
    nothing = np.zeros(0, np.int64)
    if len(code) < SEED + WINDOW - 1:
        return nothing, nothing, nothing, np.zeros(0, bool), nothing
    owner = np.repeat(np.arange(len(words)), sizes)
    runs = len(code) - SEED + 1
    h = code[:runs]
    for k in range(1, SEED):
        h = h * _P[0] + code[k : runs + k]
    h = (h ^ h >> np.uint64(32)) * _P[1]
    h = np.minimum(h ^ h >> np.uint64(29), _NONE - np.uint64(1)) + np.uint64(1)  # 0 stands for no window
    windows = runs - WINDOW + 1
    least = _sliding(h, WINDOW, least=True)
    inside = owner[:windows] == owner[WINDOW + SEED - 2 :]
    least = np.where(inside, least, np.uint64(0))
    edge = np.zeros(WINDOW - 1, np.uint64)
    reached = _sliding(np.concatenate((edge, least, edge)), WINDOW, least=False)
    at = np.flatnonzero((reached == h) & (owner[:runs] == owner[SEED - 1 :]))
    # Of equal seeds within a window's width of one another the first stays, with the words they cover together:
    # repetitive text is not all seeds.
    order = np.lexsort((at, h[at], owner[at]))
    at = at[order]
    same = (owner[at][1:] == owner[at][:-1]) & (h[at][1:] == h[at][:-1])
    begins = np.flatnonzero(np.concatenate(([True], ~(same & (np.diff(at) < WINDOW))))) if len(at) else nothing
    last = at[np.append(begins[1:] - 1, len(at) - 1)] if len(at) else nothing
    first = np.concatenate(([True], ~same))[begins] if len(at) else np.zeros(0, bool)
    at = at[begins]
    begin = np.cumsum(sizes) - sizes
    return owner[at], at - begin[owner[at]], h[at].view(np.int64), first, last - at + SEED


def best_chains(x: list[int], y: list[int], rules: Rules = Rules()) -> list[list[int]]:
    """Chains of ties sorted by (x, y), as lists of indexes; each tie is in one chain at most."""
    n = len(x)
    if all(x[i] < x[i + 1] and y[i] < y[i + 1] for i in range(n - 1)):
        return [list(range(n))]
    ranks = {v: r for r, v in enumerate(sorted(set(y)), 1)}
    m, cost = len(ranks), rules.gap_cost
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (m + 1)
    score, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:
            best, r = (float("-inf"), -1), ranks[y[j]] - 1
            while r:
                best = max(best, tree[r])
                r &= r - 1
            gain = best[0] - cost * (x[j] + y[j])
            score[j] = SEED + max(gain, 0.0)
            if gain > 0:
                before[j] = best[1]
            j += 1
        for t in range(i, j):
            entry, r = (score[t] + cost * (x[t] + y[t]), t), ranks[y[t]]
            while r <= m:
                tree[r] = max(tree[r], entry)
                r += r & -r
        i = j
    used, out = [False] * n, []
    for t in sorted(range(n), key=lambda t: (-score[t], t)):
        path = []
        while t >= 0 and not used[t]:
            used[t] = True
            path.append(t)
            t = before[t]
        if path:
            out.append(path[::-1])
    return out


def cut_chains(x: list[int], y: list[int], extent: list[int], rules: Rules = Rules()) -> Iterator[tuple[list[int], list[int], int]]:
    """Chains without wide gaps, and how far their last seed recurs; how far one grows is for the alignment to say."""
    for path in best_chains(x, y, rules):
        start = 0
        for k in range(1, len(path) + 1):
            if k == len(path) or max(x[path[k]] - x[path[k - 1]], y[path[k]] - y[path[k - 1]]) > SEED + rules.most_gap:
                part = path[start:k]
                start = k
                more = extent[part[-1]]
                yield [x[t] for t in part], [y[t] for t in part], more - SEED


def _matches(a: list[int], b: list[int]) -> int:
    """Words of two gaps that match in order."""
    if len(a) == len(b):
        same = sum(p == q for p, q in zip(a, b, strict=True))
        if 2 * same >= len(a):
            return same
    row = [0] * (len(b) + 1)
    for p in a:
        corner = 0
        for j, q in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if p == q else max(row[j], row[j - 1])
    return row[-1]


def _extend(a: list[int], b: list[int], i: int, j: int, step: int) -> tuple[int, int, int]:
    """Goes on from (i, j) while matches outweigh edits: words passed in a and b, and matches."""
    i0, j0, score, matched, best = i, j, 0, 0, (0, 0, 0, 0)

    def equal(p: int, q: int) -> bool:
        return 0 <= p < len(a) and 0 <= q < len(b) and a[p] == b[q]

    while 0 <= i < len(a) and 0 <= j < len(b):
        if a[i] == b[j]:
            i, j, score, matched = i + step, j + step, score + 1, matched + 1
            if score > best[0]:
                best = (score, abs(i - i0), abs(j - j0), matched)
            continue
        score -= 2
        if score < best[0] - 8:
            break
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2)):
            if equal(i + di * step, j + dj * step) and equal(i + (di + 1) * step, j + (dj + 1) * step):
                break
        else:
            di = dj = 1
        i, j = i + di * step, j + dj * step
    return best[1:]


def passages(a: list[int], b: list[int], x: list[int], y: list[int], rules: Rules = Rules()) -> list[tuple[int, int, int, int, int]]:
    """Aligned passages of a chain: start and end in ``a``, start and end in ``b``, matching words."""
    parts = []
    x0, y0, x1, y1, matched = x[0], y[0], x[0] + SEED, y[0] + SEED, SEED
    for p, q in zip(x[1:], y[1:], strict=True):
        if p < x1 or q < y1:
            if p - q == x1 - y1 and p + SEED > x1:
                matched += p + SEED - x1
                x1, y1 = p + SEED, q + SEED
            continue
        gap = max(p - x1, q - y1)
        same = _matches(a[x1:p], b[y1:q])
        if gap > 10 and 2 * same < gap:
            parts.append((x0, x1, y0, y1, matched))
            x0, y0, matched = p, q, 0
        else:
            matched += same
        matched += SEED
        x1, y1 = p + SEED, q + SEED
    parts.append((x0, x1, y0, y1, matched))
    out = []
    for x0, x1, y0, y1, matched in parts:
        left, right = _extend(a, b, x0 - 1, y0 - 1, -1), _extend(a, b, x1, y1, 1)
        x0, y0, x1, y1, matched = x0 - left[0], y0 - left[1], x1 + right[0], y1 + right[1], matched + left[2] + right[2]
        if min(x1 - x0, y1 - y0) >= rules.min_words and matched >= rules.similarity * max(x1 - x0, y1 - y0):
            out.append((x0, x1, y0, y1, matched))
    return out


def _seed_rows(docs: DataFrame, text: str) -> DataFrame:
    """node, position, hash, first of every text; copies within a task are skipped."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in pieces(batches, text):
            nodes, more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = []
            for i, digest in enumerate(zip(nodes.tolist(), more.tolist(), strict=True)):
                if digest not in seen:
                    new.append(i)
                    if len(seen) < SEEN:
                        seen.add(digest)
            if new:
                owner, at, h, first, extent = seeds(strings(batch.column(2).take(pa.array(new))))
                columns = [pa.array(nodes[new][owner]), pa.array(at, pa.int32()), pa.array(h), pa.array(first), pa.array(extent, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "at", "seed", "first", "extent"])

    return docs.select("node", "more", text).mapInArrow(run, "node long, at int, seed long, first boolean, extent int")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups (equal in the first ``keys`` columns), with the bounds of the groups.

    Batches of a long group are held as they are and joined once.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = (tuple(b.column(k)[i] for k in range(keys)) for b, i in ((held[0], 0), (batch, batch.num_rows - 1)))
        if first == last:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cuts = _cuts(table, keys)
        yield table.slice(0, int(cuts[-1])), np.concatenate(([0], cuts))
        held = table.slice(int(cuts[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.concatenate(([0], _cuts(table, keys), [table.num_rows]))


def _cuts(table: pa.Table, keys: int) -> np.ndarray:
    columns = [table.column(k).to_numpy() for k in range(keys)]
    return np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1


def _powers(exponents: np.ndarray, base: np.uint64) -> np.ndarray:
    """``base`` to each exponent, modulo 2**64."""
    out, e, factor = np.ones(len(exponents), np.uint64), exponents.astype(np.uint64), np.array([base])
    while e.any():
        out = np.where(e & np.uint64(1), out * factor, out)
        factor, e = factor * factor, e >> np.uint64(1)
    return out


def context_keys(at: np.ndarray, seed: np.ndarray, extent: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, indexes, keys) for recurring seeds in order: which stand in unbroken stretches of recurring seeds that long, and a hash of the stretch.

    Within words that two texts share, the seeds are the same but for those next to the ends; so equal words give equal keys.
    Keys hold distances only: the seeds of many texts may follow one another, far apart.
    """
    n = len(at)
    value = seed.astype(np.uint64) * _P[1] ^ _P[0]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * _powers(at, _P[0]), dtype=np.uint64)))
    back, every, far = _powers(at, _INVERSE), np.arange(n), at + extent - SEED
    last_of = np.flatnonzero(np.concatenate((at[1:] - far[:-1] > WINDOW, [True])))  # the last seeds of unbroken stretches
    mine = np.searchsorted(last_of, every)
    stretch_end, stretch_begin = last_of[mine], np.concatenate(([0], last_of[:-1] + 1))[mine]
    for level in LEVELS:
        reach = level - SEED - WINDOW + 1  # as far as the words of the stretch alone decide which seeds there are
        end = np.searchsorted(at, at + reach, side="right")
        begin = np.searchsorted(at, at - reach, side="left")
        right = (stretch_end >= end - 1) & (far[end - 1] + WINDOW > at + reach)
        left = (stretch_begin <= begin) & (at[begin] - WINDOW < at - reach) & (level >= BACKWARD)
        for side, (has, low, high) in enumerate(((right, every, end), (left, begin, every + 1))):
            i = np.flatnonzero(has)
            h = (total[high[i]] - total[low[i]]) * back[i] * _P[0] + np.uint64(2 * level + side)
            h = (h ^ h >> np.uint64(32)) * _P[1]
            yield level, i, (h ^ h >> np.uint64(29)).view(np.int64)


def _keyed(recurring: DataFrame) -> DataFrame:
    """Recurring seeds under their hashes and, where more than two texts have a seed, under those of the stretches that begin there."""

    def run(batches):
        for table, _ in _whole_groups(batches, 1):
            node, at, seed, extent, n = (table.column(k).to_numpy() for k in range(5))
            new = np.concatenate(([True], (node[1:] != node[:-1]) | (at[1:] != at[:-1])))  # copies in other tasks have brought the same rows
            node, at, seed, extent, n = node[new], at[new].astype(np.int64), seed[new], extent[new].astype(np.int64), n[new]
            text = np.cumsum(np.concatenate(([0], node[1:] != node[:-1])))
            keyed = [(np.arange(len(at)), seed)]
            if (n > 2).any():
                place = at + text * (int(at.max()) + 2 * LEVELS[-1])
                keyed += [(i[n[i] > 2], keys[n[i] > 2]) for _, i, keys in context_keys(place, seed, extent)]
            i, keys = (np.concatenate(c) for c in zip(*keyed, strict=True))
            order = np.lexsort((i, keys, text[i]))
            i, keys = i[order], keys[order]
            first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (text[i][1:] != text[i][:-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(node[i]), pa.array(at[i].astype(np.int32)), pa.array(extent[i].astype(np.int32)), pa.array(first)], names=["key", "node", "at", "extent", "first"]
            )

    rows = recurring.select("node", "at", "seed", "extent", "n").repartition("node").sortWithinPartitions("node", "at")
    return rows.mapInArrow(run, "key long, node long, at int, extent int, first boolean")


def _chain_rows(ties: DataFrame, rules: Rules) -> DataFrame:
    """Chains of every pair of classes; the rows of a pair arrive sorted and together."""

    def run(batches):
        for table, cuts in _whole_groups(batches, 2):
            node, hub, x, y, extent = (table.column(k).to_numpy() for k in range(5))
            rows = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                px, py, far = x[s:e], y[s:e], extent[s:e]
                if e - s > 1:  # seeds of several keys have brought the same ties
                    new = np.concatenate(([True], (np.diff(px) != 0) | (np.diff(py) != 0)))
                    px, py, far = px[new], py[new], far[new]
                rows += [(int(node[s]), int(hub[s]), *found) for found in cut_chains(px.tolist(), py.tolist(), far.tolist(), rules)]
            if rows:
                ints = pa.list_(pa.int32())
                types = (pa.int64(), pa.int64(), ints, ints, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["node", "hub", "x", "y", "more"])

    return ties.mapInArrow(run, "node long, hub long, x array<int>, y array<int>, more int")


def _regions(rows: DataFrame, id_type: str, rules: Rules) -> DataFrame:
    """(node, id, text, asks) -> the stretches that chains ask of a text, as word codes; a text is split into words once for all."""

    def run(batches):
        for batch in pieces(batches, "text"):
            asks = batch.column(3)
            owner = np.repeat(np.arange(len(asks)), np.diff(asks.offsets.to_numpy()))
            flat = asks.flatten()
            texts, before, words, begins, codes = batch.column(2), -1, [], [], []
            for k, at, more in zip(owner.tolist(), flat.field("at").to_pylist(), flat.field("more").to_pylist(), strict=True):
                if k != before:
                    before, words = k, texts[k].as_py().encode().split()
                begin = max(at[0] - rules.margin, 0)
                begins.append(begin)
                codes.append((word_codes(words[begin : at[-1] + SEED + more + rules.margin]) >> np.uint64(32)).astype(np.uint32).tobytes())
            node, who = (batch.column(c).take(pa.array(owner)) for c in (0, 1))
            columns = [flat.field("chain"), flat.field("side"), node, who, flat.field("at"), pa.array(begins, pa.int32()), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chain", "side", "node", "id", "at", "begin", "codes"])

    return rows.select("node", "id", "text", "asks").mapInArrow(run, f"chain long, side int, node long, id {id_type}, at array<int>, begin int, codes binary")


def _aligned(regions: DataFrame, id_type: str, rules: Rules) -> DataFrame:
    """Passages of chains; the two rows of a chain arrive together, that of the hub last."""

    def run(batches):
        left = None
        for batch in batches:
            rows, ids = [], batch.column(3)
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5, 6)), strict=True)):
                if row[1] == 0:
                    left = (row, ids[k].as_py())
                    continue
                if left is None or left[0][0] != row[0]:
                    continue
                (chain, _, node, y, b0, bc), who = left
                _, _, hub, x, a0, ac = row
                a, b = (np.frombuffer(c, dtype=np.uint32).tolist() for c in (ac, bc))
                for x0, x1, y0, y1, matched in passages(a, b, [p - a0 for p in x], [p - b0 for p in y], rules):
                    rows.append((node, hub, who, ids[k].as_py(), y0 + b0, y1 + b0, x0 + a0, x1 + a0, matched))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            names = ["node", "hub", "id", "other", "start_word", "end_word", "other_start", "other_end", "matched"]
            yield pa.RecordBatch.from_arrays([pa.array(c, ids.type if n in ("id", "other") else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    return regions.mapInArrow(run, f"node long, hub long, id {id_type}, other {id_type}, start_word long, end_word long, other_start long, other_end long, matched long")


def repeated(docs: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages with their counterparts: ids and word ranges (ends exclusive), matching words, similarity."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where(F.octet_length("text") >= rules.min_words)
    id_type = docs.dtypes[0][1]
    docs = docs.withColumns({"node": F.xxhash64("text"), "more": F.xxhash64(F.lit(1), "text")})
    # Places tell rows of this one table apart; later passes over the texts go by hash and id.
    rows = cut(docs.select("id", F.monotonically_increasing_id().alias("place"), "node", "more", n_words(F.col("text")).alias("words")))
    # The first of each class by id, then by place.
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    classes = cut(rows.groupBy("node", "more").agg(F.min(rank).alias("rank"), F.max("words").alias("words"), F.count(F.lit(1)).alias("copies")).select(
        "node", "more", F.col("rank.id").alias("id"), F.col("rank.place").alias("place"), "words", "copies"
    ))
    many = classes.where((F.col("copies") > 1) & (F.col("words") >= rules.min_words))
    copies = rows.select("id", "place", "node", "more").join(many.select("node", "more", F.col("id").alias("other"), F.col("place").alias("other_place"), "words"), ["node", "more"])
    copies = copies.where("place != other_place").select(
        "id", "other", F.lit(0).cast("long").alias("start_word"), F.col("words").alias("end_word"), F.lit(0).cast("long").alias("other_start"),
        F.col("words").alias("other_end"), F.col("words").alias("matched"), F.lit("copy").alias("kind"),
    )
    found = _seed_rows(docs, "text")
    # Plain longs keep the aggregate hashed and combined before the shuffle, so that a frequent seed meets no single task.
    common = found.where("first").groupBy("seed").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"))
    common = cut(common.where("least < last").select("seed", "n"))
    keyed = _keyed(cut(found.join(common, "seed").select("node", "at", "seed", "extent", "n")))
    release(docs.sparkSession)
    # The class where the seed recurs furthest, then one and the same order of classes for all keys.
    order = (F.shiftleft(F.col("extent").cast("long"), 40) + F.shiftrightunsigned("node", 24)).alias("order")
    hubs = keyed.where("first").select("key", "node", "at", order).groupBy("key").agg(
        F.max_by("node", "order").alias("hub"), F.max_by("at", "order").alias("hub_at"), F.min("node").alias("least"), F.max("node").alias("last")
    )
    hubs = cut(hubs.where("least < last").select("key", "hub", "hub_at"))
    ties = keyed.join(hubs, "key").where("node != hub").select("node", "hub", F.col("hub_at").alias("x"), F.col("at").alias("y"), "extent")
    ties = ties.repartition("node", "hub").sortWithinPartitions("node", "hub", "x", "y")
    chains = cut(_chain_rows(ties, rules).withColumn("chain", F.monotonically_increasing_id()))
    release(docs.sparkSession)
    asked = [chains.select(F.col(key).alias("node"), "chain", F.lit(side).alias("side"), F.col(at).alias("at"), "more") for side, key, at in ((0, "node", "y"), (1, "hub", "x"))]
    asked = asked[0].unionByName(asked[1])
    # A text goes out once for every so many chains that ask for it, with what they ask.
    counts = cut(asked.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("shares"))).where("shares > 1")
    if counts.limit(MOST_HOT + 1).count() <= MOST_HOT:
        counts = F.broadcast(counts)
    asked = asked.join(counts, "node", "left").withColumn("share", F.coalesce(F.pmod("chain", "shares"), F.lit(0)))
    asked = asked.groupBy("node", "share").agg(F.collect_list(F.struct("chain", "side", "at", "more")).alias("asks"))
    asked = asked.join(classes.select("node", F.col("id").alias("first_id")), "node").withColumnRenamed("node", "asked_node")
    asked = asked.join(docs.select("node", "id", "text"), (F.col("node") == F.col("asked_node")) & F.col("id").eqNullSafe(F.col("first_id")))
    regions = _regions(asked, id_type, rules).repartition("chain").sortWithinPartitions("chain", "side")
    # Parts of one passage may grow into the same one.
    near = _aligned(regions, id_type, rules).distinct()
    near = near.select("id", "other", "start_word", "end_word", "other_start", "other_end", "matched", F.lit("passage").alias("kind"))
    longer = F.greatest(F.col("end_word") - F.col("start_word"), F.col("other_end") - F.col("other_start"))
    return near.unionByName(copies).withColumn("similarity", F.col("matched") / longer).withColumnsRenamed({"id": id_column, "other": f"other_{id_column}"})


def op8_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat in another."""
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
