"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by their content (id, size, checksum), never by their place in a file, so the
numbering survives a rewrite of the table or another split of its files. The permutation of
``0..n-1`` then gives each number a position, and shard and slot are the position's remainder and
quotient: anyone who knows ``n``, the seed and the number of shards can compute them, and
:func:`row_of` inverts them. Everything here is DataFrame functions.

Law: ``rows``. Shards differ by one row at most.

Defined results: a null text counts as empty (size 1, checksum 0); a null id sorts first and is an id
like any other; repeated rows get numbers of their own, and which of two equal rows has which is not
told apart; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows of one identity that a single task expands or numbers together.
CHUNK = 4096
#: Buckets of the row numbering; bounds the table of offsets (one row of 16 bytes each).
BUCKETS = 8192
ROUNDS = 6


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per row of ``rows`` with its ``keys``, a global number ``row_no`` and the count ``n_rows``.

    Equal rows are counted first (with partial counts before the shuffle) and expanded in chunks that are
    dealt out like any other rows, so no key, however common, gathers in one task. Numbers are a bucket's
    offset plus the place within the bucket; only the counts of at most ``BUCKETS`` buckets meet in one task.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    chunks = counted.select(*keys, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(CHUNK).cast("long"))).alias("__from"))
    chunks = chunks.select(
        *keys, "__from", F.least(F.col("__n") - F.col("__from"), F.lit(CHUNK)).alias("__len"), F.xxhash64(*keys, "__from").alias("__hash")
    ).withColumn("__bucket", F.pmod("__hash", F.lit(BUCKETS)))
    sizes = chunks.groupBy("__bucket").agg(F.sum("__len").alias("__rows"))
    running = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(
        "__bucket", (F.sum("__rows").over(running) - F.col("__rows")).alias("__offset"), F.sum("__rows").over(Window.partitionBy(F.lit(0))).alias("n_rows")
    )
    within = Window.partitionBy("__bucket").orderBy("__hash", *keys, "__from").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = chunks.withColumn("__before", F.sum("__len").over(within) - F.col("__len"))
    # At most BUCKETS rows of three longs: a proven bound, so the side is broadcast.
    placed = placed.join(F.broadcast(offsets), "__bucket")
    first = F.col("__offset") + F.col("__before")
    return placed.select(*keys, "n_rows", F.explode(F.sequence(first, first + F.col("__len") - 1)).alias("row_no"))


def permuted(row: str, n: str, seed: int) -> Column:
    """Position of row number ``row`` of ``n``: alternating Feistel rounds on a grid that just covers ``n``.

    The grid has ``a * b`` cells with ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``: fewer than ``a`` cells lie
    outside ``0..n-1``. A position outside is permuted again (cycle walking); a cycle leaves the
    outside cells after as many steps as there are such cells, so ``a`` further steps always suffice.
    """
    a = f"cast(ceil(sqrt(cast({n} as double))) as bigint)"
    b = f"(({n} + {a} - 1) div {a})"

    def feistel(x: str) -> str:
        left = f"pmod(s.l + pmod(xxhash64(s.r, {seed}L, i), {a}), {a})"
        right = f"pmod(s.r + pmod(xxhash64(s.l, {seed}L, i), {b}), {b})"
        return (
            f"aggregate(sequence(0L, {ROUNDS - 1}L), named_struct('l', {x} div {b}, 'r', {x} % {b}), "
            f"(s, i) -> if(i % 2 = 0, named_struct('l', {left}, 'r', s.r), named_struct('l', s.l, 'r', {right})), s -> s.l * {b} + s.r)"
        )

    once = feistel(row)
    walk = f"aggregate(sequence(1L, {a}), p, (q, j) -> if(q < {n}, q, {feistel('q')}))"
    return F.expr(f"element_at(transform(array({once}), p -> if(p < {n}, p, {walk})), 1)")


def _mix(*values: int) -> int:
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def position(row: int, n: int, seed: int) -> int:
    """The permutation for one row number, away from Spark."""
    a = math.ceil(math.sqrt(n))
    b = -(-n // a)
    while True:
        left, right = divmod(row, b)
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + _mix(right, seed, i) % a) % a
            else:
                right = (right + _mix(left, seed, i) % b) % b
        row = left * b + right
        if row < n:
            return row


def row_of(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that a shard holds at a slot: the inverse permutation."""
    a = math.ceil(math.sqrt(n))
    b = -(-n // a)
    row = slot * shards + shard
    while True:
        left, right = divmod(row, b)
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                left = (left - _mix(right, seed, i) % a) % a
            else:
                right = (right - _mix(left, seed, i) % b) % b
        row = left * b + right
        if row < n:
            return row


def shard_rows(rows: DataFrame, keys: list[str], shards: int = 16, seed: int = 20_240_501) -> DataFrame:
    """``keys`` of every row with ``row_no``, ``n_rows``, ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    at = numbered(rows, keys).withColumn("__at", permuted("row_no", "n_rows", seed))
    return at.select(*keys, "row_no", "n_rows", F.pmod("__at", F.lit(shards)).cast("int").alias("shard"), F.expr(f"__at div {shards}").cast("long").alias("slot"))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1) and checksum of the whole texts; the texts travel no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15."""
    out = shard_rows(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
