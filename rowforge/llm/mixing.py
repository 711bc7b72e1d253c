"""Mixing sources to target weights by hash thresholds, without sorting.

Every document has a 60-bit hash of its id, source and size. A source whose target is ``q`` times its
size and a remainder takes all its documents ``q`` times and, once more, those whose hash lies below a
threshold. The threshold comes from a histogram of sizes by source and hash bucket: the bucket in which
the running sum passes the remainder is refined into finer buckets, the others are settled. A larger
budget has a higher threshold, so the selections of several budgets are nested.

Only counts and sums travel: the histograms are pre-aggregated, and what the last step orders is the
inside of one bucket of 2^-24 of a source. Documents of equal id, source and size share a hash; if a
threshold falls inside such a group, the same refinement by a hash of the row's place splits it.

Defined results: a null text has size 0 and is taken 0 words; null is a source of its own, after all
others; a source without words has target 0; an empty table gives an empty result; a repeated row counts
and is taken on its own; further columns of the input, of any name, are left as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, fresh, n_words, placed

MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Bits of the hash that each pass resolves.
BITS = 12
HASH_BITS = 60
#: Sources up to which a row per source (some 100 bytes) is broadcast and ordered in one task; with more, the joins shuffle and split
#: skewed sources, and the order is dealt by ranges.
FEW_SOURCES = 50_000


def _running(*by: str, order: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def document_hash(doc_id: Column, source: Column, size: Column, seed: str) -> Column:
    """60 bits of md5 over the seed, id, source and size."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(source, F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _ordered(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], few: bool) -> DataFrame:
    """``df`` with running sums in ``order``, the row itself included.

    Few rows meet in one task. Others are dealt by ranges of the order; only a row of sums per range meets in one.
    """
    if few:
        upto = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({name: F.sum(value).over(upto) for name, value in sums.items()})
    df = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = df.groupBy("__range").agg(*(F.sum(value).alias(f"{name}__") for name, value in sums.items()))
    ranges = ranges.select("__range", *(F.coalesce(F.sum(f"{name}__").over(ahead), F.lit(0)).alias(f"{name}__") for name in sums))
    df = df.withColumns({name: F.sum(value).over(within) for name, value in sums.items()}).join(F.broadcast(ranges), "__range")
    return df.withColumns({name: F.col(name) + F.col(f"{name}__") for name in sums}).drop("__range", *(f"{name}__" for name in sums))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MOST_REPEATS, few: bool = True) -> DataFrame:
    """source, source_size -> the same with ``target``.

    Resharing the excess of capped sources by weight until none is above its cap ends at
    ``min(cap, level * weight)`` with one level for all: with sources ordered by cap over weight, the level is
    what the uncapped ones share, at the first place where it does not exceed the next source's ratio.
    """
    ranked = _ordered(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, few).withColumn("rank", F.col("rank") - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * repeats).alias("cap"))
    ranked = ranked.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    ranked = cut(_ordered(ranked, [F.col("ratio"), F.col("rank")], {"caps": F.col("cap"), "weights": F.col("weight")}, few))
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"] or 0) - (F.col("caps") - F.col("cap"))).cast("double") / (F.lit(whole["weight"] or 0) - (F.col("weights") - F.col("weight")))
    found = ranked.select("ratio", "rank", level.alias("level")).where("level <= ratio").orderBy("ratio", "rank").first()
    capped = F.col("cap").cast("double")
    uncapped = F.lit(found["level"] if found else float("inf")) * F.col("weight")
    return ranked.select("source", "source_size", F.when(capped <= uncapped, capped).otherwise(uncapped).alias("target"))


def thresholds(light: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """Where each source's remainder ends.

    ``light``: source, size, hash, place. ``budgets``: source, remainder; ``few``: these are few. Returns per source ``below`` (hashes
    below are taken), ``at`` and ``place_below`` (rows of that hash are taken if their place hash is below).
    """

    def boundary(rows: DataFrame, left: DataFrame, bucket: Column) -> DataFrame:
        """The bucket in which each source's remainder ends, and what is left of it there."""
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(_running("source", order=["bucket"])))
        left = F.broadcast(left) if few else left
        # Sums that grow pass the remainder once: one bucket of each source, or none.
        met = sums.join(left, sums["source"].eqNullSafe(left["__source"])).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
        return met.select("__source", "bucket", (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"))

    def inside(rows: DataFrame, met: DataFrame, bucket: Column) -> DataFrame:
        met = met.select("__source", "bucket")
        met = F.broadcast(met) if few else met  # a row per source at most
        return rows.join(met, rows["source"].eqNullSafe(met["__source"]) & (bucket == met["bucket"])).select("source", "size", "hash", "place")

    high, low = (F.shiftright("hash", HASH_BITS - BITS * k) for k in (1, 2))
    left = budgets.select(F.col("source").alias("__source"), F.col("remainder").alias("left"))
    met = boundary(light, left, high)
    rest = inside(light, met, high)
    met = boundary(rest, met.drop("bucket"), low)
    rest = cut(inside(rest, met, low))
    # Inside the last bucket whole hashes are settled in order; what remains is one hash with its equal rows.
    atom = boundary(rest, met.drop("bucket"), F.col("hash"))
    rest = inside(rest, atom, F.col("hash"))
    place = F.shiftright("place", 64 - 2 * BITS)
    fine = boundary(rest, atom.drop("bucket"), place)
    last = inside(rest, fine, place).groupBy("source").agg(F.sum("size").alias("words"))
    fine = fine.withColumnRenamed("left", "over").join(last.withColumnRenamed("source", "__last"), F.col("__source").eqNullSafe(F.col("__last")))
    # The one row (or few) at the very boundary is taken if that comes nearer to the target.
    fine = fine.select(F.col("__source").alias("__fine"), (F.col("bucket") + F.when(F.col("over") * 2 >= F.col("words"), 1).otherwise(0)).alias("place_below"))
    return atom.join(fine, F.col("__source").eqNullSafe(F.col("__fine")), "left").select(F.col("__source"), F.col("bucket").alias("at"), "place_below")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MOST_REPEATS, seed: str = "mix-1", columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``columns`` of ``docs`` (all, unless named) with the mix's columns, and the names those got.

    Two passes over the texts: one leaves a light table of sizes and hashes in the checkpoint folder, one applies
    the thresholds. Tables with one row per source are broadcast if these were counted to be few, else joined
    by a shuffle that splits hot sources.
    """
    names = dict(zip(_NAMES, fresh(*_NAMES), strict=True))
    c = {k: F.col(v) for k, v in names.items()}
    kept = [F.col(f"`{k}`") for k in columns or docs.columns]
    rows = placed(docs, names["row"]).select(*kept, F.col("doc_id").alias(names["id"]), F.col("source").alias(names["source"]), n_words(F.col("text")).alias(names["size"]), names["row"])
    rows = rows.withColumn(names["hash"], document_hash(c["id"], c["source"], c["size"], seed))
    rows = rows.withColumn(names["place"], F.shiftright(F.xxhash64(c["row"]), 1).bitwiseAND(F.lit((1 << 63) - 1)))
    light = cut(rows.select(*(c[k].alias(k) for k in ("source", "size", "hash", "place"))))
    sizes = cut(light.groupBy("source").agg(F.sum("size").alias("source_size")))
    few = sizes.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    goals = targets(sizes, weights, repeats, few)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = cut(goals.withColumn("whole", whole).withColumn("remainder", F.col("target") - F.col("whole") * F.col("source_size")))
    ends = thresholds(light, goals.select("source", "remainder"), few)
    goals = goals.join(ends, F.col("source").eqNullSafe(F.col("__source")), "left")
    goals = cut(goals.select(F.col("source").alias(names["match"]), *(F.col(k).alias(names[k]) for k in ("source_size", "target", "whole", "at", "place_below"))))
    goals = F.broadcast(goals) if few else goals
    out = rows.join(goals, c["source"].eqNullSafe(c["match"]))
    once_more = (c["hash"] < c["at"]) | ((c["hash"] == c["at"]) & (F.shiftright(c["place"], 64 - 2 * BITS) < F.coalesce(c["place_below"], F.lit(0))))
    out = out.withColumn(names["times"], F.when(c["size"] > 0, c["whole"] + F.coalesce(once_more, F.lit(False)).cast("long")).otherwise(0))
    return out.select(*kept, *(c[k] for k in ("size", "source_size", "target", "times"))), names


#: What the mix adds to its input on the way, under names that no column has.
_NAMES = ("size", "source_size", "target", "times", "hash", "place", "match", "whole", "at", "place_below", "row", "id", "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: ``docs`` with each document as often as it is taken."""
    out, names = mix(docs)
    (copy,) = fresh("copy")
    out = out.where(F.col(names["times"]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["times"]))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of each."""
    out, names = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id"])
    n = {k: F.col(v) for k, v in names.items()}
    return out.select("doc_id", n["size"].alias("size"), n["source_size"].alias("source_size"), n["target"].alias("target"), (n["size"] * n["times"]).alias("taken"))


#: The same mix by sorting. Rows equal in id, source and size are told apart by nothing, so either may be taken.
OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
hashed AS (
  SELECT *, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || size), 1, 15))::BIGINT AS h FROM rows),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM rows GROUP BY source),
caps AS (SELECT *, (rank % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM sources),
ratios AS (SELECT *, cap::DOUBLE / w AS ratio FROM caps),
levels AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER up - cap))::DOUBLE / (sum(w) OVER () - (sum(w) OVER up - w))::DOUBLE AS level
  FROM ratios WINDOW up AS (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING)),
shared AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN cap::DOUBLE <= coalesce((SELECT level FROM shared) * w, cap::DOUBLE) THEN cap::DOUBLE ELSE (SELECT level FROM shared) * w END AS target
  FROM levels),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goals),
lefts AS (SELECT *, target - whole * source_size AS remainder FROM parts),
upto AS (
  SELECT h.*, l.source_size, l.target, l.whole, l.remainder, sum(size) OVER (PARTITION BY h.source ORDER BY h, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM hashed h JOIN lefts l ON h.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN upto <= remainder OR (upto - size <= remainder AND (remainder - (upto - size)) * 2 >= size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM upto
"""
