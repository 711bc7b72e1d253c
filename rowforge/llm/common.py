"""What the training-data operators share: word rule, checkpoint folder, Arrow batches."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship
from ..sources.files import shared_folder

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that one numpy pass works on; bounds a Python worker's memory.
PIECE_CHARS = 400_000


def n_words(text: Column) -> Column:
    """Number of words of a text column, 0 for null; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; a temporary one only in local mode, where it names none."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, so later passes neither recompute nor depend on executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Seconds that Python's bridge to the JVM may take to pass on what Python no longer holds.
PAUSE = 2.0


def release(spark: SparkSession) -> None:
    """Have Spark delete shuffle files that no plan needs any more. It does so for what the driver's JVM has collected as garbage, which may be late."""
    gc.collect()
    time.sleep(PAUSE)
    spark._jvm.System.gc()


#: Type of the places that ``placed`` gives.
PLACE = "struct<file:bigint,row:bigint>"
#: A key is hot if more than this share of the rows have it, so that there are no more hot keys than its inverse.
HOT = 1 / 10_000


def joined_by(rows: DataFrame, table: DataFrame, key: str, weight: str, only: Column | None = None, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each key and in ``weight`` how many rows have that key.

    Hot keys, 10,000 at most, are broadcast and their rows stay where they are; only rows of other keys are shuffled.
    Rows outside ``only`` have no partner and are not shuffled either. Both tables are read more than once, so they should be stored.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(weight) > max(total * HOT, 1)))
    columns = [c for c in table.columns if c != key]
    out = rows.join(hot, key)
    cold = rows.join(hot.select(key), key, "left_anti")
    if only is not None and how == "left":
        nothing = rows.where(~F.coalesce(only, F.lit(False)))
        out = out.unionByName(nothing.join(hot.select(key), key, "left_anti").withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in columns}).select(*out.columns))
        cold = cold.where(only)
    return out.unionByName(cold.join(table.where(F.col(weight) <= max(total * HOT, 1)), key, how).select(*out.columns))


def placed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column of two longs that tells rows apart, the same in every pass.

    Rows of Parquet files are told by file and row. Those of any other plan are told by Spark's partition and row, which stay only
    as long as the input is split the same way.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        try:
            meta = docs.metadataColumn("_metadata")
            found = docs.withColumn(name, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row")))
            found.schema  # noqa: B018  only Parquet files number their rows
            return found
        except AnalysisException:
            pass
    return docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")))


def fresh(*names: str) -> list[str]:
    """Column names that clash with no column of the input."""
    tag = uuid.uuid4().hex[:8]
    return [f"__{n}_{tag}" for n in names]


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Whole texts of a batch's column, null as the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``PIECE_CHARS`` bytes of text; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > PIECE_CHARS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema, text: str) -> DataFrame:
    """``function`` over slices of bounded text size. Rows stay in their partition."""

    def run(batches):
        for piece in pieces(batches, text):
            yield function(piece)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
