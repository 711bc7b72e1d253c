"""Rows as documents: a JSON text per row, or a file of some rows per document, made on the executors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from .readers import NAMES, Records
from .writers import check_uniform, original_names

_SCHEMA = "document binary, rows long"


def _batch(documents: list[bytes], rows: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(documents, pa.binary()), pa.array(rows, pa.int64())], names=["document", "rows"])


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encoded(records: Records, fmt: str, size: int, delimiter: str | None, header: bool) -> DataFrame:
    """(document, rows) of staged records. A CSV header is in the first document of each partition."""
    check_uniform(records, fmt)
    df = records.df
    if fmt == "json":
        return X.json_lines(df, NAMES).select(F.encode("value", "UTF-8").alias("document"), F.lit(1).cast("long").alias("rows"))
    df = df.drop(NAMES)
    if fmt in ("csv", "tsv"):
        delimiter = delimiter or (",", "\t")[fmt == "tsv"]
        first = X.csv_header(original_names(df), delimiter) + "\n" if header else ""

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = first
            for table in _chunks(batches, size):
                values = table.column(0).to_pylist()
                yield _batch([(top + "".join(v + "\n" for v in values)).encode()], [len(values)])
                top = ""

        return X.csv_lines(df, delimiter).mapInArrow(lines, _SCHEMA)
    if fmt == "parquet":
        df = df.select(*(F.col(f"`{c}`") for c in sorted(df.columns)))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, size):
            yield _batch([_file(table, fmt)], [table.num_rows])

    return df.mapInArrow(files, _SCHEMA)


def _file(table: pa.Table, fmt: str) -> bytes:
    sink = io.BytesIO()
    if fmt == "parquet":
        import pyarrow.parquet as pq

        pq.write_table(table, sink)
    else:
        with pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
    return sink.getvalue()


def raw_lines(lines: DataFrame, ends: bool, header: bool) -> DataFrame:
    """Lines as they are; ``ends``: with their line ends, and without the header line."""
    value = F.regexp_replace("value", "\r$", "")
    if header and ends:
        lines = lines.withColumn("at", F.monotonically_increasing_id()).where("at != 0")
    value = F.concat(value, F.lit("\n")) if ends else value
    return lines.where(F.trim(F.regexp_replace("value", "\r$", "")) != "").select(F.encode(value, "UTF-8").alias("document"), F.lit(1).cast("long").alias("rows"))


def row_groups(spark: SparkSession, path: str) -> DataFrame | None:
    """Each row group as a file; None where only Spark's readers can open the path."""
    import pyarrow.parquet as pq

    try:
        n = pq.ParquetFile(path.removeprefix("file://")).num_row_groups
    except OSError:
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = pq.ParquetFile(path.removeprefix("file://"))
        for batch in batches:
            for k in batch.column(0).to_pylist():
                table = source.read_row_group(k)
                yield _batch([_file(table, "parquet")], [table.num_rows])

    return spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism))).mapInArrow(read, _SCHEMA)
