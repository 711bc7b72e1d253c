"""DataFrames to files.

All formats are written as parallel parts. One continuous output is those parts in order, streamed through the driver into
the file and, on the way, its codec; row groups of Parquet and record batches of Arrow are copied as they are. Otherwise the
output is a folder of parts, each a whole file: with its header, if any.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..functions.canonical import JSON_KIND, is_container
from ..session import ship
from . import codecs
from .arrow import write_arrow
from .files import Store
from .readers import NAMES, ORIGINAL, Records


class RaggedOutput(ValueError):
    """Records that one schema cannot hold."""


def original_names(df: DataFrame) -> list[str]:
    """Names as files know them: a repeated header name comes back as it was, unless the column was renamed."""
    from .readers import unique

    originals = [(f.metadata or {}).get(ORIGINAL, f.name) for f in df.schema.fields]
    return [o if u == f.name else f.name for f, o, u in zip(df.schema.fields, originals, unique(originals), strict=True)]


def check_uniform(records: Records, fmt: str) -> None:
    if fmt == "json":
        return
    if records.ragged:
        raise RaggedOutput(f"{fmt} output needs one schema: {records.ragged}")
    for f in records.df.schema.fields:
        if fmt != "arrow" and is_container(f.dataType):
            raise RaggedOutput(f'{fmt} output cannot hold column "{f.name}": its values are lists or maps')
        if (f.metadata or {}).get(JSON_KIND):
            raise RaggedOutput(f'{fmt} output cannot hold column "{f.name}": it holds values of different kinds')
    names = records.df.columns
    if fmt in ("parquet", "arrow") and len(set(names)) < len(names):
        raise RaggedOutput(f"{fmt} output cannot hold columns of one name")


def write(records: Records, out: str, fmt: str, *, single: bool = True, codec: str | None = None, delimiter: str | None = None, header: bool = False) -> int:
    """Write and return the number of files."""
    df, spark = records.df, ship(records.df.sparkSession)
    store = Store(spark)
    codec = codec or codecs.by_extension(out)
    if codec == "bzip2":
        raise codecs.BadCompression("bzip2 output is not supported (bzip2 input is)")
    check_uniform(records, fmt)
    folder = store.scratch("out") if single else out
    if NAMES in df.columns and fmt != "json":
        df = df.drop(NAMES)
    first = b""
    if fmt == "json":
        X.json_lines(df, NAMES).write.text(folder)
    elif fmt in ("csv", "tsv"):
        delimiter = delimiter or (",", "\t")[fmt == "tsv"]
        rows = X.csv_lines(df, delimiter)
        if header and single:
            first = (X.csv_header(original_names(df), delimiter) + "\n").encode()
        elif header:  # every part of a folder is a file of its own
            rows = with_header(rows, X.csv_header(original_names(df), delimiter))
        rows.write.text(folder)
    elif fmt == "parquet":
        df.select(*(F.col(f"`{c}`") for c in sorted(df.columns))).write.parquet(folder)
    elif fmt == "arrow":
        write_arrow(df, folder, store)
    else:
        raise ValueError(f'unknown format "{fmt}"')
    parts = store.parts(folder)
    if not single:
        return len(parts)
    if fmt == "parquet":
        join_parquet(spark, parts, joined := f"{folder}-joined/part-0.parquet")
        parts = [joined]

    def content() -> Iterator[bytes]:
        if first:
            yield first
        for part in parts:
            yield from store.chunks(part)

    plain = join_arrow([store.opened(p) for p in parts], df) if fmt == "arrow" else content()
    store.write(out, codecs.compress(plain, codec))
    store.delete(folder.rpartition("/")[0])
    return 1


def with_header(rows: DataFrame, top: str) -> DataFrame:
    """Lines with ``top`` ahead of those of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                yield pa.RecordBatch.from_arrays([pa.array([top], batch.schema.field(0).type)], schema=batch.schema)
                begun = True
            yield batch

    return rows.select("value").mapInArrow(run, "value string")


def join_parquet(spark: SparkSession, parts: list[str], out: str) -> None:
    """One Parquet file of the parts' row groups, as they are: pages are copied, not decoded."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop, util = jvm.org.apache.parquet.hadoop, jvm.org.apache.parquet.hadoop.util
    files = [util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(p), conf) for p in parts]
    reader = hadoop.ParquetFileReader.open(files[0])
    try:
        meta = reader.getFooter().getFileMetaData()
    finally:
        reader.close()
    target = util.HadoopOutputFile.fromPath(jvm.org.apache.hadoop.fs.Path(out), conf)
    writer = hadoop.ParquetFileWriter(target, meta.getSchema(), jvm.org.apache.parquet.hadoop.ParquetFileWriter.Mode.CREATE, 128 << 20, 0)
    writer.start()
    for file in files:
        writer.appendFile(file)
    writer.end(meta.getKeyValueMetaData())


def join_arrow(parts: list, df: DataFrame) -> Iterator[bytes]:
    """One Arrow file of the parts' record batches, as bytes; no more than a batch is held."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = _Tail()
    writer = None
    for part in parts:
        source = pa.ipc.open_file(part)
        writer = writer or pa.ipc.new_file(held, source.schema)
        for i in range(source.num_record_batches):
            writer.write_batch(source.get_batch(i))
            yield held.take()
        part.close()
    (writer or pa.ipc.new_file(held, to_arrow_schema(df.schema))).close()
    yield held.take()


class _Tail(io.RawIOBase):
    """Where a writer puts bytes that are taken away at once."""

    def __init__(self):
        self.pieces: list[bytes] = []

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.pieces.append(bytes(data))
        return len(self.pieces[-1])

    def take(self) -> bytes:
        out, self.pieces = b"".join(self.pieces), []
        return out


def copy_lines(df: DataFrame, out: str, codec: str | None = None) -> int:
    """Lines of a ``value`` column as they are, into one file."""
    store = Store(df.sparkSession)
    folder = store.scratch("out")
    df.select("value").write.text(folder)
    parts = store.parts(folder)
    store.write(out, codecs.compress((d for p in parts for d in store.chunks(p)), codec or codecs.by_extension(out)))
    store.delete(folder.rpartition("/")[0])
    return 1
