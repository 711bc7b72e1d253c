"""Arrow IPC files as a Spark data source: a partition for some record batches, Arrow batches all the way.

The data source's tasks open files themselves, on a disk that all share; other stores are read through Spark's ``binaryFile``.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.canonical import UNIT
from .files import Store


class UnsupportedArrow(ValueError):
    """A column of a type without a counterpart."""


def files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(glob.glob(os.path.join(path, "*.arrow"))) if os.path.isdir(path) else [path]


def _target(t: pa.DataType) -> pa.DataType:
    """The Arrow type in which a column goes to Spark."""
    if pa.types.is_uint8(t):
        return pa.int16()
    if pa.types.is_uint16(t):
        return pa.int32()
    if pa.types.is_uint32(t):
        return pa.int64()
    if pa.types.is_uint64(t):
        return pa.decimal128(20, 0)
    if pa.types.is_date64(t):
        return pa.date32()
    if pa.types.is_timestamp(t):
        return pa.int64() if t.unit == "ns" else pa.timestamp("us", t.tz)
    if pa.types.is_large_string(t):
        return pa.string()
    if pa.types.is_large_binary(t):
        return pa.binary()
    if pa.types.is_list(t):
        return pa.list_(_target(t.value_type))
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _target(f.type)) for f in t])
    if pa.types.is_integer(t) or pa.types.is_boolean(t) or pa.types.is_date32(t) or pa.types.is_string(t) or pa.types.is_binary(t) or pa.types.is_decimal(t) or t in (pa.float32(), pa.float64()):
        return t
    raise UnsupportedArrow(f"Arrow type {t} is not supported")


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    return pa.ipc.open_file(pa.memory_map(path.removeprefix("file://")))


def read_schema(path: str) -> T.StructType:
    found = files(path)
    if not found:
        raise FileNotFoundError(f"no Arrow files under {path}")
    return schema_of(_open(found[0]).schema)


def schema_of(schema: pa.Schema) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_type

    fields = []
    for f in schema:
        metadata = {UNIT: f.type.unit} if pa.types.is_timestamp(f.type) and f.type.unit != "us" else {}
        fields.append(T.StructField(f.name, from_arrow_type(_target(f.type), prefer_timestamp_ntz=True), True, metadata))
    return T.StructType(fields)


def _convert(column: pa.Array, target: pa.DataType) -> pa.Array:
    return column if column.type == target else column.cast(target, safe=False) if pa.types.is_timestamp(column.type) else column.cast(target)


def converted(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_convert(c, _target(c.type)) for c in batch.columns], names=batch.schema.names)


#: Bytes of a file that a partition takes, by whole record batches.
PARTITION_BYTES = 16 << 20


@dataclass
class _Batches(InputPartition):
    path: str
    first: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in files(self.path):
            n = _open(path).num_record_batches
            step = max(1, n * PARTITION_BYTES // max(1, os.path.getsize(path)))
            out += [_Batches(path, i, min(i + step, n)) for i in range(0, n, step)]
        return out or [_Batches("", 0, 0)]

    def read(self, partition: _Batches) -> Iterator[pa.RecordBatch]:
        source = _open(partition.path) if partition.end else None
        for i in range(partition.first, partition.end):
            yield converted(source.get_batch(i))


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceArrowWriter):
    """Each task writes its own file; the files appear under their names when the job commits."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.tag = path.removeprefix("file://"), overwrite, uuid.uuid4().hex[:8]

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        where = os.path.join(self.path, f".part-{context.partitionId():05d}-{self.tag}-{context.taskAttemptId()}.tmp")
        sink = None
        for batch in batches:
            if sink is None:
                sink = pa.ipc.new_file(where, batch.schema)
            sink.write_batch(batch)
        if sink is None:
            return _Written(None)
        sink.close()
        return _Written(where)

    def commit(self, messages: list[_Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "part-*.arrow")):
                os.remove(old)
        for m in messages:
            if m is not None and m.path:
                folder, name = os.path.split(m.path)
                os.replace(m.path, os.path.join(folder, name[1:].rsplit("-", 1)[0] + ".arrow"))

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


#: Bytes of a part that is written through the driver.
PART_BYTES = 64 << 20


def write_arrow(df: DataFrame, folder: str, store: Store) -> None:
    """A folder of Arrow files. Tasks write to a shared local folder themselves; into any other store the parts go through the driver."""
    spark = df.sparkSession
    if store.is_local(folder):
        spark.dataSource.register(ArrowFiles)
        df.write.format("rowforge_arrow").mode("append").save(folder)
        return

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PART_BYTES:
                yield _file(held)
                held, size = [], 0
        if held:
            yield _file(held)

    def _file(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, held[0].schema) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["file"])

    for i, row in enumerate(df.mapInArrow(files, "file binary").toLocalIterator()):
        store.write(f"{folder}/part-{i:05d}.arrow", [bytes(row["file"])])


def read_remote(spark: SparkSession, path: str, store: Store) -> tuple[DataFrame, T.StructType]:
    """Arrow files of a store that only Spark reads; a task takes a file (2 GB at most) as a whole."""
    found = [f for f in store.parts(path) if f.endswith(".arrow")] if store.is_folder(path) else [path]
    if not found:
        raise FileNotFoundError(f"no Arrow files under {path}")
    schema = schema_of(pa.ipc.open_file(store.opened(found[0])).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                source = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for i in range(source.num_record_batches):
                    yield converted(source.get_batch(i))

    return spark.read.format("binaryFile").load(found).select("content").mapInArrow(run, schema), schema


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rowforge_arrow"

    def schema(self) -> T.StructType:
        return read_schema(self.options["path"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)
