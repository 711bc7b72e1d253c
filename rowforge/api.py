"""Convert, consume and profile files."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import IO, Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import profile as P
from .operators.stages import RecordTransform, RowFilter, Stages, observed, staged
from .operators.transform import Drop, Rename
from .plans.predicate import Predicate
from .session import ship
from .sources import codecs, detect as D, documents as documents_of, readers, writers
from .sources.files import Store

log = logging.getLogger("rowforge")


@dataclass
class Options:
    """Everything a run can be told. A number of 0 or less means the default; bad values fail before a file is opened."""

    input_format: str | None = None
    input_compression: str | None = None
    max_decompressed_size: int = 0
    output_format: str = "json"
    output_compression: str | None = None
    single_file: bool = True
    csv_delimiter: str | None = None
    csv_has_header: bool = False
    where: str | None = None
    where_strict: bool = False
    filters: Sequence[RowFilter] = ()
    transforms: Sequence[RecordTransform] = ()
    rules: Sequence[Rename | Drop] = ()
    max_row_errors: int = 0
    on_skip: Callable[[str], None] | None = None
    profile_top: int = P.TOP
    profile_columns: Sequence[str] | None = None
    profile_max_distinct: int = 0
    #: Hints that Spark's own settings replace: parallelism, split and batch sizes.
    workers: int = 0
    chunk_size: int = 0
    batch_size: int = 0
    read_buffer_size: int = 0
    max_open_readers: int = 0

    def __post_init__(self):
        for f in (self.input_format, self.output_format):
            if f is not None and f not in D.FORMATS:
                raise ValueError(f'unknown format "{f}"')
        for c in (self.input_compression, self.output_compression):
            if c is not None and c not in codecs.CODECS:
                raise ValueError(f'unknown compression "{c}"')
        if self.csv_delimiter is not None and (len(self.csv_delimiter) != 1 or self.csv_delimiter in '\0"\r\n�'):
            raise ValueError(f"delimiter {self.csv_delimiter!r} is not allowed")
        if self.where_strict and self.where is None:
            raise ValueError("where_strict says how where acts, which is missing")
        predicate = [Predicate.parse(self.where, self.where_strict)] if self.where is not None else []
        self.stages = Stages([*predicate, *self.filters], self.transforms, self.rules)


@dataclass
class Stats:
    rows_read: int = 0
    rows_skipped: int = 0
    rows_filtered: int = 0
    predicate_misses: int = 0
    unseen_columns: list[str] = field(default_factory=list)
    documents_dispatched: int = 0
    read_seconds: float = 0.0
    write_seconds: float = 0.0


def detect_format(spark: SparkSession, path: str, options: Options | None = None) -> str:
    return D.detect(spark, path, options.input_compression if options else None)[0]


class _Opened:
    """An input ready for Spark: plain bytes under a path, their format, and what to delete at the end."""

    def __init__(self, spark: SparkSession, path: str | bytes | IO[bytes], o: Options):
        self.store, self.spooled = Store(spark), None
        self._to_delete = []
        if not isinstance(path, str):  # bytes, or anything with read(): spooled where Spark can reach it
            source, path = path, self.store.scratch("input")
            self.store.write(path, [source] if isinstance(source, (bytes, bytearray)) else iter(lambda: source.read(8 << 20), b""))
            self._to_delete.append(path)
        self.many = many = "*" in path or self.store.is_folder(path)  # parts of one format: the name or the options say which
        head = b"" if many else self.store.head(path, D.HEAD)
        codec = codecs.NONE if many else o.input_compression or codecs.detect(head, path)
        self.path = path
        if codec != codecs.NONE:
            self.path = self.spooled = self.store.scratch("plain")
            self.store.write(self.path, codecs.decompress(self.store.chunks(path), codec, o.max_decompressed_size or None))
            head = self.store.head(self.path, D.HEAD)
        named = D.by_extension(path)
        self.format = o.input_format or (named or "parquet" if many else D.sniff(head, named, len(head) < D.HEAD))
        if named and named != self.format:
            log.info("%s is named like %s but holds %s", path, named, self.format)

    def __enter__(self) -> _Opened:
        self.case = readers.setting(self.store.spark, "spark.sql.caseSensitive", "true")  # names in files are case-sensitive
        self.case.__enter__()
        return self

    def __exit__(self, *_) -> None:
        self.case.__exit__(None, None, None)
        for path in [*self._to_delete, *([self.spooled] if self.spooled else [])]:
            self.store.delete(path.rpartition("/")[0])


def _read(spark: SparkSession, opened: _Opened, o: Options) -> readers.Records:
    records = readers.read(spark, opened.path, opened.format, o.csv_delimiter, o.csv_has_header, max(o.max_row_errors, 0))
    if o.on_skip:
        for error in records.errors:
            o.on_skip(error)
    return records


def read(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """A plain file as a DataFrame, after the options' stages. Lazy; compressed input is spooled and stays until the session ends."""
    o = options or Options()
    with readers.setting(ship(spark), "spark.sql.caseSensitive", "true"):
        return staged(_read(spark, _Opened(spark, path, o), o).df, o.stages)[0]


def process(spark: SparkSession, path: str, out: str, options: Options | None = None) -> Stats:
    """Convert a file. All or nothing: a failing row leaves no output."""
    o, began = options or Options(), time.monotonic()
    ship(spark)
    with _Opened(spark, path, o) as opened:
        if opened.format == o.output_format == "json" and not o.stages.any and o.max_row_errors <= 0:
            return _pass_through(spark, opened, out, o)
        records = _read(spark, opened, o)
        stats = Stats(rows_skipped=records.skipped, read_seconds=time.monotonic() - began)
        df, counts = staged(records.df, o.stages, counts=True)
        ragged = records.ragged if o.output_format != "json" else None
        staged_records = readers.Records(df, records.format, ragged=ragged)
        began = time.monotonic()
        parts = writers.write(staged_records, out, o.output_format, single=o.single_file, codec=o.output_compression, delimiter=o.csv_delimiter, header=o.csv_has_header)
        found = counts.get()
        stats.rows_read, stats.rows_filtered, stats.predicate_misses = found["rows_read"], found["rows_filtered"], found["predicate_misses"]
        stats.unseen_columns = counts.unseen if stats.rows_read else []
        stats.documents_dispatched = stats.rows_read - stats.rows_filtered if o.output_format == "json" else parts
        stats.write_seconds = time.monotonic() - began
        return stats


def _pass_through(spark: SparkSession, opened: _Opened, out: str, o: Options) -> Stats:
    """NDJSON to NDJSON with nothing to do: lines as they are."""
    df = readers.lines(spark, opened.path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    df, seen = observed(df.where(F.trim("value") != ""), rows=F.count(F.lit(1)))
    began = time.monotonic()
    writers.copy_lines(df, out, o.output_compression)
    n = seen.get["rows"]
    return Stats(rows_read=n, documents_dispatched=n, write_seconds=time.monotonic() - began)


def deliver(spark: SparkSession, path: str | bytes | IO[bytes], handler: Callable[[bytes], None], options: Options | None = None) -> Stats:
    """Give a file's rows to ``handler`` as documents: a JSON text per row, or a whole file per ``batch_size`` rows of any other format.

    Documents are made on the executors and handed over on the driver, a partition at a time. Rows of an unchanged format
    with nothing to do pass as they are: lines of NDJSON, CSV and TSV (without a header), row groups of Parquet.
    """
    o, began = options or Options(), time.monotonic()
    ship(spark)
    with _Opened(spark, path, o) as opened:
        same = opened.format == o.output_format and not o.stages.any and o.max_row_errors <= 0
        stats, delivered = Stats(), 0
        if same and (opened.format == "json" or opened.format in ("csv", "tsv") and not (o.csv_has_header and opened.many)):
            documents = documents_of.raw_lines(readers.lines(spark, opened.path), opened.format != "json", o.csv_has_header)
        elif same and opened.format == "parquet" and (groups := documents_of.row_groups(spark, opened.path)) is not None:
            documents = groups
        else:
            records = _read(spark, opened, o)
            df, bound = staged(records.df, o.stages)
            staged_records = readers.Records(df, records.format, ragged=records.ragged if o.output_format != "json" else None)
            stats.rows_skipped, stats.unseen_columns = records.skipped, bound.unseen
            documents = documents_of.encoded(staged_records, o.output_format, o.batch_size if o.batch_size > 0 else 512, o.csv_delimiter, o.csv_has_header)
            if o.stages.filters:
                # Documents go out partition by partition, in a job each, and observations would tell of the first alone.
                counted, counts = staged(records.df, o.stages, counts=True)
                counted.agg(F.count(F.lit(1))).collect()
                found = counts.get()
                stats.rows_read, stats.rows_filtered, stats.predicate_misses = found["rows_read"], found["rows_filtered"], found["predicate_misses"]
        for row in documents.toLocalIterator():
            handler(bytes(row["document"]))
            stats.documents_dispatched += 1
            delivered += row["rows"]
        stats.rows_read = stats.rows_read or delivered
        stats.write_seconds = time.monotonic() - began
        return stats


def consume(spark: SparkSession, path: str, partial: Callable[[Iterator[pa.RecordBatch]], Any], merge: Callable[[Any, Any], Any], options: Options | None = None) -> Any:
    """Decode and stage a file, give each partition's Arrow batches to ``partial`` and merge the small results in order.

    Results travel as pickles, one per partition. None if there is nothing to read.
    """
    import pickle

    o = options or Options()
    ship(spark)
    with _Opened(spark, path, o) as opened:
        df, _ = staged(_read(spark, opened, o).df, o.stages)

        def run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(partial(batches))], pa.binary())], names=["state"])

        out = None
        for row in df.mapInArrow(run, "state binary").toLocalIterator():
            state = pickle.loads(row["state"])
            out = state if out is None else merge(out, state)
        return out


def profile(spark: SparkSession, path: str, options: Options | None = None) -> P.Profile:
    """Profile a file's rows after the stages."""
    o = options or Options()
    ship(spark)
    with _Opened(spark, path, o) as opened:
        records = _read(spark, opened, o)
        df, counts = staged(records.df, o.stages, counts=bool(o.stages.filters))
        found = P.profile(df, o.profile_top, o.profile_columns, o.profile_max_distinct or None)
        found.rows_skipped, found.unseen_columns = records.skipped, counts.unseen
        found.predicate_misses = counts.get()["predicate_misses"] if counts.misses else 0
        return found
