"""``python -m rowforge convert`` and ``python -m rowforge stats``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import api
from .operators import profile as P
from .sources.readers import RowErrors


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("--in", dest="input", required=True, help="input file path")
    p.add_argument("--in-format", help="override detection: json, parquet, csv, tsv or arrow")
    p.add_argument("--in-compression", help="none, gzip, zstd, bzip2, xz, lz4, snappy or brotli")
    p.add_argument("--workers", type=int, default=0, help="local threads (0: all)")
    p.add_argument("--batch-size", type=int, default=0)
    p.add_argument("--chunk-size", type=int, default=0)
    p.add_argument("--max-open-readers", type=int, default=0)
    p.add_argument("--csv-delimiter", default="")
    p.add_argument("--csv-has-header", action="store_true")
    p.add_argument("--max-row-errors", type=int, default=0)
    p.add_argument("--where")
    p.add_argument("--where-strict", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rowforge")
    verbs = top.add_subparsers(dest="verb", required=True)
    convert = verbs.add_parser("convert")
    _common(convert)
    convert.add_argument("--out", required=True, help="output file path")
    convert.add_argument("--out-format", default="json", help="json, parquet, csv, tsv or arrow")
    convert.add_argument("--out-compression", default="auto", help="auto (by extension), none, gzip, zstd, xz, lz4, snappy or brotli")
    convert.add_argument("--read-buffer-size", type=int, default=0)
    stats = verbs.add_parser("stats")
    _common(stats)
    stats.add_argument("--output", default="table", help="table or json")
    stats.add_argument("--top", type=int, default=P.TOP)
    stats.add_argument("--max-distinct", type=int, default=0)
    stats.add_argument("--columns", default="")
    stats.add_argument("--max-value-width", type=int, default=60)
    return top


def _options(a: argparse.Namespace, **more) -> api.Options:
    if a.where is not None and not a.where.strip():
        raise ValueError("--where has no predicate")
    if a.where_strict and a.where is None:
        raise ValueError("--where-strict says how --where acts, which is missing")
    return api.Options(
        input_format=a.in_format or None, input_compression=a.in_compression or None, csv_delimiter=a.csv_delimiter or None, csv_has_header=a.csv_has_header,
        max_row_errors=a.max_row_errors, where=a.where, where_strict=a.where_strict, workers=a.workers, batch_size=a.batch_size, chunk_size=a.chunk_size,
        max_open_readers=a.max_open_readers, **more,
    )


def _warn(where: str | None, misses: int, unseen: list[str]) -> None:
    if misses:
        print(f'warning: {misses} values could not be compared as --where "{where}" asks and matched nothing (--where-strict makes that an error)', file=sys.stderr)
    for name in unseen:
        print(f'warning: no record has the column "{name}" of --where "{where}"', file=sys.stderr)


def session(workers: int = 0) -> SparkSession:
    builder = SparkSession.builder.appName("rowforge").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if SparkSession.getActiveSession() is None and workers >= 0:
        builder = builder.master(f"local[{workers or '*'}]")
    return builder.getOrCreate()


def convert(a: argparse.Namespace, spark: SparkSession) -> None:
    codec = None if a.out_compression in ("", "auto") else a.out_compression
    o = _options(a, output_format=a.out_format, output_compression=codec, read_buffer_size=a.read_buffer_size)
    try:
        s = api.process(spark, a.input, a.out, o)
    except RowErrors as e:
        for i, error in enumerate(e.errors, 1):
            print(f"row error {i}/{len(e.errors)}: {error}", file=sys.stderr)
        raise
    _warn(a.where, s.predicate_misses, s.unseen_columns)
    skipped = f", {s.rows_skipped} rows skipped" if s.rows_skipped else ""
    print(f"wrote {a.out}: {s.rows_read} rows read{skipped}, {s.documents_dispatched} documents dispatched")


def stats(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.output not in ("table", "json"):
        raise ValueError(f'--output: unknown rendering "{a.output}"')
    if a.top < 1:
        raise ValueError("--top must be at least 1")
    columns = [c for c in a.columns.split(",") if c] or None
    o = _options(a, profile_top=a.top, profile_columns=columns, profile_max_distinct=a.max_distinct)
    p = api.profile(spark, a.input, o)
    _warn(a.where, 0, p.unseen_columns)
    for want in columns or ():
        if not any(c.name == want or c.name.startswith(want + ".") for c in p.columns):
            print(f'warning: no attribute is called "{want}" (--columns)', file=sys.stderr)
    print(P.as_json(p) if a.output == "json" else P.render(p, a.input, a.max_value_width), end="" if a.output == "table" else "\n")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        (convert if a.verb == "convert" else stats)(a, spark or session(a.workers))
    except Exception as e:
        print(f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0
