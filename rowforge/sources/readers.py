"""Files to DataFrames.

NDJSON whose records all have the same scalars is told by one pass of the JVM and read by Spark's parser. Any other is parsed strictly by Arrow
batches, twice: once for what the columns have in common and which lines are bad, once for the values; a caller who
knows the schema saves the first pass. Rows whose names differ keep theirs in a hidden column, and columns whose kinds differ hold
JSON values. CSV and TSV lines are checked and split by built-in functions; only files with line breaks inside
quotes are parsed in Python, split by split.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.canonical import JSON_KIND, UNIT
from ..session import ship
from . import jsonvalues as J

#: Names that a row has, in its order; only where rows differ.
NAMES = "__rf_names"
#: Metadata key of a column's name in the file.
ORIGINAL = "rf.name"
#: Messages of skipped rows that a run keeps; all are counted.
MESSAGES = 10_000
#: Names that the records of a file may have in all.
MOST_NAMES = 20_000
#: Bytes of records that lie across splits, where CSV has line breaks inside quotes.
MOST_PIECES = 256 << 20
#: First lines that suggest what all lines may be.
SAMPLE = 100


class RowErrors(ValueError):
    """More bad rows than the run may skip."""

    def __init__(self, errors: list[str]):
        self.errors = errors
        super().__init__(f"too many row errors ({len(errors)}): " + "; ".join(errors))


class BadInput(ValueError):
    """A file that is no valid file of its format."""


@dataclass
class Records:
    df: DataFrame
    format: str
    skipped: int = 0
    errors: list[str] = field(default_factory=list)
    #: Why an output with one schema is impossible, if it is.
    ragged: str | None = None

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != NAMES]


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def _budget(errors: list[str], n: int, most: int) -> None:
    if n > most:
        raise RowErrors(errors[: most + 1])


# --- NDJSON ----------------------------------------------------------------------------------------------


def spark_type(shape) -> tuple[T.DataType, dict]:
    simple = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), None: T.StringType()}
    if shape == J.MIXED:
        return T.StringType(), {JSON_KIND: True}
    if isinstance(shape, tuple):
        if shape[0] == "list":
            return T.ArrayType(spark_type(shape[1])[0]), {}
        return T.StructType([T.StructField(k, spark_type(t)[0]) for k, t in shape[1]]), {}
    return simple[shape], {}


def _shape_of(dt: T.DataType, metadata: dict):
    if (metadata or {}).get(JSON_KIND):
        return J.MIXED
    if isinstance(dt, T.StructType):
        return ("object", tuple((f.name, _shape_of(f.dataType, f.metadata)) for f in dt.fields))
    if isinstance(dt, T.ArrayType):
        return ("list", _shape_of(dt.elementType, {}))
    return {T.BooleanType: "bool", T.LongType: "int", T.DoubleType: "float"}.get(type(dt), "str")


def _line(raw: str, first: bool) -> str:
    return raw.removeprefix("﻿").strip(" \t\r\n")


@dataclass
class _Summary:
    names: dict = field(default_factory=dict)
    layouts: set = field(default_factory=set)
    rows: int = 0
    bad: int = 0
    errors: list = field(default_factory=list)
    known: set = field(default_factory=set)

    def add(self, pairs: J.Pairs) -> None:
        self.rows += 1
        kinds = tuple([(name, type(value)) for name, value in pairs])
        if kinds in self.known:
            return
        if len(self.known) < 1000 and not any(k in (list, J.Pairs) for _, k in kinds):
            self.known.add(kinds)
        for name, value in pairs:
            if name not in self.names and len(self.names) >= MOST_NAMES:
                raise BadInput(f"records have more than {MOST_NAMES} names; give them as entries of an object")
            found = J.shape(value)
            self.names[name] = J.merge(self.names.get(name), found) if name in self.names else found
        if len(self.layouts) < 2:
            self.layouts.add(tuple(name for name, _ in pairs))


def _dump(s: _Summary) -> str:
    return repr((list(s.names.items()), sorted(s.layouts), s.rows, s.bad, s.errors))


def _summaries(df: DataFrame, keep_errors: int) -> list[_Summary]:
    """One per partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, met = _Summary(), set()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if not (line := _line(raw, False)):
                    continue
                kinds = J.flat_kinds(line)
                if kinds is not None:
                    if kinds in met:
                        s.rows += 1
                        continue
                    if len(met) < 1000:
                        met.add(kinds)
                try:
                    s.add(J.record(line))
                except J.BadJson as e:
                    s.bad += 1
                    if len(s.errors) < keep_errors:
                        s.errors.append(f"json: {e}")
        yield pa.RecordBatch.from_arrays([pa.array([_dump(s)])], names=["summary"])

    import ast

    rows = df.select("value").mapInArrow(run, "summary string").collect()
    out = []
    for (text,) in rows:
        names, layouts, n, bad, errors = ast.literal_eval(text)
        out.append(_Summary(dict(names), set(layouts), n, bad, errors))
    return out


def _total(parts: list[_Summary], keep_errors: int) -> _Summary:
    total = _Summary()
    for s in parts:
        for name, shape in s.names.items():
            total.names[name] = J.merge(total.names.get(name), shape) if name in total.names else shape
        total.layouts |= s.layouts
        total.rows, total.bad = total.rows + s.rows, total.bad + s.bad
        total.errors = (total.errors + s.errors)[:keep_errors]
    return total


def parse_ndjson(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Good lines of a ``value`` column as rows of the schema."""
    shapes = [(f.name, _shape_of(f.dataType, f.metadata)) for f in schema.fields if f.name != NAMES]
    with_names = NAMES in schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in schema.names}
            for raw in batch.column(0).to_pylist():
                if not (line := _line(raw, False)):
                    continue
                try:
                    pairs = J.record(line)
                except J.BadJson:
                    continue
                values = dict(pairs)
                for name, shape in shapes:
                    columns[name].append(J.plain(values.get(name), shape))
                if with_names:
                    columns[NAMES].append([name for name, _ in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], types[n]) for n in schema.names], names=schema.names)

    out = text.select("value").mapInArrow(run, schema)
    return out.select(*map(_named, schema.fields))


def read_ndjson(spark: SparkSession, path: str | DataFrame, max_row_errors: int = 0, schema: T.StructType | None = None) -> Records:
    """``path`` may be a DataFrame with the lines in ``value``. A given schema takes the file's rows as they are and skips the survey."""
    ship(spark)
    text = path if isinstance(path, DataFrame) else lines(spark, path)
    if schema is not None:
        return Records(parse_ndjson(text, schema), "json")
    if (names := _uniform(text)) is not None:
        s = _Summary(names, {tuple(names)})
    else:
        most = min(max_row_errors, MESSAGES) + 1
        s = _total(_summaries(text, most), most)
        _budget(s.errors, s.bad, max_row_errors)
    fields, ragged = [], None
    for name, shape in s.names.items():
        dt, metadata = spark_type(J.settled(shape))
        fields.append(T.StructField(name, dt, True, metadata | {ORIGINAL: name}))
        if metadata and ragged is None:
            ragged = f'column "{name}" holds values of different kinds'
    if len(s.layouts) > 1:
        ragged = "records have different fields, or the same in another order"
        fields.append(T.StructField(NAMES, T.ArrayType(T.StringType())))
    schema = T.StructType(fields)
    if not s.bad and ragged is None and fields and all(type(f.dataType) in _PLAIN for f in fields) and len({f.name.lower() for f in fields}) == len(fields):
        # Every line has been seen: all are objects of the same scalars, which Spark's parser reads alike.
        value = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "[ \\t\\r]+$", "")
        bare = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
        parsed = text.select(value.alias("value")).where("value != ''").select(F.from_json("value", bare).alias("v")).select("v.*")
        return Records(parsed.select(*(_named(f) for f in fields)), "json")
    return Records(parse_ndjson(text, schema), "json", s.bad, s.errors, ragged)


#: Scalars as a line may spell them, in a strict form that both JSON readers take for the same value.
_SPELLED = {
    "int": "-?(?:0|[1-9][0-9]{0,17}+)", "bool": "true|false", None: "null",
    "float": "-?(?:0|[1-9][0-9]*+)(?:\\.[0-9]++(?:[eE][+-]?[0-9]{1,2}+)?|[eE][+-]?[0-9]{1,2}+)",
    "str": r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}))*+"',
}


def _uniform(text: DataFrame) -> dict | None:
    """Names and kinds of records that all have the same scalars in the same order, else None.

    The first lines say what to ask; one pass of the JVM asks it of every line.
    """
    names: dict | None = None
    for (line,) in text.select("value").limit(SAMPLE).collect():
        if not (line := _line(line, False)):
            continue
        try:
            pairs = J.record(line)
        except J.BadJson:
            return None
        kinds = {name: J.shape(value) for name, value in pairs}
        if names is not None and list(names) != list(kinds):
            return None
        names = {name: J.merge((names or kinds)[name], kind) for name, kind in kinds.items()}
    if not names or any(kind not in _SPELLED or json.dumps(name, ensure_ascii=False) != f'"{name}"' or "\\E" in name for name, kind in names.items()):
        return None
    space = "[ \\t\\r]*+"
    members = f"{space},{space}".join(f'"\\Q{name}\\E"{space}:{space}(?:null|{_SPELLED[kind]})' for name, kind in names.items())
    whole = rf"\A\x{{feff}}?{space}(?:\{{{space}{members}{space}\}}{space})?\z"
    unlike = text.agg(F.count_if(~F.rlike("value", F.lit(whole))).alias("n")).first()["n"]
    return None if unlike else names


_PLAIN = (T.BooleanType, T.LongType, T.DoubleType, T.StringType)


def _named(f: T.StructField):
    return F.col("`" + f.name.replace("`", "``") + "`").alias(f.name, metadata=f.metadata or {})


# --- CSV and TSV -----------------------------------------------------------------------------------------


class BadQuotes(ValueError):
    """A bare or unterminated quote."""


class OtherHeader(ValueError):
    """A file of a folder whose header is not the first file's."""


def parse_fields(text: str, delimiter: str) -> list[list[str]]:
    """RFC 4180 records of a text, without leniency: quotes only around whole fields. Empty lines are no records."""
    if '"' not in text:
        whole = (line.removesuffix("\r") for line in text.split("\n"))
        return [line.split(delimiter) for line in whole if line]
    records, fields, i, n = [], [], 0, len(text)
    while i <= n:
        if i < n and text[i] == '"':
            out, i = [], i + 1
            while True:
                end = text.find('"', i)
                if end < 0:
                    raise BadQuotes("a quoted field is not closed, or something follows its closing quote")
                out.append(text[i:end])
                i = end + 1
                if i < n and text[i] == '"':
                    out.append('"')
                    i += 1
                    continue
                break
            fields.append("".join(out).replace("\r\n", "\n"))
            if text.startswith("\r\n", i):
                i += 1
            if i < n and text[i] not in (delimiter, "\n"):
                raise BadQuotes("a quoted field is not closed, or something follows its closing quote")
        else:
            end = _field_end(delimiter).search(text, i).start()
            value = text[i:end]
            if (end == n or text[end] == "\n") and value.endswith("\r"):
                value = value[:-1]
            if '"' in value:
                raise BadQuotes("a bare quote stands in a field without quotes")
            if not (value == "" and not fields and (end == n or text[end] == "\n")):
                fields.append(value)
            i = end
        if i < n and text[i] == delimiter:
            i += 1
            if i == n:
                fields.append("")
                break
            continue
        if fields:
            records.append(fields)
        fields, i = [], i + 1
    if fields:
        records.append(fields)
    return records


@functools.cache
def _field_end(delimiter: str) -> re.Pattern:
    return re.compile(f"[{re.escape(delimiter)}\n]|\\Z")


def unique(names: list[str]) -> list[str]:
    """Column names for a header that may repeat some: the first keeps its name."""
    out, seen = [], set()
    for i, name in enumerate(names):
        while name in seen:
            name = f"{name}__{i}"
        seen.add(name)
        out.append(name)
    return out


def _wide(df: DataFrame, names: list[str], original: list[str]) -> DataFrame:
    fields = F.col("fields")
    return df.select(*(fields[i].alias(n, metadata={ORIGINAL: o}) for i, (n, o) in enumerate(zip(names, original, strict=True))))


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False, max_row_errors: int = 0, fmt: str = "csv") -> Records:
    """All fields are text. A record of another width than the first is a row error; bad quotes are fatal.

    With a header, the first record of every file of a folder is one, and all must be the same.
    One pass of the JVM learns what the file has; a second one, of the caller, splits lines by built-in functions. Only
    where quoted fields hold line breaks, or a data line repeats the header, are records put together in Python, split by split.
    """
    ship(spark)
    if len(delimiter) != 1 or delimiter in '\0"\r\n\ufffd':
        raise ValueError(f"delimiter {delimiter!r} is not allowed")
    text = lines(spark, path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"))
    top = text.where("start = 0").select(_whole_line()).where("value != ''").first()
    if top is None:
        if header:
            raise BadInput(f"{fmt} header: EOF")
        return Records(spark.createDataFrame([], T.StructType([])), fmt)
    clean = text.select(_whole_line(), "file_path", "start").where("value != ''")
    value, is_top = F.col("value"), (F.col("start") == 0) & (F.col("value") == F.lit(top["value"]))
    shape = Shape(delimiter)
    fields = F.when(F.contains(value, F.lit('"')), shape.quoted(value)).otherwise(shape.plain(value))
    try:
        first = parse_fields(top["value"], delimiter)[0]
    except BadQuotes:
        first = None
    at = F.monotonically_increasing_id()
    census = clean.select("file_path", "start", "value", at.alias("at")).groupBy("file_path").agg(
        F.count_if(F.contains(value, F.lit('"'))).alias("quoted"), F.count_if(_quotes(value) % 2 == 1).alias("odd"), F.count_if(~shape.valid(value)).alias("invalid"),
        F.count_if(shape.width(value) != len(first or ())).alias("wrong"), F.count_if(is_top).alias("tops"), F.min(F.when(F.col("start") == 0, F.col("at"))).alias("first"), F.min(F.when(is_top, F.col("at"))).alias("first_top"),
    )
    seen = census.agg(*(F.sum(c).alias(c) for c in ("quoted", "odd", "invalid", "wrong")), F.count_if((F.col("tops") != 1) | (F.col("first") != F.col("first_top"))).alias("unlike")).first()
    try:
        if first is None or seen["odd"] or header and seen["unlike"]:
            records = _assembled(text, delimiter, header)
            if first is None or seen["odd"]:
                first = _first_record(text, delimiter)
            right = F.size("fields") == len(first)
            bad = records.where(~right)
        else:
            if seen["invalid"]:
                parse_fields(clean.where(~shape.valid(value)).first()["value"], delimiter)  # says what is wrong with it
            clean = clean.where(~is_top) if header else clean
            records = clean.select((fields if seen["quoted"] else shape.plain(value)).alias("fields"))
            right = F.lit(True) if not seen["wrong"] else F.size("fields") == len(first)
            bad = records.where(~right) if seen["wrong"] else None
        bad = bad.select(F.size("fields").alias("n")).limit(min(max_row_errors, MESSAGES) + 1).collect() if bad is not None else []
        errors = [f"{fmt}: {r['n']} fields where {len(first)} belong" for r in bad]
        skipped = len(errors)
        if skipped > MESSAGES:
            skipped = records.where(~right).count()
    except (BadQuotes, OtherHeader) as e:
        raise BadInput(f"{fmt}: {e}") from None
    except Exception as e:
        raise _bad_records(e, fmt) from None
    original = list(first) if header else [f"col{i}" for i in range(len(first))]
    _budget(errors, skipped, max_row_errors)
    return Records(_wide(records.where(right), unique(original), original), fmt, skipped, errors)


def _whole_line() -> Column:
    """A line without its end, and a file's first without the mark of its byte order."""
    value = F.regexp_replace("value", "\r$", "")
    return F.when((F.col("start") == 0) & F.startswith("value", F.lit("\ufeff")), F.substring(value, 2, 1 << 30)).otherwise(value).alias("value")


class Shape:
    """Lines that are whole records, as built-in functions see them."""

    def __init__(self, delimiter: str):
        self.delimiter, d = delimiter, re.escape(delimiter) if delimiter != "\t" else "\t"
        self.pattern = d
        field = rf'(?:"(?:[^"]++|"")*+"|[^"{d}]*+)'
        self.record, self.field = rf"^{field}(?:{d}{field})*+$", rf"{d}({field})"

    def valid(self, value: Column) -> Column:
        return ~F.contains(value, F.lit('"')) | F.rlike(value, F.lit(self.record))

    def plain(self, value: Column) -> Column:
        return F.split(value, self.pattern, -1)

    def _raw(self, value: Column) -> Column:
        return F.regexp_extract_all(F.concat(F.lit(self.delimiter), value), F.lit(self.field), 1)

    def quoted(self, value: Column) -> Column:
        unquoted = lambda f: F.when(F.startswith(f, F.lit('"')), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
        return F.transform(self._raw(value), unquoted)

    def width(self, value: Column) -> Column:
        bare = F.length(value) - F.length(F.replace(value, F.lit(self.delimiter), F.lit(""))) + 1
        return F.when(F.contains(value, F.lit('"')), F.size(self._raw(value))).otherwise(bare)


def _bad_records(e: Exception, fmt: str) -> Exception:
    for kind in ("BadQuotes: ", "OtherHeader: "):
        if kind in str(e):
            return BadInput(f"{fmt}: " + str(e).split(kind)[1].splitlines()[0])
    return e


def _first_record(text: DataFrame, delimiter: str) -> list[str]:
    """The first record of the first file, over as many lines as it has."""
    held, odd = [], 0
    for row in text.where("start = 0").toLocalIterator():
        line = row["value"] if held else row["value"].removeprefix("\ufeff")
        if not held and line.removesuffix("\r") == "":
            continue
        held.append(line)
        odd += line.count('"')
        if odd % 2 == 0:
            break
    return parse_fields("\n".join(held), delimiter)[0]


def _assembled(text: DataFrame, delimiter: str, header: bool) -> DataFrame:
    """Records whose quoted fields may hold line breaks.

    The number of quotes before a split says whether it begins inside a field. A split gives its records up to its end; what it holds of
    a record that begins in an earlier one goes to that one. Such pieces are one per split at most; they travel to
    the workers, and no more than ``MOST_PIECES`` bytes of them may.
    """
    splits = text.groupBy("file_path", "start").agg((F.sum(_quotes(F.col("value"))) % 2).alias("odd"))
    before = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)) == 1)
    inside = {(r["file_path"], r["start"]): r["odd"] for r in splits.where("inside").collect()}

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines with which splits begin that begin inside a field."""
        held: dict[tuple[str, int], list[str]] = {}
        closed: set[tuple[str, int]] = set()
        for batch in batches:
            for line, file, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                key = (file, start)
                if key in inside and key not in closed:
                    held.setdefault(key, []).append(line)
                    if line.count('"') % 2:
                        closed.add(key)
        rows = [(f, s, "\n".join(v), (f, s) in closed) for (f, s), v in held.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.string(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "start", "head", "closed"])

    pieces: dict[str, list[tuple[int, str, bool]]] = {}
    size = 0
    if inside:
        within = F.broadcast(splits.where("inside").select("file_path", "start"))
        for r in text.join(within, ["file_path", "start"], "left_semi").select("value", "file_path", "start").mapInArrow(heads, "file string, start long, head string, closed boolean").toLocalIterator():
            size += len(r["head"])
            if size > MOST_PIECES:
                raise BadInput(f"records that cross splits hold over {MOST_PIECES} bytes; raise spark.sql.files.maxPartitionBytes")
            pieces.setdefault(r["file"], []).append((r["start"], r["head"], r["closed"]))
    for found in pieces.values():
        found.sort()
    top = _first_record(text, delimiter) if header else None

    def rest(file: str, start: int) -> list[str]:
        """What later splits hold of a record that begins in this one."""
        out = []
        for at, head, closed in pieces.get(file, ()):
            if at > start:
                out.append(head)
                if closed:
                    break
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, skipping, whole, odd, begun = None, False, [], 0, False

        def parsed(ends: bool) -> list[list[str]]:
            nonlocal whole, odd, begun
            if key is None:
                return []
            if ends and odd:
                whole += rest(*key)
            elif odd:
                return []
            rows = parse_fields("\n".join(whole), delimiter)
            whole, odd = [], 0
            if rows and key[1] == 0 and not begun:
                begun = True
                if top is not None and rows.pop(0) != top:
                    raise OtherHeader(f"the header of {key[0]} is not the first file's")
            return rows

        for batch in batches:
            out = []
            for line, file, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (file, start) != key:
                    out += parsed(True)
                    key, whole, odd, begun = (file, start), [], 0, False
                    skipping = key in inside
                    if start == 0:
                        line = line.removeprefix("\ufeff")
                quotes = line.count('"') % 2
                if skipping:
                    skipping = not quotes
                    continue
                whole.append(line)
                odd ^= quotes
            out += parsed(False)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["fields"])
        yield pa.RecordBatch.from_arrays([pa.array(parsed(True), pa.list_(pa.string()))], names=["fields"])

    return text.mapInArrow(run, "fields array<string>")


# --- Parquet and Arrow -----------------------------------------------------------------------------------


@contextmanager
def setting(spark: SparkSession, key: str, value: str | None):
    """A session setting for some lines of the driver's code; None leaves it as it is."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if value is not None:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _units(schema: pa.Schema) -> dict[str, str]:
    return {f.name: f.type.unit for f in schema if pa.types.is_timestamp(f.type)}


def read_parquet(spark: SparkSession, path: str) -> Records:
    """Timestamps keep their unit in the metadata where the driver can see a footer; nanoseconds are longs."""
    units = {}
    try:
        import pyarrow.dataset as ds

        units = _units(ds.dataset(path.removeprefix("file://"), format="parquet").schema)
    except (OSError, pa.ArrowException, ValueError):
        pass  # not a path that the driver can open: Spark's own types hold
    with setting(spark, "spark.sql.legacy.parquet.nanosAsLong", "true" if "ns" in units.values() else None):
        df = spark.read.parquet(path)
        df.schema  # noqa: B018  resolved while the setting holds
    tagged = {f.name: (f.metadata or {}) | {UNIT: units[f.name]} for f in df.schema.fields if f.name in units and units[f.name] != "us"}
    for name, metadata in tagged.items():
        df = df.withMetadata(name, metadata)
    return Records(df, "parquet")


def read_arrow(spark: SparkSession, path: str) -> Records:
    from .arrow import ArrowFiles, read_remote, read_schema
    from .files import Store

    ship(spark)
    if (store := Store(spark)).is_local(path):
        spark.dataSource.register(ArrowFiles)
        df, schema = spark.read.format("rowforge_arrow").load(path), read_schema(path)
    else:
        df, schema = read_remote(spark, path, store)
    for f in schema.fields:
        if f.metadata:
            df = df.withMetadata(f.name, f.metadata)
    return Records(df, "arrow")


def read(spark: SparkSession, path: str, fmt: str, delimiter: str | None = None, header: bool = False, max_row_errors: int = 0) -> Records:
    match fmt:
        case "json":
            return read_ndjson(spark, path, max_row_errors)
        case "csv" | "tsv":
            return read_delimited(spark, path, delimiter or (",", "\t")[fmt == "tsv"], header, max_row_errors, fmt)
        case "parquet":
            return read_parquet(spark, path)
        case "arrow":
            return read_arrow(spark, path)
    raise ValueError(f'unknown format "{fmt}"')


