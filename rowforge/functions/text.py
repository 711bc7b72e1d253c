"""Rows as lines of JSON or CSV text, built from built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .canonical import JSON_KIND, UNIT, canonical_text, float_text, is_container


class NoSuchText(ValueError):
    """A column that the format cannot hold."""


def quoted(c: Column) -> Column:
    """A JSON string, with <, > and & (and the two line separators of Unicode) escaped for HTML."""
    text = F.to_json(F.struct(c.alias("v")))
    text = F.substr(text, F.lit(6), F.length(text) - 6)
    for ch, code in (("<", "003c"), (">", "003e"), ("&", "0026"), (" ", "2028"), (" ", "2029")):
        text = F.replace(text, F.lit(ch), F.lit("\\u" + code))
    return text


def json_value(c: Column, dt: T.DataType, metadata: dict | None = None) -> Column:
    """JSON text of a column's values, null as ``null``."""
    metadata = metadata or {}
    if metadata.get(JSON_KIND):
        return F.coalesce(c, F.lit("null"))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        text = F.when(c.isNull() | finite, float_text(c, negative_zero=True)).otherwise(F.raise_error(F.lit("JSON has no NaN or infinity")))
    elif isinstance(dt, T.StringType):
        text = quoted(c)
    elif isinstance(dt, T.BinaryType):
        text = quoted(F.decode(c, "UTF-8"))
    elif isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)) or metadata.get(UNIT) == "ns":
        text = F.concat(F.lit('"'), canonical_text(c, dt, metadata), F.lit('"'))
    elif isinstance(dt, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_value(x, dt.elementType)), ","), F.lit("]"))
    elif isinstance(dt, T.StructType):
        text = json_object([(f.name, c.getField(f.name), f.dataType, f.metadata) for f in dt.fields])
    elif isinstance(dt, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), json_value(e["value"], dt.valueType)))
        text = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    else:
        text = c.cast("string")
    return F.when(c.isNotNull(), text).otherwise("null")


def json_object(fields: Sequence[tuple[str, Column, T.DataType, dict]]) -> Column:
    from ..sources.jsonvalues import text

    parts = [F.concat(F.lit(text(name) + ":"), json_value(c, dt, metadata)) for name, c, dt, metadata in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def positional(df: DataFrame) -> tuple[DataFrame, list[T.StructField]]:
    """``df`` with columns named by place, so that repeated names are no obstacle, and the fields they stand for."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.schema.fields


def json_lines(df: DataFrame, names: str | None = None) -> DataFrame:
    """A ``value`` column with a JSON object per row. ``names``: a column with the (original) names that a row has."""
    from ..sources.readers import ORIGINAL
    from ..sources.jsonvalues import text

    placed, fields = positional(df)
    if names is None or names not in df.columns:
        return placed.select(json_object([(f.name, F.col(f"c{i}"), f.dataType, f.metadata) for i, f in enumerate(fields)]).alias("value"))
    has = F.col(f"c{df.columns.index(names)}")
    entries = []
    for i, f in enumerate(fields):
        if f.name != names:
            member = F.concat(F.lit(text(f.name) + ":"), json_value(F.col(f"c{i}"), f.dataType, f.metadata))
            entries += [F.lit((f.metadata or {}).get(ORIGINAL, f.name)), member]
    members = F.filter(F.transform(has, lambda n: F.try_element_at(F.create_map(*entries), n)), lambda m: m.isNotNull())
    return placed.select(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("value"))


#: Characters that Unicode counts as space; a CSV field that begins with one is quoted.
_SPACES = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def csv_field(c: Column, dt: T.DataType, metadata: dict | None, delimiter: str) -> Column:
    if (metadata or {}).get(JSON_KIND) or is_container(dt):
        raise NoSuchText("CSV and TSV cannot hold lists, maps or columns of values of different kinds")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.coalesce(float_text(c, negative_zero=True), F.lit(""))
    text = F.coalesce(canonical_text(c, dt, metadata), F.lit(""))
    if not isinstance(dt, (T.StringType, T.BinaryType)):
        return text
    quote = F.contains(text, F.lit(delimiter)) | F.rlike(text, F.lit(f'["\\r\\n]|^[{_SPACES}]')) | (text == "\\.")
    return F.when(quote, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """A ``value`` column with a CSV record per row, without line ends of its own."""
    placed, fields = positional(df)
    parts = [csv_field(F.col(f"c{i}"), f.dataType, f.metadata, delimiter) for i, f in enumerate(fields)]
    return placed.select((F.concat_ws(delimiter, *parts) if parts else F.lit("")).alias("value"))


def csv_header(names: Sequence[str], delimiter: str = ",") -> str:
    out = []
    for n in names:
        risky = any(ch in n for ch in (delimiter, '"', "\r", "\n")) or n[:1].isspace() or n == "\\."
        out.append('"' + n.replace('"', '""') + '"' if risky else n)
    return delimiter.join(out)
