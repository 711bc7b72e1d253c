"""One text for each value, and what counts as empty.

The text of a value is what predicates on strings, CSV and profiles see: integers in decimal, floats with the fewest
digits that read back (positional from 1e-6 up to 1e21, else with an exponent), booleans as words, dates and
timestamps in ISO 8601 with as many fraction digits as the column's unit has. Null, the empty string and containers
have none.

A column whose values differ in kind (ragged JSON) is a string column of JSON values, marked in its
metadata; see :data:`JSON_KIND`.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: Metadata key of a string column that holds JSON values, one per row.
JSON_KIND = "rf.json"
#: Metadata key of a timestamp's (or ns long's) unit: s, ms, us or ns.
UNIT = "ts_unit"

_FRACTION = {"s": 3, "ms": 3, "us": 6, "ns": 9}


def is_container(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StructType, T.ArrayType, T.MapType))


def float_text(c: Column, negative_zero: bool = False) -> Column:
    """Shortest text of a float or double column; cast a float itself, never its double."""
    raw = c.cast("string")
    digits_of = F.regexp_replace(raw, "^-", "")
    mantissa = F.substring_index(digits_of, "E", 1)
    exponent = F.when(F.instr(digits_of, "E") > 0, F.substring_index(digits_of, "E", -1)).otherwise(F.lit("0"))
    exponent = exponent.try_cast("int")
    point = F.instr(mantissa, ".") - 1 + exponent
    all_digits = F.translate(mantissa, ".", "")
    digits = F.regexp_replace(all_digits, "^0+", "")
    point = point - (F.length(all_digits) - F.length(digits))
    digits = F.regexp_replace(digits, "0+$", "")
    n = F.length(digits)
    left = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
    left = left.when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
    positional = left.otherwise(F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
    power = point - 1
    tail = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit(""))
    scientific = F.concat(F.left(digits, F.lit(1)), tail, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))
    magnitude = F.abs(c)
    # The bounds are compared at the column's own width.
    plain = (magnitude >= F.lit(1e-6).cast("double")) & (magnitude < F.lit(1e21).cast("double"))
    text = F.when(plain, positional).otherwise(scientific)
    sign = F.when(c < 0, "-").otherwise("")
    # From 1e-3 up to 1e7 the cast is positional already, but for a whole number's ".0"; only the rest is rebuilt.
    usual = F.when(F.endswith(raw, F.lit(".0")), F.left(raw, F.length(raw) - 2)).otherwise(raw)
    zero = F.when(F.startswith(raw, F.lit("-")), "-0").otherwise("0") if negative_zero else F.lit("0")
    special = F.when(F.isnan(c), "NaN").when(magnitude == F.lit(float("inf")), F.when(c > 0, "+Inf").otherwise("-Inf"))
    return special.when(c == 0, zero).when(F.instr(raw, "E") == 0, usual).when(c.isNotNull(), F.concat(sign, text))


def time_text(c: Column, dt: T.DataType, unit: str = "us") -> Column:
    digits = _FRACTION[unit]
    if isinstance(dt, T.LongType):  # nanoseconds
        seconds = F.date_format(F.timestamp_seconds(F.floor(c / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")), "yyyy-MM-dd'T'HH:mm:ss")
        return F.concat(seconds, F.lit("."), F.lpad(F.pmod(c, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))
    return F.date_format(c, f"yyyy-MM-dd'T'HH:mm:ss.{'S' * digits}'Z'")


def canonical_text(c: Column, dt: T.DataType, metadata: dict | None = None) -> Column:
    """Text of a column's values; null where a value has none."""
    metadata = metadata or {}
    if metadata.get(JSON_KIND):
        return json_text(c)
    if isinstance(dt, T.StringType):
        return F.when(c != "", c)
    if isinstance(dt, T.BinaryType):
        return F.when(F.octet_length(c) > 0, F.decode(c, "UTF-8"))
    if metadata.get(UNIT) == "ns" and isinstance(dt, T.LongType):
        return time_text(c, dt, "ns")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return float_text(c)
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return time_text(c, dt, metadata.get(UNIT, "us"))
    if is_container(dt) or isinstance(dt, T.NullType):
        return F.lit(None).cast("string")
    return c.cast("string")


def is_empty(c: Column, dt: T.DataType, metadata: dict | None = None) -> Column:
    """Null, the empty string, an empty list or an empty map; never null itself."""
    if (metadata or {}).get(JSON_KIND):
        return c.isNull() | c.isin("null", '""', "[]", "{}")
    if isinstance(dt, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(dt, T.BinaryType):
        return c.isNull() | (F.octet_length(c) == 0)
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(dt, T.StructType) and not dt.fields:
        return F.lit(True)
    return c.isNull()


# --- JSON values ---------------------------------------------------------------------------------------


def json_first(c: Column) -> Column:
    return F.substring(c, 1, 1)


def json_is_text(c: Column) -> Column:
    return json_first(c) == '"'


def json_is_bool(c: Column) -> Column:
    return c.isin("true", "false")


def json_is_container(c: Column) -> Column:
    return json_first(c).isin("{", "[")


def json_is_number(c: Column) -> Column:
    return F.rlike(json_first(c), F.lit("[-0-9]"))


def json_string(c: Column) -> Column:
    """The string that a JSON string value stands for."""
    return F.when(json_is_text(c), F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"])


def json_text(c: Column) -> Column:
    whole = F.rlike(c, F.lit("^-?[0-9]+$")) & c.try_cast("long").isNotNull()
    number = F.when(whole, F.when(c == "-0", "0").otherwise(c)).otherwise(float_text(c.try_cast("double")))
    text = json_string(c)
    return F.when(json_is_text(c), F.when(text != "", text)).when(json_is_bool(c), c).when(json_is_number(c), number)
