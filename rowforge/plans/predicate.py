"""Predicates as Columns.

Every test lowers to two Columns: ``match`` (never null) and ``miss`` (the value could not be compared with the
literal). ``and`` and ``or`` count the misses of their right side only where the left side leaves the answer open, so
counts do not depend on the order in which the engine evaluates. For filtering there is a second form, made for
pushdown: negations move to the tests, a typed test is the bare comparison (null acts as false), a negated one
is the inverse comparison or null.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import canonical as C
from .syntax import And, Compare, Empty, In, InvalidWhere, Literal, Node, Not, Or, TextTest, compared_paths, parse

__all__ = ["Bound", "InvalidWhere", "Predicate"]

_INVERSE = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}
_WHOLE_TEXT = r"^[+-]?[0-9]+$"
_PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

NOT_NUMBER = "does not spell a number"
CONTAINER = "holds several values"
BOOLEAN = "is true or false"
NOT_BOOLEAN = "is neither true nor false"
TEMPORAL = "is a point in time, which only a quoted date or time can be compared with"


def _apply(op: str, left: Column, right: Column) -> Column:
    match op:
        case "=":
            return left == right
        case "!=":
            return left != right
        case "<":
            return left < right
        case "<=":
            return left <= right
        case ">":
            return left > right
    return left >= right


@dataclass
class Value:
    """What a path leads to."""

    column: Column
    type: T.DataType
    metadata: dict = field(default_factory=dict)

    @property
    def empty(self) -> Column:
        return C.is_empty(self.column, self.type, self.metadata)

    @property
    def text(self) -> Column:
        return C.canonical_text(self.column, self.type, self.metadata)

    @property
    def is_json(self) -> bool:
        return bool(self.metadata.get(C.JSON_KIND))

    @property
    def is_time(self) -> bool:
        return isinstance(self.type, (T.DateType, T.TimestampType, T.TimestampNTZType)) or self.metadata.get(C.UNIT) == "ns"


@dataclass
class Test:
    """A test on a value: true and miss (both never null; miss None if it cannot happen), and forms for pushdown."""

    true: Column
    miss: Column | None = None
    reasons: Sequence[tuple[Column, str]] = ()
    positive: Column | None = None
    negative: Column | None = None


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def resolve(schema: T.StructType, path: Sequence[str]) -> Value | None:
    """The value at a path, through maps, structs and JSON values; the first of columns of one name. None if no record can have it."""
    names = [f.name for f in schema.fields]
    if path[0] not in names:
        return None
    top = schema.fields[names.index(path[0])]
    value = Value(F.col("`" + path[0].replace("`", "``") + "`"), top.dataType, top.metadata or {})
    for k, name in enumerate(path[1:], 1):
        if value.is_json:
            keys = "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path[k:])
            inner = F.to_json(F.try_variant_get(F.try_parse_json(value.column), F.lit("$" + keys), "variant"))
            return Value(F.when(C.json_is_container(value.column), inner), T.StringType(), {C.JSON_KIND: True})
        if isinstance(value.type, T.StructType):
            found = next((f for f in value.type.fields if f.name == name), None)
            if found is None:
                return None
            value = Value(value.column.getField(name), found.dataType, found.metadata or {})
        elif isinstance(value.type, T.MapType) and isinstance(value.type.keyType, T.StringType):
            value = Value(F.try_element_at(value.column, F.lit(name)), value.type.valueType)
        else:
            return None
    return value


def _typed(value: Value, compared: Column, inverse: Column | None) -> Test:
    """A comparison that cannot miss, on a value that null alone makes empty."""
    negative = None if inverse is None else inverse | value.column.isNull()
    return Test(_sure(compared), positive=compared, negative=negative)


def _always_miss(value: Value, reason: str) -> Test:
    miss = ~value.empty
    return Test(F.lit(False), miss, [(miss, reason)])


def _date_like(value: Value, op: str, text: str) -> tuple[Column, Column] | None:
    """A timestamp against a bare date, as a comparison of timestamps: stored texts are longer than the literal."""
    if not isinstance(value.type, (T.TimestampType, T.TimestampNTZType)) or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        return None
    bound = F.lit(text).try_cast(value.type.simpleString())
    # Years beyond four digits have texts with a sign, which stands ahead of all digits; those before the year 1 come first either way.
    four = value.column <= F.lit("9999-12-31 23:59:59.999999").try_cast(value.type.simpleString())
    if op in (">", ">="):
        return (value.column >= bound) & four, (value.column < bound) | ~four
    if op in ("<", "<="):
        return (value.column < bound) | ~four, (value.column >= bound) & four
    return None


def _compare_text(value: Value, op: str, text: str) -> Test:
    literal = F.lit(text)
    if C.is_container(value.type):
        return _always_miss(value, CONTAINER)
    if value.is_json:
        miss = C.json_is_container(value.column) & ~value.empty
        return Test(_sure(_apply(op, value.text, literal)), _sure(miss), [(_sure(miss), CONTAINER)])
    if isinstance(value.type, T.StringType):
        c = value.column
        compared = _apply(op, c, literal) & (c != "")
        return Test(_sure(compared), positive=compared, negative=_apply(_INVERSE[op], c, literal) | c.isNull() | (c == ""))
    exact = _apply(op, value.text, literal)
    test = Test(_sure(exact), positive=exact)
    if _valid_date(text) and (forms := _date_like(value, op, text)):
        test.positive, test.negative = forms[0], forms[1] | value.column.isNull()
        test.true = _sure(forms[0])
    return test


def _valid_date(text: str) -> bool:
    import datetime

    try:
        datetime.date.fromisoformat(text)
    except ValueError:
        return False
    return True


def _number_literal(value: T.DataType, literal: Literal) -> Column:
    if isinstance(value, T.FloatType):
        return F.lit(literal.value).cast("float")
    return F.lit(literal.value).cast("double")


def _compare_whole_text(text: Column, op: str, literal: Literal) -> tuple[Column, Column]:
    """(true, miss) of a text that should spell a number."""
    plain = F.rlike(text, F.lit(_PLAIN_NUMBER))
    number = F.when(plain, text.try_cast("double"))
    usable = _sure(number.isNotNull() & (F.abs(number) != F.lit(float("inf"))))
    compared = _apply(op, number, F.lit(literal.value))
    if literal.whole is not None:
        exact = F.when(F.rlike(text, F.lit(_WHOLE_TEXT)), F.regexp_replace(text, r"^\+", "").try_cast("decimal(38,0)"))
        fits = exact.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit(str((1 << 64) - 1)).cast("decimal(38,0)"))
        compared = F.when(_sure(fits), _apply(op, exact, F.lit(str(literal.whole)).cast("decimal(38,0)"))).otherwise(compared)
    return _sure(usable & compared), ~usable


def _compare_number(value: Value, op: str, literal: Literal) -> Test:
    c, dt = value.column, value.type
    if C.is_container(dt):
        return _always_miss(value, CONTAINER)
    if value.is_json:
        text = F.when(C.json_is_text(c), C.json_string(c)).when(C.json_is_number(c), c)
        true, miss = _compare_whole_text(text, op, literal)
        present, scalar = ~value.empty, C.json_is_text(c) | C.json_is_number(c)
        reasons = [
            (_sure(present & C.json_is_container(c)), CONTAINER), (_sure(present & C.json_is_bool(c)), BOOLEAN), (_sure(present & scalar & miss), NOT_NUMBER),
        ]
        return Test(_sure(present & scalar & true), _sure(present & (~scalar | miss)), reasons)
    if value.is_time:
        return _always_miss(value, TEMPORAL)
    if isinstance(dt, T.BooleanType):
        return _always_miss(value, BOOLEAN)
    if isinstance(dt, (T.StringType, T.BinaryType)):
        text = c if isinstance(dt, T.StringType) else F.decode(c, "UTF-8")
        true, miss = _compare_whole_text(text, op, literal)
        miss = _sure(~value.empty & miss)
        return Test(_sure(~value.empty & true), miss, [(miss, NOT_NUMBER)])
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        bound = _number_literal(dt, literal)
        if op == "!=":
            compared = F.isnan(c) | (c != bound)
            return Test(_sure(c.isNotNull() & compared), positive=c.isNotNull() & compared, negative=(c == bound) | c.isNull())
        # Spark orders NaN above all numbers; here it matches nothing but !=.
        guarded = _apply(op, c, bound) & ~F.isnan(c) if op in (">", ">=") else _apply(op, c, bound)
        negative = _apply(_INVERSE[op], c, bound) | c.isNull() | F.isnan(c)
        return Test(_sure(guarded), positive=guarded, negative=negative)
    if literal.whole is not None:
        small = -(1 << 63) <= literal.whole < 1 << 63
        if isinstance(dt, T.DecimalType) or not small:
            wide = c if isinstance(dt, T.DecimalType) else c.cast("decimal(20,0)")
            bound = F.lit(str(literal.whole)).cast("decimal(20,0)")
            return _typed(value, _apply(op, wide, bound), _apply(_INVERSE[op], wide, bound))
        # A literal that fits the column's own width is pushed down without a cast of the column.
        width = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(dt), 64)
        narrow = -(1 << (width - 1)) <= literal.whole < 1 << (width - 1)
        bound = F.lit(literal.whole).cast(dt if narrow else T.LongType())
        return _typed(value, _apply(op, c, bound), _apply(_INVERSE[op], c, bound))
    bound = F.lit(literal.value).cast("double")
    return _typed(value, _apply(op, c.cast("double"), bound), _apply(_INVERSE[op], c.cast("double"), bound))


def _compare_bool(value: Value, op: str, literal: Literal) -> Test:
    c, dt, wanted = value.column, value.type, F.lit(str(literal.value).lower())
    if C.is_container(dt):
        return _always_miss(value, CONTAINER)
    if isinstance(dt, T.BooleanType):
        bound = F.lit(bool(literal.value))
        return _typed(value, _apply(op, c, bound), _apply(_INVERSE[op], c, bound))
    if not value.is_json and not isinstance(dt, (T.StringType, T.BinaryType)):
        return _always_miss(value, NOT_BOOLEAN)
    text = value.text
    word = F.translate(text, "TRUEFALS", "truefals")
    right = _sure(word.isin("true", "false"))
    if value.is_json:
        right = right & _sure(C.json_is_text(c) | C.json_is_bool(c))
        container = _sure(C.json_is_container(c) & ~value.empty)
        miss = _sure(~value.empty & ~right)
        return Test(_sure(right & _apply(op, word, wanted)), miss, [(container, CONTAINER), (miss & ~container, NOT_BOOLEAN)])
    miss = _sure(~value.empty & ~right)
    return Test(_sure(right & _apply(op, word, wanted)), miss, [(miss, NOT_BOOLEAN)])


def _compare(value: Value, op: str, literal: Literal) -> Test:
    if literal.kind == "string":
        return _compare_text(value, op, literal.value)
    return _compare_number(value, op, literal) if literal.kind == "number" else _compare_bool(value, op, literal)


def _in(value: Value, node: In) -> Test:
    tests = [_compare(value, "=", lit) for lit in node.literals]
    found = tests[0].true
    for t in tests[1:]:
        found = found | t.true
    missing = [t.miss for t in tests if t.miss is not None]
    miss = None
    if missing:
        miss = missing[0]
        for m in missing[1:]:
            miss = miss | m
        miss = ~found & miss
    plain = None
    if all(lit.kind == "string" for lit in node.literals) and isinstance(value.type, T.StringType) and not value.is_json:
        plain = value.column.isin(*(lit.value for lit in node.literals if lit.value != "")) if any(lit.value for lit in node.literals) else F.lit(False)
    elif miss is None:
        plain = found
    reasons = [(~found & when, why, node.literals[i]) for i, t in enumerate(tests) for when, why in t.reasons]
    if not node.negate:
        return Test(found, miss, reasons, positive=plain)
    true = ~value.empty & ~found if miss is None else ~value.empty & ~found & ~miss
    positive = ~value.empty & ~plain if plain is not None and miss is None else None
    return Test(_sure(true), miss, reasons, positive=positive)


def _text_test(value: Value, node: TextTest) -> Test:
    if C.is_container(value.type):
        return _always_miss(value, CONTAINER)
    test = F.contains if node.op == "contains" else F.startswith
    if value.is_json:
        miss = _sure(C.json_is_container(value.column) & ~value.empty)
        return Test(_sure(test(value.text, F.lit(node.text))), miss, [(miss, CONTAINER)])
    if isinstance(value.type, T.StringType):
        found = test(value.column, F.lit(node.text))
        if node.text == "":
            found = found & (value.column != "")
        return Test(_sure(found), positive=found)
    found = test(value.text, F.lit(node.text))
    return Test(_sure(found), positive=found)


@dataclass
class Bound:
    """A predicate on a schema."""

    match: Column
    #: Number of misses of a row, or None if no row can have one.
    misses: Column | None
    #: A condition for ``filter`` that keeps the same rows as ``match``, in the form that pushes down.
    keep: Column
    #: Compared columns that no record can have, sorted.
    unseen: list[str]


@dataclass(frozen=True)
class Predicate:
    text: str
    node: Node
    strict: bool = False

    @classmethod
    def parse(cls, text: str, strict: bool = False) -> Predicate:
        try:
            return cls(text, parse(text), strict)
        except InvalidWhere as e:
            raise InvalidWhere(f'invalid where expression "{text}": {e}') from None

    def bind(self, schema: T.StructType) -> Bound:
        match, misses = self._exact(self.node, schema)
        unseen = sorted({".".join(p) for p in compared_paths(self.node) if resolve(schema, p) is None})
        keep = match if self.strict else self._filter(self.node, schema, False)
        return Bound(match, misses, keep, unseen)

    def filter(self, df: DataFrame) -> DataFrame:
        """The matching rows."""
        return df.filter(self.bind(df.schema).keep)

    # Both walks see the same test for a node.
    def _test(self, node: Node, schema: T.StructType) -> Test:
        value = resolve(schema, node.path)
        if isinstance(node, Empty):
            empty = F.lit(True) if value is None else value.empty
            true = ~empty if node.negate else empty
            return Test(true, positive=true, negative=~true)
        if value is None:
            return Test(F.lit(False), positive=F.lit(False), negative=F.lit(True))
        if isinstance(node, Compare):
            return _compare(value, node.op, node.literal)
        return _in(value, node) if isinstance(node, In) else _text_test(value, node)

    def _strict(self, node: Node, test: Test) -> Column:
        """``test.true``, failing where the value cannot be compared."""
        if not self.strict or test.miss is None:
            return test.true
        out = None
        for when, why, *literal in test.reasons:
            against = literal[0] if literal else node.literal if isinstance(node, Compare) else f"'{node.text}'"
            message = f'a value of {".".join(node.path)} {why}; it cannot be held against {against}'
            failing = F.raise_error(F.lit(message)).cast("boolean")
            out = F.when(when, failing) if out is None else out.when(when, failing)
        return out.otherwise(test.true)

    def _exact(self, node: Node, schema: T.StructType) -> tuple[Column, Column | None]:
        if isinstance(node, Not):
            match, misses = self._exact(node.inner, schema)
            return ~match, misses
        if isinstance(node, (And, Or)):
            left, left_misses = self._exact(node.left, schema)
            right, right_misses = self._exact(node.right, schema)
            open_ = left if isinstance(node, And) else ~left
            if right_misses is not None:
                right_misses = F.when(open_, right_misses).otherwise(0)
            both = [m for m in (left_misses, right_misses) if m is not None]
            misses = None if not both else both[0] if len(both) == 1 else both[0] + both[1]
            if self.strict:  # the right side must not fail where the left one settles the answer
                return F.when(open_, right).otherwise(F.lit(isinstance(node, Or))), misses
            return (left & right if isinstance(node, And) else left | right), misses
        test = self._test(node, schema)
        return self._strict(node, test), None if test.miss is None else test.miss.cast("int")

    def _filter(self, node: Node, schema: T.StructType, negated: bool) -> Column:
        if isinstance(node, Not):
            return self._filter(node.inner, schema, not negated)
        if isinstance(node, (And, Or)):
            left, right = (self._filter(n, schema, negated) for n in (node.left, node.right))
            return left & right if isinstance(node, And) != negated else left | right
        test = self._test(node, schema)
        if not negated:
            return test.positive if test.positive is not None else test.true
        return test.negative if test.negative is not None else ~test.true
