"""Predicates: the language, the cases, and Columns against a plain evaluator on random expressions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F, types as T

from rowforge.functions.canonical import JSON_KIND
from rowforge.plans.predicate import InvalidWhere, Predicate
from rowforge.plans.syntax import And, Compare, Empty, In, Not, Or, TextTest, parse

SAMPLE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("age", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("age_text", T.StringType()),
    T.StructField("active", T.BooleanType()), T.StructField("flag_text", T.StringType()), T.StructField("blank", T.StringType()), T.StructField("nothing", T.LongType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("msg", T.StringType()),
    T.StructField("attrs", T.StructType([T.StructField("env", T.StringType()), T.StructField("a.b", T.StringType()), T.StructField("deep", T.StructType([T.StructField("n", T.LongType())]))])),
])
ROW = ("alice", 30, 4.5, "42", True, "TRUE", "", None, ["a"], "connection timeout", ("prod", "dotted", (7,)))

CASES = {
    "name = 'alice'": True, 'name = "alice"': True, "name != 'bob'": True, "name = 'bob'": False, "name < 'b'": True, "NAME = 'alice'": False,
    "age = 30": True, "age > 18": True, "age < 30": False, "age != 30": False, "age > 29.5": True, "age == 30": True, "score > 4": True, "score = 4.5": True,
    "age_text > 40": True, "age_text = 42": True, "age = '30'": True, "active = true": True, "active != true": False, "flag_text = true": True,
    "blank is empty": True, "nothing is empty": True, "missing is empty": True, "name is empty": False, "name is not empty": True, "tags is empty": False,
    "blank = ''": False, "blank != 'a'": False, "nothing = 1": False, "missing != 'x'": False, "attrs.env = 'prod'": True, "attrs.deep.n = 7": True,
    "attrs.`a.b` = 'dotted'": True, "attrs.missing = 'x'": False, "name.sub = 'x'": False, "name in ('alice', 'bob')": True, "name not in ('alice')": False,
    "name not in ('carol')": True, "missing in ('a')": False, "missing not in ('a')": False, "age in (1, 30)": True, "msg contains 'timeout'": True,
    "msg starts_with 'timeout'": False, "missing contains 'x'": False, "age > 18 AND name = 'alice'": True, "age > 40 or name = 'bob'": False, "not age > 40": True,
    "not (age > 18 and name = 'alice')": False, "age > 18 and (name = 'bob' or active = true)": True, "not missing = 1": True, "age contains '3'": True, "active contains 'ru'": True,
    "not tags = 'a'": True, "not blank = 'a'": True,
}


def test_cases(spark):
    df = spark.createDataFrame([ROW], SAMPLE)
    got = df.select(*(F.struct(b.match.alias("m"), df_keep.alias("k")).alias(f"c{i}") for i, (b, df_keep) in enumerate((b, F.coalesce(b.keep, F.lit(False))) for b in (Predicate.parse(t).bind(df.schema) for t in CASES)))).first()
    for (text, want), cell in zip(CASES.items(), got, strict=True):
        assert cell["m"] is want, text
        assert cell["k"] is want, f"pushdown form of {text}"


@pytest.mark.parametrize(
    ("text", "column", "part"),
    [
        ("age >", 6, "the expression ends"), ("(age = 1", 9, "should close"), ("age ~ 1", 5, "'~' has no meaning"), ("name contains 5", 15, "takes a quoted string"),
        ("active < true", 8, "have no order"), ("age in ()", 9, "a number, a quoted string"), ("not = 1", 1, "backticks"), ("größe", 6, "comes a comparison"),
        ("a = 1 b", 7, "follows a complete expression"), ("a = 'x", 5, "never closed"), ("a = '\\q'", 6, "is no escape"), ("`a = 1", 1, "none closes"),
        ("a = 1x", 5, "does not spell a number"), ("a = 1" + " or a = 1" * 20_000, 1, "limit"), ("not " * 70 + "a = 1", None, "levels of nesting"),
    ],
)
def test_errors_name_the_column(text, column, part):
    with pytest.raises(InvalidWhere) as e:
        Predicate.parse(text)
    assert part in str(e.value)
    if column:
        assert f"syntax error at column {column}:" in str(e.value)


def test_long_expressions_stay_shallow():
    node, depth = parse(" or ".join(["a = 1"] * 7000)), 0
    while hasattr(node, "left"):
        node, depth = node.left, depth + 1
    assert depth <= 13


def test_keywords_are_names_where_nothing_else_can_stand():
    for name in ("and", "or", "in", "is", "empty", "contains"):
        assert parse(f"{name} = 1").path == (name,)
    assert parse("`not` = 1").path == ("not",)


def misses(spark, text, value, dt, metadata=None):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", dt, True, metadata or {})]))
    b = Predicate.parse(text).bind(df.schema)
    r = df.select(b.match.alias("m"), (b.misses if b.misses is not None else F.lit(0)).alias("n")).first()
    kept = df.filter(b.keep).count()
    assert kept == int(r["m"])
    return r["m"], r["n"]


def test_numbers_in_text(spark):
    for text in ("inf", "NaN", "0x10", "1_000", " 42", "42 ", "e", "-", ".", "1e999", "1d"):
        assert misses(spark, "x > 0", text, T.StringType()) == (False, 1), text
    for text, want in {"1e3": True, "4.5": True, ".5": True, "-0.0": False, "+7": True}.items():
        assert misses(spark, "x > 0", text, T.StringType()) == (want, 0), text
    assert misses(spark, "x = 9007199254740993", "9007199254740993", T.StringType()) == (True, 0)
    assert misses(spark, "x = 9007199254740992", "9007199254740993", T.StringType()) == (False, 0)
    assert misses(spark, "x < 18446744073709551615", "18446744073709551615", T.StringType()) == (False, 0)


def test_misses_by_kind(spark):
    import datetime

    assert misses(spark, "x in (1, 'abc')", "abc", T.StringType()) == (True, 0)
    assert misses(spark, "x in (1, 2)", "n/a", T.StringType()) == (False, 1)
    assert misses(spark, "x not in (1, 2)", "n/a", T.StringType()) == (False, 1)
    assert misses(spark, "x > 1000", datetime.date(2024, 1, 1), T.DateType()) == (False, 1)
    assert misses(spark, "not x > 1000", datetime.datetime(2024, 1, 1), T.TimestampNTZType()) == (True, 1)
    assert misses(spark, "x >= '2024-01-01' and x < '2024-01-02'", datetime.datetime(2024, 1, 1), T.TimestampNTZType()) == (True, 0)
    assert misses(spark, "x = 1", True, T.BooleanType()) == (False, 1)
    assert misses(spark, "x = true", 1, T.LongType()) == (False, 1)
    assert misses(spark, "x contains 'a'", ["a"], T.ArrayType(T.StringType())) == (False, 1)
    assert misses(spark, "x contains 'a'", [], T.ArrayType(T.StringType())) == (False, 0)
    assert misses(spark, "x = 1", None, T.StringType()) == (False, 0)


def test_number_edges(spark):
    nan, inf = float("nan"), float("inf")
    for text, want in {"x = 1": False, "x != 1": True, "x < 1": False, "x > 1": False, "not x > 1": True}.items():
        assert misses(spark, text, nan, T.DoubleType()) == (want, 0), text
    assert misses(spark, "x > 1e300", inf, T.DoubleType()) == (True, 0)
    assert misses(spark, "x = 0", -0.0, T.DoubleType()) == (True, 0)
    assert misses(spark, "x = 0.1", 0.1, T.FloatType()) == (True, 0)
    assert misses(spark, "x = '0.1'", 0.1, T.FloatType()) == (True, 0)
    assert misses(spark, "x < 18446744073709551615", (1 << 63) - 1, T.LongType()) == (True, 0)
    assert misses(spark, "x < -9223372036854775807", -(1 << 63), T.LongType()) == (True, 0)
    from decimal import Decimal

    assert misses(spark, "x = 18446744073709551615", Decimal((1 << 64) - 1), T.DecimalType(20, 0)) == (True, 0)
    assert misses(spark, "x > 300", 5, T.ByteType()) == (False, 0)


def test_json_values(spark):
    tag = {JSON_KIND: True}
    for text, value, want in (
        ("x > 18", '"unknown"', (False, 1)), ("x > 18", "30", (True, 0)), ("x > 18", '"30"', (True, 0)), ("x = 'unknown'", '"unknown"', (True, 0)), ("x = true", "true", (True, 0)),
        ("x = 1", "true", (False, 1)), ("x = 'a'", "[1]", (False, 1)), ("x = 'a'", "[]", (False, 0)), ("x is empty", '""', (True, 0)), ("x.a.b = 2", '{"a":{"b":2}}', (True, 0)),
        ("x.a = 'q'", '{"a":"q"}', (True, 0)), ("x.a is empty", '{"b":1}', (True, 0)), ("x = '1000'", "1e3", (True, 0)),
    ):
        assert misses(spark, text, value, T.StringType(), tag) == want, (text, value)


def test_short_circuit_counts(spark):
    df = spark.createDataFrame([(5, "zz")], "a long, b string")
    n = lambda t: df.select(Predicate.parse(t).bind(df.schema).misses).first()[0]
    assert n("a > 1 or b > 1") == 0
    assert n("b > 1 or a > 1") == 1
    assert n("a < 1 and b > 1") == 0
    assert n("not (b > 1)") == 1


def test_strict(spark):
    df = spark.createDataFrame([("abc", 5)], "x string, a long")
    p = lambda t: df.filter(Predicate.parse(t, strict=True).bind(df.schema).keep).count()
    assert p("x in ('abc', 1)") == 1
    assert p("a > 1 or x > 1") == 1
    for text in ("x > 18", "x in (1, 2)"):
        with pytest.raises(Exception, match='a value of x does not spell a number; it cannot be held against'):
            p(text)


def test_pushdown(spark, sf):
    def plan(text, table="lineitem"):
        df = Predicate.parse(text).filter(spark.read.parquet(f"{sf}/{table}.parquet"))
        spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
        return re.search(r"PushedFilters: (\[.*?\])(?:,|\n)", df._jdf.queryExecution().toString(), re.DOTALL)[1]

    assert "GreaterThanOrEqual(l_quantity,30.0)" in plan("l_quantity >= 30")
    assert "GreaterThanOrEqual(l_linenumber,3)" in plan("l_linenumber >= 3")
    assert "Or(LessThan(l_linenumber,3),IsNull(l_linenumber))" in plan("not l_linenumber >= 3").replace(" ", "")
    assert "In(l_returnflag" in plan("l_returnflag in ('R','A')")
    assert "StringContains" in plan("l_returnflag contains 'R'")
    assert "o_orderdate" in plan("o_orderdate >= '1997-01-01'", "orders")


# --- random expressions against a plain evaluator ----------------------------------------------------------

FIELDS = {"s": T.StringType(), "i": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "l": T.ArrayType(T.LongType())}
VALUES = {
    "s": [None, "", "a", "b", "5", "-3", "4.5", "n/a", "true", "9007199254740993"], "i": [None, 0, 5, -3, 9007199254740993], "d": [None, 0.0, 4.5, -3.0, math.nan, math.inf],
    "b": [None, True, False], "l": [None, [], [1]],
}
LITERALS = ["5", "-3", "4.5", "9007199254740993", "'a'", "'5'", "''", "true", "false", "'n/a'"]


def expression(rng, depth=0):
    if depth < 3 and rng.random() < 0.5:
        op = rng.choice(["and", "or", "not"])
        return f"not ({expression(rng, depth + 1)})" if op == "not" else f"({expression(rng, depth + 1)} {op} {expression(rng, depth + 1)})"
    path = rng.choice([*FIELDS, "gone"])
    kind = rng.randrange(5)
    if kind == 0:
        return f"{path} is {rng.choice(['', 'not '])}empty"
    if kind == 1:
        return f"{path} {rng.choice(['', 'not '])}in ({', '.join(rng.choices(LITERALS, k=rng.randint(1, 3)))})"
    if kind == 2:
        return f"{path} {rng.choice(['contains', 'starts_with'])} {rng.choice([chr(39) + c + chr(39) for c in ('a', '5', 'ru', '')])}"
    literal = rng.choice(LITERALS)
    return f"{path} {rng.choice(['=', '!='] if literal in ('true', 'false') else ['=', '!=', '<', '<=', '>', '>='])} {literal}"


class Miss(Exception):
    pass


def order(op, a, b):
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def text_of(v):
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "NaN" if v != v else "+Inf" if v == math.inf else repr(v).removesuffix(".0")
    return str(v)


def compare(v, op, lit):
    if v is None or v == "" or v == []:
        return False
    if isinstance(v, list):
        raise Miss
    if lit.kind == "string":
        return order(op, text_of(v), lit.value)
    if lit.kind == "bool":
        word = text_of(v).lower() if isinstance(v, (str, bool)) else ""
        if word not in ("true", "false"):
            raise Miss
        return order(op, word == "true", lit.value)
    if isinstance(v, bool):
        raise Miss
    if isinstance(v, str):
        if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
            raise Miss
        v = int(v) if re.fullmatch(r"[+-]?\d+", v) else float(v)
    if isinstance(v, int) and lit.whole is not None:
        return order(op, v, lit.whole)
    return order(op, float(v), float(lit.value))


def evaluate(node, row):
    match node:
        case Not(inner):
            m, n = evaluate(inner, row)
            return not m, n
        case And(a, b) | Or(a, b):
            m, n = evaluate(a, row)
            if m == isinstance(node, Or):
                return m, n
            k, o = evaluate(b, row)
            return k, n + o
    v = row.get(node.path[0])
    empty = v is None or v == "" or v == []
    try:
        match node:
            case Empty(_, negate):
                return empty != negate, 0
            case Compare(_, op, lit):
                return compare(v, op, lit), 0
            case TextTest(_, op, text):
                if empty:
                    return False, 0
                if isinstance(v, list):
                    raise Miss
                return (text in text_of(v) if op == "contains" else text_of(v).startswith(text)), 0
            case In(_, literals, negate):
                missed = False
                for lit in literals:
                    try:
                        if compare(v, "=", lit):
                            return not negate, 0
                    except Miss:
                        missed = True
                if missed:
                    raise Miss
                return negate and not empty, 0
    except Miss:
        return False, 1


def test_random_expressions(spark):
    rng = random.Random(11)
    rows = [{f: rng.choice(VALUES[f]) for f in FIELDS} for _ in range(25)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], T.StructType([T.StructField(f, t) for f, t in FIELDS.items()])).coalesce(1).cache()
    texts = [expression(rng) for _ in range(120)]
    for at in range(0, len(texts), 12):
        bounds = [Predicate.parse(t).bind(df.schema) for t in texts[at : at + 12]]
        columns = [F.struct(b.match.alias("m"), F.coalesce(b.misses, F.lit(0)).alias("n") if b.misses is not None else F.lit(0).alias("n"), F.coalesce(b.keep, F.lit(False)).alias("k")).alias(f"c{i}") for i, b in enumerate(bounds)]
        for row, got in zip(rows, df.select(*columns).collect(), strict=True):
            for text, cell in zip(texts[at : at + 12], got, strict=True):
                want = evaluate(parse(text), row)
                assert (cell["m"], cell["n"]) == want, (text, row)
                assert cell["k"] == want[0], ("pushdown form", text, row)


def test_years_beyond_four_digits_compare_as_text(spark):
    df = spark.sql("select timestamp_micros(253402300800000000L + 86400000000L * 366 * k) as t, k from (select explode(array(-3000, -1, 1, 5)) as k)").select("k", F.col("t"), F.col("t").cast("timestamp_ntz").alias("n"))
    for c in ("t", "n"):
        for op, want in ((">=", [-1]), (">", [-1]), ("<", [-3000, 1, 5]), ("<=", [-3000, 1, 5])):
            bound = Predicate.parse(f"{c} {op} '9997-01-01'").bind(df.schema)
            assert sorted(r["k"] for r in df.filter(bound.keep).select('k').collect()) == want == sorted(r["k"] for r in df.filter(bound.match).select('k').collect()), (c, op)
            inverse = Predicate.parse(f"not {c} {op} '9997-01-01'").bind(df.schema)
            assert sorted(r["k"] for r in df.filter(inverse.keep).select('k').collect()) == sorted({-3000, -1, 1, 5} - set(want))
