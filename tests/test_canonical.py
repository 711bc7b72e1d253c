import datetime
import random
import struct

from pyspark.sql import functions as F, types as T

from rowforge.functions import text as X
from rowforge.functions.canonical import UNIT, canonical_text, float_text
from rowforge.sources.jsonvalues import float_text as plain_float_text


def test_floats_against_python(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, -1.5, 1e-6, 9.99e-7, 1e7, 123456789.125, 1e20, 1.5e300, 1e-300, 0.1, 100.0, 12345678.0, 1e-3, 9.5e-4]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 18) for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(float_text(F.col("x"))).collect()
    for v, (got,) in zip(values, rows, strict=True):
        assert float(got) == v
        if abs(v) < 1e15:  # beyond, the JVM's own digits may be one longer than the shortest
            assert got == plain_float_text(v, negative_zero=False), v


def test_float_forms(spark):
    for x, want in ((1e7, "10000000"), (1.0, "1"), (-0.0, "0"), (1e21, "1e+21"), (1.25e-7, "1.25e-7"), (0.000001, "0.000001"), (float("nan"), "NaN"), (float("inf"), "+Inf")):
        df = spark.createDataFrame([(x,)], "x double")
        assert df.select(float_text(F.col("x"))).first()[0] == want
    x = struct.unpack("f", struct.pack("f", 0.1))[0]
    assert spark.createDataFrame([(x,)], "x float").select(float_text(F.col("x"))).first()[0] == "0.1"


def test_times_and_units(spark):
    t = datetime.datetime(2024, 1, 2, 3, 4, 5, 678900)
    df = spark.createDataFrame([(t, t.date(), 1_704_164_645_678_900_123)], T.StructType([T.StructField("t", T.TimestampNTZType()), T.StructField("d", T.DateType()), T.StructField("n", T.LongType())]))
    r = df.select(
        canonical_text(F.col("t"), T.TimestampNTZType()).alias("us"), canonical_text(F.col("t"), T.TimestampNTZType(), {UNIT: "ms"}).alias("ms"),
        canonical_text(F.col("d"), T.DateType()).alias("d"), canonical_text(F.col("n"), T.LongType(), {UNIT: "ns"}).alias("ns"),
    ).first()
    assert tuple(r) == ("2024-01-02T03:04:05.678900Z", "2024-01-02T03:04:05.678Z", "2024-01-02", "2024-01-02T03:04:05.678900123Z")


def test_json_line(spark):
    df = spark.createDataFrame([(1, 'a<b>&"\n', None, 1e7, True, [1, None], ("x", {"k": "v"}))], "i long, s string, n string, f double, b boolean, l array<long>, o struct<p:string,m:map<string,string>>")
    assert X.json_lines(df).first()[0] == r'{"i":1,"s":"a\u003cb\u003e\u0026\"\n","n":null,"f":10000000,"b":true,"l":[1,null],"o":{"p":"x","m":{"k":"v"}}}'


def test_csv_quoting(spark):
    fields = {"": "", "plain": "plain", "a,b": '"a,b"', 'q"q': '"q""q"', "a\nb": '"a\nb"', "a\rb": '"a\rb"', " lead": '" lead"', "\tlead": '"\tlead"', "\\.": '"\\."', "trail ": "trail ", " nb": '" nb"'}
    df = spark.createDataFrame([(v,) for v in fields], "s string").coalesce(1)
    assert [r[0] for r in X.csv_lines(df).collect()] == list(fields.values())
