import pytest

from rowforge.operators.transform import Drop, InvalidTransform, Rename, apply, compiled


@pytest.mark.parametrize(
    ("rules", "part"),
    [
        ([Drop("")], "path is empty"), ([Drop("a..b")], "empty segment"), ([Rename("a", "b.c")], "depth"), ([Rename("a.x", "b.y")], "parent"), ([Drop("a"), Drop("a")], "more than one rule"),
        ([Drop("a"), Drop("a.b")], "rule below"), ([Drop("a.b"), Drop("a")], "rule below"),
    ],
)
def test_bad_rules(rules, part):
    with pytest.raises(InvalidTransform, match=part):
        compiled(rules)


def test_rules(spark):
    df = spark.createDataFrame([(1, 2, ("x", 3), {"k": "v", "z": "w"})], "a long, b long, s struct<p:string,q:long>, m map<string,string>")
    out = apply(df, [Rename("a", "A"), Drop("b"), Rename("s.p", "s.P"), Drop("s.q"), Rename("m.k", "m.K"), Drop("m.z"), Drop("nope.x"), Rename("gone", "there")])
    assert out.columns == ["A", "s", "m"]
    r = out.first()
    assert r["A"] == 1 and r["s"].asDict() == {"P": "x"} and r["m"] == {"K": "v"}


def test_a_rename_onto_an_entry_fails(spark):
    df = spark.createDataFrame([({"k": "v", "z": "w"},)], "m map<string,string>")
    with pytest.raises(Exception, match='the entry "z" exists'):
        apply(df, [Rename("m.k", "m.z")]).collect()
