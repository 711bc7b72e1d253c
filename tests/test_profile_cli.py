import json

import pytest

from rowforge import Options, Predicate, Rename, Stages, consume, profile
from rowforge.cli import main
from rowforge.operators.profile import SpaceSaving, percent_text, shown
from rowforge.streaming import stream_stages, write_json


@pytest.fixture(scope="module")
def people(tmp_path_factory):
    path = tmp_path_factory.mktemp("people") / "people.ndjson"
    with path.open("w") as f:
        for i in range(1000):
            row = {"id": i, "name": "" if i % 10 == 0 else f"user{i}", "country": ["US", "GR", "DE", "JP"][i % 4], "age": 10 + i % 70, "active": i % 3 == 0, "email": None if i % 7 == 0 else f"u{i}@x.org", "score": "n/a" if i % 50 == 0 else str(i % 100)}
            f.write(json.dumps(row) + "\n")
    return str(path)


def run(spark, capsys, *args):
    code = main(list(args), spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_convert_messages(spark, capsys, people, tmp_path):
    out = str(tmp_path / "o.json")
    for where, n in (("age >= 18", None), ("country = 'JP' or age < 15", None), ("name starts_with 'user9'", 100), ("email is not empty and email contains '@x.org'", 857), ("not missing_col = 1", 1000)):
        code, said, err = run(spark, capsys, "convert", "--in", people, "--out", out, "--where", where)
        assert code == 0, err
        if n is not None:
            assert said == f"wrote {out}: 1000 rows read, {n} documents dispatched\n"
    _, said, err = run(spark, capsys, "convert", "--in", people, "--out", out, "--where", "score > 50")
    assert said.endswith("490 documents dispatched\n") and "warning: 20 values could not be compared" in err
    _, _, err = run(spark, capsys, "convert", "--in", people, "--out", out, "--where", "nmae = 'x'")
    assert 'no record has the column "nmae"' in err


def test_errors(spark, capsys, people, tmp_path):
    out = str(tmp_path / "o.json")
    for args, part in (
        (["--where", ""], "--where has no predicate"), (["--where-strict"], "which is missing"), (["--where", "age >"], "syntax error at column 6"), (["--out-format", "xml"], "unknown format"),
        (["--where", "score > 50", "--where-strict"], "cannot be held against 50"),
    ):
        code, _, err = run(spark, capsys, "convert", "--in", people, "--out", out, *args)
        assert code == 1 and err.startswith("Error: ") and part in err, (args, err)


def test_stats(spark, capsys, people):
    _, said, _ = run(spark, capsys, "stats", "--in", people, "--where", "age >= 70", "--columns", "country", "--top", "4")
    assert said.split("\n\n")[1] == "ATTRIBUTE  NON-EMPTY  %       DISTINCT\ncountry    140        100.0%  4"
    assert said.endswith("top values of country:\n  DE  35  25.0%\n  GR  35  25.0%\n  JP  35  25.0%\n  US  35  25.0%\n")
    _, said, _ = run(spark, capsys, "stats", "--in", people, "--columns", "name,country", "--top", "2", "--output", "json")
    p = json.loads(said)
    assert [c["name"] for c in p["columns"]] == ["name", "country"] and p["columns"][0]["non_empty"] == 900 and p["columns"][0]["pct"] == 90
    _, _, err = run(spark, capsys, "stats", "--in", people, "--columns", "nope")
    assert 'no attribute is called "nope"' in err


def test_profile_details(spark, tmp_path):
    path = tmp_path / "a.ndjson"
    path.write_text('{"v":"a\\tb\\nc","m":{"x":1},"l":[1]}\n{"v":"   ","m":{},"l":[]}\n{"v":"","m":{"y":"q"}}\n{"v":null}\n{"v":"plain"}\n')
    p = profile(spark, str(path))
    got = {c.name: (c.non_empty, c.distinct) for c in p.columns}
    assert got["v"] == (3, 3) and got["m.x"] == (1, 1) and got["m.y"] == (1, 1) and got["l"] == (1, 1)
    assert next(c for c in p.columns if c.name == "l").top_values[0].value == "[list]"


def test_approximate_profile(spark, tmp_path):
    path = tmp_path / "a.ndjson"
    path.write_text("".join(json.dumps({"k": f"rare-{i}"}) + "\n" for i in range(3000)) + '{"k":"HOT"}\n' * 6000)
    p = profile(spark, str(path), Options(profile_max_distinct=100, profile_top=1))
    c = p.columns[0]
    assert not c.distinct_exact and c.distinct == 100 and c.non_empty == 9000 and c.top_values[0].value == "HOT"
    assert abs(c.top_values[0].count - 6000) <= c.top_values[0].max_error + 1
    exact = profile(spark, str(path), Options(profile_top=1)).columns[0]
    assert exact.distinct == 3001 and exact.top_values[0].count == 6000


def test_space_saving_bounds():
    s = SpaceSaving(3)
    for v in "aabbbcdea":
        s.add(v)
    assert len(s.counts) == 3 and sum(n for n, _ in s.counts.values()) == 9


def test_errors_of_estimates_hold_across_tables(spark):
    """A value that one partition counts exactly and another has lost may have been counted there as often as its least counter."""
    from rowforge.operators.profile import approximate_counts

    rows = [(0, "x")] * 3 + [(0, f"a{i}") for i in range(40)] * 5 + [(1, "x")] * 200 + [(1, "y")] * 4
    df = spark.createDataFrame(rows, "p int, k string").repartitionByRange(2, "p").select("k")
    assert df.rdd.getNumPartitions() == 2
    true = {}
    for _, k in rows:
        true[k] = true.get(k, 0) + 1
    got = {r["text"]: (r["n"], r["max_error"]) for r in approximate_counts(df, 10).collect()}
    assert got["x"][1] > 0 and all(abs(n - true[k]) <= e for k, (n, e) in got.items())


def test_consume(spark, people):
    n = consume(spark, people, lambda batches: sum(b.num_rows for b in batches), lambda a, b: a + b, Options(where="age >= 70"))
    assert n == 140


def test_shown():
    assert shown("a\tb", 60) == '"a\\tb"' and shown("   ", 60) == '"   "' and shown("abcdef", 4) == "abc…" and percent_text(0.01) == "<0.1%"


def test_streams_take_the_same_stages(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    folder = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    out = stream_stages(stream, Stages([Predicate.parse("event_type = 'error'")], rules=[Rename("user_id", "who")])).select("event_id", "who")
    q = write_json(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.text(str(tmp_path / "out")).count() == spark.read.parquet(str(folder)).where("event_type = 'error'").count()
