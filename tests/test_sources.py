"""Detection, codecs, and files in and out."""

import bz2
import gzip
import io
import json
import lzma
import random

import pyarrow as pa
import pytest
import zstandard

from rowforge import Drop, Options, Rename, process
from rowforge import profile as profile_file
from rowforge.sources import codecs
from rowforge.sources.detect import UnknownFormat, by_extension, detect, sniff
from rowforge.sources.readers import BadInput, RowErrors, parse_fields, read
from rowforge.sources.writers import RaggedOutput


@pytest.mark.parametrize(
    ("head", "hint", "want"),
    [
        ("PAR1\0\1", None, "parquet"), ("PAR1\0\1", "csv", "parquet"), ("ARROW1\0\0", None, "arrow"), ('{"a":1}\n', None, "json"), ('﻿\n  {"a":1,"b":2}\n', None, "json"),
        ('{"a":1,"b":2}\n', "csv", "json"), ("id,name\n1,ann\n2,bob\n", None, "csv"), ("id\tname\n1\tann\n", None, "tsv"), ("id,name\n1,ann\n", "tsv", "csv"),
        ("id\ttext\n1\ta, b, c\n2\td, e\n", None, "tsv"), ('id\ttext\n1\t"a,b"\n', None, "tsv"), ("id\n1\n", "csv", "csv"), ("", "parquet", "parquet"), ("", None, "json"), (" \n\n", None, "json"),
        ("not json\n", "json", "json"), ("a,b\tc\nd,e\tf\n", "tsv", "tsv"), ("a,b\tc\nd,e\tf\n", None, "csv"),
    ],
)
def test_formats(head, hint, want):
    assert sniff(head.encode(), hint, whole=True) == want


def test_unknown_formats():
    for head in (b"PARE", b"\0\1", b"prose without any delimiter\n"):
        with pytest.raises(UnknownFormat):
            sniff(head, None, whole=True)


def test_names():
    assert by_extension("x.CSV.gz") == "csv" and by_extension("a.ndjson") == "json" and by_extension("a.txt") is None
    assert codecs.detect(b"plain", "a.gz") == "none" and codecs.detect(b"plain", "a.br") == "brotli"
    assert codecs.sniff(b"BZh91AY&SY\0") == "bzip2" and codecs.sniff(b"BZh, the header\n") == "none" and codecs.sniff(b"BZh01AY&SY") == "none"


DATA = b"".join(b'{"i":%d,"s":"%s"}\n' % (i, bytes([97 + i % 26]) * (i % 50)) for i in range(3000))


@pytest.mark.parametrize("codec", ["gzip", "zstd", "xz", "lz4", "snappy", "brotli"])
def test_codecs_round_trip(codec):
    chunks = [DATA[i : i + 7001] for i in range(0, len(DATA), 7001)]
    packed = b"".join(codecs.compress(chunks, codec))
    assert codec == "brotli" or codecs.sniff(packed) == codec
    assert b"".join(codecs.decompress(iter([packed[:100], packed[100:]]), codec)) == DATA
    with pytest.raises(codecs.DecompressedTooLarge):
        list(codecs.decompress(iter([packed]), codec, 1000))


def test_members_and_bad_bytes():
    assert b"".join(codecs.decompress(iter([gzip.compress(b"a") + gzip.compress(b"b")]), "gzip")) == b"ab"
    assert b"".join(codecs.decompress(iter([bz2.compress(b"a") + bz2.compress(b"b")]), "bzip2")) == b"ab"
    assert b"".join(codecs.decompress(iter([lzma.compress(b"a")]), "xz")) == b"a"
    assert b"".join(codecs.decompress(iter([zstandard.compress(b"a")]), "zstd")) == b"a"
    for codec in ("gzip", "zstd", "xz", "lz4", "snappy"):
        with pytest.raises(codecs.BadCompression):
            list(codecs.decompress(iter([b"this is not compressed data at all"]), codec))
    with pytest.raises(codecs.BadCompression, match="bzip2 output is not supported"):
        list(codecs.compress([b""], "bzip2"))


def test_csv_parser_against_the_standard_one():
    import csv

    rng = random.Random(5)
    for _ in range(300):
        rows = [["".join(rng.choice('ab,"\n \t') for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(2, 4))] for _ in range(rng.randint(1, 4))]
        out = io.StringIO()
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
        assert parse_fields(out.getvalue(), ",") == rows
    for bad in ('a"b,c\n', '"a"b,c\n', '"abc\n'):
        with pytest.raises(ValueError):
            parse_fields(bad, ",")


def lines(path):
    return path.read_text().splitlines()


def test_every_pair_of_formats(spark, tmp_path):
    rows = [{"id": str(i), "name": f"n{i}"} for i in range(30)]
    first = tmp_path / "in.ndjson"
    first.write_text("".join(json.dumps(r) + "\n" for r in rows))
    formats = ("json", "parquet", "csv", "tsv", "arrow")
    for a in formats:
        one = str(tmp_path / f"one.{a}")
        process(spark, str(first), one, Options(output_format=a, csv_has_header=True))
        assert detect(spark, one) == (a, "none")
        for b in formats[:: 1 if a == "json" else 2]:
            two, back = str(tmp_path / f"two.{a}.{b}"), tmp_path / f"back.{a}.{b}.ndjson"
            process(spark, one, two, Options(output_format=b, csv_has_header=True))
            process(spark, two, str(back), Options(csv_has_header=True))
            assert [json.loads(x) for x in lines(back)] == rows, (a, b)


def test_types_survive(spark, tmp_path):
    a = tmp_path / "a.ndjson"
    a.write_text('{"i":1,"f":1e-9,"g":2.5,"s":"<&>","b":true,"n":null}\n{"i":9007199254740993,"f":1e22,"g":-0.5,"s":"","b":false,"n":null}\n')
    for fmt in ("parquet", "arrow"):
        process(spark, str(a), str(tmp_path / f"b.{fmt}"), Options(output_format=fmt))
        process(spark, str(tmp_path / f"b.{fmt}"), str(tmp_path / f"c.{fmt}.json"))
        got = [json.loads(x) for x in lines(tmp_path / f"c.{fmt}.json")]
        assert got == [json.loads(x) for x in lines(a)]
    assert "\\u003c\\u0026\\u003e" in (tmp_path / "c.arrow.json").read_text()


def test_ragged_records(spark, tmp_path):
    a = tmp_path / "a.ndjson"
    a.write_text('{"a":1,"b":"x"}\n{"b":"y","c":{"k":[1,"z"],"a":2.5}}\n\n{"a":"text","d":null}\r\n')
    out = tmp_path / "out.json"
    process(spark, str(a), str(out), Options(where="not b = 'nope'"))
    assert lines(out) == ['{"a":1,"b":"x"}', '{"b":"y","c":{"k":[1,"z"],"a":2.5}}', '{"a":"text","d":null}']
    process(spark, str(a), str(out), Options(rules=[Rename("b", "B"), Drop("c.k"), Rename("c.a", "c.A")]))
    assert lines(out) == ['{"a":1,"B":"x"}', '{"B":"y","c":{"A":2.5}}', '{"a":"text","d":null}']
    for fmt in ("parquet", "arrow", "csv"):
        with pytest.raises(RaggedOutput):
            process(spark, str(a), str(tmp_path / f"x.{fmt}"), Options(output_format=fmt))
    stats = process(spark, str(a), str(out), Options(where="a > 0"))
    assert (stats.rows_read, stats.rows_filtered, stats.predicate_misses) == (3, 2, 1)


def test_row_errors(spark, tmp_path):
    a = tmp_path / "a.ndjson"
    a.write_text('{"a":1}\n{"a":}\n{"a":3}\n{"a":1,"a":2}\n{"a":4}{"b":1}\n[1]\n')
    skipped = []
    stats = process(spark, str(a), str(tmp_path / "o.parquet"), Options(output_format="parquet", max_row_errors=4, on_skip=skipped.append))
    assert (stats.rows_read, stats.rows_skipped, len(skipped)) == (2, 4, 4)
    with pytest.raises(RowErrors) as e:
        process(spark, str(a), str(tmp_path / "p.parquet"), Options(output_format="parquet", max_row_errors=3))
    assert len(e.value.errors) == 4 and not (tmp_path / "p.parquet").exists()
    c = tmp_path / "a.csv"
    c.write_text("a,b,c\n1,2\n4,5,6\n")
    stats = process(spark, str(c), str(tmp_path / "o.json"), Options(csv_has_header=True, max_row_errors=1))
    assert (stats.rows_read, stats.rows_skipped) == (1, 1) and lines(tmp_path / "o.json") == ['{"a":"4","b":"5","c":"6"}']
    c.write_text('a,b\n1,x"y\n')
    with pytest.raises(BadInput, match="bare"):
        process(spark, str(c), str(tmp_path / "o.json"), Options(csv_has_header=True, max_row_errors=9))


def test_csv_shapes(spark, tmp_path):
    c = tmp_path / "a.csv"
    c.write_bytes('﻿a,a\r\n"x\r\ny",""\r\n\r\n"q""q",z\r\n'.encode())
    r = read(spark, str(c), "csv", header=True)
    assert [tuple(x) for x in r.df.collect()] == [("x\ny", ""), ('q"q', "z")] and r.df.columns[0] == "a"
    assert read(spark, str(c), "csv").df.columns == ["col0", "col1"]
    c.write_text("")
    with pytest.raises(BadInput, match="EOF"):
        read(spark, str(c), "csv", header=True)
    assert read(spark, str(c), "csv").df.count() == 0
    c.write_text("a;b\n1;,2\n")
    assert read(spark, str(c), "csv", delimiter=";", header=True).df.collect()[0]["b"] == ",2"


def test_headers_of_folders(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(30)))
    for fmt in ("csv", "tsv"):
        out = tmp_path / f"out.{fmt}"
        o = Options(csv_has_header=True, single_file=False, where="id > 0", output_format=fmt)
        stats = process(spark, str(a), str(out), o)
        assert stats.rows_filtered == 1
        parts = [p.read_text().splitlines() for p in out.glob("part-*")]
        assert all(p[0] == "id,name".replace(",", "," if fmt == "csv" else "\t") for p in parts if p)
        back = read(spark, str(out), fmt, header=True)
        assert sorted(int(r["id"]) for r in back.df.collect()) == list(range(1, 30)) and back.df.columns == ["id", "name"]
    two = tmp_path / "two"
    two.mkdir()
    (two / "a.csv").write_text("id,name\n1,x\nid,name\n")  # a data line like the header stays
    (two / "b.csv").write_bytes(b"\xef\xbb\xbf\r\nid,name\r\n2,y\r\n")
    assert sorted(map(tuple, read(spark, str(two), "csv", header=True).df.collect())) == [("1", "x"), ("2", "y"), ("id", "name")]
    (two / "a.csv").write_text('id,name\n1,"x\ny"\n')
    assert sorted(map(tuple, read(spark, str(two), "csv", header=True).df.collect())) == [("1", "x\ny"), ("2", "y")]
    out: list[bytes] = []
    from rowforge import deliver

    deliver(spark, str(two), out.append, Options(input_format="csv", output_format="csv", csv_has_header=True))
    assert sum(d.count(b"id,name\n") for d in out) >= 1 and b"".join(out).replace(b"id,name\n", b"") in (b'1,"x\ny"\n2,y\n', b'2,y\n1,"x\ny"\n')
    (two / "b.csv").write_text("id,other\n2,y\n")
    with pytest.raises(BadInput, match="header"):
        read(spark, str(two), "csv", header=True).df.collect()


@pytest.mark.parametrize("size", ["40", "97", "1000"])
def test_records_across_splits(spark, tmp_path, size):
    import csv
    import random

    rng = random.Random(int(size))
    rows = [["a", "b", "c"]] + [[str(i), "".join(rng.choice(['x', '"', "\n", ",", "long word ", "\n\n"]) for _ in range(rng.randint(0, 30))), rng.choice(["", "z"])] for i in range(60)]
    path = tmp_path / "m.csv"
    with path.open("w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = read(spark, str(path), "csv", header=True).df
        assert found.rdd.getNumPartitions() > 1
        assert [list(r) for r in found.collect()] == rows[1:] and found.columns == rows[0]
        path.write_text(path.read_text() + '9,"open')
        with pytest.raises(Exception, match="quoted field"):
            read(spark, str(path), "csv", header=True).df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_with_quotes_as_the_parser_reads_them(spark, tmp_path):
    import random

    from rowforge.sources.readers import parse_fields

    rng = random.Random(6)
    path = tmp_path / "q.csv"
    for delimiter in (",", "|", "\t", "-"):
        lines_of = []
        while len(lines_of) < 200:
            line = delimiter.join('"' + "".join(rng.choice(["a", '""', delimiter, " ", "é"]) for _ in range(rng.randint(0, 4))) + '"' if rng.random() < 0.5 else rng.choice(["", "b", " c", "0.5"]) for _ in range(3))
            if line:
                lines_of.append(line)
        path.write_text("\n".join(lines_of) + "\n")
        assert [list(r) for r in read(spark, str(path), "csv", delimiter=delimiter).df.collect()] == [parse_fields(x, delimiter)[0] for x in lines_of]


def test_flat_lines_told_by_a_pattern(spark, tmp_path):
    from rowforge.sources.readers import _uniform

    def kinds(*rows):
        return _uniform(spark.createDataFrame([(r,) for r in rows], "value string"))

    assert kinds('{"a":1,"b":"x\\n\\u00e9","c":null,"d":1.5,"e":true}', ' { "a" : -20 , "b":null,"c":null,"d":2e3,"e":false}\r', "") == {"a": "int", "b": "str", "c": None, "d": "float", "e": "bool"}
    for other in ('{"a":1,"a":2}', '{"b":1}', '{"a":1.0}', '{"a":01}', '{"a":"1"}', '{"a":1} x', '{"a":1,}', '{"a":12345678901234567890}', '{"a":[1]}', '{"a":1', "nonsense"):
        assert kinds('{"a":1}', other) is None and kinds(*['{"a":1}'] * 150, other) is None, other
    for text in ('{"a":"\x01"}', '{"a":"\\ud800"}', '{"a":"\\x"}', '{"a":"b"c"}'):
        assert kinds(*['{"a":"ok"}'] * 150, text) is None, text


def test_settings_are_as_before(spark, tmp_path):
    a = tmp_path / "a.ndjson"
    a.write_text('{"a":1}\n')
    for key in ("spark.sql.caseSensitive", "spark.sql.legacy.parquet.nanosAsLong"):
        spark.conf.unset(key)
    before = {k: spark.conf.get(k) for k in ("spark.sql.caseSensitive", "spark.sql.legacy.parquet.nanosAsLong")}
    process(spark, str(a), str(tmp_path / "o.parquet"), Options(output_format="parquet"))
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"t": pa.array([1], pa.timestamp("ns"))}), tmp_path / "n.parquet")
    assert read(spark, str(tmp_path / "n.parquet"), "parquet").df.collect()[0]["t"] == 1
    assert {k: spark.conf.get(k) for k in before} == before


def test_a_store_that_only_spark_reads(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./d", f"file://{tmp_path}")
    base = "viewfs://t/d"
    for fmt in ("arrow", "parquet", "csv", "json"):
        df = spark.range(50).selectExpr("id", "concat('n', id) AS name").repartition(3)
        from rowforge.sources import readers, writers

        writers.write(readers.Records(df, "parquet"), f"{base}/many.{fmt}", fmt, single=False, header=True)
        process(spark, f"{base}/many.{fmt}", f"{base}/one.{fmt}", Options(input_format=fmt, output_format=fmt, csv_has_header=True))
        back = read(spark, f"{base}/one.{fmt}", fmt, header=True).df
        assert sorted(int(r["id"]) for r in back.collect()) == list(range(50)), fmt


def test_compressed_files(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_bytes(gzip.compress(b"id,name\n1,ann\n2,bob\n"))  # named like plain CSV, gzip inside
    out = tmp_path / "b.ndjson.zst"
    stats = process(spark, str(a), str(out), Options(csv_has_header=True))
    assert stats.rows_read == 2
    assert zstandard.ZstdDecompressor().stream_reader(out.open("rb")).read() == b'{"id":"1","name":"ann"}\n{"id":"2","name":"bob"}\n'
    p = profile_file(spark, str(out), Options(where="id > 1"))
    assert p.records == 1 and [c.name for c in p.columns] == ["id", "name"]
    with pytest.raises(codecs.BadCompression):
        process(spark, str(a), str(tmp_path / "c.json"), Options(input_compression="zstd"))


def test_raw_lines_stay_as_they_are(spark, tmp_path):
    a, b = tmp_path / "a.ndjson", tmp_path / "b.ndjson"
    a.write_text('{"a" : 1.0}\n\n{"a":1,"a":2}\n')
    stats = process(spark, str(a), str(b))
    assert lines(b) == ['{"a" : 1.0}', '{"a":1,"a":2}'] and stats.documents_dispatched == 2


def test_arrow_types(spark, tmp_path):
    import datetime

    table = pa.table({
        "u": pa.array([1 << 63], pa.uint64()), "s": pa.array([5], pa.timestamp("s")), "ns": pa.array([1_704_164_645_678_900_123], pa.timestamp("ns")),
        "l": pa.array([[{"k": "x", "v": 1}]], pa.list_(pa.struct([("k", pa.string()), ("v", pa.int64())]))),
    })
    path = str(tmp_path / "a.arrow")
    with pa.ipc.new_file(path, table.schema) as f:
        for _ in range(3):
            f.write_table(table)
    r = read(spark, path, "arrow").df
    assert r.count() == 3 and r.first()["s"] == datetime.datetime(1970, 1, 1, 0, 0, 5) and int(r.first()["u"]) == 1 << 63
    process(spark, path, str(tmp_path / "o.json"), Options(where="ns >= '2024-01-02T03:04:05.678900123Z' and u > 9223372036854775807"))
    assert json.loads(lines(tmp_path / "o.json")[0]) == {"u": 1 << 63, "s": "1970-01-01T00:00:05.000Z", "ns": "2024-01-02T03:04:05.678900123Z", "l": [{"k": "x", "v": 1}]}


def test_documents(spark, tmp_path):
    import pyarrow.parquet as pq

    from rowforge import deliver

    source = b"".join(b'{"i":%d,"s":"x,%d"}\n' % (i, i) for i in range(25))

    def documents(data, **options):
        out = []
        stats = deliver(spark, data, out.append, Options(**options))
        assert stats.documents_dispatched == len(out)
        return out, stats

    out, stats = documents(source)
    assert out == source.splitlines() and stats.rows_read == 25
    out, stats = documents(source, where="i >= 20 or s > 3")
    assert (stats.rows_read, stats.rows_filtered, stats.predicate_misses) == (25, 20, 20)
    assert [json.loads(d)["i"] for d in out] == list(range(20, 25))
    out, stats = documents(source, output_format="csv", batch_size=10, csv_has_header=True)
    assert [len(d.splitlines()) for d in out] == [11, 10, 5] and out[0].startswith(b'i,s\n0,"x,0"\n') and stats.rows_read == 25
    for fmt in ("parquet", "arrow"):
        out, _ = documents(io.BytesIO(source), output_format=fmt, batch_size=10)
        tables = [pq.read_table(io.BytesIO(d)) if fmt == "parquet" else pa.ipc.open_file(d).read_all() for d in out]
        assert [t.num_rows for t in tables] == [10, 10, 5] and tables[2].column("i").to_pylist() == [20, 21, 22, 23, 24]
    path = str(tmp_path / "g.parquet")
    pq.write_table(pa.table({"z": list(range(9)), "a": list("abcdefghi")}), path, row_group_size=4)
    out, _ = documents(path, output_format="parquet")
    assert sorted(pq.read_table(io.BytesIO(d)).num_rows for d in out) == [1, 4, 4]
    out, _ = documents(b"a,b\r\n1,2\r\n3,4\r\n", output_format="csv", csv_has_header=True)
    assert out == [b"1,2\n", b"3,4\n"]


def test_flat_records_are_told_from_others():
    from rowforge.sources.jsonvalues import flat_kinds

    assert flat_kinds('{"a": 1, "b":"x", "c":null}') == (("a", "b", "c"), (int, str, type(None)))
    for text in ('{"a" : 1,"a":2}', '{"a":1,"a":1}', '{"a":[1]}', '{"a":{}}', '{"a":1} x', '[1]', '{"a":}', '{"a":"q\\"q"}'):
        assert flat_kinds(text) is None, text
