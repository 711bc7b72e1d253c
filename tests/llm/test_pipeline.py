"""The pipeline against a plain version of its stages."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from rowforge.llm import bpe, quality_rules, secrets  # noqa: E402
from rowforge.llm.queries import ORACLES, QUERIES  # noqa: E402

from .conftest import EXTRA, ODD  # noqa: E402


def test_every_operator_is_registered():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
        assert name == "bpe" or docs.columns == columns
    texts = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")["text"]
    rules = quality_rules.Rules(quality_rules.Bands())
    kept = {i for i, t in texts.items() if rules.score([t])["kept"][0]}
    assert set(seen["quality_rules"]["doc_id"]) == kept
    sets, groups = {}, []
    for i in sorted(kept):
        w = texts[i].encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        near = [g for g in groups if any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [i]]
    assert set(seen["near_duplicates"]["doc_id"]) == {min(g) for g in groups}
    clean = {r.doc_id: r.text for r in seen["secret_scans"].itertuples()}
    assert clean == {min(g): secrets.redacted(texts[min(g)], secrets.scan(texts[min(g)])[1]) for g in groups}
    mixed = seen["mixing"]["doc_id"].value_counts()
    assert set(mixed.index) <= set(clean) and mixed.max() <= 3 and (seen["mixing"].set_index("doc_id")["text"] == seen["mixing"]["doc_id"].map(clean).values).all()
    a = bpe.compiled(bpe.default_path())
    assert sorted(seen["bpe"]["n_tokens"]) == sorted(a.encode(t).count(",") + 1 for t in seen["mixing"]["text"])


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_run_on_odd_rows_and_columns_of_any_name(spark, sf, make, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties and clashing columns; the results are those that the docstring names."""
    plain = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = [tuple(r) for r in plain.select("doc_id", "text", "source").collect()]
    rows = [(10_000 + i, t, s) for i, t, s in rows] + [rows[0], rows[0], (None, rows[1][1], None), (None, rows[2][1] + " tail", "s")] + ODD
    docs = make(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(corpus_pipeline.quality(spark, docs, "").toPandas()["doc_id"].dropna().astype(int))
    assert len(out) and set(out["doc_id"].dropna().astype(int)) <= kept and {2, 3, 4, 9}.isdisjoint(kept)
    assert out["doc_id"].value_counts().max() <= 3 and (out["n_tokens"] > 0).all()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5:] == list(EXTRA), name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.where(" or ".join(f"`{c}` != 'x'" for c in EXTRA)).isEmpty(), name


def test_run_on_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.isEmpty()
