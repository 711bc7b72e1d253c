import pytest
from pyspark.sql import types as T

from rowforge.llm.common import WORD  # noqa: F401

#: Further columns whose names clash with what the operators return or use.
EXTRA = (
    "score", "size", "place", "cls", "kept", "media", "ids", "spans", "n", "hash", "node", "shard", "taken", "at", "whole", "place_below", "block", "blocks", "other", "root", "low", "high",
    "copies", "values", "bands", "id", "group", "links", "least_id", "file", "row", "more", "words", "seed", "key", "chain", "side", "begin", "codes", "asks", "share", "bucket", "left",
    "upto", "label", "predicted", "held_out", "times", "source_size", "target", "match", "law", "slot", "rank", "order", "clip", "error", "feature", "remainder", "ratio", "level", "number",
)
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in EXTRA),
])


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """Writes (doc_id, text, source) rows as a documents table and reads it again."""

    def write(rows, parts=3):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        full = [(i, t, "en", s, None if t is None else len(t), *(["x"] * len(EXTRA))) for i, t, s in rows]
        spark.createDataFrame(full, SCHEMA).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return write


def long_text(words=30_000):
    return " ".join(f"w{i * 7919 % 100003}" for i in range(words))


#: Nulls, empty and white texts, copies, ties, a very long text.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi", "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"),
    (None, "a text without an id " * 8, "b"), (5, "same text here for a copy " * 6, "c"), (6, "same text here for a copy " * 6, "c"), (6, "same text here for a copy " * 6, "c"),
    (7, long_text(), None), (8, "日本語 текст 🙂 émile naïve\x0bword\x0cend <|endoftext|> it's 12,345", "é"), (9, "x", ""),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
