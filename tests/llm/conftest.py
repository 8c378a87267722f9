import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text, lang, source) rows, shorter rows filled with nulls."""

    def make(*rows):
        full = [(*r, *[None] * (4 - len(r)), None if len(r) < 2 or r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(3)

    return make


@pytest.fixture
def awkward(documents):
    """Nulls, empty and long texts, ties and repeated rows; extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    df = documents(
        (1, "The cat sat on the mat and looked at the big dog", "en", "a"), (2, "the CAT sat on the mat and looked at the big dog", "en", "a"), (2, "the CAT sat on the mat and looked at the big dog", "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (None, "an orphan text without any id at all", "en", None), (5, "é" * 50_000, "fr", "b"), (6, "word " * 30_000, "en", "a"), (7, "\t\n \x0b", None, "a"), (8, "İstanbul ẞ Ünïcode", "de", "c"), (9, "x", None, "c"),
    )
    for name in ("id", "sha", "rid", "salt", "size", "maybe", "score", "_id", "range", "key", "n", "rep", "a", "b", "bucket", "label", "target", "piece"):
        df = df.withColumn(name, F.lit("clash"))
    return df
