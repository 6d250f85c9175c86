import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("N_HIT", T.StringType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names clash with results."""

    def make(pairs, lang="en"):
        return spark.createDataFrame([(i, t, lang, "x", None) for i, t in pairs], DOC)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty, blank, wordless, repeated and very long texts."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the cellar tonight"
    return [(1, base), (2, base), (2, base), (3, None), (None, base + " again"), (4, ""), (5, "   \n\n "), (6, "### !!!"), (7, "one"), (8, "word " * 60_000), (9, "é" * 100 + "\n" + "日本語 text")]
