import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use themselves; a table may have them too.
CLASHING = ("score", "kept", "fp", "h", "k", "label", "spans", "ids", "component_id", "shard", "_bucket", "_words", "_t", "toxic", "start")


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.fixture(scope="session")
def make_docs(spark):
    """Builds a documents table from texts, or (doc_id, text) pairs, with extra columns of clashing names."""
    def make(texts, lang="en"):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], DOCS)
        return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    return make


@pytest.fixture(scope="session")
def edge_texts():
    long = "\n".join(f"word{i} and{i % 7} more{i % 31}." for i in range(40_000))
    return [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "One two three four five.", long, "same text here twice over",
            "same text here twice over", "ünï çödé ß 中文字 \U0001f600 é", "\x00\x1c\x85 ", "x" * 3000,
            'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', (None, "a document without an id"), (None, None), (9, "same text here twice over"),
            (12, "x" * 3000)]
