import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def frame(spark):
    """A small table of documents from (doc_id, text) or longer rows."""

    def make(rows, extra=()):
        full = [tuple(r) + (None,) * (5 - len(r)) if len(r) < 5 else tuple(r) for r in rows]
        schema = T.StructType(DOCUMENTS.fields + [T.StructField(n, T.StringType()) for n in extra])
        return spark.createDataFrame([r[:5] + ("clash",) * len(extra) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def given(spark):
    """A table of the smallest scale as Python rows."""

    def read(name):
        return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").collect()

    return read


ODD_TEXTS = [
    (5, None), (3, ""), (4, " \n\t "), (1, "one"), (2, "Café café İΣ 你好 \U0001f600 it's 42!"),
    (7, "x" * 20000), (8, "a b c " * 3000), (9, "same text here"), (10, "same text here"), (10, "same text here"),
    (None, "no id"), (11, "<|endoftext|> and <|ENDOFTEXT|> a\x1cb c"), (12, "tabs\tand\x0bmore\r\n\nlines   end."),
]
